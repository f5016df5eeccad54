"""Connected components of a link table by alternating large and small stars.

Each round is two aggregations by node joined back to the links, so a hub of any degree is
combined before the shuffle; a round's links are written to shared storage, which cuts the
lineage. The number of rounds grows with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm import shared


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One star step over links (u, v) with u > v."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else links
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    told = both.join(least, "u")
    if large:
        made = told.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        made = told.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return made.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(links: DataFrame, at: str) -> DataFrame:
    """(u, v): each linked node but a component's least, and that least node. ``links``: columns u and v, of an ordered type."""
    now = links.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, before, step = shared.written(now, f"{at}/links-0"), None, 0
    while True:
        step += 1
        now = shared.written(_star(_star(now, True), False), f"{at}/links-{step}")
        print_of = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if print_of == before:
            return now
        before = print_of
