import re

import duckdb
import pytest

from brindle.plans import catalog
from brindle.sources import providers, services

SF = "/root/testdata/sf0.001"


def test_catalogues():
    assert len(services.SERVICES) == 121 and len(providers.PROVIDERS) == 63
    for _, _, _, patterns, public in services.SERVICES:
        assert patterns and all(re.compile(p) for p in patterns + public)
    known = {p[0] for p in providers.PROVIDERS}
    assert len(providers.BY_SIGNATURE) == 63 and set(providers.BY_SIGNATURE.values()) == known
    assert len(providers.BY_SERVICE) == 18 and set(providers.BY_SERVICE.values()) <= known and set(providers.BY_SERVICE) <= {s[0] for s in services.SERVICES}


def test_service_values(spark):
    rows = [
        ("datadogApiKey", "A" * 32, "x.py", [("datadog", "secret", False)]),
        ("LOB_KEY", "test_pub_" + "a1" * 15 + "b", "x.py", [("lob", "public", False)]),
        ("key", "f" * 40, "deploy/Buildkite/env", [("buildkite", "secret", True)]),
        ("etherscan_key", "A" * 34, "x", []),  # upper-case patterns never meet a lower-cased value
        ("datadog_key", "short", "x", []),
        ("datadog_key", None, None, []),
        (None, "A" * 32, "x", []),
    ]
    df = spark.createDataFrame([(i, *r[:3]) for i, r in enumerate(rows)], "id int, name string, value string, path string")
    got = services.service_values(spark, df, "path").collect()
    for i, (*_, wanted) in enumerate(rows):
        assert [(g.keyword, g.exposure, g.by_path) for g in got if g.id == i] == wanted
    assert services.service_values(spark, df.limit(0)).count() == 0


def test_validation(spark):
    rows = [("NPM access token", None, "a"), ("NPM access token", None, "a"), ("Stripe secret key", None, "b"), (None, "heroku", "c"), ("GitHub token", None, "d"), (None, "lob", "e")]
    df = providers.with_provider(spark, spark.createDataFrame(rows, "detail string, service string, secret string"), "detail", "service")
    assert {tuple(r) for r in providers.requests(df).collect()} == {("Npm", "a"), ("Stripe", "b"), ("Heroku", "c"), ("GitHub", "d")} and providers.requests(df).count() == 4
    answers = spark.createDataFrame([("Npm", "a", 200), ("Stripe", "b", 403), ("Heroku", "c", 401), ("GitHub", "d", 500)], "provider string, secret string, code int")
    got = sorted((r.secret, r.validation) for r in providers.with_status(spark, df, answers).collect())
    assert got == [("a", "live"), ("a", "live"), ("b", "live"), ("c", "inactive"), ("d", "unknown"), ("e", None)]


@pytest.mark.parametrize("name", ["service_mentions", "document_services", "mention_providers"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = catalog.queries()[name](spark, SF)
    wanted = con.execute(catalog.oracle_sql()[name]).to_arrow_table().select(got.columns).to_pylist()
    assert sorted(map(str, (r.asDict() for r in got.collect()))) == sorted(map(str, wanted))
