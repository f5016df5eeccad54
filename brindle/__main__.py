"""``python -m brindle scan|watch ROOT --output-file FOLDER [--option value ...]``: exit code 0 without findings, 1 with, 2 after a failure."""

from __future__ import annotations

import argparse
import sys

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

from brindle import api
from brindle.plans import reports
from brindle.sources.options import Options
from brindle.streaming import watch


def main(arguments: list[str]) -> int:
    parser = argparse.ArgumentParser("brindle", description=__doc__)
    parser.add_argument("command", choices=("scan", "watch"))
    parser.add_argument("root")
    parser.add_argument("--checkpoint", help="folder of a watch's progress")
    for name, value in vars(Options()).items():
        flag = "--" + name.replace("_", "-")
        if isinstance(value, bool):
            parser.add_argument(flag, choices=("true", "false"))
        else:
            parser.add_argument(flag, action="append" if isinstance(value, tuple) else "store", type=int if isinstance(value, int) else str)
    own = parser.parse_args(arguments)
    given = {k: v == "true" if v in ("true", "false") and k != "deep" else v for k, v in vars(own).items() if v is not None and hasattr(Options(), k)}
    spark = SparkSession.builder.appName("brindle").getOrCreate()
    try:
        if own.command == "scan":
            return api.report(spark, own.root, own.output_file or "findings", given)
        write = lambda batch, number: reports.write(batch.where("NOT cleared"), f"{own.output_file or 'findings'}/batch={number}", own.output_format or "text")
        watch.watch(watch.file_changes(spark, own.root), own.checkpoint or "watch-checkpoint", write, interval="1 second").awaitTermination()
        return reports.CLEAN
    except (PySparkException, OSError, ValueError) as fault:
        print(fault, file=sys.stderr)
        return reports.FAILED


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
