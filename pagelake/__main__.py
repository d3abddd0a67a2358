"""python -m pagelake --tables FOLDER --query NAME --output FOLDER: run a query and write its rows as Parquet."""

from __future__ import annotations

import sys
from collections.abc import Sequence


def main(argv: Sequence[str] | None = None) -> int:
    from pyspark.sql import SparkSession

    from pagelake.config import load
    from pagelake.plans import catalog
    from pagelake.session import SETTINGS, ship

    config = load(argv)
    queries = dict(catalog.QUERIES)
    if config.query not in queries or not config.tables:
        print(f"give --tables and one of: {', '.join(sorted(queries))}", file=sys.stderr)
        return 2
    builder = SparkSession.builder.appName("pagelake")
    for k, v in SETTINGS.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    ship(spark)
    df = queries[config.query](spark, config.tables)
    if config.output:
        df.write.mode("errorifexists").parquet(config.output)
    else:
        df.show(20, False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
