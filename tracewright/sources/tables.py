"""Stored logs and results as parquet tables."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tracewright.plans.skew import sliced
from tracewright.spec import ORDER, TRACE

LAYOUT = "layout"  # beside the rows: what they are stored by
ROWS = "rows"


def load_log(spark: SparkSession, path: str) -> DataFrame:
    """A stored log; filters and column choices made on it reach the parquet scan."""
    return spark.read.parquet(path)


def save_tables(tables: Mapping[str, DataFrame], directory: str) -> dict[str, str]:
    """One parquet table per result; returns where each one lies."""
    paths = {name: f"{directory.rstrip('/')}/{name}" for name in tables}
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(paths[name])
    return paths


def save_log(log: DataFrame, path: str, buckets: int | None = None) -> None:
    """Store a log by case: in buckets of the case, and of the slice where very large cases are sliced, in order of events.

    Operators on cases read such a log without a shuffle. As many buckets as shuffle partitions if
    nothing else is said: a bucket should fit a task. What was there before is replaced.
    """
    spark, by = log.sparkSession, [TRACE, *sliced(log)]
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"log_{uuid.uuid4().hex}"
    # one file a bucket: rows of a bucket meet in one task before they are written
    rows = log.repartition(buckets, *by)
    rows.write.mode("overwrite").format("parquet").bucketBy(buckets, *by).sortBy(*by, *[c for c in ORDER if c in log.columns]).option(
        "path", f"{path.rstrip('/')}/{ROWS}").saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay: the table is an external one
    spark.createDataFrame([(buckets, by, log.schema.json())], "buckets int, by array<string>, schema string").coalesce(1).write.mode(
        "overwrite").parquet(f"{path.rstrip('/')}/{LAYOUT}")


def open_log(spark: SparkSession, path: str) -> DataFrame:
    """A log of `save_log`, in the same or another session, with its layout known to the plans."""
    layout = spark.read.parquet(f"{path.rstrip('/')}/{LAYOUT}").first()
    schema = StructType.fromJson(json.loads(layout["schema"]))
    name = f"log_{uuid.uuid4().hex}"
    quoted = [f"`{c}`" for c in layout["by"]]
    order = [f"`{c}`" for c in [*layout["by"], *ORDER] if c in schema.names]
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    spark.sql(f"""CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({', '.join(quoted)})
        SORTED BY ({', '.join(order)}) INTO {layout['buckets']} BUCKETS LOCATION '{path.rstrip('/')}/{ROWS}'""")
    rows = spark.table(name)
    # metadata of columns, such as that of slices, does not pass through a table
    return rows.select(*[F.col(f"`{f.name}`").alias(f.name, metadata=f.metadata) if f.metadata else F.col(f"`{f.name}`") for f in schema])
