"""Logs in the XES interchange format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Attribute keys of the format.
NAME_KEY, TIME_KEY = "concept:name", "time:timestamp"

_ATTRIBUTES = "array<struct<_key:string,_value:string>>"
# one attribute or many: an explicit schema keeps both an array
EVENT_SCHEMA = f"string {_ATTRIBUTES}, date {_ATTRIBUTES}"
TRACE_SCHEMA = f"string {_ATTRIBUTES}"


def _attribute(attributes: Column, key: str) -> Column:
    return F.get(F.filter(attributes, lambda a: a["_key"] == key), F.lit(0))["_value"]


def _last_element(text: Column, tag: str, end: str) -> Column:
    """The text from the last `<tag` on, closed; null if there is none."""
    start = F.length(text) - F.length(F.substring_index(text, f"<{tag}", -1))
    found = F.substring(text, start - len(tag), F.length(text))
    return F.when(F.instr(text, f"<{tag}") > 0, F.concat(found, F.lit(end)))


def _records(spark: SparkSession, path: str) -> DataFrame:
    """The text up to the end of each event, with its file, block of the file, and place in the order of reading."""
    rows = spark.read.option("lineSep", "</event>").text(path)
    return rows.select(
        "value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_id"))


def read_xes_log(spark: SparkSession, path: str, rewrite_names: bool = False) -> DataFrame:
    """`case, event, completeTime`: one row per event, in no particular order.

    Times keep their instant, so an offset is honoured. `rewrite_names` turns case names into
    numbers where it can: `caso` and its dots go, in other names a dot becomes `0`.

    Files are cut at the ends of events, so a record is one event with what stands before it, and a
    case of any length is read in as many blocks as its text fills. What stands before an event opens its
    case if there is a `trace` in it; other events take the case of the last one that did, across
    blocks by a table with a row for each block. Attributes of a trace stand before its events, as the
    format has it. An event in short form, without attributes, has no row.
    """
    records = _records(spark, path)
    before = F.substring_index("value", "<event", -1)
    head = F.substring(F.col("value"), F.lit(1), F.length("value") - F.length(before) - len("<event"))
    event = F.when(F.instr("value", "<event") > 0, F.concat(F.lit("<event"), before, F.lit("</event>")))
    trace = F.when(event.isNotNull(), _last_element(head, "trace", "</trace>"))
    parsed = records.select(
        "_file", "_block", "_id", F.from_xml(event, EVENT_SCHEMA).alias("_event"),
        # present, with or without a name, where a case opens
        F.when(trace.isNotNull(), F.struct(_attribute(F.from_xml(trace, TRACE_SCHEMA)["string"], NAME_KEY).alias("name"))).alias("_opens"),
        event.isNotNull().alias("_is"),
    ).where("_is")
    here = Window.partitionBy("_file", "_block").orderBy("_id").rowsBetween(Window.unboundedPreceding, 0)
    placed = parsed.withColumn("_own", F.last("_opens", ignorenulls=True).over(here))
    along = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = parsed.groupBy("_file", "_block").agg(F.max_by("_opens", F.when(F.col("_opens").isNotNull(), F.col("_id"))).alias("_last"))
    blocks = blocks.select("_file", "_block", F.last("_last", ignorenulls=True).over(along).alias("_carried"))
    name = F.coalesce("_own", "_carried")["name"]
    if rewrite_names:
        name = F.when(name.contains("caso"), F.translate(F.replace(name, F.lit("caso"), F.lit("")), ".", "")
                      ).otherwise(F.translate(name, ".", "0"))
    return placed.join(blocks, ["_file", "_block"]).select(
        name.alias("case"),
        _attribute(F.col("_event.string"), NAME_KEY).alias("event"),
        F.to_timestamp(_attribute(F.col("_event.date"), TIME_KEY)).alias("completeTime"),
    )
