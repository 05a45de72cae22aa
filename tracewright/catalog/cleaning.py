"""Queries on sources, cleaning and slicing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.catalog.logs import DAILY, PADDED, TAGGED, daily, table, tagged, with_
from tracewright.catalog.registry import query
from tracewright.functions import format_duration, normalize_activity, simplify_name, strip_accents
from tracewright.operators import branches as B
from tracewright.operators import cleaning as C
from tracewright.operators.activity import activity_frequency
from tracewright.operators.sequence import add_dummies, segment_of, sequence
from tracewright.plans.storage import new_path
from tracewright.sources import export_csv, load_log, read_csv_log, read_typed_log, read_xes_log, save_tables
from tracewright.spec import ACTIVITY, COMPLETE, SEGMENT, SEGMENT_EVENTS, START, TRACE, LogSpec

EVENT_COLUMNS = (TRACE, ACTIVITY, START, COMPLETE)
EVENT_SQL = 'trace, activity, ts AS "timestamp", tf AS timestampf'
CHECKED = LogSpec(TRACE, ACTIVITY, "began", "ended", "yyyy/MM/dd HH:mm:ss")


def _as_text(log: DataFrame) -> DataFrame:
    """The log as a user would hand it in: times as text, to the second."""
    return log.select(
        TRACE, ACTIVITY,
        *[F.date_format(F.timestamp_millis(c), CHECKED.pattern).alias(n) for c, n in ((START, "began"), (COMPLETE, "ended"))])


@query(with_(DAILY) + """SELECT trace AS "case", upper(activity) || ' -> ' || activity AS task,
strftime(make_timestamp(ts*1000), '%Y/%m/%d %H:%M:%S') AS began FROM ev""")
def read_csv_log_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes and accents in cells, an empty column and one not asked for."""
    path = new_path(spark, "csv")
    task = F.concat(F.upper(ACTIVITY), F.lit(' -> "'), F.col(ACTIVITY), F.lit('"'))
    _as_text(daily(spark, sf_dir, windows=False)).select(
        F.col(TRACE).alias("case"), task.alias("task"), "began", F.lit("x").alias("other")
    ).write.csv(path, header=True, escape='"')
    return read_csv_log(spark, path, ["case", "task", "began"])


@query("""SELECT CAST(conv_id AS VARCHAR) AS "case", role, CASE WHEN turn = 0 THEN '-' ELSE 'tur' END AS note
FROM conversations""")
def read_csv_log_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Empty cells and accents."""
    path = new_path(spark, "csv")
    table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("case"), "role", F.when(F.col("turn") == 0, "").otherwise("tür").alias("note")
    ).write.csv(path, header=True, escape='"')
    return read_csv_log(spark, path)


@query(with_(DAILY) + f"SELECT {EVENT_SQL} FROM ev")
def read_typed_log_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "typed")
    daily(spark, sf_dir, windows=False).select(*EVENT_COLUMNS).write.csv(path, header=True, escape='"')
    return read_typed_log(spark, path)


@query(with_(DAILY) + """SELECT trace AS "case", activity AS event, ts AS complete_ms FROM ev""")
def read_xes_log_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log is first written in the format. Long cases take several elements of the same name."""
    path = new_path(spark, "xes")

    def attribute(key: str, value: F.Column) -> F.Column:
        return F.array(F.struct(F.lit(key).alias("_key"), value.alias("_value")))

    when = F.date_format(F.timestamp_millis(START), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")
    event = F.struct(attribute("concept:name", F.col(ACTIVITY)).alias("string"),
                     attribute("time:timestamp", when).alias("date"))
    placed = sequence(daily(spark, sf_dir)).withColumn(SEGMENT, segment_of(SEGMENT_EVENTS))
    placed.groupBy(TRACE, SEGMENT).agg(F.collect_list(event).alias("event")).select(
        attribute("concept:name", F.col(TRACE)).alias("string"), "event"
    ).write.format("xml").options(rowTag="trace", rootTag="log").save(path)
    return read_xes_log(spark, path).select("case", "event", F.unix_millis("completeTime").alias("complete_ms"))


@query(with_(DAILY) + f"SELECT {EVENT_SQL} FROM ev WHERE activity = 'click'")
def load_log_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "log")
    daily(spark, sf_dir, windows=False).write.parquet(path)
    return load_log(spark, path).where(F.col(ACTIVITY) == "click").select(*EVENT_COLUMNS)


@query(with_(DAILY, PADDED) + """SELECT 'events' AS name, count(*) AS n FROM pad
UNION ALL SELECT 'activities', count(DISTINCT activity) FROM ev""")
def save_tables_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = daily(spark, sf_dir)
    paths = save_tables({"events": add_dummies(log), "activities": activity_frequency(log)},
                        new_path(spark, "result"))
    counts = [load_log(spark, p).agg(F.lit(n).alias("name"), F.count("*").alias("n")) for n, p in paths.items()]
    return counts[0].unionByName(counts[1])


@query(with_(DAILY) + """SELECT trace AS "CaseIdentifier", activity AS "TaskIdentifier",
strftime(make_timestamp(ts*1000), '%Y %m %d %H:%M:%S') AS "InitialTime",
strftime(make_timestamp(tf*1000), '%Y %m %d %H:%M:%S') AS "CompleteTime" FROM ev""")
def export_csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "export")
    export_csv(daily(spark, sf_dir, windows=False), path)
    return spark.read.csv(path, header=True)


@query(with_(DAILY) + """SELECT trace AS "CaseIdentifier", activity AS "TaskIdentifier" FROM ev""")
def export_csv_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "export")
    export_csv(daily(spark, sf_dir, windows=False), path, times=False)
    return spark.read.csv(path, header=True)


@query(with_(DAILY) + """SELECT trace, activity, ts//1000*1000 AS "timestamp", tf//1000*1000 AS timestampf FROM ev""")
def standardize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.standardize(_as_text(daily(spark, sf_dir, windows=False)), CHECKED).select(*EVENT_COLUMNS)


@query("""SELECT doc_id, translate(regexp_replace(strip_accents(text), '[ =>?¿:().]', '', 'g'), '-', '_') AS name
FROM documents""", name="normalize_activity")
def _normalize_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", normalize_activity("text").alias("name"))


@query("SELECT doc_id, strip_accents(text) AS plain FROM documents", name="strip_accents")
def _strip_accents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", strip_accents("text").alias("plain"))


@query("""SELECT doc_id, replace(regexp_replace(replace(replace(text, ':complete', ''), ':COMPLETE', ''),
'[\\s-]', '_', 'g'), ':', '__') AS label FROM documents""", name="simplify_name")
def _simplify_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", simplify_name("text").alias("label"))


_SPANS = "CAST(l_orderkey AS BIGINT) * l_partkey * l_suppkey % 100000000000"


@query(f"""WITH v AS (SELECT {_SPANS} AS ms FROM lineitem),
p AS (SELECT ms, ms//86400000 AS d, ms//3600000 AS h, ms//60000 AS m, ms//1000 AS s FROM v)
SELECT ms, CASE
WHEN ms > 31104000000 THEN (d//365) || 'y ' || CASE WHEN d%365 > 0 THEN (d%365) || 'd ' ELSE '' END
  || CASE WHEN h%24 > 0 THEN (h%24) || 'h' ELSE '' END
WHEN ms > 86400000 THEN d || 'd ' || CASE WHEN h%24 > 0 THEN (h%24) || 'h' ELSE '' END
WHEN ms > 3600000 THEN h || 'h ' || CASE WHEN m%60 > 0 THEN (m%60) || 'm' ELSE '' END
WHEN ms > 60000 THEN m || 'm ' || CASE WHEN s%60 > 0 THEN (s%60) || 's' ELSE '' END
ELSE s || 's ' || CASE WHEN ms%1000 > 0 THEN (ms%1000) || 'ms' ELSE '' END END AS label, count(*) AS n
FROM p GROUP BY ALL""", name="format_duration")
def _format_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = F.expr(_SPANS.replace("BIGINT", "LONG"))
    return table(spark, sf_dir, "lineitem").select(ms.alias("ms")).groupBy("ms").agg(
        F.count("*").alias("n")).withColumn("label", format_duration("ms"))


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN '-' ELSE event_type END AS kind FROM events")
def fill_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") != "error", F.col("event_type")).when(F.col("event_id") % 2 == 0, "")
    return C.fill_empty(table(spark, sf_dir, "events").select("event_id", kind.alias("kind")))


@query("SELECT event_id, replace(CAST(value AS VARCHAR), '.', '0') AS id FROM events")
def fix_case_dots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.fix_case_dots(
        table(spark, sf_dir, "events").select("event_id", F.col("value").cast("string").alias("id")), "id")


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN 'unknown' ELSE event_type END AS kind FROM events")
def replace_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", "-").otherwise(F.col("event_type")).alias("kind")
    return C.replace_nulls(table(spark, sf_dir, "events").select("event_id", kind), "kind", "unknown")


@query("""SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN 'browse' ELSE event_type END AS kind
FROM events""")
def replace_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("kind"))
    return C.replace_values(log, "kind", ["click", "view"], "browse")


@query("""SELECT DISTINCT 'c_mktsegment' AS "column", c_mktsegment AS "value" FROM customer
UNION ALL SELECT DISTINCT 'c_nationkey', CAST(c_nationkey AS VARCHAR) FROM customer""")
def distinct_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.distinct_values(table(spark, sf_dir, "customer"), ["c_mktsegment", "c_nationkey"])


@query(with_(TAGGED) + f"""SELECT {EVENT_SQL}, workflow, category FROM ev
WHERE workflow IN ('BUILDING', 'MACHINERY') AND activity = 'click'""")
def filter_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = LogSpec("id", "kind", "began", "ended")
    return C.filter_attributes(
        tagged(spark, sf_dir, windows=False), {"workflow": ["BUILDING", "MACHINERY"], "kind": ["click"]}, spec
    ).select(*EVENT_COLUMNS, "workflow", "category")


FIRST, LAST = 1_704_500_000_000, 1_705_500_000_000


@query(with_(DAILY) + f"SELECT {EVENT_SQL} FROM ev WHERE ts BETWEEN {FIRST} AND {LAST}")
def filter_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.filter_interval(daily(spark, sf_dir, windows=False), FIRST, LAST).select(*EVENT_COLUMNS)


@query(with_(DAILY) + f"SELECT {EVENT_SQL} FROM ev ORDER BY trace, tf, seq")
def order_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.order_log(daily(spark, sf_dir, windows=False)).select(*EVENT_COLUMNS)


@query(with_(DAILY) + f"SELECT {EVENT_SQL} FROM ev")
def drop_dummies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.drop_dummies(add_dummies(daily(spark, sf_dir))).select(*EVENT_COLUMNS)


@query("SELECT min(strftime(ts, '%Y/%m/%d %H:%M:%S')) AS sample FROM events")
def sample_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.sample_time(_as_text(daily(spark, sf_dir, windows=False)), "began")


BRANCHES = [
    [{"workflow": B.SPLIT}, {ACTIVITY: ["click", "view"]}],
    [{"category": ["1", "2", "3"], "workflow": ["BUILDING"]}],
]
_SLICES = """sl AS (SELECT *, '0' AS branch_id, NULL AS parent_id, 0 AS level, 'ROOT' AS label, '' AS filter FROM ev
  UNION ALL SELECT *, '1.1[workflow=' || workflow || ']', '0', 1, 'workflow', 'workflow=' || workflow FROM ev
  UNION ALL SELECT *, '1.2[workflow=' || workflow || ']', '1.1[workflow=' || workflow || ']', 2, 'activity',
    'activity=click|view;workflow=' || workflow FROM ev WHERE activity IN ('click', 'view')
  UNION ALL SELECT *, '2.1', '0', 1, 'workflow', 'category=1|2|3;workflow=BUILDING' FROM ev
    WHERE category IN ('1', '2', '3') AND workflow = 'BUILDING')"""


@query(with_(TAGGED, _SLICES) + "SELECT DISTINCT branch_id, parent_id, level, label, filter FROM sl")
def expand_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    conditions = F.transform(F.map_entries("filter"), lambda e: F.concat_ws("=", e["key"], F.concat_ws("|", e["value"])))
    return B.expand_branches(BRANCHES, tagged(spark, sf_dir, windows=False)).withColumn("filter", F.concat_ws(";", conditions))


@query(with_(TAGGED, _SLICES) + "SELECT branch_id, activity, count(*) AS n FROM sl GROUP BY ALL")
def run_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.run_branches(tagged(spark, sf_dir, windows=False), BRANCHES, activity_frequency)


@query(with_(TAGGED, _SLICES) + """SELECT branch_id, activity, count(*) AS n FROM sl
WHERE branch_id LIKE '1.2%' OR branch_id = '2.1' GROUP BY ALL""")
def run_branches_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.run_branches(tagged(spark, sf_dir, windows=False), BRANCHES, activity_frequency, only_leaves=True)


