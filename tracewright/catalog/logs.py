"""Event logs made of the given tables, and the SQL for the same logs.

| log | case | activity | time |
| --- | --- | --- | --- |
| daily | user and day | event type | event time, plus `value` seconds to complete |
| instant | as daily | as daily | complete equals start |
| tagged | as daily | as daily | with market segment and nation of the user |
| by_user | user | event type | as daily |
| conversations | conversation | role | turn number in seconds |
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.plans.skew import join_dimension, split_hot_cases
from tracewright.spec import ACTIVITY, COMPLETE, SEQ, START, TRACE


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # times in the tables carry no zone; all queries take them as UTC, whatever the session was set to
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str, trace: F.Column, *extra: str) -> DataFrame:
    millis = F.unix_millis(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select(
        trace.alias(TRACE), F.col("event_type").alias(ACTIVITY), millis.alias(START),
        (millis + F.round(F.col("value") * 1000).cast("long")).alias(COMPLETE),
        F.col("event_id").alias(SEQ), *extra)


def _user_and_day() -> F.Column:
    return F.concat_ws("|", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd"))


#: Logs with slices, by session, name and input files: a log is counted and sliced once for all queries.
_SLICED: dict[tuple, DataFrame] = {}


def _for_windows(name: str, log: DataFrame) -> DataFrame:
    key = (log.sparkSession.sparkContext.applicationId, name, *sorted(log.inputFiles()))
    if key not in _SLICED:
        _SLICED[key] = split_hot_cases(log)
    return _SLICED[key]


def daily(spark: SparkSession, sf_dir: str, windows: bool = True) -> DataFrame:
    """`windows` asks for slices of very large cases; without it nothing is computed ahead."""
    log = _events(spark, sf_dir, _user_and_day())
    return _for_windows("daily", log) if windows else log


def instant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily(spark, sf_dir).withColumn(COMPLETE, F.col(START))


def by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _for_windows("by_user", _events(spark, sf_dir, F.col("user_id").cast("string")))


def tagged(spark: SparkSession, sf_dir: str, windows: bool = True) -> DataFrame:
    users = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("workflow"),
        F.col("c_nationkey").cast("string").alias("category"))
    log = _events(spark, sf_dir, _user_and_day(), "user_id")
    return join_dimension(_for_windows("tagged", log) if windows else log, users, "user_id").drop("user_id")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _for_windows("conversations", table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias(TRACE), F.col("role").alias(ACTIVITY),
        (F.col("turn") * 1000).alias(START), ((F.col("turn") + 1) * 1000).alias(COMPLETE),
        F.col("turn").alias(SEQ)))


def with_(*ctes: str, recursive: bool = False) -> str:
    """A WITH clause of the given common table expressions."""
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(ctes) + "\n"


# ev(trace, activity, ts, tf, seq): the events of a log
_TIMES = "epoch_us(ts)//1000 AS ts, epoch_us(ts)//1000 + CAST(round(value*1000) AS BIGINT) AS tf, event_id AS seq"
DAILY = f"ev AS (SELECT user_id || '|' || strftime(ts,'%Y-%m-%d') AS trace, event_type AS activity, {_TIMES} FROM events)"
BY_USER = f"ev AS (SELECT CAST(user_id AS VARCHAR) AS trace, event_type AS activity, {_TIMES} FROM events)"
INSTANT = DAILY.replace("ev AS", "timed AS", 1) + ",\nev AS (SELECT trace, activity, ts, ts AS tf, seq FROM timed)"
TAGGED = f"""ev AS (SELECT user_id || '|' || strftime(ts,'%Y-%m-%d') AS trace, event_type AS activity, {_TIMES},
  c_mktsegment AS workflow, CAST(c_nationkey AS VARCHAR) AS category
  FROM events JOIN customer ON user_id = c_custkey)"""
CONVERSATIONS = """ev AS (SELECT CAST(conv_id AS VARCHAR) AS trace, role AS activity, turn*1000 AS ts,
  (turn+1)*1000 AS tf, turn AS seq FROM conversations)"""

# sq: with the place in the case
SEQUENCE = "sq AS (SELECT *, row_number() OVER (PARTITION BY trace ORDER BY ts, seq) AS pos FROM ev)"
# runs: consecutive equal activities made one
RUNS = """br AS (SELECT *, CASE WHEN activity = lag(activity) OVER (PARTITION BY trace ORDER BY ts, seq)
  THEN 0 ELSE 1 END AS opens FROM ev),
rn AS (SELECT *, sum(opens) OVER (PARTITION BY trace ORDER BY ts, seq) AS run FROM br),
runs AS (SELECT trace, any_value(activity) AS activity, min(ts) AS ts, arg_max(tf, (ts, seq)) AS tf,
  arg_min(seq, (ts, seq)) AS seq FROM rn GROUP BY trace, run)"""
# ends: per case; pad: with START and END
ENDS = """ends AS (SELECT trace, count(*) AS n_events, min(ts) AS first_time, arg_max(tf, (ts, seq)) AS last_time
  FROM ev GROUP BY trace)"""
PADDED = f"""{SEQUENCE}, {ENDS},
pad AS (SELECT trace, pos, activity, ts, tf FROM sq
  UNION ALL SELECT trace, 0, '_START_', first_time - 1000, first_time FROM ends
  UNION ALL SELECT trace, n_events + 1, '_END_', last_time, last_time + 1000 FROM ends)"""
# cs: activities of each case; vr: variants
CASES = """cs AS (SELECT trace, count(*) AS n_events, string_agg(activity, '>' ORDER BY pos) AS variant
  FROM sq GROUP BY trace)"""
VARIANTS = f"""{CASES},
vr AS (SELECT variant, min(trace) AS variant_id, any_value(n_events) AS n_events, count(*) AS n
  FROM cs GROUP BY variant)"""
TOP = "tv AS (SELECT * FROM vr ORDER BY n DESC, variant_id LIMIT 3)"


def summary(value: str) -> str:
    """Truncated mean, max, min, deviation around the truncated mean, total."""
    return (f"sum({value})//count(*) AS mean, max({value}) AS max, min({value}) AS min, "
            f"round(sqrt(avg(power({value} - m, 2))), 4) AS deviation, CAST(sum({value}) AS BIGINT) AS total")


def model(threshold: float = 0.9) -> str:
    """model(src, dst, f, d): the arcs found in the padded sequences."""
    return f"""nx AS (SELECT activity AS a, lead(activity) OVER w AS b, lead(activity, 2) OVER w AS c FROM pad
  WINDOW w AS (PARTITION BY trace ORDER BY pos)),
ab AS (SELECT a AS src, b AS dst, count(*) AS f FROM nx WHERE b IS NOT NULL GROUP BY ALL),
tr AS (SELECT a AS src, b AS dst, count(*) AS n FROM nx WHERE c = a AND a <> b GROUP BY ALL),
dep AS (SELECT x.src, x.dst, x.f,
    CASE WHEN x.src = x.dst THEN CAST(x.f AS DOUBLE) / CAST(x.f + 1 AS DOUBLE)
      ELSE CAST(x.f - coalesce(y.f, 0) AS DOUBLE) / CAST(x.f + coalesce(y.f, 0) + 1 AS DOUBLE) END AS d,
    CAST(coalesce(p.n, 0) + coalesce(q.n, 0) AS DOUBLE)
      / CAST(coalesce(p.n, 0) + coalesce(q.n, 0) + 1 AS DOUBLE) AS l2
  FROM ab x LEFT JOIN ab y ON y.src = x.dst AND y.dst = x.src
  LEFT JOIN tr p ON p.src = x.src AND p.dst = x.dst LEFT JOIN tr q ON q.src = x.dst AND q.dst = x.src),
lp AS (SELECT src FROM dep WHERE src = dst AND d >= {threshold}),
strong AS (SELECT src, dst FROM dep WHERE d >= {threshold} OR (l2 >= {threshold} AND src <> dst
  AND src NOT IN (SELECT src FROM lp) AND dst NOT IN (SELECT src FROM lp))),
bo AS (SELECT src, dst FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY d DESC, f DESC, dst) AS r
  FROM dep WHERE src <> dst) WHERE r = 1 AND src NOT IN (SELECT src FROM strong WHERE src <> dst)),
bi AS (SELECT src, dst FROM (SELECT src, dst, row_number() OVER (PARTITION BY dst ORDER BY d DESC, f DESC, src) AS r
  FROM dep WHERE src <> dst) WHERE r = 1 AND dst NOT IN (SELECT dst FROM strong WHERE src <> dst)),
model AS (SELECT src, dst, f, d FROM dep WHERE (src, dst) IN
  (SELECT (src, dst) FROM strong UNION SELECT (src, dst) FROM bo UNION SELECT (src, dst) FROM bi))"""


# ca(variant_id, src_pos, pos, src, dst, reps): arcs of the variants' cases
CASE_ARCS = """ve AS (SELECT p.trace AS variant_id, p.pos, p.activity, v.n AS reps
  FROM pad p JOIN vr v ON v.variant_id = p.trace),
latest AS (SELECT y.variant_id, max(x.pos) AS src_pos, y.pos, m.src, m.dst, any_value(y.reps) AS reps
  FROM ve y JOIN model m ON m.dst = y.activity
  JOIN ve x ON x.variant_id = y.variant_id AND x.activity = m.src AND x.pos < y.pos
  GROUP BY y.variant_id, y.pos, m.src, m.dst),
ca AS (SELECT * FROM latest l WHERE NOT EXISTS (SELECT 1 FROM ve z WHERE z.variant_id = l.variant_id
  AND z.activity = l.dst AND z.pos > l.src_pos AND z.pos < l.pos))"""
