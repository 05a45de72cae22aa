"""Queries on case, sequence and variant construction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.catalog.logs import (
    BY_USER, DAILY, ENDS, INSTANT, PADDED, RUNS, SEQUENCE, TAGGED, TOP, VARIANTS,
    by_user, daily, instant, summary, tagged, with_,
)
from tracewright.catalog.registry import query
from tracewright.operators import sequence as S
from tracewright.operators import variants as V
from tracewright.plans.storage import new_path
from tracewright.sources import open_log, save_log
from tracewright.spec import ACTIVITY, COMPLETE, POS, START, TRACE

EVENT_COLUMNS = (TRACE, ACTIVITY, START, COMPLETE)
EVENT_SQL = 'trace, activity, ts AS "timestamp", tf AS timestampf'


def joined(column: str) -> F.Column:
    return F.concat_ws(">", column).alias(column)


@query(with_(DAILY, SEQUENCE) + f"SELECT pos, {EVENT_SQL} FROM sq")
def sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.sequence(daily(spark, sf_dir)).select(POS, *EVENT_COLUMNS)


@query(with_(BY_USER, SEQUENCE) + f"SELECT pos, {EVENT_SQL} FROM sq")
def sequence_long_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.sequence(by_user(spark, sf_dir)).select(POS, *EVENT_COLUMNS)


@query(with_(DAILY, RUNS) + f"SELECT {EVENT_SQL} FROM runs")
def collapse_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.collapse_runs(daily(spark, sf_dir)).select(*EVENT_COLUMNS)


@query(with_(INSTANT) + """SELECT trace, activity,
coalesce(lag(tf) OVER (PARTITION BY trace ORDER BY ts, seq), ts) AS "timestamp", tf AS timestampf FROM ev""")
def artificial_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.artificial_starts(instant(spark, sf_dir)).select(*EVENT_COLUMNS)


@query(with_(DAILY, PADDED) + f"SELECT {EVENT_SQL} FROM pad")
def add_dummies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.add_dummies(daily(spark, sf_dir)).select(*EVENT_COLUMNS)


@query(with_(INSTANT.replace("ev AS (SELECT", "e0 AS (SELECT"),
             RUNS.replace("FROM ev", "FROM e0"),
             "ev AS (SELECT trace, activity, coalesce(lag(tf) OVER (PARTITION BY trace ORDER BY ts, seq), ts) AS ts,"
             " tf, seq FROM runs)", PADDED) + f"SELECT {EVENT_SQL} FROM pad")
def prepare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs collapsed, starts made up and START and END added: the table that mining stores."""
    return S.prepare(instant(spark, sf_dir), group=True, instant=True).select(*EVENT_COLUMNS)


@query(with_(DAILY, PADDED) + """SELECT trace, 0 AS segment, string_agg(activity, '>' ORDER BY pos) AS activities,
string_agg(ts || '-' || tf, '>' ORDER BY pos) AS times, any_value(first_time) AS first_time,
any_value(last_time) AS last_time FROM pad JOIN ends USING (trace) GROUP BY trace""")
def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    times = F.transform("activities_time", lambda t: F.concat_ws("-", t["start"].cast("string"), t["complete"].cast("string")))
    return S.traces(daily(spark, sf_dir)).select(
        TRACE, "segment", joined("activities"), F.concat_ws(">", times).alias("times"), "first_time", "last_time")


@query(with_(BY_USER, PADDED) + """SELECT trace, (greatest(least(pos, n_events), 1) - 1) // 40 AS segment,
string_agg(activity, '>' ORDER BY pos) AS activities FROM pad JOIN ends USING (trace) GROUP BY ALL""")
def traces_in_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long cases in several rows of at most 40 events."""
    return S.traces(by_user(spark, sf_dir), segment_events=40).select(TRACE, "segment", joined("activities"))


@query(with_(DAILY, SEQUENCE, VARIANTS) + "SELECT variant_id, 0 AS segment, n, variant AS activities FROM vr")
def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = daily(spark, sf_dir)
    return V.variant_sequences(log, V.variants(log)).select(V.VARIANT, "segment", "n", joined("activities"))


@query(with_(BY_USER, SEQUENCE, VARIANTS) + "SELECT variant_id, n_events, n FROM vr")
def variants_long_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.variants(by_user(spark, sf_dir))


@query(with_(DAILY, SEQUENCE, VARIANTS) + "SELECT variant_id, trace FROM cs JOIN vr USING (variant)")
def variant_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.variant_cases(daily(spark, sf_dir))


@query(with_(TAGGED, "k AS (SELECT trace, workflow, string_agg(activity, '>' ORDER BY ts, seq) AS variant"
             " FROM ev GROUP BY ALL)") + """SELECT workflow, min(trace) AS variant_id, count(*) AS n
FROM k GROUP BY workflow, variant""")
def variants_by_workflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.variants(tagged(spark, sf_dir), keys=["workflow"]).select("workflow", V.VARIANT, "n")


@query(with_(DAILY) + "SELECT count(DISTINCT trace) AS n_cases FROM ev")
def case_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.case_count(daily(spark, sf_dir, windows=False))


@query(with_(DAILY, SEQUENCE, VARIANTS, TOP)
       + "SELECT variant_id, '_START_>' || variant || '>_END_' AS activities, n FROM tv")
def variant_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.variant_frequency(daily(spark, sf_dir)).select(V.VARIANT, joined("activities"), "n")


@query(with_(DAILY, SEQUENCE, VARIANTS, TOP) + """SELECT variant_id, variant AS activities, n,
round(n / (SELECT count(*) FROM cs), 6) AS share FROM tv""")
def variant_relative_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.variant_relative_frequency(daily(spark, sf_dir)).select(
        V.VARIANT, joined("activities"), "n", F.round("share", 6).alias("share"))


@query(with_(DAILY, SEQUENCE, VARIANTS, TOP) + "SELECT variant_id, n, trace FROM tv JOIN cs USING (variant)")
def variant_frequency_with_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.variant_frequency_with_cases(daily(spark, sf_dir))


@query(with_(DAILY, SEQUENCE, ENDS, VARIANTS,
             "dr AS (SELECT variant, last_time - first_time AS d FROM cs JOIN ends USING (trace))",
             "mn AS (SELECT variant, sum(d)//count(*) AS m FROM dr GROUP BY variant)")
       + f"""SELECT variant_id, any_value(n) AS n, {summary('d')}
FROM dr JOIN mn USING (variant) JOIN vr USING (variant) GROUP BY variant_id""")
def variant_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.variant_durations(daily(spark, sf_dir)).withColumn("deviation", F.round("deviation", 4))


@query(with_(DAILY, SEQUENCE, VARIANTS, TOP) + """SELECT variant_id,
round(100.0 * n / (SELECT count(*) FROM cs), 2) AS percent, n AS compliant,
(SELECT count(*) FROM cs) - n AS not_compliant FROM tv""")
def variant_compliance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.variant_compliance(daily(spark, sf_dir))


@query(with_(DAILY, SEQUENCE) + f"SELECT pos, {EVENT_SQL} FROM sq")
def sequence_of_stored_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log is first stored by case; its events are then numbered without a shuffle."""
    path = new_path(spark, "by-case")
    save_log(daily(spark, sf_dir), path)
    return S.sequence(open_log(spark, path)).select(POS, *EVENT_COLUMNS)
