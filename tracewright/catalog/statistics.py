"""Queries on activities and cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.catalog.logs import (
    DAILY, ENDS, PADDED, SEQUENCE, TAGGED, daily, summary, tagged, with_,
)
from tracewright.catalog.registry import query
from tracewright.catalog.sequences import joined
from tracewright.operators import activity as A
from tracewright.operators import cases as C
from tracewright.operators.sequence import add_dummies
from tracewright.plans.storage import store

BY_ACTIVITY = "du AS (SELECT activity, tf - ts AS d FROM ev)"
MEANS = f"{BY_ACTIVITY},\nmn AS (SELECT activity, sum(d)//count(*) AS m FROM du GROUP BY activity)"
AVERAGES = f"{MEANS},\nav AS (SELECT activity, {summary('d')} FROM du JOIN mn USING (activity) GROUP BY activity)"
CASE_DURATIONS = f"{ENDS},\ncd AS (SELECT trace, first_time, last_time, last_time - first_time AS duration FROM ends)"


def rounded(df: DataFrame, column: str, places: int = 6) -> DataFrame:
    return df.withColumn(column, F.round(column, places))


@query(with_(DAILY) + "SELECT activity, count(*) AS n FROM ev GROUP BY activity ORDER BY n DESC, activity")
def activity_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.activity_frequency(add_dummies(daily(spark, sf_dir)))


@query(with_(DAILY) + "SELECT activity, count(*) AS n, round(count(*)/(SELECT count(*) FROM ev), 6) AS share FROM ev GROUP BY activity")
def activity_relative_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.activity_relative_frequency(daily(spark, sf_dir, windows=False)), "share")


@query(with_(TAGGED) + """SELECT workflow, activity, count(*) AS n,
round(count(*)/sum(count(*)) OVER (PARTITION BY workflow), 6) AS share FROM ev GROUP BY workflow, activity""")
def activity_relative_frequency_by_workflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.activity_relative_frequency(tagged(spark, sf_dir, windows=False), ["workflow"]), "share")


@query(with_(DAILY, PADDED) + 'SELECT min(ts) AS "first", max(tf) AS "last" FROM pad')
def log_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.log_interval(add_dummies(daily(spark, sf_dir)))


@query(with_(DAILY, PADDED) + 'SELECT min(ts) AS "first", max(tf) AS "last", max(tf) - min(ts) AS span FROM pad')
def log_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.log_span(add_dummies(daily(spark, sf_dir)))


QUARTERS = """iv AS (SELECT min(ts) AS f, max(tf) AS l FROM pad),
qs AS (SELECT f, l, (l-f)//4 AS s FROM iv),
qt AS (SELECT 1 AS quartile, f AS first, f+s AS last FROM qs
  UNION ALL SELECT 2, f+s+1, f+2*s FROM qs
  UNION ALL SELECT 3, f+2*s+1, f+3*s FROM qs
  UNION ALL SELECT 4, f+3*s+1, l FROM qs)"""


@query(with_(DAILY, PADDED, QUARTERS) + 'SELECT quartile, first AS "first", last AS "last" FROM qt')
def quartile_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.quartile_intervals(add_dummies(daily(spark, sf_dir)))


@query(with_(DAILY, PADDED, QUARTERS) + """SELECT quartile, activity, count(*) AS n,
round(count(*)/sum(count(*)) OVER (PARTITION BY quartile), 6) AS share
FROM ev JOIN qt ON ts BETWEEN first AND last GROUP BY quartile, activity""")
def activity_frequency_by_quartile(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = store(add_dummies(daily(spark, sf_dir)), "events")  # read for the interval, then for the counts
    return rounded(A.activity_frequency_by_quartile(events), "share")


@query(with_(DAILY, AVERAGES) + """SELECT av.*, med.median FROM av JOIN
(SELECT activity, CAST(floor(quantile_cont(d, 0.5)) AS BIGINT) AS median FROM du GROUP BY activity) med USING (activity)""")
def activity_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.activity_durations(daily(spark, sf_dir, windows=False)), "deviation", 4)


@query(with_(DAILY, AVERAGES) + """SELECT 'longest' AS kind, * FROM
(SELECT activity, total, deviation FROM av ORDER BY total DESC, activity LIMIT 1)
UNION ALL SELECT 'shortest', * FROM (SELECT activity, total, deviation FROM av ORDER BY total, activity LIMIT 1)""")
def longest_shortest_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.longest_shortest_activity(daily(spark, sf_dir, windows=False)), "deviation", 4)


@query(with_(DAILY) + "SELECT DISTINCT trace FROM ev WHERE activity = 'purchase'")
def cases_of_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.cases_of_activity(daily(spark, sf_dir, windows=False), "purchase")


@query(with_(DAILY, AVERAGES) + "SELECT activity, mean, round(100.0*mean/(SELECT sum(mean) FROM av), 6) AS share FROM av")
def activity_duration_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.activity_duration_share(daily(spark, sf_dir, windows=False)), "share")


@query(with_(DAILY, SEQUENCE) + 'SELECT trace, pos, ts AS "timestamp", tf AS timestampf FROM sq')
def case_activity_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.case_activity_times(daily(spark, sf_dir))


@query(with_(DAILY, CASE_DURATIONS) + "SELECT * FROM cd")
def case_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.case_durations(daily(spark, sf_dir, windows=False))


@query(with_(DAILY, CASE_DURATIONS) + "SELECT trace, first_time FROM cd")
def case_first_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.case_first_time(daily(spark, sf_dir, windows=False))


@query(with_(DAILY, CASE_DURATIONS) + "SELECT trace, last_time FROM cd")
def case_last_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.case_last_time(daily(spark, sf_dir, windows=False))


@query(with_(DAILY, CASE_DURATIONS) + "SELECT trace, first_time, last_time FROM cd ORDER BY first_time, trace")
def case_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.case_extents(daily(spark, sf_dir, windows=False))


@query(with_(DAILY, PADDED, CASE_DURATIONS.removeprefix(f"{ENDS},\n"), """lc AS (
SELECT 'longest' AS kind, * FROM (SELECT trace, duration FROM cd ORDER BY duration DESC, trace LIMIT 1)
UNION ALL SELECT 'shortest', * FROM (SELECT trace, duration FROM cd ORDER BY duration, trace LIMIT 1))""")
       + """SELECT kind, lc.trace, any_value(duration) AS duration, string_agg(activity, '>' ORDER BY pos) AS activities
FROM lc JOIN pad USING (trace) GROUP BY kind, lc.trace""")
def longest_shortest_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = daily(spark, sf_dir)
    return C.case_activities(log, C.longest_shortest_case(log)).select(
        "kind", "trace", "duration", joined("activities"))


@query(with_(DAILY, CASE_DURATIONS, "od AS (SELECT duration, row_number() OVER (ORDER BY duration) - 1 AS r,"
             " count(*) OVER () AS n FROM cd)") + """SELECT rank_name, duration FROM od JOIN
(VALUES ('min', 0), ('q1', 0.25), ('q2', 0.5), ('q3', 0.75), ('max', 1)) AS q(rank_name, part)
ON r = CASE WHEN part = 1 THEN n - 1 ELSE CAST(floor(part * n) AS BIGINT) END WHERE n > 4""")
def duration_five_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.duration_five_numbers(daily(spark, sf_dir, windows=False))


@query(with_(DAILY, CASE_DURATIONS) + "SELECT CAST(floor(quantile_cont(duration, 0.5)) AS BIGINT) AS median FROM cd")
def median_case_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.median_case_duration(daily(spark, sf_dir, windows=False))


@query(with_(TAGGED, "cd AS (SELECT workflow, trace, arg_max(tf, (ts, seq)) - min(ts) AS d FROM ev GROUP BY ALL)")
       + "SELECT workflow, CAST(floor(quantile_cont(d, 0.5)) AS BIGINT) AS median FROM cd GROUP BY workflow")
def median_case_duration_by_workflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.median_case_duration(tagged(spark, sf_dir, windows=False), ["workflow"])


@query(with_(DAILY, SEQUENCE, "fc AS (SELECT trace, row_number() OVER (ORDER BY trace) AS line FROM"
             " (SELECT DISTINCT trace FROM ev) ORDER BY trace LIMIT 18)")
       + "SELECT line, trace, pos, activity, tf AS at FROM sq JOIN fc USING (trace)")
def case_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.case_timeline(daily(spark, sf_dir, windows=False))
