"""Queries of the workflow and category report, and on buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracewright.catalog.logs import DAILY, SEQUENCE, TAGGED, daily, tagged, with_
from tracewright.catalog.registry import query
from tracewright.catalog.statistics import AVERAGES, rounded
from tracewright.mining import report
from tracewright.operators import buckets as B
from tracewright.operators import workflow as W
from tracewright.operators.activity import activity_averages, activity_frequency
from tracewright.operators.arcs import directly_follows
from tracewright.plans.storage import store

EXTENTS = """ce AS (SELECT trace, min(tf) AS first_complete, max(tf) AS last_complete,
  arg_min(workflow, (ts, seq)) AS workflow, arg_min(category, (ts, seq)) AS category FROM ev GROUP BY trace)"""
FRAME = """fr AS (SELECT f, l, CASE WHEN (l-f)//30 < 86400000 THEN 86400000 WHEN (l-f)//30 < 604800000 THEN 604800000
  ELSE 2629800000 END AS w FROM (SELECT min(last_complete) AS f, max(last_complete) AS l FROM ce))"""
TIMELINE = f"""{FRAME},
bn AS (SELECT unnest(range((l-f)//w + 1)) AS bin, f, w FROM fr),
cb AS (SELECT category, (last_complete - f)//w AS bin, count(*) AS n FROM ce, fr GROUP BY ALL),
tl AS (SELECT c.category, b.bin, f + b.bin*w AS bin_start, coalesce(cb.n, 0) AS n
  FROM (SELECT DISTINCT category FROM ce) c CROSS JOIN bn b
  LEFT JOIN cb ON cb.category = c.category AND cb.bin = b.bin)"""


def _extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.case_completion_extents(tagged(spark, sf_dir, windows=False), "workflow", "category")


@query(with_(TAGGED, EXTENTS) + "SELECT * FROM ce")
def case_completion_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _extents(spark, sf_dir)


@query(with_(TAGGED, EXTENTS) + "SELECT workflow, count(*) AS n FROM ce GROUP BY workflow")
def workflow_executions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.workflow_executions(_extents(spark, sf_dir))


@query(with_(TAGGED, EXTENTS) + """SELECT workflow, count(*) AS n, round(count(*)/(SELECT count(*) FROM ce), 6) AS share
FROM ce GROUP BY workflow""")
def workflow_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(W.workflow_share(_extents(spark, sf_dir)), "share")


@query(with_(TAGGED, EXTENTS) + "SELECT DISTINCT workflow, category FROM ce")
def workflow_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.workflow_categories(_extents(spark, sf_dir))


@query(with_(TAGGED, EXTENTS) + """SELECT workflow, count(*) AS n, min(last_complete - first_complete) AS min,
round(avg(last_complete - first_complete), 4) AS mean, max(last_complete - first_complete) AS max
FROM ce GROUP BY workflow""")
def workflow_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(W.workflow_durations(_extents(spark, sf_dir)), "mean", 4)


@query(with_(TAGGED, EXTENTS, FRAME) + 'SELECT f AS "first", l AS "last", w AS width FROM fr')
def report_bin_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.report_bin_width(_extents(spark, sf_dir))


@query(with_(TAGGED, EXTENTS, TIMELINE) + "SELECT * FROM tl")
def category_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.category_timeline(store(_extents(spark, sf_dir), "cases"))


@query(with_(TAGGED, EXTENTS, TIMELINE) + """SELECT *, CAST(sum(n) OVER (PARTITION BY bin) AS BIGINT) AS total,
round(CASE WHEN sum(n) OVER (PARTITION BY bin) > 0 THEN 100.0*n/sum(n) OVER (PARTITION BY bin) END, 6) AS share FROM tl""")
def category_timeline_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(report(tagged(spark, sf_dir, windows=False), "workflow", "category")["category_timeline"], "share")


@query(with_(TAGGED, EXTENTS) + """SELECT category, workflow, n FROM (SELECT DISTINCT workflow, category FROM ce)
JOIN (SELECT workflow, count(*) AS n FROM ce GROUP BY workflow) USING (workflow)""")
def workflow_category_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.workflow_category_matrix(_extents(spark, sf_dir))


WORKFLOWS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query(with_(TAGGED, EXTENTS, "ex AS (SELECT workflow, count(*) AS n FROM ce GROUP BY workflow)",
             "pr AS (SELECT DISTINCT category, workflow, n FROM ce JOIN ex USING (workflow))") + "SELECT category, "
       + ", ".join(f"""max(CASE WHEN workflow = '{w}' THEN n END) AS "{w}" """ for w in WORKFLOWS)
       + "FROM pr GROUP BY category")
def workflow_category_matrix_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.workflow_category_matrix(_extents(spark, sf_dir), WORKFLOWS)


FREQUENCY = "fq AS (SELECT activity, count(*) AS n FROM ev GROUP BY activity)"
FOLLOWS = f"""{SEQUENCE},
df AS (SELECT src, dst, count(*) AS frequency FROM (SELECT activity AS src, lead(activity) OVER
  (PARTITION BY trace ORDER BY pos) AS dst FROM sq) WHERE dst IS NOT NULL GROUP BY ALL)"""


def _width_sql(value: str, step: str) -> str:
    return f"""CASE WHEN {value} < {step} THEN 0 WHEN {value} < {step}*2 THEN 1
WHEN {value} < {step}*3 THEN 2 ELSE 3 END AS bucket"""


def _count_sql(source: str, value: str) -> str:
    """bk: the rows of a table with their equal-count bucket."""
    return f"""dv AS (SELECT {value}, row_number() OVER (ORDER BY {value} DESC) - 1 AS i, count(*) OVER () AS c
  FROM (SELECT DISTINCT {value} FROM {source})),
bk AS (SELECT s.*, CASE WHEN i < (c//2)//2 THEN 3 WHEN i < c//2 THEN 2 WHEN i < c//2 + (c - c//2)//2 THEN 1
  ELSE 0 END AS bucket FROM {source} s JOIN dv USING ({value}))"""


@query(with_(DAILY, FREQUENCY) + f"SELECT activity, n, {_width_sql('n', '((SELECT max(n) FROM fq)/4)')} FROM fq")
def bucket_equal_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.bucket_equal_width(activity_frequency(daily(spark, sf_dir, windows=False)), "n")


@query(with_(DAILY, AVERAGES) + f"SELECT activity, mean, {_width_sql('mean', '((SELECT max(mean) FROM av)//4)')} FROM av")
def bucket_equal_width_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = activity_averages(daily(spark, sf_dir, windows=False)).select("activity", "mean")
    return B.bucket_equal_width(means, "mean", whole_steps=True)


@query(with_(DAILY, FOLLOWS) + f"""SELECT src, dst, frequency,
{_width_sql('frequency', '((SELECT max(frequency) FROM df)/4)')} FROM df""")
def bucket_equal_width_arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.bucket_equal_width(directly_follows(daily(spark, sf_dir)), "frequency")


@query(with_(DAILY, FREQUENCY, _count_sql("fq", "n")) + "SELECT activity, n, bucket FROM bk")
def bucket_equal_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.bucket_equal_count(activity_frequency(daily(spark, sf_dir, windows=False)), "n")


@query(with_(DAILY, AVERAGES, _count_sql("av", "mean")) + "SELECT activity, mean, bucket FROM bk")
def bucket_equal_count_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = activity_averages(daily(spark, sf_dir, windows=False)).select("activity", "mean")
    return B.bucket_equal_count(means, "mean")


@query(with_(DAILY, FOLLOWS, _count_sql("df", "frequency")) + "SELECT src, dst, frequency, bucket FROM bk")
def bucket_equal_count_arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.bucket_equal_count(directly_follows(daily(spark, sf_dir)), "frequency")


@query(with_(DAILY, FOLLOWS, "st AS (SELECT max(frequency)/4 AS s FROM df)")
       + 'SELECT i AS bucket, s*i AS "low", s*(i+1) AS "high" FROM st, (SELECT unnest(range(4)) AS i)')
def bucket_bounds_equal_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.bounds_equal_width(directly_follows(daily(spark, sf_dir)), "frequency")


@query(with_(DAILY, FOLLOWS, _count_sql("df", "frequency"))
       + """SELECT bucket, coalesce(lag(max(frequency)) OVER (ORDER BY bucket), min(frequency)) AS "low",
max(frequency) AS "high" FROM bk GROUP BY bucket""")
def bucket_bounds_equal_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.bounds_equal_count(B.bucket_equal_count(directly_follows(daily(spark, sf_dir)), "frequency"), "frequency")
