"""Queries that mine all slices of a log in the same jobs.

In their SQL the name of the slice is put before the case and the activity, so that every statement for a
whole log works on all slices at once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.catalog.logs import CASE_ARCS, PADDED, TAGGED, VARIANTS, model, tagged, with_
from tracewright.catalog.model import BINDINGS, CLEAN, FREQUENT, INFREQUENT, LOOPS, LOOSE, PATTERNS, THRESHOLDS
from tracewright.catalog.registry import query
from tracewright.catalog.statistics import rounded
from tracewright.mining import mine
from tracewright.operators import arcs as R
from tracewright.operators import branches as B
from tracewright.operators import loops as L
from tracewright.operators import model as M
from tracewright.operators import patterns as P
from tracewright.operators import variants as V
from tracewright.operators.sequence import case_count
from tracewright.plans.storage import materialize

KEYS = [B.BRANCH]
BRANCHES = [[{"workflow": ["BUILDING", "MACHINERY"]}, {"category": B.SPLIT}], [{"workflow": B.SPLIT}]]
FEW = [[{"workflow": ["BUILDING", "MACHINERY"]}]]

_FEW = """sl AS (SELECT *, '0' AS branch_id FROM tg
  UNION ALL SELECT *, '1.1' FROM tg WHERE workflow IN ('BUILDING', 'MACHINERY')"""
_ALL = _FEW + """ UNION ALL SELECT *, '1.2[category=' || category || ']' FROM tg WHERE workflow IN ('BUILDING', 'MACHINERY')
  UNION ALL SELECT *, '2.1[workflow=' || workflow || ']' FROM tg"""


def _keyed(slices: str, *parts: str, recursive: bool = False) -> str:
    base = [TAGGED.replace("ev AS", "tg AS", 1), slices + ")",
            "ev AS (SELECT branch_id || '~' || trace AS trace, branch_id || '~' || activity AS activity, ts, tf, seq FROM sl)",
            PADDED.replace("'_START_'", "split_part(trace, '~', 1) || '~_START_'").replace("'_END_'", "split_part(trace, '~', 1) || '~_END_'")]
    return with_(*base, *parts, recursive=recursive)


def _of(column: str) -> str:
    return f"split_part({column}, '~', 1)"


def _own(column: str, name: str | None = None) -> str:
    return f"split_part({column}, '~', 2) AS {name or column}"


_LOOPS = LOOPS.replace(
    "SELECT '_START_' AS node, 0 AS depth", "SELECT DISTINCT src AS node, 0 AS depth FROM model WHERE split_part(src, '~', 2) = '_START_'")
_CASES = "bc AS (SELECT split_part(trace, '~', 1) AS b, count(*) AS c FROM cs GROUP BY 1)"
_PATTERNS = PATTERNS.replace("(SELECT count(*) FROM cs)", f"(SELECT c FROM bc WHERE b = (SELECT any_value({_of('src')}) FROM am WHERE (am.bit & gr.mask) <> 0))")
_TOP = f"""tv AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {_of('variant_id')} ORDER BY n DESC, variant_id) AS r,
  sum(n) OVER (PARTITION BY {_of('variant_id')}) AS total FROM vr) WHERE r <= 3)"""


def _slices(spark: SparkSession, sf_dir: str, branches: list = BRANCHES) -> DataFrame:
    return B.tag_branches(tagged(spark, sf_dir), branches)


def _case_arcs(log: DataFrame, threshold: float = LOOSE) -> DataFrame:
    return R.case_arcs(log, materialize(M.dependency_graph(log, threshold, keys=KEYS)), keys=KEYS)


@query(_keyed(_ALL, VARIANTS, _TOP) + f"""SELECT {_of('variant_id')} AS branch_id, {_own('variant_id')}, round(100.0 * n / total, 2) AS percent,
n AS compliant, CAST(total - n AS BIGINT) AS not_compliant FROM tv""")
def run_branches_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The top variants of every slice."""
    return B.run_branches(tagged(spark, sf_dir), BRANCHES, lambda log, keys: V.variant_compliance(log, keys=keys))


@query(_keyed(_ALL, VARIANTS, _TOP) + f"""SELECT {_of('variant_id')} AS branch_id, {_own('variant_id')}, n,
string_agg(split_part(activity, '~', 2), ',' ORDER BY pos) AS activities FROM tv JOIN pad ON pad.trace = variant_id GROUP BY variant_id, n""")
def run_branches_variant_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = B.run_branches(tagged(spark, sf_dir), BRANCHES, lambda log, keys: V.variant_frequency(log, keys=keys))
    return found.select(*KEYS, "variant_id", "n", F.concat_ws(",", "activities").alias("activities"))


@query(_keyed(_ALL, model(LOOSE), CLEAN) + f"""SELECT {_of('src')} AS branch_id, {_own('src')}, {_own('dst')}, f AS frequency,
round(d, 6) AS dependency FROM cl""")
def run_branches_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model of every slice."""
    return rounded(M.discover(_slices(spark, sf_dir), LOOSE, KEYS)["edges"], "dependency")


@query(_keyed(_ALL, model(LOOSE), CLEAN) + f"""SELECT {_of('activity')} AS branch_id, {_own('activity')}, count(*) AS frequency FROM pad
WHERE activity IN (SELECT src FROM cl UNION SELECT dst FROM cl) GROUP BY pad.activity""")
def run_branches_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.discover(_slices(spark, sf_dir), LOOSE, KEYS)["nodes"]


@query(_keyed(_ALL, VARIANTS, model(LOOSE), CASE_ARCS) + f"""SELECT {_of('variant_id')} AS branch_id, {_own('variant_id')}, src_pos, pos,
{_own('src')}, {_own('dst')}, reps FROM ca""")
def run_branches_case_arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The arcs of all variants of every slice, each by the model of its slice."""
    return _case_arcs(_slices(spark, sf_dir))


@query(_keyed(_ALL, VARIANTS, model(LOOSE), CASE_ARCS, BINDINGS) + f"""SELECT {_of('activity')} AS branch_id, {_own('activity')}, side,
regexp_replace(members, '[^,~]*~', '', 'g') AS members, CAST(sum(reps) AS BIGINT) AS n FROM pe GROUP BY ALL""")
def run_branches_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.bindings(materialize(_case_arcs(_slices(spark, sf_dir))), KEYS).withColumn("members", F.concat_ws(",", "members"))


@query(_keyed(_ALL, VARIANTS, model(LOOSE), CASE_ARCS, _LOOPS, "af AS (SELECT src, dst, CAST(sum(reps) AS BIGINT) AS frequency FROM ca GROUP BY ALL)",
              f"tt AS (SELECT {_of('src')} AS b, sum(frequency) AS total FROM af GROUP BY 1)", recursive=True)
       + f"""SELECT {_of('lo.src')} AS branch_id, kind, {_own('lo.src', 'src')}, {_own('lo.dst', 'dst')}, coalesce(frequency, 0) AS frequency,
round(100.0 * coalesce(frequency, 0) / total, 6) AS share
FROM lo LEFT JOIN af ON af.src = lo.src AND af.dst = lo.dst LEFT JOIN tt ON tt.b = {_of('lo.src')}""")
def run_branches_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The loops of every slice and how often they are used."""
    log = _slices(spark, sf_dir)
    found = materialize(M.dependency_graph(log, LOOSE, keys=KEYS))
    used = R.arc_frequency(R.case_arcs(log, found, keys=KEYS), KEYS)
    return rounded(L.loop_share(L.loops(found, KEYS), used, KEYS), "share")


def _patterns_sql(part: str, name: str) -> str:
    limits = f"th AS (SELECT CAST(unnest({THRESHOLDS}) AS DOUBLE) AS threshold)"
    return _keyed(_FEW, VARIANTS, model(), CASE_ARCS, _CASES, _PATTERNS, limits, part, recursive=True) + f"""SELECT
any_value({_of('src')}) AS branch_id, threshold, string_agg(split_part(src, '~', 2) || '->' || split_part(dst, '~', 2), ',' ORDER BY src, dst) AS pattern,
any_value(round(support, 6)) AS support FROM {name} JOIN am ON (mask & bit) <> 0 GROUP BY threshold, mask"""


def _patterns(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    log = _slices(spark, sf_dir, FEW)
    n_cases = materialize(case_count(log, KEYS))
    found = P.patterns_many(_case_arcs(log, M.THRESHOLD), n_cases, THRESHOLDS, kind, keys=KEYS)
    names = F.transform("arcs", lambda a: F.concat(a["src"], F.lit("->"), a["dst"]))
    return found.select(*KEYS, "threshold", F.concat_ws(",", names).alias("pattern"), F.round("support", 6).alias("support"))


@query(_patterns_sql(FREQUENT, "fp"))
def run_branches_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest frequent patterns of every slice."""
    return _patterns(spark, sf_dir, "frequent")


@query(_patterns_sql(INFREQUENT, "ip"))
def run_branches_infrequent_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _patterns(spark, sf_dir, "infrequent")


@query(_keyed(_FEW, VARIANTS, model(), CASE_ARCS, _CASES, _PATTERNS, "th AS (SELECT CAST(0.1 AS DOUBLE) AS threshold)", FREQUENT,
              f"cl AS (SELECT * FROM model WHERE src IN (SELECT src FROM model WHERE src <> dst UNION SELECT dst FROM model WHERE src <> dst))",
              f"fa AS (SELECT src, dst, CAST(sum(reps) AS BIGINT) AS f FROM ca GROUP BY ALL)",
              f"fm AS (SELECT {_of('src')} AS b, max(f) AS top FROM fa GROUP BY 1)", recursive=True)
       + f"""SELECT branch_id, name, CAST(n AS BIGINT) AS n FROM (
SELECT {_of('trace')} AS branch_id, 'events' AS name, count(*) AS n FROM pad GROUP BY 1
UNION ALL SELECT {_of('trace')}, 'traces', count(*) FROM cs GROUP BY 1
UNION ALL SELECT {_of('src')}, 'edges', count(*) FROM cl GROUP BY 1
UNION ALL SELECT {_of('variant_id')}, 'case_arcs', count(*) FROM ca GROUP BY 1
UNION ALL SELECT {_of('variant_id')}, 'variant_durations', count(*) FROM vr GROUP BY 1
UNION ALL SELECT {_of('variant_id')}, 'variant_frequency', least(3, count(*)) FROM vr GROUP BY 1
UNION ALL SELECT {_of('src')}, 'arc_buckets', count(*) FROM fa GROUP BY 1
UNION ALL SELECT b, 'pruned_arcs', count(*) FROM fa JOIN fm ON b = {_of('src')} WHERE f > 0.5 * top GROUP BY 1
UNION ALL SELECT b, 'frequent_patterns', count(*) FROM (SELECT mask, any_value({_of('src')}) AS b FROM fp JOIN am ON (mask & bit) <> 0 GROUP BY mask) GROUP BY 1)""")
def run_branches_mine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the main tables of every slice, mined in the same jobs."""
    tables = mine(tagged(spark, sf_dir), branches=FEW, prune=[0.5], frequent=[0.1])
    names = ("events", "traces", "edges", "case_arcs", "variant_durations", "variant_frequency", "arc_buckets", "pruned_arcs", "frequent_patterns")
    counts = [tables[n].groupBy(*KEYS).agg(F.lit(n).alias("name"), F.count("*").alias("n")) for n in names]
    return reduce(DataFrame.unionByName, counts)
