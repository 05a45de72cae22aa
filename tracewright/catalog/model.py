"""Queries on arcs, loops, models and patterns.

Arcs of cases use a model of a low dependency threshold, so that it holds arcs between activities and
not only those from START and to END.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.catalog.logs import (
    CASE_ARCS, CONVERSATIONS, DAILY, PADDED, RUNS, SEQUENCE, TAGGED, TOP, VARIANTS,
    conversations, daily, model, summary, tagged, with_,
)
from tracewright.catalog.registry import query
from tracewright.catalog.statistics import rounded
from tracewright.mining import mine
from tracewright.operators import arcs as R
from tracewright.operators import loops as L
from tracewright.operators import model as M
from tracewright.operators import patterns as P
from tracewright.operators.activity import activity_frequency
from tracewright.operators.buckets import bucket_equal_width
from tracewright.operators.cases import longest_shortest_case
from tracewright.operators.sequence import case_count
from tracewright.operators.variants import top_variants
from tracewright.plans.storage import materialize, new_path

LOOSE = 0.03
THRESHOLD = 0.05
THRESHOLDS = [0.05, 0.1, 0.3]

FOLLOWS = """df AS (SELECT src, dst, count(*) AS frequency FROM (SELECT activity AS src, lead(activity) OVER
  (PARTITION BY trace ORDER BY pos) AS dst FROM sq) WHERE dst IS NOT NULL GROUP BY ALL)"""
ARCS = (PADDED, VARIANTS, model(LOOSE), CASE_ARCS)


def _model(log: DataFrame, threshold: float = M.THRESHOLD) -> DataFrame:
    return materialize(M.dependency_graph(log, threshold))


def _arcs(log: DataFrame, threshold: float = LOOSE) -> DataFrame:
    return R.case_arcs(log, _model(log, threshold))


@query(with_(DAILY, SEQUENCE, FOLLOWS) + "SELECT * FROM df")
def directly_follows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.directly_follows(daily(spark, sf_dir))


@query(with_(TAGGED) + """SELECT workflow, src, dst, count(*) AS frequency FROM (SELECT workflow, activity AS src,
lead(activity) OVER (PARTITION BY workflow, trace ORDER BY ts, seq) AS dst FROM ev) WHERE dst IS NOT NULL GROUP BY ALL""")
def directly_follows_by_workflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.directly_follows(tagged(spark, sf_dir), ["workflow"])


@query(with_(DAILY, *ARCS) + "SELECT variant_id, src_pos, pos, src, dst, reps FROM ca")
def case_arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _arcs(daily(spark, sf_dir))


@query(with_(DAILY, PADDED, VARIANTS, model(LOOSE)) + """SELECT variant_id, x.pos AS src_pos, y.pos, src, dst, n AS reps
FROM vr JOIN pad x ON x.trace = variant_id JOIN pad y ON y.trace = variant_id AND y.pos = x.pos + 1
JOIN model ON src = x.activity AND dst = y.activity""")
def case_arcs_directly_follows(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = daily(spark, sf_dir)
    return R.case_arcs(log, _model(log, LOOSE), mode="directly_follows")


@query(with_(DAILY, *ARCS) + "SELECT src, dst, CAST(sum(reps) AS BIGINT) AS frequency FROM ca GROUP BY ALL ORDER BY 3 DESC, 1, 2")
def arc_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.arc_frequency(_arcs(daily(spark, sf_dir)))


@query(with_(DAILY, *ARCS, TOP) + """SELECT variant_id, src_pos, pos, src, dst, reps FROM ca
WHERE variant_id IN (SELECT variant_id FROM tv)""")
def variant_arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = daily(spark, sf_dir)
    return R.variant_arcs(log, _model(log, LOOSE), top_variants(log))


@query(with_(DAILY, PADDED, model(LOOSE), "lc AS (SELECT 'longest' AS kind, trace AS variant_id FROM (SELECT trace FROM ends"
             " ORDER BY last_time - first_time DESC, trace LIMIT 1) UNION ALL SELECT 'shortest', trace FROM"
             " (SELECT trace FROM ends ORDER BY last_time - first_time, trace LIMIT 1))",
             "vr AS (SELECT DISTINCT variant_id, 1 AS n FROM lc)", CASE_ARCS)
       + "SELECT kind, variant_id AS trace, src_pos, pos, src, dst FROM ca JOIN lc USING (variant_id)")
def arcs_of_reported_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = daily(spark, sf_dir)
    return R.arcs_of_reported_cases(log, _model(log, LOOSE), longest_shortest_case(log))


@query(with_(DAILY, SEQUENCE, FOLLOWS) + "SELECT * FROM df WHERE frequency > 0.9 * (SELECT max(frequency) FROM df)")
def prune_arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.prune_arcs(R.directly_follows(daily(spark, sf_dir)), 0.9)


@query(with_(DAILY, SEQUENCE, FOLLOWS) + """SELECT CAST(threshold AS DOUBLE) AS threshold, df.* FROM df,
(VALUES (0.5), (0.8), (0.95)) AS t(threshold) WHERE frequency > threshold * (SELECT max(frequency) FROM df)""")
def prune_arcs_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.prune_arcs_many(R.directly_follows(daily(spark, sf_dir)), [0.5, 0.8, 0.95])


@query(with_(DAILY, SEQUENCE, FOLLOWS, "pr AS (SELECT * FROM df WHERE frequency > 0.95 * (SELECT max(frequency) FROM df))")
       + "SELECT src AS activity FROM pr UNION SELECT dst FROM pr")
def prune_arcs_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.arc_nodes(R.prune_arcs(R.directly_follows(daily(spark, sf_dir)), 0.95))


STEPS = """sp AS (SELECT * FROM (SELECT trace, activity AS src, lead(activity) OVER w AS dst, lead(ts) OVER w - tf AS d
  FROM ev WINDOW w AS (PARTITION BY trace ORDER BY ts, seq)) WHERE dst IS NOT NULL)"""


def _step_summary(by: str) -> str:
    """sm: truncation is towards zero, and a step may be negative when events overlap."""
    mean = "CAST(trunc(CAST(sum(d) AS DOUBLE) / count(*)) AS BIGINT)"
    return (f"mn AS (SELECT {by}, {mean} AS m FROM sp GROUP BY {by}),\n"
            f"sm AS (SELECT {by}, {summary('d').replace('sum(d)//count(*)', mean)}"
            f" FROM sp JOIN mn USING ({by}) GROUP BY {by})")


@query(with_(DAILY, STEPS, _step_summary("src, dst")) + "SELECT * FROM sm")
def arc_duration_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.arc_duration_stats(daily(spark, sf_dir)), "deviation", 4)


@query(with_(DAILY, STEPS, _step_summary("trace")) + "SELECT * FROM sm")
def case_step_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.case_step_stats(daily(spark, sf_dir)), "deviation", 4)


@query(with_(DAILY, STEPS, _step_summary("trace")) + """SELECT 'longest' AS kind, * FROM
(SELECT trace, max, min, mean, deviation FROM sm ORDER BY max DESC, trace LIMIT 1) UNION ALL
SELECT 'shortest', * FROM (SELECT trace, max, min, mean, deviation FROM sm ORDER BY min, trace LIMIT 1)""")
def extreme_step_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.extreme_step_cases(daily(spark, sf_dir)), "deviation", 4)


# lo(kind, src, dst)
LOOPS = """bf AS (SELECT '_START_' AS node, 0 AS depth UNION SELECT m.dst, bf.depth + 1 FROM bf JOIN model m ON m.src = bf.node
  WHERE bf.depth < (SELECT count(*) FROM model)),
dp AS (SELECT node, min(depth) AS depth FROM bf GROUP BY node),
re AS (SELECT src AS origin, dst AS node FROM model UNION SELECT re.origin, m.dst FROM re JOIN model m ON m.src = re.node),
lo AS (SELECT 'self' AS kind, src, dst FROM model WHERE src = dst UNION ALL
  SELECT 'return', m.src, m.dst FROM model m LEFT JOIN dp a ON a.node = m.src LEFT JOIN dp b ON b.node = m.dst
  WHERE m.src <> m.dst AND (coalesce(b.depth, 1000000), m.dst) < (coalesce(a.depth, 1000000), m.src)
  AND EXISTS (SELECT 1 FROM re WHERE re.origin = m.dst AND re.node = m.src))"""
TALK = (CONVERSATIONS, PADDED, VARIANTS, model())


@query(with_(*TALK, LOOPS, recursive=True) + "SELECT * FROM lo")
def loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.loops(_model(conversations(spark, sf_dir)))


@query(with_(DAILY, PADDED, model(LOOSE), LOOPS, recursive=True) + "SELECT * FROM lo")
def loops_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.loops(_model(daily(spark, sf_dir), LOOSE))


@query(with_(*TALK, LOOPS, recursive=True) + "SELECT DISTINCT kind, src AS activity FROM lo")
def loop_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.loop_nodes(L.loops(_model(conversations(spark, sf_dir))))


@query(with_(*TALK, CASE_ARCS, LOOPS, "af AS (SELECT src, dst, CAST(sum(reps) AS BIGINT) AS frequency FROM ca GROUP BY ALL)",
             recursive=True) + """SELECT kind, src, dst, coalesce(frequency, 0) AS frequency,
round(100.0 * coalesce(frequency, 0) / (SELECT sum(frequency) FROM af), 6) AS share
FROM lo LEFT JOIN af USING (src, dst)""")
def loop_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = conversations(spark, sf_dir)
    found = _model(log)
    return rounded(L.loop_share(L.loops(found), R.arc_frequency(R.case_arcs(log, found))), "share")


@query(with_(DAILY, PADDED, model()) + "SELECT src, dst, f AS frequency, round(d, 6) AS dependency FROM model")
def dependency_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.dependency_graph(daily(spark, sf_dir)), "dependency")


@query(with_(DAILY, PADDED, model(LOOSE)) + "SELECT src, dst, f AS frequency, round(d, 6) AS dependency FROM model")
def dependency_graph_loose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.dependency_graph(daily(spark, sf_dir), LOOSE), "dependency")


@query(with_(*TALK) + "SELECT src, dst, f AS frequency, round(d, 6) AS dependency FROM model")
def dependency_graph_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.dependency_graph(conversations(spark, sf_dir)), "dependency")


@query(with_(DAILY, PADDED, model()) + "SELECT src, dst, f AS frequency, round(d, 6) AS dependency, round(l2, 6) AS two_step FROM dep")
def dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs with their measures; the two-step measure of an activity with itself is 0."""
    pairs = M.dependencies(daily(spark, sf_dir))
    return rounded(rounded(pairs, "dependency"), "two_step")


BINDINGS = """pe AS (SELECT variant_id, src AS activity, 'out' AS side, src_pos AS pos, any_value(reps) AS reps,
  string_agg(DISTINCT dst, ',' ORDER BY dst) AS members FROM ca GROUP BY ALL
  UNION ALL SELECT variant_id, dst, 'in', pos, any_value(reps), string_agg(DISTINCT src, ',' ORDER BY src) FROM ca
  GROUP BY variant_id, dst, pos)"""


@query(with_(DAILY, *ARCS, BINDINGS) + "SELECT activity, side, members, CAST(sum(reps) AS BIGINT) AS n FROM pe GROUP BY ALL")
def bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    arcs = materialize(_arcs(daily(spark, sf_dir)))
    return M.bindings(arcs).withColumn("members", F.concat_ws(",", "members"))


CLEAN = """cl AS (SELECT * FROM model WHERE src IN
  (SELECT src FROM model WHERE src <> dst UNION SELECT dst FROM model WHERE src <> dst))"""


@query(with_(DAILY, PADDED, model(LOOSE), CLEAN) + "SELECT src, dst, f AS frequency FROM cl")
def clean_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.clean_model(_model(daily(spark, sf_dir), LOOSE)).select("src", "dst", "frequency")


@query(with_(CONVERSATIONS, PADDED, model(), CLEAN) + "SELECT src, dst, f AS frequency, round(d, 6) AS dependency FROM cl")
def discover_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.discover(conversations(spark, sf_dir))["edges"], "dependency")


@query(with_(DAILY, PADDED, model(), CLEAN) + """SELECT activity, count(*) AS frequency FROM pad
WHERE activity IN (SELECT src FROM cl UNION SELECT dst FROM cl) GROUP BY activity""")
def discover_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.discover(daily(spark, sf_dir))["nodes"]


# sp(mask, support): every connected set of arcs that occurs, as bits of arc numbers in am
PATTERNS = """ar AS (SELECT src, dst, row_number() OVER (ORDER BY src, dst) - 1 AS id FROM (SELECT DISTINCT src, dst FROM ca)),
am AS (SELECT x.src, x.dst, CAST(1 AS BIGINT) << x.id AS bit, bit_or(CAST(1 AS BIGINT) << y.id) AS near
  FROM ar x JOIN ar y ON x.src IN (y.src, y.dst) OR x.dst IN (y.src, y.dst) GROUP BY x.src, x.dst, x.id),
st AS (SELECT variant_id, any_value(reps) AS w, bit_or(bit) AS mask FROM ca JOIN am USING (src, dst) GROUP BY variant_id),
sm AS (SELECT mask, sum(w) AS w FROM st GROUP BY mask),
gr AS (SELECT bit AS mask FROM am UNION SELECT gr.mask | am.bit FROM gr JOIN am
  ON (gr.mask & am.bit) = 0 AND (gr.mask & am.near) <> 0),
sp AS (SELECT gr.mask, CAST(sum(w) AS DOUBLE) / (SELECT count(*) FROM cs) AS support
  FROM gr JOIN sm ON (sm.mask & gr.mask) = gr.mask GROUP BY gr.mask)"""
# fp(threshold, mask, support) and ip(...)
_LIMITS = "th AS (SELECT CAST(unnest([{}]) AS DOUBLE) AS threshold)"
FREQUENT = """fp AS (SELECT threshold, p.mask, p.support FROM sp p, th WHERE p.support >= threshold - 1e-12 AND NOT EXISTS
  (SELECT 1 FROM sp q WHERE q.support >= threshold - 1e-12 AND q.mask <> p.mask AND (q.mask & p.mask) = p.mask))"""
INFREQUENT = """ra AS (SELECT threshold, mask, support FROM sp, th WHERE support < threshold - 1e-12),
ip AS (SELECT * FROM ra p WHERE NOT EXISTS (SELECT 1 FROM ra q WHERE q.threshold = p.threshold
  AND q.mask <> p.mask AND (q.mask & p.mask) = q.mask))"""
DEFAULT_ARCS = (DAILY, PADDED, VARIANTS, model(), CASE_ARCS, PATTERNS)


def _patterns_sql(kind: str, limits: list[float]) -> str:
    part, name = {"frequent": (FREQUENT, "fp"), "infrequent": (INFREQUENT, "ip")}[kind]
    return with_(*DEFAULT_ARCS, _LIMITS.format(", ".join(map(str, limits))), part, recursive=True) + f"""SELECT threshold,
string_agg(src || '->' || dst, ',' ORDER BY src, dst) AS pattern, any_value(round(support, 6)) AS support
FROM {name} JOIN am ON (mask & bit) <> 0 GROUP BY threshold, mask"""


def _patterns(spark: SparkSession, sf_dir: str, kind: str, limits: list[float]) -> DataFrame:
    log = daily(spark, sf_dir)
    arcs = _arcs(log, M.THRESHOLD)
    return P.patterns_many(arcs, case_count(log).first()["n_cases"], limits, kind)


def _scalar(patterns: DataFrame) -> DataFrame:
    names = F.transform("arcs", lambda a: F.concat(a["src"], F.lit("->"), a["dst"]))
    return patterns.select("threshold", F.concat_ws(",", names).alias("pattern"), F.round("support", 6).alias("support"))


@query(_patterns_sql("frequent", [THRESHOLD]))
def frequent_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scalar(_patterns(spark, sf_dir, "frequent", [THRESHOLD]))


@query(_patterns_sql("infrequent", [THRESHOLD]))
def infrequent_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scalar(_patterns(spark, sf_dir, "infrequent", [THRESHOLD]))


@query(_patterns_sql("frequent", THRESHOLDS))
def patterns_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scalar(_patterns(spark, sf_dir, "frequent", THRESHOLDS))


@query(_patterns_sql("infrequent", THRESHOLDS))
def patterns_many_infrequent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scalar(_patterns(spark, sf_dir, "infrequent", THRESHOLDS))


@query(_patterns_sql("frequent", [0.1, 0.3]))
def stored_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grown and kept at a low threshold, then read at higher ones."""
    log, path = daily(spark, sf_dir), new_path(spark, "patterns")
    arcs, n_cases = materialize(_arcs(log, M.THRESHOLD)), case_count(log).first()["n_cases"]
    P.stored_patterns(path, arcs, n_cases, [THRESHOLD])
    return _scalar(P.stored_patterns(path, arcs, n_cases, [0.1, 0.3]))


@query(with_(*DEFAULT_ARCS, _LIMITS.format(THRESHOLD), FREQUENT,
             """nd AS (SELECT DISTINCT mask, unnest([src, dst]) AS node FROM fp JOIN am ON (mask & bit) <> 0)""",
             "ns AS (SELECT mask, count(*) AS n_nodes, string_agg(node, ',' ORDER BY node) AS nodes FROM nd GROUP BY mask)",
             """su AS (SELECT threshold, any_value(support) AS support, list({'src': src, 'dst': dst} ORDER BY src, dst) AS arcs,
  string_agg(src || '->' || dst, ',' ORDER BY src, dst) AS pattern,
any_value(nodes) AS nodes, any_value(n_nodes) AS n_nodes, count(*) AS n_arcs, 2*any_value(n_nodes) + count(*) AS weight
FROM fp JOIN am ON (mask & bit) <> 0 JOIN ns USING (mask) GROUP BY threshold, mask)""",
             recursive=True) + """SELECT threshold, 'Pattern ' || row_number() OVER (PARTITION BY threshold ORDER BY support DESC, arcs) AS name,
pattern, nodes, n_nodes, n_arcs, weight, round(support*100, 2) AS frequency FROM su""")
def pattern_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.pattern_summary(_patterns(spark, sf_dir, "frequent", [THRESHOLD]))


@query(with_(DAILY, *ARCS, TOP) + """SELECT src, dst, f AS frequency, (src, dst) IN
(SELECT (src, dst) FROM ca WHERE variant_id IN (SELECT variant_id FROM tv)) AS in_pattern FROM model""")
def highlight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model arcs that the most frequent variants take."""
    log = daily(spark, sf_dir)
    edges = _model(log, LOOSE)
    return M.highlight(edges, R.variant_arcs(log, edges, top_variants(log))).select(
        "src", "dst", "frequency", "in_pattern")


@query(with_(*DEFAULT_ARCS, _LIMITS.format(THRESHOLD), FREQUENT,
             """pt AS (SELECT threshold, mask, string_agg(src || '->' || dst, ',' ORDER BY src, dst) AS pattern
  FROM fp JOIN am ON (mask & bit) <> 0 GROUP BY threshold, mask)""", recursive=True) + """SELECT m.src, m.dst,
m.f AS frequency, pt.threshold, pt.pattern FROM model m LEFT JOIN am ON am.src = m.src AND am.dst = m.dst
LEFT JOIN pt ON (pt.mask & am.bit) <> 0""")
def highlight_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each frequent pattern on the arcs of the model."""
    log = daily(spark, sf_dir)
    edges = _model(log)
    found = P.patterns_many(R.case_arcs(log, edges), case_count(log).first()["n_cases"], [THRESHOLD])
    names = F.transform("arcs", lambda a: F.concat(a["src"], F.lit("->"), a["dst"]))
    return M.highlight_patterns(edges, found).select(
        "src", "dst", "frequency", "threshold", F.array_join(names, ",").alias("pattern"))


@query(with_(DAILY, PADDED, model(), CLEAN, "nf AS (SELECT activity, count(*) AS n FROM ev GROUP BY activity)",
             "sw AS (SELECT max(n) / 4.0 AS step FROM nf)") + """SELECT activity, n,
CASE WHEN n < step THEN 0 WHEN n < step*2 THEN 1 WHEN n < step*3 THEN 2 ELSE 3 END AS bucket
FROM nf, sw WHERE activity IN (SELECT src FROM cl UNION SELECT dst FROM cl)""")
def bucket_kept_activities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only activities of the model, by steps of the most frequent one of all."""
    log = daily(spark, sf_dir)
    return bucket_equal_width(activity_frequency(log), "n", kept=R.arc_nodes(M.clean_model(_model(log))))


@query(with_(DAILY, *ARCS, TOP, "mk AS (SELECT src, dst FROM ca WHERE variant_id IN (SELECT variant_id FROM tv))",
             CLEAN) + """SELECT activity, count(*) AS frequency,
activity IN (SELECT src FROM mk UNION SELECT dst FROM mk) AS in_pattern
FROM pad WHERE activity IN (SELECT src FROM model UNION SELECT dst FROM model) GROUP BY activity""")
def highlight_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = daily(spark, sf_dir)
    edges = _model(log, LOOSE)
    return M.highlight_nodes(M.model_nodes(log, edges), R.variant_arcs(log, edges, top_variants(log)))


@query(with_(DAILY.replace("ev AS (SELECT", "e0 AS (SELECT", 1), RUNS.replace("FROM ev", "FROM e0"),
             "ev AS (SELECT * FROM runs)", PADDED, VARIANTS, model(), CASE_ARCS)
       + """SELECT 'events' AS name, count(*) AS n FROM pad UNION ALL SELECT 'traces', count(*) FROM cs
UNION ALL SELECT 'edges', count(*) FROM model WHERE src <> dst UNION ALL SELECT 'case_arcs', count(*) FROM ca
UNION ALL SELECT 'variant_durations', count(*) FROM vr UNION ALL SELECT 'case_extents', count(*) FROM cs
UNION ALL SELECT 'activity_durations', count(DISTINCT activity) FROM ev
UNION ALL SELECT 'variant_frequency', least(3, count(*)) FROM vr UNION ALL SELECT 'longest_shortest_case', 2""")
def mine_table_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the main tables of a log mined with runs collapsed."""
    tables = mine(daily(spark, sf_dir), group=True)
    names = ("events", "traces", "edges", "case_arcs", "variant_durations", "case_extents", "activity_durations",
             "variant_frequency", "longest_shortest_case")
    counts = [tables[n].agg(F.lit(n).alias("name"), F.count("*").alias("n")) for n in names]
    return reduce(DataFrame.unionByName, counts)
