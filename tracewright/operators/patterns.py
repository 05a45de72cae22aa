"""Frequent and infrequent behaviour: connected sets of model arcs and the share of cases they occur in.

A case counts once for a pattern that holds all of its arcs, so cases are first reduced to their sets of
frequent arcs, as bits, and equal sets to one with a weight. Counting a pattern looks up the sets by
its rarest arc, an equi-join, and yields two things at once: the weight of the sets that hold it, and by
the conjunction of their bits its closure, the arcs that all of them hold.

*Largest frequent patterns* grow from closure to closure: arcs that always come along are taken at once,
so the number of rounds is that of different supports on the way, not that of arcs. *Smallest infrequent
patterns* grow arc by arc, but an arc that always comes along is only taken where a further one has to
hang on to it: without it the pattern would be as frequent, so the larger one can not be smallest.

Frequent arcs are numbered on the driver. In each slice there are at most as many as a case has different
arcs on average, divided by the threshold.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions.text import simplify_name
from tracewright.operators.arcs import ARC
from tracewright.operators.variants import VARIANT
from tracewright.plans.ranks import numbered
from tracewright.plans.skew import join_lookup
from tracewright.plans.storage import materialize, store

SLACK = 1e-12  # a threshold is met despite rounding of the quotient
BITS = 63  # arcs in a word of a set


class Graph:
    """Which arcs share an activity; sets of arcs are integers with a bit for each."""

    def __init__(self, arcs: Sequence[tuple[str | None, str | None]]):
        self.arcs = list(arcs)
        self.words = max(1, -(-len(self.arcs) // BITS))
        self.at: dict[str | None, int] = {}
        for i, ends in enumerate(self.arcs):
            for node in ends:
                self.at[node] = self.at.get(node, 0) | 1 << i
        self.near = [self.at[a] | self.at[b] for a, b in self.arcs]

    def members(self, mask: int) -> Iterator[int]:
        while mask:
            low = mask & -mask
            yield low.bit_length() - 1
            mask ^= low

    def around(self, mask: int) -> int:
        """The arcs that share an activity with one of the set, without the set."""
        return reduce(lambda found, i: found | self.near[i], self.members(mask), 0) & ~mask

    def part(self, mask: int, start: int) -> int:
        """What hangs together with `start` within the set."""
        found, new = start, start
        while new:
            new = reduce(lambda f, i: f | self.near[i], self.members(new), 0) & mask & ~found
            found |= new
        return found

    def smaller(self, mask: int) -> Iterator[int]:
        """The connected sets with one arc less."""
        for i in self.members(mask):
            less = mask & ~(1 << i)
            if less and self.part(less, less & -less) == less:
                yield less

    def onward(self, mask: int, closure: int, hook: int) -> Iterator[tuple[int, int]]:
        """Sets with one arc more, and the arc that the next one has to hang on to, or -1.

        An arc of the closure only leads on if it brings a new activity, and only there.
        """
        nodes = {n for i in self.members(mask) for n in self.arcs[i]}
        only = ~0
        if hook >= 0:
            rest = {n for i in self.members(mask & ~(1 << hook)) for n in self.arcs[i]}
            only = reduce(lambda f, n: f | self.at[n], set(self.arcs[hook]) - rest, 0)
        for i in self.members(self.around(mask) & only):
            if not closure >> i & 1:
                yield mask | 1 << i, -1
            elif not set(self.arcs[i]) <= nodes:
                yield mask | 1 << i, i

    def split(self, mask: int) -> list[int]:
        return [mask >> BITS * w & (1 << BITS) - 1 for w in range(self.words)]


def weighted_arc_sets(arcs_of_cases: DataFrame) -> DataFrame:
    """`set_id, arc, weight`: the different sets of arcs, each with the number of cases it stands for.

    Sets are told apart by size and two exclusive-or hashes, so that no set is built in memory.
    """
    items = arcs_of_cases.select(VARIANT, "reps", F.struct(*ARC).alias("arc")).distinct()
    mark = ["_size", "_hash_1", "_hash_2"]
    sets = items.groupBy(VARIANT, "reps").agg(
        F.count("*").alias("_size"),
        *[F.bit_xor(F.xxhash64(F.lit(i), "arc")).alias(f"_hash_{i}") for i in (1, 2)],
    ).groupBy(*mark).agg(F.min(VARIANT).alias("set_id"), F.sum("reps").alias("weight"))
    return items.select(F.col(VARIANT).alias("set_id"), "arc").join(sets.select("set_id", "weight"), "set_id")


def _touches(arc: Column, nodes: Column) -> Column:
    return F.array_contains(nodes, arc["src"]) | F.array_contains(nodes, arc["dst"])


def _ends(arcs: Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(arcs, lambda a: F.array(a["src"], a["dst"]))))


def _connected(arcs: Column) -> Column:
    """Whether the arcs hang together, direction aside: spread from the first one as often as there are arcs."""
    reached = F.aggregate(
        F.sequence(F.lit(1), F.size(arcs)),
        F.array(arcs[0]["src"], arcs[0]["dst"]),
        lambda nodes, _: F.array_union(nodes, _ends(F.filter(arcs, lambda a: _touches(a, nodes)))),
    )
    return F.size(F.array_except(_ends(arcs), reached)) == 0


def _smaller(patterns: DataFrame) -> Column:
    """The connected sets with one arc less."""
    less = F.transform("arcs", lambda a: F.array_except("arcs", F.array(a)))
    return F.filter(less, lambda s: F.when(F.size(s) > 0, _connected(s)).otherwise(False))


def grow_patterns(
    sets: DataFrame, n_cases: int, threshold: float, max_arcs: int | None = None
) -> DataFrame:
    """`arcs, n_arcs, n, support` of every connected set tried: the frequent ones and their extensions.

    Growth ends when no set of the last size is frequent, or at `max_arcs`. Each size is computed
    once and kept in shared storage.
    """
    frequent = F.col("n") >= (threshold - SLACK) * n_cases
    sets = materialize(sets)
    singles = materialize(sets.groupBy("arc").agg(F.sum("weight").alias("n")))
    # the frequent arcs by the nodes they touch
    touching = materialize(singles.where(frequent).select(
        "arc", F.explode(F.array_distinct(F.array("arc.src", "arc.dst"))).alias("node")))
    n_touching = touching.count()
    level = singles.select(F.array("arc").alias("arcs"), "n")
    held = sets.select("set_id", "weight", F.array("arc").alias("arcs"))
    tried, size = level, 1
    while max_arcs is None or size < max_arcs:
        parents = level.where(frequent).select("arcs")
        wider = materialize(
            join_lookup(parents.select("arcs", F.explode(_ends(F.col("arcs"))).alias("node")),
                        touching, ["node"], rows=n_touching)
            .where(~F.array_contains("arcs", F.col("arc")))
            .select(F.sort_array(F.array_append("arcs", F.col("arc"))).alias("_wider"), "arcs", "arc")
            # a set is reached from several parents; one is enough to find where it occurs
            .groupBy("_wider").agg(F.min(F.struct("arcs", "arc")).alias("_from"))
            .select("_wider", "_from.*")
        )
        rows = wider.count()
        if rows == 0:
            break
        held = materialize(
            join_lookup(held, wider, ["arcs"], rows=rows)
            .join(sets.select("set_id", "arc"), ["set_id", "arc"])
            .select("set_id", "weight", F.col("_wider").alias("arcs"))
        )
        level = materialize(held.groupBy("arcs").agg(F.sum("weight").alias("n")))
        tried = tried.unionByName(level)
        size += 1
    return tried.select("arcs", F.size("arcs").alias("n_arcs"), "n", (F.col("n") / n_cases).alias("support"))


def maximal_patterns(tried: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """The sets at or above each threshold that no larger one contains, as `threshold, arcs, support`."""
    rated = tried.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    frequent = rated.where(F.col("support") >= F.col("threshold") - SLACK)
    inside = frequent.select("threshold", F.explode(_smaller(frequent)).alias("arcs")).distinct()
    return frequent.join(inside, ["threshold", "arcs"], "left_anti").select("threshold", "arcs", "support")


def minimal_patterns(tried: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """The sets that occur below each threshold while all connected smaller ones reach it."""
    rated = tried.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    frequent = F.col("support") >= F.col("threshold") - SLACK
    rare = rated.where(~frequent)
    parts = rare.select("threshold", "arcs", F.explode(_smaller(rare)).alias("_part"))
    known = rated.where(frequent).select("threshold", F.col("arcs").alias("_part"))
    broken = parts.join(known, ["threshold", "_part"], "left_anti").select("threshold", "arcs").distinct()
    return rare.join(broken, ["threshold", "arcs"], "left_anti").select("threshold", "arcs", "support")


def _words(name: str, graph: Graph) -> list[str]:
    return [f"{name}{w}" for w in range(graph.words)]


def _derived(
    rows: DataFrame, keys: Sequence[str], graph: Graph, take: Sequence[str], make: Callable[..., Iterable[tuple]],
    masks: Sequence[str], numbers: Sequence[str] = (),
) -> DataFrame:
    """Rows that `make` yields for each row: the keys, then masks, then numbers. `take` are masks or numbers of the row."""
    inputs = [_words(t, graph) if f"{t}0" in rows.columns else [t] for t in take]
    keyed = rows.select(*keys, *[c for of in inputs for c in of])
    key_fields = [f for f in keyed.schema if f.name in keys]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in key_fields],
                        *[f"{c} long" for m in masks for c in _words(m, graph)], *[f"{n} long" for n in numbers]])

    def whole(values: Sequence[int]) -> int:
        return sum(v << BITS * w for w, v in enumerate(values))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns, at, arguments = batch.columns, len(keys), []
            for of in inputs:
                taken = [c.to_pylist() for c in columns[at:at + len(of)]]
                arguments.append([whole(v) for v in zip(*taken, strict=True)] if len(of) > 1 or of[0][-1].isdigit() else taken[0])
                at += len(of)
            owner, out = [], []
            for i, row in enumerate(zip(*arguments, strict=True)):
                for made in make(*row):
                    owner.append(i)
                    out.append([w for m in made[:len(masks)] for w in graph.split(m)] + list(made[len(masks):]))
            pick = pa.array(owner, pa.int64())
            made = list(zip(*out, strict=True)) if out else [()] * (len(masks) * graph.words + len(numbers))
            yield pa.RecordBatch.from_arrays(
                [*[c.take(pick) for c in columns[:len(keys)]], *[pa.array(m, pa.int64()) for m in made]],
                names=[*keys, *[c for m in masks for c in _words(m, graph)], *numbers])

    return keyed.mapInArrow(run, schema)


class Sets:
    """The different sets of frequent arcs of the cases, with their weight, found by any of their arcs."""

    def __init__(self, arcs_of_cases: DataFrame, n_cases: int | DataFrame, least: float, keys: Sequence[str] = ()):
        self.keys, self.least = list(keys), least
        items = store(arcs_of_cases.select(*keys, VARIANT, "reps", *ARC).distinct(), "items")
        self.n_cases = n_cases.select(*keys, "n_cases") if keys else None
        self.total = None if keys else int(n_cases)
        self.singles = store(self.rated(items.groupBy(*keys, *ARC).agg(F.sum("reps").alias("n"))), "single-arcs")
        frequent = self.singles.where(self.reaches(F.col("n"), F.lit(least)))
        # rare ones first: sets are looked up by the lowest bit of a pattern
        rows = frequent.groupBy(*ARC).agg(F.sum("n").alias("n")).orderBy("n", *ARC).collect()
        self.graph = Graph([(r["src"], r["dst"]) for r in rows])
        spark, self.words = items.sparkSession, _words("s", self.graph)
        numbers = spark.createDataFrame(
            [(*arc, i, i // BITS, 1 << i % BITS) for i, arc in enumerate(self.graph.arcs)], "src string, dst string, arc int, _word int, _bit long")
        self.starts = join_lookup(frequent.select(*keys, *ARC), numbers, ARC, rows=len(rows)).select(*keys, "arc")
        known = join_lookup(items, frequent.select(*keys, *ARC), [*keys, *ARC], "left_semi")
        placed = join_lookup(known, numbers, ARC, rows=len(rows))
        masks = placed.groupBy(*keys, VARIANT, "reps").agg(
            *[F.bit_or(F.when(F.col("_word") == i, F.col("_bit")).otherwise(0)).alias(w) for i, w in enumerate(self.words)])
        whole = masks.groupBy(*keys, *self.words).agg(F.sum("reps").alias("weight"))
        held = F.array_compact(F.array(*[
            F.when(F.getbit(self.words[i // BITS], F.lit(i % BITS)) == 1, F.lit(i)) for i in range(len(rows))])) if rows else F.array().cast("array<int>")
        self.by_arc = store(whole.select("*", F.explode(held).alias("_arc")), "arc-sets")

    def rated(self, rows: DataFrame) -> DataFrame:
        """With the number of cases of the slice."""
        return rows.join(self.n_cases, self.keys) if self.keys else rows.withColumn("n_cases", F.lit(self.total).cast("long"))

    @staticmethod
    def reaches(n: Column, threshold: Column) -> Column:
        return n / F.col("n_cases") >= threshold - SLACK

    def counted(self, patterns: DataFrame, rows: int) -> DataFrame:
        """Of masks c: how many cases hold them (n), out of n_cases, and what all of those hold (closure k). None has no row.

        `rows` is the most there can be of them.
        """
        graph, names = self.graph, _words("c", self.graph)
        lowest = F.coalesce(*[F.when(F.col(c) != 0, i * BITS + F.bit_count((F.col(c).bitwiseAND(-F.col(c))) - 1)) for i, c in enumerate(names)])
        wanted = patterns.select(*self.keys, *names).distinct().withColumn("_arc", lowest.cast("int"))
        holds = reduce(lambda a, b: a & b, [F.col(s).bitwiseAND(F.col(c)) == F.col(c) for s, c in zip(self.words, names, strict=True)])
        found = join_lookup(self.by_arc, wanted, [*self.keys, "_arc"], rows=rows).where(holds).groupBy(*self.keys, *names).agg(
            F.sum("weight").alias("n"), *[F.bit_and(s).alias(k) for s, k in zip(self.words, _words("k", graph), strict=True)])
        return store(self.rated(found), "counted")

    def derived(self, rows: DataFrame, take: Sequence[str], make: Callable[..., Iterable[tuple]],
                masks: Sequence[str], numbers: Sequence[str] = ()) -> DataFrame:
        return _derived(rows, self.keys, self.graph, take, make, masks, numbers)

    def named(self, rows: DataFrame, *rest: str) -> DataFrame:
        """`arcs` in order of their names in place of the mask c."""
        names = _words("c", self.graph)
        by_name = sorted(range(len(self.graph.arcs)), key=lambda i: tuple((x is not None, x) for x in self.graph.arcs[i]))
        arcs = F.array_compact(F.array(*[
            F.when(F.getbit(names[i // BITS], F.lit(i % BITS)) == 1, F.struct(*[F.lit(x).alias(e) for e, x in zip(ARC, self.graph.arcs[i], strict=True)]))
            for i in by_name])) if by_name else F.array().cast("array<struct<src:string,dst:string>>")
        return rows.select(*self.keys, arcs.alias("arcs"), *rest)

    def union(self, parts: Sequence[DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionByName, parts)


def closed_patterns(sets: Sets) -> DataFrame:
    """`arcs, n, other, n_cases`: connected closures, with the largest number of cases that hold one arc more.

    A round is one table: candidates counted, with their closures, from which the next ones follow.
    """
    graph, keys, mask, of = sets.graph, sets.keys, _words("c", sets.graph), _words("p", sets.graph)
    around, part, members = graph.around, graph.part, graph.members
    patterns, rows = sets.derived(sets.starts, ["arc"], lambda i: [(1 << i,)], ["c"]), sets.starts.count()

    def onto(c: int, k: int) -> Iterator[tuple[int]]:
        whole = part(k, c)
        return ((whole | 1 << i,) for i in members(around(whole)))

    frequent = sets.reaches(F.col("n"), F.lit(sets.least))
    known: list[DataFrame] = []
    while rows:
        known.append(sets.counted(patterns, rows))
        new = known[-1].where(frequent)
        patterns = sets.derived(new, ["c", "k"], onto, ["c"]).join(sets.union(known), [*keys, *mask], "left_anti")
        rows = new.count() * len(graph.arcs)  # the most there can be
    if not known:
        return sets.named(sets.derived(sets.starts.where("false"), ["arc"], lambda i: [], ["c"], ["n", "other", "n_cases"]), "n", "other", "n_cases")
    counted = sets.union(known)
    whole = sets.derived(counted.where(frequent), ["c", "k", "n", "n_cases"], lambda c, k, n, m: [(part(k, c), n, m)], ["p"], ["n", "n_cases"])
    # the closure itself, then beside each arc more
    wider = sets.derived(whole.distinct(), ["p", "n", "n_cases"], lambda p, n, m: [
        (p, p, n, m), *[(p, p | 1 << i, n, m) for i in members(around(p))]], ["p", "c"], ["n", "n_cases"])
    itself = reduce(lambda a, b: a & b, [F.col(p) == F.col(c) for p, c in zip(of, mask, strict=True)])
    more = wider.withColumn("_itself", itself).join(counted.select(*keys, *mask, F.col("n").alias("_n")), [*keys, *mask], "left")
    largest = more.groupBy(*keys, *of).agg(
        F.max("n").alias("n"), F.coalesce(F.max(F.when(~F.col("_itself"), F.col("_n"))), F.lit(0).cast("long")).alias("other"),
        F.max("n_cases").alias("n_cases")).withColumnsRenamed(dict(zip(of, mask, strict=True)))
    return sets.named(largest, "n", "other", "n_cases")


def rare_patterns(sets: Sets, greatest: float) -> DataFrame:
    """`arcs, n, other, n_cases`: connected sets below `greatest`, with the least number of cases that hold one arc less.

    Holds all that are smallest for a threshold between that of the sets and `greatest`.
    """
    graph, keys, mask = sets.graph, sets.keys, _words("c", sets.graph)
    onward, smaller = graph.onward, graph.smaller
    alone = sets.singles.select(*keys, F.array(F.struct(*ARC)).alias("arcs"), "n", (F.col("n_cases") + 1).alias("other"), "n_cases")
    state, rows = sets.derived(sets.starts, ["arc"], lambda i: [(1 << i, -1)], ["c"], ["hook"]), sets.starts.count()
    tried = []
    while rows:
        counted = sets.counted(state, rows)
        frequent = counted.where(sets.reaches(F.col("n"), F.lit(sets.least))).join(state, [*keys, *mask])
        onto = sets.derived(frequent, ["c", "k", "hook"], lambda c, k, hook: onward(c, k, hook), ["c"], ["hook"])
        # a set that is also reached without a hook needs none
        onto = onto.groupBy(*keys, *mask).agg(F.collect_set("hook").alias("_hooks"))
        hooks = F.when(F.array_contains("_hooks", -1), F.array(F.lit(-1).cast("long"))).otherwise(F.col("_hooks"))
        state = store(onto.select(*keys, *mask, F.explode(hooks).alias("hook")), "growth")
        rows = state.count()
        tried.append(counted if tried else counted.where("false"))  # single arcs are all rated already
    if not tried:
        return alone
    rare = sets.union(tried).where(~sets.reaches(F.col("n"), F.lit(greatest))).select(*keys, *mask, "n", "n_cases")
    parts = store(sets.derived(rare, ["c"], lambda c: [(c, z) for z in smaller(c)], ["p", "c"]), "parts")
    least = parts.join(sets.counted(parts, parts.count()).select(*keys, *mask, "n"), [*keys, *mask]).groupBy(*keys, *_words("p", graph)).agg(
        F.min("n").alias("other")).withColumnsRenamed(dict(zip(_words("p", graph), mask, strict=True)))
    return alone.unionByName(sets.named(rare.join(least, [*keys, *mask]), "n", "other", "n_cases"))


def candidates(
    arcs_of_cases: DataFrame, n_cases: int | DataFrame, thresholds: Sequence[float], kind: str, keys: Sequence[str] = ()
) -> DataFrame:
    """What `pick` finds the patterns of all thresholds from the least to the greatest one in."""
    sets = Sets(arcs_of_cases, n_cases, min(thresholds), keys)
    return closed_patterns(sets) if kind == "frequent" else rare_patterns(sets, max(thresholds))


def pick(found: DataFrame, thresholds: Sequence[float], kind: str, keys: Sequence[str] = ()) -> DataFrame:
    """`threshold, arcs, support`: frequent sets of which none with an arc more is frequent, or infrequent ones of which all with one less are."""
    rated = found.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in sorted(set(thresholds))])))
    own, other = (Sets.reaches(F.col(c), F.col("threshold")) for c in ("n", "other"))
    return rated.where(own & ~other if kind == "frequent" else ~own & other).select(
        *keys, "threshold", "arcs", (F.col("n") / F.col("n_cases")).alias("support"))


def frequent_patterns(
    arcs_of_cases: DataFrame, n_cases: int | DataFrame, threshold: float, max_arcs: int | None = None, keys: Sequence[str] = ()
) -> DataFrame:
    """The largest connected sets of arcs present in at least `threshold` of the cases."""
    return patterns_many(arcs_of_cases, n_cases, [threshold], "frequent", max_arcs, keys)


def infrequent_patterns(
    arcs_of_cases: DataFrame, n_cases: int | DataFrame, threshold: float, max_arcs: int | None = None, keys: Sequence[str] = ()
) -> DataFrame:
    """The smallest connected sets of arcs present in some cases, but less than `threshold` of them."""
    return patterns_many(arcs_of_cases, n_cases, [threshold], "infrequent", max_arcs, keys)


def patterns_many(
    arcs_of_cases: DataFrame, n_cases: int | DataFrame, thresholds: Sequence[float], kind: str = "frequent",
    max_arcs: int | None = None, keys: Sequence[str] = (),
) -> DataFrame:
    """Patterns for several thresholds from a single growth at the lowest of them.

    With `keys`, `n_cases` is a table of the keys and the column `n_cases`. With `max_arcs` only sets of so many
    arcs are grown, one size after the other, and largest means among those.
    """
    if max_arcs is None:
        return pick(candidates(arcs_of_cases, n_cases, thresholds, kind, keys), thresholds, kind, keys)
    if keys:
        raise ValueError("a limit of arcs can not be combined with keys")
    tried = materialize(grow_patterns(weighted_arc_sets(arcs_of_cases), n_cases, min(thresholds), max_arcs))
    choose = {"frequent": maximal_patterns, "infrequent": minimal_patterns}[kind]
    return choose(tried, sorted(set(thresholds)))


def stored_patterns(
    path: str, arcs_of_cases: DataFrame, n_cases: int | DataFrame, thresholds: Sequence[float], kind: str = "frequent",
    keys: Sequence[str] = (),
) -> DataFrame:
    """`patterns_many` of a model whose candidates are kept below `path`, for one log and model.

    What is there is read if it was grown at the least threshold or below (and, for infrequent ones, up to
    the greatest one or above); nothing is grown then. Otherwise growth at the range asked for joined
    with the one there is added, and later calls read that.
    """
    spark, folder = arcs_of_cases.sparkSession, f"{path.rstrip('/')}/{kind}"
    low, high = float(min(thresholds)), float(max(thresholds))
    try:
        there = [(r["low"], r["high"]) for r in spark.read.parquet(folder).select("low", "high").distinct().collect()]
    except AnalysisException:
        there = []
    fits = [(a, b) for a, b in there if a <= low and (kind == "frequent" or b >= high)]
    if not fits:
        low, high = min([low, *[a for a, _ in there]]), max([high, *[b for _, b in there]])
        candidates(arcs_of_cases, n_cases, [low, high], kind, keys).withColumns(
            {"low": F.lit(low), "high": F.lit(high)}).write.mode("append").partitionBy("low", "high").parquet(folder)
        fits = [(low, high)]
    a, b = max(fits)
    found = spark.read.parquet(folder).where((F.col("low") == a) & (F.col("high") == b)).drop("low", "high")
    return pick(found, thresholds, kind, keys)


def pattern_summary(patterns: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Name, size, frequency in percent, weight, and readable nodes and arcs of each pattern.

    Patterns of a threshold are named `Pattern 1`, `Pattern 2`, ... from the most frequent one on, ties by their arcs.
    """
    nodes = F.sort_array(_ends(F.col("arcs")))
    label = lambda a: F.concat(simplify_name(a["src"]), F.lit("->"), simplify_name(a["dst"]))
    n_nodes, n_arcs = F.size(nodes), F.size("arcs")
    placed = numbered(patterns, [F.desc("support"), F.col("arcs")], "_number", by=[*keys, "threshold"])
    return placed.select(
        *keys, "threshold",
        F.concat(F.lit("Pattern "), "_number").alias("name"),
        F.concat_ws(",", F.transform("arcs", label)).alias("pattern"),
        F.concat_ws(",", F.transform(nodes, simplify_name)).alias("nodes"),
        n_nodes.alias("n_nodes"), n_arcs.alias("n_arcs"),
        (n_nodes * 2 + n_arcs).alias("weight"),
        F.round(F.col("support") * 100, 2).alias("frequency"),
    )
