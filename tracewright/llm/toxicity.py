"""Toxicity by weak supervision: many voters, a generative model of them, a linear classifier on its posteriors.

Voters fire on words and stems that a sample of labelled texts associates with toxicity, dealt out to
many small lexicons, and on fixed patterns. None of them is trusted as such: the label model estimates
from how often voters fire together, over all texts and without labels, how often each fires on toxic
and on other texts, and which of them depend on each other. Its posterior labels train a
logistic regression on the lexicon entries and votes, which gives the score.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm.batches import text_batches
from tracewright.plans.storage import store

LABELLED = 50_000  # most labelled texts that lexicons are learned from
TRAINED = 40_000  # most texts whose posterior labels the classifier is trained on
LEAST_SHARE = 0.02  # of toxic texts that have an entry
LEAST_LOG_ODDS = 2.0  # of an entry, toxic against other texts
LEAST_Z = 3.5  # the same in standard errors
LEXICONS = 8  # voters that the learned words are dealt to, and the learned stems
PRIOR = 0.1  # share of toxic texts, where no label tells
RATES = (1e-4, 1 - 1e-4)  # least and greatest rate of firing
DEPENDENT = 0.1  # correlation within the classes from which voters count as dependent
THRESHOLD = 0.7  # of the score
PENALTY = 0.5
ROUNDS = 400
STEMS = (4, 5, 6)
NEAR = 50  # words within which two entries make a cluster
DENSE = 0.01  # entries by words

# English words of abuse.
INSULTS = frozenset(
    "bastard clown coward disgusting dumb filth freak fool garbage idiot imbecile jerk loser moron pathetic pig scum "
    "stupid trash ugly useless vermin worthless".split())
_WORD = re.compile(r"[^\W\d_]+")
#: Each with words of which the text needs one, or a simpler pattern that it needs: most texts are done with then.
_PATTERNS = [
    (re.compile(r"\b(?:you|you're|u) (?:are |r )?(?:a|an|all|so|such|nothing)\b", re.I), {"you", "u"}),  # address
    (re.compile(r"\b\w+[*@#$]{2,}\w*"), re.compile(r"[*@#$]{2}")),  # masked words
    (re.compile(r"[!?]{3,}"), re.compile(r"[!?]{3}")),  # agitation
    (re.compile(r"\b[A-Z]{4,}(?:\W+[A-Z]{4,}){2}\b"), re.compile(r"[A-Z]{4}")),  # shouting
    (re.compile(r"\b(?:shut up|get lost|go away|drop dead)\b", re.I), {"shut", "lost", "away", "dead"}),  # dismissal
]
VOTERS = 2 * LEXICONS + 3 + len(_PATTERNS)


def remainder() -> Column:
    """What decides whether a document is held out (1)."""
    return F.crc32(F.col("doc_id").cast("string")) % 3


def _forms(word: str) -> list[str]:
    """The entries that a word may count for: itself and its stems, which end with a dash."""
    return [word, *[f"{word[:n]}-" for n in STEMS if len(word) > n]]


def _words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


class Lexicon(dict):
    """Numbers of entries, and the beginnings that a word needs to count for any."""

    def __init__(self, numbers: dict[str, int]):
        super().__init__(numbers)
        self.beginnings = {form.rstrip("-")[:STEMS[0]] for form in numbers}


def find_entries(words: Counter, lexicon: Lexicon) -> tuple[Counter, set[str]]:
    """How often each entry (by number) occurs, and the words that have any."""
    counts, carriers, first = Counter(), set(), STEMS[0]
    beginnings = lexicon.beginnings
    for word in [w for w in words if w[:first] in beginnings]:
        for form in _forms(word):
            at = lexicon.get(form)
            if at is not None:
                counts[at] += words[word]
                carriers.add(word)
    return counts, carriers


def votes(
    text: str | None, words: Sequence[str], known: Counter, entries: Counter, carriers: set[str], voter_of: Sequence[int]
) -> set[int]:
    """The voters that fire: lexicons by the entries found, then cluster, density, fixed lexicon, patterns."""
    fired = {voter_of[e] for e in entries}
    after = 2 * LEXICONS
    if carriers:
        places = [i for i, w in enumerate(words) if w in carriers]
        if any(b - a <= NEAR for a, b in zip(places, places[1:], strict=False)):
            fired.add(after)
        if len(places) >= DENSE * len(words):
            fired.add(after + 1)
    if not INSULTS.isdisjoint(known):
        fired.add(after + 2)
    if text:
        for i, (pattern, needed) in enumerate(_PATTERNS):
            if (not needed.isdisjoint(known) if isinstance(needed, set) else needed.search(text)) and pattern.search(text):
                fired.add(after + 3 + i)
    return fired


@dataclass(frozen=True)
class LabelModel:
    """Share of toxic texts, rates at which voters fire on toxic and on other texts, correlations within classes."""

    prior: float
    toxic: np.ndarray
    other: np.ndarray
    correlation: np.ndarray

    def evidence(self) -> tuple[np.ndarray, np.ndarray, float]:
        """Log-odds a voter adds if it fires and if not, and those of no voter.

        Voters that depend on each other share their say: each counts one by the sum of its correlations.
        """
        say = 1 / np.abs(self.correlation).sum(axis=1)
        fires = say * np.log(self.toxic / self.other)
        silent = say * np.log((1 - self.toxic) / (1 - self.other))
        return fires, silent, float(np.log(self.prior / (1 - self.prior)))

    def posterior(self, fired: np.ndarray) -> np.ndarray:
        """Probability of toxic, from rows of votes (0 or 1)."""
        fires, silent, start = self.evidence()
        return 1 / (1 + np.exp(-np.clip(start + silent.sum() + fired @ (fires - silent), -40, 40)))


def fit_label_model(together: np.ndarray, n: int, prior: float, rounds: int = 20) -> LabelModel:
    """From the numbers of texts on which two voters fire together, and of all texts.

    Given the class, independent voters i and j have covariance u_i u_j, with u_i the difference of their
    rates in both classes times sqrt(prior (1 - prior)). u is fitted to the correlations of all pairs but
    those found dependent, which are the pairs that the last fit leaves a correlation of; they are found
    and left out in rounds. A voter that never or always fires has equal rates.
    """
    rate = np.diag(together) / max(n, 1)
    covariance = together / max(n, 1) - np.outer(rate, rate)
    spread = np.sqrt(np.maximum(np.diag(covariance), 0))
    live = spread > 0
    scale = np.where(live, spread, 1)
    observed = covariance / np.outer(scale, scale)
    used = np.outer(live, live) & ~np.eye(len(rate), dtype=bool)
    u = np.where(live, np.sqrt(np.clip(np.abs(observed).mean(axis=1), 0.01, 1)), 0.0)
    pairs = used.copy()
    for _ in range(rounds):
        for _ in range(100):  # least squares by turns; only sums over few voters
            weight = used * (u**2)[None, :]
            step = (used * observed * u[None, :]).sum(axis=1) / np.maximum(weight.sum(axis=1), 1e-9)
            u = 0.5 * u + 0.5 * np.clip(step, -0.999, 0.999)
        within = np.sqrt(np.outer(1 - u**2, 1 - u**2))
        residual = np.where(pairs, (observed - np.outer(u, u)) / within, 0)
        left = np.abs(residual) * used
        if left.max() < DEPENDENT:
            break
        # the worst go first: they pull the fit, and with it the others; a voter keeps three to be held against
        fewer = used & (left < max(DEPENDENT, 0.7 * left.max()))
        enough = fewer.sum(axis=1) >= 3
        if (fewer | ~(enough[:, None] & enough[None, :]) & used).sum() == used.sum():
            break
        used = np.where(enough[:, None] & enough[None, :], fewer, used)
    if u[live].sum() < 0:
        u = -u
    odds = np.sqrt((1 - prior) / prior)
    toxic = np.clip(rate + spread * u * odds, *RATES)
    other = np.clip(rate - spread * u / odds, *RATES)
    toxic, other = np.where(live, toxic, 0.5), np.where(live, other, 0.5)
    inside = np.clip(np.where(np.abs(residual) >= DEPENDENT, residual, 0), -1, 1)
    np.fill_diagonal(inside, 1)
    return LabelModel(prior, toxic, other, inside)


def fit_linear(rows: Sequence[tuple[Sequence[int], Sequence[float], float, int]], width: int) -> np.ndarray:
    """Weights of a penalised logistic regression; the last is that of no feature.

    A row has the numbers and values of its features, its label between 0 and 1, and how many texts it stands for.
    """
    if not rows:
        return np.r_[np.zeros(width), np.log(PRIOR / (1 - PRIOR))]
    sizes = np.array([len(r[0]) for r in rows])
    owner = np.repeat(np.arange(len(rows)), sizes)
    column = np.array([i for r in rows for i in r[0]], np.int64)
    value = np.array([v for r in rows for v in r[1]], float)
    label, weight = np.array([r[2] for r in rows]), np.array([r[3] for r in rows], float)
    w = np.r_[np.zeros(width), 0.0]
    # curvature of each weight bounds its step
    curve = np.bincount(column, weight[owner] * value * np.bincount(owner, value, len(rows))[owner], width) / 4 + PENALTY
    step = 1 / np.r_[curve, weight.sum() / 4]
    ahead, momentum = w.copy(), 1.0
    for _ in range(ROUNDS):
        score = np.bincount(owner, value * ahead[column], len(rows)) + ahead[-1]
        error = weight * (1 / (1 + np.exp(-np.clip(score, -40, 40))) - label)
        gradient = np.r_[np.bincount(column, error[owner] * value, width) + PENALTY * ahead[:-1], error.sum()]
        new = ahead - 0.5 * step * gradient
        grown = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead, w, momentum = new + (momentum - 1) / grown * (new - w), new, grown
    return w


@dataclass(frozen=True)
class Model:
    """Entries with their numbers, the voter of each, and weights of entries, then votes, then none."""

    lexicon: Lexicon
    voter_of: list[int]
    label_model: LabelModel
    weights: np.ndarray


def _features(text: str | None, lexicon: Lexicon, voter_of: Sequence[int]) -> tuple[list[int], list[float], set[int]]:
    words = _words(text)
    known = Counter(words)
    entries, carriers = find_entries(known, lexicon)
    fired = votes(text, words, known, entries, carriers, voter_of)
    columns = [*entries, *[len(lexicon) + v for v in fired]]
    return columns, [*[float(np.log1p(n)) for n in entries.values()], *[1.0] * len(fired)], fired


def _count_forms(batches: Iterator[pa.RecordBatch], wanted: frozenset[str] | None) -> Iterator[pa.RecordBatch]:
    """Of batches of texts, how many have each form: of all forms, or of those wanted."""
    for _, texts in text_batches(batches):
        counts = Counter()
        for text in texts:
            forms = {f for w in set(_words(text)) for f in _forms(w)}
            counts.update(forms if wanted is None else forms & wanted)
        yield pa.RecordBatch.from_arrays(
            [pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["form", "n"])


def _forms_of(texts: DataFrame, wanted: frozenset[str] | None = None) -> DataFrame:
    counted = texts.select("text").mapInArrow(lambda b: _count_forms(b, wanted), "form string, n long")
    return counted.groupBy("form").agg(F.sum("n").alias("n"))


def learn_lexicon(texts: DataFrame) -> tuple[Lexicon, float]:
    """Entries that go with toxic texts, numbered in order of the alphabet, and the share of toxic texts.

    `texts` has text and label (0 or 1); equal ones count once. First toxic texts are counted: an entry has to be in LEAST_SHARE of
    them, so there are at most as many as a toxic text has forms on average, divided by that share. Only
    those are counted in the others.
    """
    texts = store(texts.select("text", "label").dropDuplicates(), "labelled-texts")
    sizes = {r["label"]: r["n"] for r in texts.groupBy("label").agg(F.count("*").alias("n")).collect()}
    toxic, other = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic:
        return Lexicon({}), PRIOR
    common = {r["form"]: r["n"] for r in _forms_of(texts.where("label = 1")).where(F.col("n") >= max(2, LEAST_SHARE * toxic)).collect()}
    rest = {r["form"]: r["n"] for r in _forms_of(texts.where("label = 0"), frozenset(common)).collect()}

    def telling(a: int, b: int) -> bool:
        odds = np.log((a + 0.5) / (toxic + 1)) - np.log((b + 0.5) / (other + 1))
        return odds >= LEAST_LOG_ODDS and odds / np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5)) >= LEAST_Z

    chosen = sorted(form for form, a in common.items() if telling(a, rest.get(form, 0)))
    return Lexicon({form: i for i, form in enumerate(chosen)}), min(max(toxic / (toxic + other), 0.001), 0.5)


def deal(lexicon: dict[str, int]) -> list[int]:
    """The voter of each entry, by a hash: words to the first LEXICONS, stems to the next."""
    return [zlib.crc32(form.encode()) % LEXICONS + LEXICONS * form.endswith("-") for form in sorted(lexicon, key=lexicon.get)]


def _count_votes(batches: Iterator[pa.RecordBatch], lexicon: Lexicon, voter_of: list[int]) -> Iterator[pa.RecordBatch]:
    """Of batches of texts, on how many two voters fire together; the number of texts is at (-1, -1)."""
    for _, texts in text_batches(batches):
        fired = [sorted(_features(t, lexicon, voter_of)[2]) for t in texts]
        table = np.zeros((len(texts), VOTERS), np.int64)
        table[np.repeat(np.arange(len(texts)), [len(f) for f in fired]), [v for f in fired for v in f]] = 1
        a, b = np.indices((VOTERS, VOTERS)).reshape(2, -1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.r_[-1, a]), pa.array(np.r_[-1, b]), pa.array(np.r_[len(texts), (table.T @ table).ravel()])], names=["a", "b", "n"])


def _describe(batches: Iterator[pa.RecordBatch], lexicon: Lexicon, voter_of: list[int]) -> Iterator[pa.RecordBatch]:
    for _, texts in text_batches(batches):
        columns, values, fired = zip(*(_features(t, lexicon, voter_of) for t in texts), strict=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float64())),
             pa.array([sorted(f) for f in fired], pa.list_(pa.int32()))], names=["columns", "values", "fired"])


def train(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, trained: int = TRAINED) -> Model:
    """A model from documents (doc_id, text) and labels (doc_id, label).

    Lexicons are learned from at most `labelled` of the documents with a label, those whose id has the
    least hash; of several labels of one document the greatest counts. Votes are counted over all documents. The
    classifier is trained on about `trained` documents at most, chosen by a hash of id and text. No row is
    chosen by where it lies. Without a toxic label there are no learned entries, and voters are the fixed ones.
    """
    chosen = labels.where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled)  # so many rows at most are broadcast
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    lexicon, prior = learn_lexicon(docs.join(F.broadcast(chosen), "doc_id"))
    voter_of = deal(lexicon)
    counted = docs.select("text").mapInArrow(partial(_count_votes, lexicon=lexicon, voter_of=voter_of), "a long, b long, n long")
    together, n = np.zeros((VOTERS, VOTERS)), 0
    for a, b, count in counted.groupBy("a", "b").agg(F.sum("n")).collect():
        if a < 0:
            n = count
        else:
            together[a, b] = count
    label_model = fit_label_model(together, n, prior)
    share = min(1.0, trained / max(n, 1))
    sample = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < int(share * (1 << 20)))
    described = sample.select("text").mapInArrow(
        partial(_describe, lexicon=lexicon, voter_of=voter_of), "columns array<int>, values array<double>, fired array<int>")
    alike = Counter()
    for columns, values, fired in described.toLocalIterator():
        alike[tuple(sorted(zip(columns, values, strict=True))), tuple(fired)] += 1
    rows = []
    for features, fired in sorted(alike):
        vote = np.zeros(VOTERS)
        vote[list(fired)] = 1
        columns, values = zip(*features, strict=True) if features else ((), ())
        rows.append((columns, values, float(label_model.posterior(vote)), alike[features, fired]))
    return Model(lexicon, voter_of, label_model, fit_linear(rows, len(lexicon) + VOTERS))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Per row of `docs` all its columns, `score` (0 to 1) and `predicted` (1 from THRESHOLD on).

    Only text is looked at. A null text counts as an empty one, on which no voter fires. Repeated rows get equal scores; a
    column named as a new one is replaced; no rows give none.
    """
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    schema = docs.select(*kept).schema.add("score", "double").add("predicted", "integer")
    lexicon, voter_of, weights = model.lexicon, model.voter_of, model.weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches):
            raw = []
            for text in texts:
                columns, values, _ = _features(text, lexicon, voter_of)
                raw.append(weights[-1] + (weights[columns] @ np.array(values) if columns else 0.0))
            score = 1 / (1 + np.exp(-np.clip(np.array(raw), -40, 40)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))],
                names=[*batch.schema.names, "score", "predicted"])

    return docs.select(*kept).mapInArrow(run, schema)
