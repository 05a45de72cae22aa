"""The registered queries on the smallest tables, against SQL or brute force."""

import collections
import html
import math
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from tests.oracle import compare, connect
from tracewright import llm
from tracewright.llm.contract import tokenizer_path

QUERIES = llm.queries()


@pytest.fixture(scope="module")
def texts(sf_dir):
    rows = pq.read_table(f"{sf_dir}/documents.parquet").to_pylist()
    return {r["doc_id"]: r["text"] or "" for r in sorted(rows, key=lambda r: r["doc_id"])}


def result(spark, sf_dir, name):
    return [r.asDict() for r in QUERIES[name](spark, sf_dir).collect()]


def ids_of(file, text):
    library = Tokenizer.from_file(tokenizer_path(file))
    return library.encode_batch(text, add_special_tokens=False)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


class Groups:
    """Union-find whose root is the smallest member."""

    def __init__(self, items):
        self.up = {i: i for i in items}

    def root(self, i):
        while self.up[i] != i:
            i = self.up[i]
        return i

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_query_gives_what_its_sql_gives(spark, sf_dir, name):
    assert compare(spark, connect(sf_dir), name, sf_dir) == ""


def test_ten_operators_are_registered():
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES} == set(range(1, 11))


def test_token_records(spark, sf_dir, texts):
    got = {r["doc_id"]: r for r in result(spark, sf_dir, "op1_token_records")}
    at = 0
    for doc, found in zip(texts, ids_of("byte_bpe_50k.json", list(texts.values())), strict=True):
        ids = [*found.ids, 2]
        assert (got[doc]["start"], got[doc]["n_tokens"], got[doc]["ids_crc32"]) == (at, len(ids), crc(ids))
        at += len(ids)
    assert len(got) == len(texts)


def test_packing(spark, sf_dir, texts):
    rows = result(spark, sf_dir, "op10_best_fit_packing")
    got = {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows}
    want = {}
    for doc, found in zip(texts, ids_of("word_bpe_49k.json", list(texts.values())), strict=True):
        ids = [*found.ids, 1]
        for piece, start in enumerate(range(0, len(ids), 4096)):
            part = ids[start:start + 4096]
            want[doc, piece] = (start, len(part), crc(part))
    assert got == want and len(rows) == len(want)
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 4096
    assert len(sequences) <= math.ceil(sum(r["length"] for r in rows) / 4096) + 1


def test_near_duplicates(spark, sf_dir, texts):
    sets = {}
    for doc, text in texts.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
        sets[doc] = set(zip(words, words[1:], strict=False)) if len(words) > 1 else {tuple(words)} if words else set()
    groups, docs = Groups(sets), list(sets)
    for i, a in enumerate(docs):
        for b in docs[i + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                groups.join(a, b)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in result(spark, sf_dir, "op3_tensored_minhash")}
    assert got == {d: (len(sets[d]), groups.root(d), groups.root(d) == d) for d in docs}


def test_fuzzy_lines(spark, sf_dir, texts):
    places = collections.defaultdict(list)
    for doc, text in texts.items():
        for number, line in enumerate(text.split("\n")):
            if len(line) >= 32 and len(plain := " ".join(line.lower().split())) >= 32:
                places[plain].append((doc, number))
    lines = list(places)
    sets = [{x[i:i + 7] for i in range(len(x) - 6)} for x in lines]
    groups, having = Groups(range(len(lines))), collections.defaultdict(list)
    for i, shingles in enumerate(sets):
        both = collections.Counter(j for s in shingles for j in having[s])
        for j, n in both.items():
            if 100 * n >= 80 * (len(shingles) + len(sets[j]) - n):
                groups.join(i, j)
        for s in shingles:
            having[s].append(i)
    removed, components = collections.defaultdict(list), collections.defaultdict(list)
    for i, line in enumerate(lines):
        components[groups.root(i)] += places[line]
    for found in components.values():
        for doc, number in sorted(found)[1:]:
            removed[doc].append(number)
    got = {r["doc_id"]: r["removed_lines"] for r in result(spark, sf_dir, "op4_fuzzy_lines")}
    assert got == {d: ",".join(map(str, sorted(removed[d]))) for d in texts}


def test_language(spark, sf_dir):
    labels = {r["doc_id"]: r["lang"] for r in pq.read_table(f"{sf_dir}/documents.parquet", columns=["doc_id", "lang"]).to_pylist()}
    rows = result(spark, sf_dir, "op5_word_first_language")
    assert len(rows) == len(labels)
    held = [r for r in rows if r["held_out"]]
    assert {r["doc_id"] for r in held} == {d for d in labels if zlib.crc32(str(d).encode()) % 3 == 1}
    assert sum(r["lang_pred"] == labels[r["doc_id"]] for r in held) >= 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_quality(spark, sf_dir, texts):
    got = {r["doc_id"]: r for r in result(spark, sf_dir, "op6_compression_bands")}
    for doc, text in texts.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
        times = collections.Counter(windows)
        repeated = {j for i, w in enumerate(windows) if times[w] > 1 for j in range(i, i + 5)}
        seen, dup = set(), 0
        for line in text.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        failed = len(words) < 10 or 100 * len(repeated) > 20 * len(words)
        row = got[doc]
        assert (row["n_words"], row["word_chars"], row["n_symbols"], row["n_dup_lines"], row["n_repeat_words"], row["base_failed"]) == (
            len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeated), failed)
        assert not (failed and row["kept"])


def test_passages(spark, sf_dir, texts):
    words = {d: re.findall(r"[^\x20\x09-\x0D]+", lower(t)) for d, t in texts.items()}
    times = collections.Counter(tuple(w[i:i + 50]) for w in words.values() for i in range(len(w) - 49))
    want = {}
    for doc, w in words.items():
        spans = []
        for i in range(len(w) - 49):
            if times[tuple(w[i:i + 50])] > 1:
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + 50
                else:
                    spans.append([i, i + 50])
        if spans:
            want[doc] = ",".join(f"{a}-{b}" for a, b in spans)
    assert {r["doc_id"]: r["spans"] for r in result(spark, sf_dir, "op7_sparse_suffix_passages")} == want


def test_page_text(spark, sf_dir):
    got = {r["page_id"]: r for r in result(spark, sf_dir, "op9_tag_ratio_text")}
    for page in pq.read_table(f"{sf_dir}/pages.parquet").to_pylist():
        inner = re.search(r"<article>(.*?)</article>", page["html"] or "", re.S)
        text = re.sub(r"<!--.*?-->", "", inner[1] if inner else "", flags=re.S)
        text = re.sub(r"<[a-zA-Z/][^>]*>", "", re.sub(r"</?(p|h\d|br)\b[^>]*>", " ", text))
        text = " ".join(html.unescape(text).split())
        assert got[page["page_id"]]["text"] == text
        assert got[page["page_id"]]["n_chars"] == len(text)
