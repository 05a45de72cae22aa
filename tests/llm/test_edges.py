"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns for every operator."""

import random

import numpy as np
import pyarrow.fs
import pytest
from pyspark.sql import functions as F

from tracewright.llm import (
    decontamination, html_text, language, linking, lines, minhash, packing, passages, quality, records, tool_calls)
from tracewright.llm.contract import tokenizer_path
from tracewright.llm.fm_index import FMIndex, suffix_array
from tracewright.plans.storage import new_path, store

DRAW = random.Random(5)
WORDS = ["".join(DRAW.choices("abcdefghijklmnop", k=DRAW.randrange(2, 9))) for _ in range(900)]


def prose(n, seed):
    draw = random.Random(seed)
    return " ".join(draw.choice(WORDS) for _ in range(n))


LONG = prose(60_000, 1)
ODD = [(1, None), (2, ""), (3, " \n\t"), (None, "no id here"), (5, "12 34 --"), (6, "x"), (6, "x"), (6, "y"), (7, LONG)]


@pytest.fixture
def odd(make_docs):
    return make_docs(*ODD)


@pytest.fixture
def none(make_docs):
    return make_docs(*ODD).limit(0)


def rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def test_records(spark, odd, none):
    path = new_path(spark, "records")
    manifest = records.write_records(odd, path, tokenizer_path("byte_bpe_50k.json"), 2, max_file_bytes=20_000)
    got = records.read_records(manifest).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, 1, 2, 3, 5, 6, 6, 6, 7]
    assert [r["start"] for r in got] == np.cumsum([0] + [r["n_tokens"] for r in got[:-1]]).tolist()
    assert [r["n_tokens"] for r in got][1:3] == [1, 1]
    assert np.frombuffer(got[1]["ids"], "<u4").tolist() == [2]
    assert records.read_records(records.write_records(none, new_path(spark, "records"), tokenizer_path("byte_bpe_50k.json"), 2)).count() == 0
    stem = manifest.first()["path"]
    fs, local = pyarrow.fs.FileSystem.from_uri(stem + ".bin")
    data = bytearray(fs.open_input_file(local).read())
    data[-6] ^= 1
    with fs.open_output_stream(local) as out:
        out.write(bytes(data))
    with pytest.raises(Exception, match="damaged"):
        records.read_records(manifest).collect()


def test_frames_tell_damage():
    data = records.frame(b"abc")
    assert bytes(records.unframe(memoryview(data), 0)) == b"abc"
    for i in range(len(data)):
        with pytest.raises(ValueError, match="damaged"):
            records.unframe(memoryview(data[:i] + bytes([data[i] ^ 4]) + data[i + 1:]), 0)


def test_packing(odd, none):
    pieces = store(packing.cut_pieces(odd, tokenizer_path("word_bpe_49k.json"), 1), "pieces")
    got = packing.pack(pieces)
    assert got.count() == pieces.count()
    assert got.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").count() == 0
    assert packing.pack(store(packing.cut_pieces(none, tokenizer_path("word_bpe_49k.json"), 1), "pieces")).count() == 0


def test_packing_across_shards(spark):
    """Shards whose last bins are half empty share them."""
    pieces = spark.range(400).select(
        (F.col("id") % 40).alias("shard"), (F.col("id") / 40).cast("int").alias("item"), F.lit(900).cast("long").alias("length"))
    got = packing.pack(store(pieces, "pieces"))
    assert got.select("sequence_id").distinct().count() == 100


def test_genetic_search_improves_on_best_fit():
    draw = random.Random(2)
    sizes = []
    for _ in range(40):  # bins that can be filled exactly
        cuts = sorted(draw.sample(range(1, 1000), 2))
        sizes += [cuts[0], cuts[1] - cuts[0], 1000 - cuts[1]]
    falling = packing.fit(sizes, sorted(range(len(sizes)), key=lambda i: -sizes[i]), 1000)
    found = packing.evolve(sizes, 1000, 1, [], children=200)
    assert sorted(i for b in found for i in b) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in b) <= 1000 for b in found)
    assert 40 <= len(found) <= len(falling)


def test_crossover_keeps_every_piece():
    sizes = [random.Random(i).randrange(1, 60) for i in range(80)]
    a, b = packing.fit(sizes, list(range(80)), 100), packing.fit(sizes, list(range(79, -1, -1)), 100)
    child = packing.crossover(a, b, sizes, 100, random.Random(1))
    assert sorted(i for x in child for i in x) == list(range(80))


def test_near_duplicates(make_docs, none):
    base = prose(200, 9).split()
    near = [" ".join([*base[:i], "changed", *base[i + 1:]]) for i in (20, 60, 90)]
    docs = make_docs(*ODD, (20, " ".join(base)), (11, near[0]), (None, near[1]), (15, near[2]), (15, near[2]), (30, prose(200, 10)))
    got = rows(minhash.near_duplicates(docs), "doc_id", "n_shingles", "component_id")
    assert sorted(r[2] for r in got if r[1] == 196) == [11] * 5 + [30]
    assert [r[2] for r in got if r[1] == 0] == [1, 2, 3]
    kept = rows(minhash.keep_one(docs), "doc_id", "text")
    assert [r[0] for r in kept if r[1] in near or r[1] == " ".join(base)] == [11]
    # the shared text of document 6 is one group with one row, its other text another one
    assert sum(r[1] == "x" for r in kept) == 1 and len(kept) == 10
    assert minhash.keep_one(docs).columns == docs.columns
    assert minhash.near_duplicates(none).count() == 0 and minhash.keep_one(none).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(200, i) for i in range(100, 180)] + [(7, 7), (None, 3)]
    got = dict(rows(linking.connected_components(spark.createDataFrame(edges, "a long, b long")), "node", "root"))
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in [*range(100, 180), 200]}}


def test_every_pair_of_a_bucket_that_links_is_found(spark):
    """Members that are unlike their leader find each other by their rare tokens."""
    keys = spark.createDataFrame([(1, i) for i in range(40)] + [(1, 5)] + [(2, i) for i in range(40, 44)], "key long, rid long")
    # a core that all share, and a tenth that those with the same remainder share
    tokens = spark.range(44).selectExpr("id as rid", "explode(sequence(0, 99)) as t").selectExpr(
        "rid", "case when t < 75 then t when t < 95 then 1000 * (rid % 8 + 1) + t else 100000 * (rid + 1) + t end as token")
    tested = []

    def verify(pairs):
        tested.extend(tuple(r) for r in pairs.collect())
        return pairs.where("a % 8 = b % 8")

    got = dict(rows(linking.group_similar(keys, verify, lambda items: tokens.join(items, "rid", "left_semi"), 80), "node", "root"))
    assert got == {i: i % 8 if i < 40 else i - 40 for i in range(44)}  # 40 to 43 share 95 of 105 tokens with 0 to 3
    assert len(tested) == len(set(tested)) < 300


def test_frequent_tokens_of_unlike_sets_make_no_pairs(spark):
    """Every token is in many sets, so a join on tokens alone gives all 1,770 pairs."""
    sets = [random.Random(i).sample(range(300), 60) for i in range(59)]
    sets.append([*sets[0][:57], 301, 302, 303])  # 57 of 63 are shared
    tokens = spark.createDataFrame([(i, t) for i, s in enumerate(sets) for t in s], "rid long, token long")
    none = spark.createDataFrame([], "node long, root long")
    assert rows(linking.rare_token_pairs(tokens, none, 80), "a", "b") == [(0, 59)]
    same = spark.createDataFrame([(0, 0), (59, 0)], "node long, root long")
    assert rows(linking.rare_token_pairs(tokens, same, 80), "a", "b") == []


def test_parities_never_differ_more_than_sets():
    draw = random.Random(4)
    for _ in range(200):
        a = {draw.randrange(1 << 63) for _ in range(draw.randrange(1, 200))}
        b = {x for x in a if draw.random() < 0.9} | {draw.randrange(1 << 63) for _ in range(draw.randrange(0, 20))}
        pa, pb = (minhash.parity(np.array(sorted(x), np.uint64)).view(np.uint64) for x in (a, b))
        assert sum(int(x).bit_count() for x in pa ^ pb) <= len(a ^ b)


def test_groups_joined_by_later_links(spark):
    """Links found in a later round join whole groups found before."""
    keys = spark.createDataFrame([(1, 1), (1, 5), (2, 2), (2, 6), (3, 5), (3, 6), (4, 6), (4, 9)], "key long, rid long")
    got = dict(rows(linking.group_similar(keys, lambda p: p, lambda items: None, 80), "node", "root"))
    assert got == {i: 1 for i in (1, 2, 5, 6, 9)}


def test_shared_keys_over_partitions(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        keys = spark.range(3000).select(F.when(F.col("id") < 2500, 7).otherwise(F.col("id")).alias("key").cast("long"), F.col("id").alias("rid"))
        found = linking.share_keys(keys.repartition(5)).distinct()
        assert found.select("key").distinct().count() == 1
        assert found.select("rid").distinct().count() == 2500
        # leaders of the other partitions follow the first
        assert found.where("rid = leader or leader = 0").where("leader = 0").count() >= 1250
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_lines(make_docs, odd, none):
    line = "This line is certainly long enough to be held against others."
    docs = make_docs((2, f"one\n{line}\ntwo"), (1, f"{line}\nshort\nshort"), (3, f"{line.replace('others', 'any').upper()}\n{line}"),
                     (None, "alone"), (4, None), (5, ""), extra="removed")
    got = {r["doc_id"]: r for r in lines.dedup_lines(docs).collect()}
    assert got[1]["text"] == f"{line}\nshort\nshort" and got[1]["removed"] == []
    assert got[2]["text"] == "one\ntwo" and got[2]["removed"] == [1]
    assert got[3]["text"] == "" and got[3]["removed"] == [0, 1]
    assert got[None]["text"] == "alone" and got[4]["text"] is None and got[5]["text"] == ""
    assert lines.dedup_lines(odd).count() == len(ODD)
    assert lines.dedup_lines(none).count() == 0


def test_long_lines_are_hashed_in_parts(monkeypatch):
    text = LONG[:5000]
    whole = lines.signatures([text, "x" * 40])
    monkeypatch.setattr(lines, "BLOCK_CHARS", 300)
    assert (lines.signatures([text, "x" * 40]) == whole).all()


def test_language(odd, none, make_docs):
    model = language.train(language.sample_labelled(odd))
    got = {r["text"]: (r["lang_pred"], r["score"]) for r in language.predict(odd, model).collect()}
    assert got[None] == got[""] == got["12 34 --"] == ("und", 0.0)
    assert got["x"][0] == "en"
    empty = language.train(language.sample_labelled(none))
    assert {r["lang_pred"] for r in language.predict(odd, empty).collect()} == {"und"}
    assert language.predict(none, model).count() == 0
    assert "score" in language.predict(odd, model).columns and language.predict(odd, model).count() == len(ODD)


def test_words_come_before_grams():
    index = [{"the": 0}, {"t": 0}, {}, {}, {}, {}]
    model = language.Model(["a", "b"], index, [np.array([[-1.0, -9.0]]), np.array([[-9.0, -1.0]]), *[np.zeros((0, 2))] * 4])
    assert model.predict("the")[0] == "a"
    assert model.predict("tttt")[0] == "b"
    assert model.predict("???") == ("und", 0.0)


def test_quality(odd, none):
    got = rows(quality.judge(odd), "doc_id", "n_words", "base_failed", "kept")
    assert (1, 0, True, False) in got and (7, 60_000, False, True) in got and len(got) == len(ODD)
    assert quality.judge(none).count() == 0


def test_bands():
    import zstandard

    z = zstandard.ZstdCompressor(level=quality.LEVEL)
    noise = random.Random(1)
    jumble = " ".join("".join(chr(noise.randrange(0x4E00, 0x9FFF)) for _ in range(6)) for _ in range(2000))
    assert quality.measure(prose(3000, 4), z)[-1]
    assert not quality.measure(jumble, z)[-1]
    half = prose(400, 3) + "".join(f" item {i % 3} {'z' * (i % 7)}" for i in range(4000))
    assert not quality.measure(half, z)[-1]
    assert quality.chunks(b"x" * 5000, 2048) == [b"x" * 2048, b"x" * 2952]
    assert quality.repeated_words("a b c d e x a b c d e".split()) == 10


def test_html(spark):
    page = ("<html><body class='has-sidebar'><header><h1>Site</h1></header><div id='cookie-bar'>We use cookies " + "x " * 90
            + "</div><div class='content'><h2>A title</h2><p>" + prose(90, 1) + "<p>Short.<p>" + prose(120, 2)
            + " &amp; more</div><div class='comments'><p>" + prose(80, 3) + "</p></div><footer>" + prose(60, 4) + "</footer></body></html>")
    want = f"A title {prose(90, 1)} Short. {prose(120, 2)} & more"
    pages = spark.createDataFrame(
        [(1, "u", page, "t"), (2, None, None, "t"), (3, "v", "", "t"), (None, "w", "<p>", "t"), (5, "x", "plain &lt;text", "t"),
         (5, "x", "plain &lt;text", "t"), (6, "y", "<div>" * 3000 + "deep", "t")], "page_id long, url string, html string, text string")
    got = html_text.extract(pages).collect()
    assert [r["text"] for r in got] == [want, "", "", "", "plain <text", "plain <text", "deep"]
    assert [r["n_chars"] for r in got] == [len(r["text"]) for r in got]
    assert html_text.extract(pages.limit(0)).count() == 0


def test_decontamination(spark, make_docs, odd, none):
    passage = prose(30, 20)
    benchmark = spark.createDataFrame(
        [(10, passage), (9, passage.upper()), (2, "tiny item"), (None, prose(12, 21)), (4, None), (5, "")], "item_id long, text string")
    docs = make_docs((1, f"{prose(50, 1)} {passage}! And {prose(40, 2)}"), (2, "a Tiny, ITEM; tiny"), (3, prose(12, 21)), (4, None),
                     (5, " ".join(passage.split()[5:15])), (6, " ".join(passage.split()[5:14])), extra="spans")
    blocks = {}
    for size in (1 << 20, 200):
        found = decontamination.find(docs, benchmark, block_bytes=size)
        blocks[size] = {r["doc_id"]: ([tuple(s) for s in r["spans"]], r["item_ids"]) for r in found.collect()}
    got = blocks[200]
    assert got == blocks[1 << 20]
    assert got == {1: ([(50, 80)], ["10", "9"]), 2: ([(1, 3)], ["2"]), 3: ([(0, 12)], []), 4: ([], []),
                   5: ([(0, 10)], ["10", "9"]), 6: ([], [])}
    clean = {r["doc_id"]: r["text"] for r in decontamination.remove(decontamination.find(docs, benchmark)).collect()}
    assert clean[1] == f"{prose(50, 1)} ! And {prose(40, 2)}" and clean[2] == "a ; tiny" and clean[4] is None
    assert decontamination.find(odd, benchmark.limit(0)).where("size(spans) > 0").count() == 0
    assert decontamination.find(none, benchmark).count() == 0


def test_fm_index_finds_every_occurrence():
    draw = np.random.default_rng(1)
    for size in (2, 5, 40):
        text = draw.integers(0, size, 300)
        assert suffix_array(text).tolist() == sorted(range(300), key=lambda i: text[i:].tolist())
        index = FMIndex(text, size)
        patterns = draw.integers(1, size, (50, 3)) if size > 1 else np.ones((50, 3), int)
        low, high = index.search(patterns, np.full(50, 3))
        for p, a, b in zip(patterns, low, high, strict=True):
            want = [i for i in range(298) if (text[i:i + 3] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_passages(make_docs, odd, none):
    shared, exactly = prose(80, 30), prose(50, 31)
    docs = make_docs((1, f"{prose(70, 1)} {shared} {prose(40, 2)}"), (2, f"{shared} {prose(90, 3)}"), (3, exactly), (4, f"{exactly} x"),
                     (5, " ".join(exactly.split()[1:])), (6, None), (None, shared), (7, prose(300, 8)), extra="spans")
    got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in passages.repeated_passages(docs).collect()}
    assert got == {1: [(70, 150)], 2: [(0, 80)], 3: [(0, 50)], 4: [(0, 50)], None: [(0, 80)]}
    assert passages.repeated_passages(odd).count() == 0
    assert passages.repeated_passages(none).count() == 0


def test_passages_at_partition_borders(spark, make_docs):
    """The same rows with neighbours in many partitions."""
    shared = prose(120, 40)
    docs = make_docs(*[(i, f"{prose(20, i)} {shared} {prose(20, i + 100)}") for i in range(30)])
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        got = {tuple(s) for r in passages.repeated_passages(docs).collect() for s in r["spans"]}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "2")
    assert got == {(20, 140)}


CALLS = "conv_id long, turn long, role string, content string, call_id string, name string, arguments string, refs array<string>, status string"


@pytest.fixture
def tools(spark):
    return spark.createDataFrame(
        [("f", "a", "integer", True), ("f", "b", "string", False), ("g", "x", "number", True), ("g", "o", "object", False)],
        "name string, param string, type string, required boolean")


def test_tool_calls(spark, tools):
    def call(turn, call_id, name, arguments, refs=None, conv=1):
        return (conv, turn, "assistant", None, call_id, name, arguments, refs, "s")

    def answer(turn, call_id, conv=1):
        return (conv, turn, "tool", "r", call_id, None, None, None, "s")

    messages = spark.createDataFrame([
        call(1, "p", "f", '{"b": "é\\n", "a": 1}', ["q"]), call(2, "q", "g", '{"x": 2, "o": {"z": 1, "y": [1, "2"]}}'),
        call(3, "r", "f", '{"a": "1"}', ["p", "q"]), call(4, "s", "g", "not json", ["t"]), call(5, "t", "h", "{}", ["s", "s"]),
        call(6, "p", "f", '{"a": 1, "c": 2}'), call(7, None, "f", None), call(8, "u", "g", "[1]", ["missing"]), call(9, "v", "f", '{"b": null}', ["t"]),
        answer(10, "p"), answer(10, "p"), answer(0, "q"), answer(11, "nobody"), answer(12, None), (1, 13, "user", 'say "hi"', None, None, None, None, "s"),
        (None, None, None, None, None, None, None, None, None)], CALLS)
    got = {(r["turn"], r["call_id"]): r for r in tool_calls.format_calls(messages, tools).collect()}
    assert {k: r["status"] for k, r in got.items()} == {
        (1, "p"): "answered", (2, "q"): "answered", (3, "r"): "unanswered", (4, "s"): "unanswered", (5, "t"): "unanswered", (6, "p"): "repeated",
        (7, None): "repeated", (8, "u"): "unanswered", (9, "v"): "unanswered", (10, "p"): "linked", (0, "q"): "early", (11, "nobody"): "orphan",
        (12, None): "orphan", (13, None): "plain", (None, None): "plain"}
    assert {k[1]: r["level"] for k, r in got.items() if k[0] in (1, 2, 3, 4, 5, 8, 9)} == {"p": 1, "q": 0, "r": 2, "s": None, "t": None, "u": 0, "v": None}
    assert {k[0]: r["valid"] for k, r in got.items() if r["name"]} == {
        1: True, 2: True, 3: False, 4: False, 5: False, 6: False, 7: False, 8: False, 9: False}
    assert got[1, "p"]["json"] == '{"arguments":{"a":1,"b":"é\\n"},"content":null,"id":"p","name":"f","role":"assistant"}'
    assert got[2, "q"]["canonical"] == '{"o":{"y":[1,"2"],"z":1},"x":2}'
    assert got[10, "p"]["json"] == '{"content":"r","role":"tool","tool_call_id":"p"}'
    assert got[13, None]["json"] == '{"content":"say \\"hi\\"","role":"user"}'
    assert tool_calls.format_calls(messages, tools).count() == 16
    assert tool_calls.format_calls(messages.limit(0), tools).count() == 0
    assert tool_calls.format_calls(messages, tools.limit(0)).where("valid").count() == 0


def test_shards_of_pieces_that_never_fit_together_stay_small(spark, monkeypatch):
    """Poor sequences that can not be better are dealt again once, in shards no larger than before, then kept."""
    monkeypatch.setattr(packing, "SHARD_PIECES", 64)
    seen = []
    original = packing._pack_shards

    def watched(items, capacity, level):
        seen.append(max(r["count"] for r in items.groupBy("shard").count().collect()))
        return original(items, capacity, level)

    monkeypatch.setattr(packing, "_pack_shards", watched)
    pieces = spark.range(640).selectExpr("id div 64 as shard", "id % 64 as item", "id", "2500L as length")
    got = packing.pack(pieces, 4096).collect()
    assert len({r["sequence_id"] for r in got}) == 640 == len(got)
    assert len(seen) == 2 and max(seen) < 2 * 64


def test_pairs_come_once_not_for_each_token_they_share(spark):
    # 30 sets of 100 tokens, of which 90 or more are the same ones
    sets = spark.createDataFrame(
        [(i, t) for i in range(30) for t in [*range(90), *range(1000 + 10 * (i // 2), 1010 + 10 * (i // 2))]], "rid long, token long")
    alone = spark.createDataFrame([], "node long, root long")
    made = linking._pairs_of_tokens(sets, alone, 80)
    pairs = {(r["a"], r["b"]) for r in made.collect()}
    assert pairs >= {(i, j) for i in range(30) for j in range(i + 1, 30)}
    assert made.count() < 2 * len(pairs)


def test_pairs_of_small_buckets_need_no_tokens(spark):
    """Unlike leaders part a bucket of several groups; its other pairs come from the sketches, each once."""
    shingles = [{1000 * (i % 8) + t for t in range(100)} for i in range(40)]
    sketches = spark.createDataFrame(
        [(i, len(s), minhash.parity(np.array(sorted(s), np.uint64)).tolist()) for i, s in enumerate(shingles)],
        "rid long, n long, sketch array<long>")
    members = linking.share_keys(spark.createDataFrame([(1, i) for i in range(40)] + [(1, 5)], "key long, rid long"))
    tested = []

    def verify(pairs):
        tested.extend(tuple(r) for r in pairs.collect())
        return pairs.where("a % 8 = b % 8")

    def sets(items):
        raise AssertionError("the bucket is small")

    got = dict(rows(linking.group_members(members, verify, sets, 80, sketches), "node", "root"))
    assert got == {i: i % 8 for i in range(40)}
    assert len(tested) == len(set(tested)) < 150


def test_lines_of_large_buckets_and_texts_read_once(make_docs, monkeypatch):
    """All texts that are compared come from one pass, whatever the size of the buckets."""
    families = [prose(30, i) for i in range(3)]
    draw = random.Random(9)
    docs = make_docs(*[(i, f"{families[i % 3]} {draw.randrange(1000)} {prose(i % 5, i)}") for i in range(45)])
    passes, read = [], lines._lines_of
    monkeypatch.setattr(lines, "_lines_of", lambda wanted: passes.append(1) or read(wanted))
    texts = {r["doc_id"]: lines.plain(r["text"]) for r in docs.collect()}

    def alike(a, b):
        both = len(lines.shingles(a) & lines.shingles(b))
        return 100 * both >= 80 * len(lines.shingles(a) | lines.shingles(b))

    root = {i: i for i in texts}
    for a in texts:
        for b in texts:
            if a < b and root[a] != root[b] and alike(texts[a], texts[b]):
                low, high = sorted((root[a], root[b]))
                root = {i: low if r == high else r for i, r in root.items()}
    for paired in (2, 128):
        monkeypatch.setattr(linking, "PAIRED", paired)
        passes.clear()
        assert {r["doc_id"] for r in lines.repeated_lines(docs).collect()} == {i for i, r in root.items() if r != i}
        assert len(passes) == 1


def test_a_set_of_bits_keeps_every_item(spark):
    items = [-(1 << 63), -1, 0, 63, 64, (1 << 63) - 1, *(random.Random(3).randrange(-1 << 63, 1 << 63) for _ in range(500))]
    bits = lines.bits_of(spark.createDataFrame([(i,) for i in items], "rid long"))
    assert lines._among(bits, np.array(items)).all()
    others = np.random.default_rng(1).integers(-1 << 63, (1 << 63) - 1, 10_000)
    assert lines._among(bits, others).mean() < 0.05
    assert not lines._among(lines.bits_of(spark.createDataFrame([], "rid long")), others).any()


def test_sketches_of_lines_are_those_of_their_sets(monkeypatch):
    texts = [LONG[:5000], "x" * 40, LONG[200:240], "ab" * 200, LONG[:700]]
    monkeypatch.setattr(lines, "BLOCK_CHARS", 1000)
    sizes, parities = lines.sketches(texts)
    for text, n, sketch in zip(texts, sizes, parities, strict=True):
        hashed = np.unique(np.concatenate([sums for _, sums in lines._hashed([text])]))
        assert n == len(lines.shingles(text)) and (sketch == minhash.parity(hashed)).all()
    assert lines.sketches([])[0].tolist() == []
