"""One thin query per operator, over its whole table."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm import (
    decontamination, html_text, language, lines, minhash, packing, passages, prefix_trie, quality, records, runs,
    tool_calls, toxicity,
)
from tracewright.llm.registry import query, table
from tracewright.plans.storage import new_path, store



def tokenizer_path(name: str, folder: str | None = None) -> str:
    """A public tokenizer file: in the folder given, else where the package of them has it."""
    if folder is not None:
        return os.path.join(folder, name)
    import public_tokenizers

    return str(public_tokenizers.path(name))


@query()
def op1_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents, written as framed records and read back."""
    manifest = records.write_records(
        table(spark, sf_dir, "documents"), new_path(spark, "records"), tokenizer_path("byte_bpe_50k.json"), end_id=2)
    return records.read_records(manifest).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"coalesce(regexp_extract_all({_LOWER}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+'), [])"

DECONTAMINATION_SQL = f"""
WITH docs AS (SELECT doc_id, {_WORDS} AS words FROM documents),
items AS (SELECT item_id, {_WORDS} AS words FROM benchmark),
windows AS (
    SELECT DISTINCT item_id, n, array_to_string(words[i:i + n - 1], ' ') AS passage
    FROM (SELECT item_id, words, n, unnest(range(1, len(words) - n + 2)) AS i
          FROM (SELECT *, least(10, len(words)) AS n FROM items WHERE len(words) > 0))),
places AS (
    SELECT doc_id, n, i, array_to_string(words[i:i + n - 1], ' ') AS passage
    FROM (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS i
          FROM docs CROSS JOIN (SELECT DISTINCT n FROM windows) WHERE len(words) >= n)),
hits AS (SELECT doc_id, i, n, item_id FROM places JOIN windows USING (n, passage)),
words_hit AS (
    SELECT doc_id, count(DISTINCT place) AS n_hit
    FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM (SELECT DISTINCT doc_id, i, n FROM hits)) GROUP BY doc_id),
items_hit AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(names, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM docs LEFT JOIN words_hit USING (doc_id) LEFT JOIN items_hit USING (doc_id)
"""


@query(DECONTAMINATION_SQL)
def op2_fm_index_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in all documents."""
    found = decontamination.find(
        table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"))


@query()
def op3_tensored_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents, by distinct shingles of two words."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle_words=2).select(
        "doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


@query()
def op4_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated lines of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("text").alias("whole"))
    return lines.dedup_lines(docs).select(
        "doc_id", F.coalesce(F.size(F.split("whole", "\n", -1)), F.lit(0)).cast("long").alias("n_lines"),
        F.size("removed").cast("long").alias("n_removed"), F.array_join("removed", ",").alias("removed_lines"),
        F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("n_chars_left"))


@query()
def op5_word_first_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents, learned from two thirds of the labelled ones."""
    docs = table(spark, sf_dir, "documents").withColumn("held_out", language.remainder() == 1)
    model = language.train(language.sample_labelled(docs.where(~F.col("held_out")).select("doc_id", "text", "lang")))
    return language.predict(docs.select("doc_id", "held_out", "text"), model).drop("text")


@query()
def op6_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and compression verdict of all documents."""
    return quality.judge(table(spark, sf_dir, "documents"))


@query()
def op7_sparse_suffix_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more of all documents that occur elsewhere."""
    covered = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return passages.repeated_passages(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", F.size("spans").cast("long").alias("n_spans"), covered.alias("n_repeated"),
        F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["start"], s["end"])), ",").alias("spans"))


#: Fixed schemas of the tools that conversation turns are read as calls of: name, parameter, type, required.
TOOLS = [
    ("lookup", "text", "string", True), ("lookup", "words", "integer", True), ("lookup", "exact", "boolean", False),
    ("search", "text", "string", True), ("search", "limit", "integer", True),
    ("summarise", "text", "string", True), ("summarise", "words", "number", False),
]

CALLS_SQL = """
WITH RECURSIVE turns AS (
    SELECT conv_id, turn, role, text, coalesce(len(text), 0) AS size FROM conversations),
messages AS (
    SELECT conv_id, turn, CASE WHEN role = 'user' AND turn > 0 THEN 'tool' ELSE role END AS role,
        CASE WHEN role = 'assistant' THEN NULL ELSE text END AS content,
        CASE WHEN role = 'assistant' THEN 'call-' || turn WHEN role = 'user' AND turn > 0 THEN 'call-' || (turn - 1) END AS call_id,
        CASE WHEN role = 'assistant' THEN CASE size % 4 WHEN 0 THEN 'lookup' WHEN 1 THEN 'search' WHEN 2 THEN 'summarise' ELSE 'unknown' END END AS name,
        text, size, CASE WHEN role = 'assistant' AND size % 3 = 0 THEN 'call-' || (turn - 2) END AS ref
    FROM turns),
calls AS (SELECT *, row_number() OVER (PARTITION BY conv_id, call_id ORDER BY turn) AS nth FROM messages WHERE name IS NOT NULL),
answers AS (SELECT conv_id, call_id, min(turn) AS answer FROM messages WHERE name IS NULL AND call_id IS NOT NULL GROUP BY ALL),
levels AS (
    SELECT c.conv_id, c.call_id, 0 AS level FROM calls c
    WHERE NOT EXISTS (SELECT 1 FROM calls r WHERE r.conv_id = c.conv_id AND r.call_id = c.ref)
    UNION ALL
    SELECT c.conv_id, c.call_id, l.level + 1 FROM calls c JOIN levels l ON l.conv_id = c.conv_id AND l.call_id = c.ref),
described AS (
    SELECT m.conv_id, m.turn, m.role, m.call_id, m.name, m.content, c.turn AS call_turn, a.answer, l.level, m.size, to_json(m.text) AS quoted
    FROM messages m LEFT JOIN calls c ON c.conv_id = m.conv_id AND c.call_id = m.call_id
    LEFT JOIN answers a ON a.conv_id = m.conv_id AND a.call_id = m.call_id
    LEFT JOIN levels l ON l.conv_id = m.conv_id AND l.call_id = m.call_id)
SELECT conv_id, turn, call_id, name,
    CASE WHEN name IS NOT NULL THEN CASE WHEN answer IS NULL THEN 'unanswered' ELSE 'answered' END
        WHEN call_id IS NULL THEN 'plain' WHEN call_turn IS NULL THEN 'orphan' ELSE 'linked' END AS status,
    CASE WHEN name IS NOT NULL THEN answer ELSE call_turn END AS linked_turn,
    CASE WHEN call_id IS NULL OR (name IS NULL AND call_turn IS NULL) THEN 0 ELSE level END AS level,
    CASE WHEN name IS NOT NULL THEN name <> 'unknown' AND size % 5 <> 0 END AS valid,
    sha256(CASE WHEN name IS NOT NULL THEN
            '{"arguments":{' || CASE name WHEN 'lookup' THEN '"exact":true,' WHEN 'search' THEN '"limit":' || CASE WHEN size % 5 = 0 THEN '"' || size || '"' ELSE CAST(size AS VARCHAR) END || ',' ELSE '' END
            || '"text":' || coalesce(quoted, 'null')
            || CASE name WHEN 'search' THEN '' WHEN 'unknown' THEN '' ELSE ',"words":' || CASE WHEN size % 5 = 0 THEN '"' || size || '"' ELSE CAST(size AS VARCHAR) END END
            || '},"content":null,"id":"' || call_id || '","name":"' || name || '","role":"assistant"}'
        WHEN call_id IS NOT NULL THEN '{"content":' || coalesce(quoted, 'null') || ',"role":"tool","tool_call_id":"' || call_id || '"}'
        ELSE '{"content":' || coalesce(quoted, 'null') || ',"role":"' || role || '"}' END) AS json_sha256
FROM described
"""


def conversation_calls(turns: DataFrame) -> DataFrame:
    """Turns read as tool traffic: what the assistant says is a call, what the user says next its result.

    The length of the text picks the tool, puts a wrong type into every fifth call, and lets every
    third call need the result of the call before it.
    """
    size = F.coalesce(F.char_length("text"), F.lit(0))
    call, answer = F.col("role") == "assistant", (F.col("role") == "user") & (F.col("turn") > 0)
    tool = F.element_at(F.array(*map(F.lit, ("lookup", "search", "summarise", "unknown"))), size % 4 + 1)
    number = F.when(size % 5 == 0, F.concat(F.lit('"'), size, F.lit('"'))).otherwise(size.cast("string"))
    quoted = F.coalesce(F.get_json_object(F.to_json(F.struct(F.array("text").alias("v"))), "$.v"), F.lit("[null]"))
    text = F.concat(F.lit('"text":'), F.substring(quoted, F.lit(2), F.length(quoted) - 2))
    # written in another order than the canonical one
    arguments = F.when(tool == "lookup", F.concat(F.lit('{"words": '), number, F.lit(", "), text, F.lit(', "exact": true}'))).when(
        tool == "search", F.concat(F.lit("{"), text, F.lit(', "limit": '), number, F.lit("}"))).when(
        tool == "summarise", F.concat(F.lit('{"words": '), number, F.lit(", "), text, F.lit("}"))).otherwise(
        F.concat(F.lit("{"), text, F.lit("}")))
    return turns.select(
        "conv_id", "turn", F.when(answer, "tool").otherwise(F.col("role")).alias("role"),
        F.when(~call, F.col("text")).alias("content"),
        F.when(call, F.concat(F.lit("call-"), "turn")).when(answer, F.concat(F.lit("call-"), F.col("turn") - 1)).alias("call_id"),
        F.when(call, tool).alias("name"), F.when(call, arguments).alias("arguments"),
        F.when(call & (size % 3 == 0), F.array(F.concat(F.lit("call-"), F.col("turn") - 2))).alias("refs"))


@query(CALLS_SQL)
def op8_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations as linked, checked and serialised tool calls."""
    schemas = spark.sql("SELECT * FROM VALUES " + ", ".join(
        f"('{n}', '{p}', '{t}', {str(r).lower()})" for n, p, t, r in TOOLS) + " AS t(name, param, type, required)")
    done = tool_calls.format_calls(conversation_calls(table(spark, sf_dir, "conversations")), schemas)
    return done.select("conv_id", "turn", "call_id", "name", "status", "linked_turn", "level", "valid",
                       F.sha2(F.col("json").cast("binary"), 256).alias("json_sha256"))


@query()
def op9_tag_ratio_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return html_text.extract(table(spark, sf_dir, "pages"))


@query()
def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 4096 tokens."""
    pieces = store(packing.cut_pieces(
        table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=1), "pieces")
    return packing.pack(pieces).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query()
def op11_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learned from two thirds of them."""
    docs = table(spark, sf_dir, "documents").withColumn("held_out", toxicity.remainder() == 1)
    labels = table(spark, sf_dir, "labels").where(toxicity.remainder() != 1).select("doc_id", F.col("toxic").alias("label"))
    model = toxicity.train(docs.where("not held_out").select("doc_id", "text"), labels)
    return toxicity.predict(docs.select("doc_id", "held_out", "text"), model).drop("text")


def with_borrowed_openings(sequences: DataFrame, sizes: DataFrame) -> DataFrame:
    """Numbered turns of which the first h of conversation c - c % 20 take the place of the first h of c.

    h is crc32 of the id, modulo 4. Where that conversation has fewer turns, or is not there, its turns
    are all that is taken; the places of the turns of c follow.
    """
    origin = (F.col("conv_id") - F.col("conv_id") % 20).alias("_origin")
    plan = sizes.select("conv_id", origin, (F.crc32(F.col("conv_id").cast("string")) % 4).alias("_h"))
    plan = plan.join(sizes.select(F.col("conv_id").alias("_origin"), F.col("n_turns").alias("_there")), "_origin", "left").select(
        "conv_id", "_origin", "_h", F.least("_h", F.coalesce("_there", F.lit(0).cast("long"))).alias("_taken"))
    plan = store(plan, "openings")
    rest = ["mark_1", "mark_2", "words"]
    own = sequences.where("place > crc32(cast(conv_id as string)) % 4").join(plan.drop("_origin"), "conv_id").select(
        "conv_id", (F.col("place") - F.col("_h") + F.col("_taken")).alias("place"), *rest)
    # at most three turns of each conversation that others borrow from, for twenty conversations each
    heads = sequences.where("place <= 3 and conv_id % 20 = 0").withColumnRenamed("conv_id", "_origin")
    return heads.join(plan, "_origin").where("place <= _h").select("conv_id", "place", *rest).unionByName(own)


TRIE_SQL = """
WITH turns AS (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place, role, text
    FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
convs AS (
    SELECT conv_id, conv_id - conv_id % 20 AS origin, xor(list_reduce(
        list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
        lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
            lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, CAST(3988292384 AS BIGINT)) ELSE x // 2 END)), CAST(4294967295 AS BIGINT)) % 4 AS h
    FROM (SELECT DISTINCT conv_id FROM turns)),
rebuilt AS (
    SELECT c.conv_id, row_number() OVER (PARTITION BY c.conv_id ORDER BY t.own, t.place) AS d, t.role, t.text
    FROM convs c JOIN (SELECT conv_id, place, role, text, unnest([0, 1]) AS own FROM turns) t
        ON (own = 0 AND t.conv_id = c.origin AND place <= h) OR (own = 1 AND t.conv_id = c.conv_id AND place > h)),
lists AS (
    SELECT conv_id, d, text, list({'role': role, 'text': text}) OVER (PARTITION BY conv_id ORDER BY d) AS path FROM rebuilt
    UNION ALL SELECT conv_id, 0, '', [] FROM convs),
lengths AS (SELECT conv_id, max(d) AS n FROM lists GROUP BY conv_id),
nodes AS (
    SELECT path, min(conv_id) AS conv_id, any_value(d) AS depth, count(*) AS n_convs, any_value(text) AS text,
        list(conv_id ORDER BY conv_id) FILTER (d = n) AS ends
    FROM lists JOIN lengths USING (conv_id) GROUP BY path),
linked AS (
    SELECT c.path, c.conv_id, c.depth, p.conv_id AS parent_conv_id, c.n_convs, c.ends,
        (c.n_convs - 1) * len(regexp_extract_all(c.text, '[^\\x20\\x09-\\x0D]+')) AS saved
    FROM nodes c LEFT JOIN nodes p ON c.depth > 0 AND p.path = c.path[:c.depth - 1]),
children AS (SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM linked WHERE depth > 0 GROUP BY ALL),
counted AS (SELECT l.*, coalesce(n_children, 0) AS n_children FROM linked l LEFT JOIN children USING (conv_id, depth)),
totals AS (
    SELECT path[:d] AS path, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(saved) AS saved_tokens
    FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM counted) GROUP BY 1)
SELECT conv_id, CAST(depth AS BIGINT) AS depth, parent_conv_id, n_convs, n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
    CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(array_to_string(ends, ','), '')) AS ends_sha256
FROM counted JOIN totals USING (path)
"""


@query(TRIE_SQL)
def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shared openings of all conversations, each with its opening borrowed from another."""
    sequences, sizes = prefix_trie.numbered(table(spark, sf_dir, "conversations"))
    return prefix_trie.trie(with_borrowed_openings(sequences, sizes), sizes)


def with_loops(docs: DataFrame) -> DataFrame:
    """Documents of which every tenth, by a hash of its id, repeats a stretch of its words from some word on.

    With h = crc32 of the id and g = h // 10, a text of n words whose h is a multiple of 10 goes on from
    word a = g % n with the p = 1 + (n - a) // (3 + g % 8) words that start there, again and again.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    chosen = docs.withColumn("_words", F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))))
    n, g = F.size("_words"), F.floor(h / 10)
    placed = chosen.withColumns({"_n": n, "_a": F.when(n > 0, g % n).cast("int")}).withColumn(
        "_p", (1 + F.floor((F.col("_n") - F.col("_a")) / (3 + g % 8))).cast("int"))
    again = F.flatten(F.array_repeat(F.slice("_words", F.col("_a") + 1, F.col("_p")), F.ceil((F.col("_n") - F.col("_a")) / F.col("_p")).cast("int")))
    looped = F.slice(F.concat(F.slice("_words", F.lit(1), F.col("_a")), again), F.lit(1), F.col("_n"))
    return placed.select("doc_id", F.when(F.col("_n") > 0, F.array_join(looped, " ")).otherwise(F.col("text")).alias("text"))


def _run_line(run: Column) -> Column:
    return F.concat(F.concat_ws(",", run["start"], run["length"], run["period"]), F.lit("\n"))


@query()
def op13_branching_tandem_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of all documents, of which every tenth is made to loop."""
    found = runs.periodic_runs(with_loops(table(spark, sf_dir, "documents")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", _run_line), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
