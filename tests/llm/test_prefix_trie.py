"""The prefix trie against brute force."""

import hashlib
import random

import __spark_entry__ as entry
from tests import oracle
from tracewright.llm import prefix_trie


TURN = "conv_id long, turn long, role string, text string, depth string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(turns):
    """Rows of the trie, from lists of (conv_id, turn, role, text)."""
    sequences = {}
    for conv, turn, role, text in sorted(
            ((c, t, r or "", x or "") for c, t, r, x in turns if c is not None),
            key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2], r[3])):
        sequences.setdefault(conv, []).append((role, text))
    members, ends = {}, {}
    for conv, path in sorted(sequences.items()):
        for d in range(len(path) + 1):
            members.setdefault(tuple(path[:d]), []).append(conv)
        ends.setdefault(tuple(path), []).append(conv)
    children = {n: [c for c in members if len(c) == len(n) + 1 and c[:-1] == n] for n in members}

    def totals(node):
        leaves = 0 if children[node] else 1
        saved = (len(members[node]) - 1) * len(node[-1][1].split()) if node else 0
        below = [totals(c) for c in children[node]]
        return leaves + sum(b[0] for b in below), saved + sum(b[1] for b in below)

    return sorted(
        (members[n][0], len(n), members[n[:-1]][0] if n else None, len(members[n]), len(children[n]), *totals(n),
         hashlib.sha256(",".join(map(str, ends.get(n, []))).encode()).hexdigest()) for n in members)


def built(spark, turns):
    frame = spark.createDataFrame([(*t, "x") for t in turns], TURN)
    return sorted(tuple(r) for r in prefix_trie.conversation_trie(frame).select(*COLUMNS).collect())


def test_random_conversations_with_ties_nulls_and_repeats(spark):
    rnd = random.Random(3)
    turns = [(c, None if rnd.random() < 0.1 else rnd.randint(0, 9), rnd.choice(["user", "user", None]),
              rnd.choice(["a", "b c", "", None])) for c in range(-3, 25) for _ in range(rnd.randint(1, 9))]
    turns += [(c + 50, t, "user", f"w {t}") for c in range(5) for t in range(1 + 3 * c)]
    turns += turns[:7] + [(None, 1, "user", "of no conversation"), (90, 0, "ab", "c"), (91, 0, "a", "bc")]
    rnd.shuffle(turns)
    assert built(spark, turns) == brute(turns)


def test_equal_conversations_and_one_long_one(spark):
    turns = [(c, t, "user", f"hello {t}") for c in range(600) for t in range(2)]
    turns += [(1001, t, "user", f"hello {t} {t > 200}") for t in range(260)] + [(1002 + c, t, "user", f"hello {t}") for c in range(4) for t in range(64 * (c + 1))]
    turns += [(1000, t, "user", f"hello {t}") for t in range(300)] + [(-4, 0, "user", "other")]
    assert built(spark, turns) == brute(turns)


def test_no_conversations(spark):
    assert built(spark, []) == []


def test_conversations_without_turns_end_at_the_root(spark):
    none = spark.createDataFrame([], "conv_id long, place long, mark_1 long, mark_2 long, words long")
    got = prefix_trie.trie(none, spark.createDataFrame([(7,), (5,)], "conv_id long")).select(*COLUMNS).collect()
    assert [tuple(r) for r in got] == [(5, 0, None, 2, 0, 1, 0, hashlib.sha256(b"5,7").hexdigest())]


def test_query_is_its_sql(spark, sf_dir):
    assert entry.oracle_sql()["op12_conversation_trie"]
    assert oracle.compare(spark, oracle.connect(sf_dir), "op12_conversation_trie", sf_dir) == ""
