"""The prefix trie against a plain dictionary of prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np

from doctables.llm import trie

TURNS = "conv_id long, turn long, role string, text string, no long, depth int, parent long"


def frame(spark, rows):
    return spark.createDataFrame([(c, t, r, x, 3, 3, 3) for c, t, r, x in rows], TURNS).repartition(3)


def ordered(rows):
    out = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            out[c].append((t is not None, t or 0, r or "", x or ""))
    return {c: [(r, x) for *_, r, x in sorted(turns)] for c, turns in out.items()}


def rebuilt(convs):
    out = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - c % 5, [])[:h] + turns[h:]
    return out


def brute(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = defaultdict(list)
    for path in members:
        if path:
            kids[path[:-1]].append(path)

    def under(path):
        below = [under(k) for k in kids[path]]
        own = (len(members[path]) - 1) * len(path[-1][1].encode()) if path else 0
        return sum(n for n, _ in below) or 1, own + sum(s for _, s in below)
    rows = set()
    for path, ids in members.items():
        ends = ",".join(str(c) for c in sorted(ids) if len(convs[c]) == len(path))
        rows.add((min(ids), len(path), min(members[path[:-1]]) if path else None, len(ids), len(kids[path]), *under(path), hashlib.sha256(ends.encode()).hexdigest()))
    return rows


def got(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


ODD = [(1, 0, "user", "a"), (1, 1, None, "b"), (1, None, "system", None), (1, 0, "user", "a"), (2, 5, "user", "a"), (2, 5, "user", "A"), (2, 5, "bot", "z"),
       (None, 0, "user", "nobody"), (5, 0, "user", "é\U0001F600" * 9), (6, 1, "user", ""), (6, 0, "", "user"), (7, 0, "us", "era"), (8, 0, "user", "a"), (-9, 0, "user", "a"),
       (10, 0, "user", "x" * 90_000), (11, 0, "user", "x" * 90_000), (11, 1, "bot", "1")]


def test_odd_turns(spark):
    assert got(trie.conversation_trie(frame(spark, ODD))) == brute(ordered(ODD))


def test_no_turns(spark):
    assert trie.conversation_trie(frame(spark, [])).count() == 0
    assert trie.conversation_trie(frame(spark, [(None, 1, "user", "x")])).count() == 0


def test_conversations_without_turns_end_at_the_root(spark):
    turns = trie.numbered_turns(frame(spark, [(3, 0, "user", "a")])).withColumnRenamed("pos", "depth")
    nodes = got(trie.prefix_trie(turns, spark.createDataFrame([(3,), (4,), (2,)], "conv_id long")))
    assert nodes == brute({3: [("user", "a")], 4: [], 2: []})


def test_rebuilt_conversations(spark):
    rng = random.Random(5)
    rows = [(c, t, rng.choice(["user", "assistant"]), rng.choice("ab")) for c in range(0, 120) if c % 11 for t in range(rng.randrange(1, 14))]
    df = trie.prefix_trie(*trie.rebuilt_turns(trie.numbered_turns(frame(spark, rows))))
    assert got(df) == brute(rebuilt(ordered(rows)))


def test_one_long_and_many_equal_conversations(spark):
    rows = [(0, t, "user", str(t % 3)) for t in range(700)] + [(c, t, "user", str(t % 3)) for c in range(1, 300) for t in range(3)]
    import sys
    sys.setrecursionlimit(5000)
    assert got(trie.conversation_trie(frame(spark, rows))) == brute(ordered(rows))


def test_list_ranks(spark):
    """A list in random order over many partitions."""
    n = 3000
    order = np.random.default_rng(1).permutation(n)
    onward = np.full(n, -1)
    onward[order[:-1]] = order[1:]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        df = spark.createDataFrame([(i, int(x)) for i, x in enumerate(onward)], "arc long, onward long").repartition(5)
        left = {r.arc: r.left for r in trie.list_ranked(df).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [left[a] for a in order.tolist()] == list(range(n - 1, -1, -1))
