"""Prefix trie of conversations by the Euler-tour technique.

A node is a distinct sequence of first turns, known by its smallest member conversation and its depth. Each node has an enter and an exit
arc, and each arc knows the next one of the tour (children in order of their smallest members). The tour is list-ranked: every
range partition contracts its own stretches of the list, pointers between stretches double in joins, and an arc's place is
that of its stretch plus its place therein. Leaves and savings of a subtree are differences of prefix sums at its two arcs.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from doctables.llm.common import column, give_back, written
from doctables.llm.running import running

#: Ids in one piece of a node's list, while the list is hashed.
PIECE = 1 << 16
KEY = ["depth", "k1", "k2"]


def _digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """128 bits of each turn's role and text, and the text's bytes."""
    for batch in batches:
        role, text = (column(batch, c).cast(pa.binary()) for c in ("role", "text"))
        digests = [struct.unpack("<qq", xxhash.xxh3_128_digest(struct.pack("<q", len(r)) + r + t)) for r, t in zip(role.to_pylist(), text.to_pylist())]
        a, b = np.array(digests, np.int64).reshape(-1, 2).T
        yield pa.RecordBatch.from_arrays([*(column(batch, c) for c in ("conv_id", "turn", "role", "text")), pa.array(a), pa.array(b), pc.binary_length(text).cast(pa.int64())],
                                         ["conv_id", "turn", "role", "text", "a", "b", "n_bytes"])
    give_back()


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """``(conv_id, pos, a, b, n_bytes)``: turns numbered from 1, a 128-bit digest of role and text, and the text's UTF-8 bytes.

    Turns are ordered by turn (null first), ties by role and text; each row is a turn, also when it repeats. A null role or text is
    empty; rows with a null conv_id belong to no conversation and are left out. Other columns are ignored.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text"))).where("conv_id is not null")
    rows = rows.mapInArrow(_digests, "conv_id long, turn long, role string, text string, a long, b long, n_bytes long").withColumn("pos", F.lit(1).cast("long"))
    numbered = running(rows, ["conv_id", "turn", "role", "text"], sums=["pos"], group="conv_id", drop=["turn", "role", "text"], label="turns")
    return numbered.select("conv_id", F.col("pos_upto").alias("pos"), "a", "b", "n_bytes")


def _contract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The stretches of the tour that lie in this partition: each arc's last arc before the tour leaves it, and how many arcs ahead that is."""
    batches = list(batches)
    if sum(b.num_rows for b in batches):
        whole = pa.Table.from_batches(batches).combine_chunks()
        arc, onward = (whole.column(c).to_numpy() for c in ("arc", "onward"))
        order = np.argsort(arc)
        found = np.minimum(np.searchsorted(arc, onward, sorter=order), len(arc) - 1)
        inside = arc[order[found]] == onward
        to = np.where(inside, order[found], np.arange(len(arc)))
        ahead = inside.astype(np.int64)
        while True:
            further = to[to]
            if (further == to).all():
                break
            ahead, to = ahead + ahead[to], further
        whole = whole.append_column("tail", pa.array(arc[to])).append_column("ahead", pa.array(ahead))
        yield from whole.to_batches(max_chunksize=1 << 16)
    give_back()


def list_ranked(arcs: DataFrame) -> DataFrame:
    """``arcs`` (arc, onward: the next arc or -1 at the end, other columns) with ``left``, the number of arcs that follow.

    One list, in as many range partitions as Spark makes of it. Stretches that leave a partition point to the stretch they enter; these
    pointers double until all reach the end. Every round is stored, so a lost executor repeats one round at most.
    """
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in arcs.schema), "tail long", "ahead long"])
    parts = written(arcs.repartitionByRange("arc").mapInArrow(_contract, schema), "stretches")
    tails = parts.where("arc = tail").select(F.col("arc").alias("at"), "onward")
    entered = parts.select(F.col("arc").alias("onward"), F.col("tail").alias("goal"), (F.col("ahead") + 1).alias("steps"))
    links = written(tails.where("onward >= 0").join(entered, "onward").select("at", "goal", "steps").union(
        tails.where("onward < 0").selectExpr("at", "-1L", "0L")), "links")
    while not links.where("goal >= 0").isEmpty():
        reached = links.select(F.col("at").alias("goal"), F.col("goal").alias("beyond"), F.col("steps").alias("more"))
        doubled = links.where("goal >= 0").join(reached, "goal").select("at", F.col("beyond").alias("goal"), (F.col("steps") + F.col("more")).alias("steps"))
        links = written(links.where("goal < 0").union(doubled), "links")
    ends = links.select(F.col("at").alias("tail"), "steps")
    return parts.join(ends, "tail").select(*arcs.columns, (F.col("ahead") + F.col("steps")).alias("left"))


def _listed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Comma-joined ids of each run of one node, in pieces."""
    for batch in batches:
        keys = [column(batch, c).to_numpy() for c in KEY]
        ids = column(batch, "conv_id").to_numpy()
        new = np.zeros(len(ids), bool)
        new[::PIECE] = True
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
        at = np.flatnonzero(new)
        texts = [",".join(map(str, x.tolist())) for x in np.split(ids, at[1:])] if len(ids) else []
        yield pa.RecordBatch.from_arrays([*(pa.array(k[at]) for k in keys), pa.array(ids[at]), pa.array(texts, pa.string())], [*KEY, "first", "ids"])


def _hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest per node from its sorted pieces, taken one after another."""
    last, state = None, None

    def out(rows):
        columns = list(zip(*rows)) or [()] * 4
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())], [*KEY, "ends_sha256"])
    for batch in batches:
        rows = []
        for key, ids in zip(zip(*(column(batch, c).to_pylist() for c in KEY)), column(batch, "ids").to_pylist()):
            if key == last:
                state.update(b"," + ids.encode())
                continue
            if last is not None:
                rows.append((*last, state.hexdigest()))
            last, state = key, hashlib.sha256(ids.encode())
        yield out(rows)
    if last is not None:
        yield out([(*last, state.hexdigest())])


def hashed_lists(ends: DataFrame) -> DataFrame:
    """``(depth, k1, k2, ends_sha256)`` from ``ends`` with conv_id: the digest of each node's ids, ascending and comma-joined.

    Ids become pieces of text in range partitions, which split a node that very many conversations end at; one task then hashes a
    node's pieces in their order, a piece at a time.
    """
    order = [*KEY, "conv_id"]
    kinds = "depth long, k1 long, k2 long"
    pieces = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_listed, f"{kinds}, first long, ids string")
    pieces = written(pieces, "end-lists").repartition(*KEY).sortWithinPartitions(*KEY, "first")
    return pieces.mapInArrow(_hashed, f"{kinds}, ends_sha256 string")


def prefix_trie(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """The trie's nodes from ``turns (conv_id, depth, a, b, n_bytes)``, depth from 1 without gaps, and all ``conversations (conv_id)``.

    Returns conv_id (smallest member), depth, parent_conv_id (the parent's smallest member; null at the root), n_convs, n_children,
    n_leaves and saved_tokens (over the subtree; a node saves its last text's bytes for each member but one), and ends_sha256 of the
    conversations that end there. Conversations without turns end at the root; without conversations there is no node. Sequences are
    told apart by 128 bits.
    """
    mixed = [F.xxhash64(F.lit(n), "depth", "a", "b").alias(f"x{n}") for n in (1, 2)]
    steps = running(turns.select("conv_id", "depth", "n_bytes", *mixed), ["conv_id", "depth"], xors=["x1", "x2"], group="conv_id", label="prefixes")
    steps = steps.withColumnsRenamed({"x1_upto": "k1", "x2_upto": "k2"})
    # a prefix's key is the exclusive or of its steps, so the last step leads back to the parent's
    found = steps.groupBy(*KEY).agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("n_bytes").alias("n_bytes"),
                                    F.min("x1").alias("x1"), F.min("x2").alias("x2"))
    nothing = F.lit(0).cast("long")
    root = conversations.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")).where("n_convs > 0")
    root = root.select(*(nothing.alias(c) for c in KEY), "n_convs", "conv_id", *(nothing.alias(c) for c in ("n_bytes", "x1", "x2")))
    nodes = running(found.unionByName(root).withColumn("one", F.lit(1).cast("long")), ["conv_id", "depth"], sums=["one"], label="nodes")
    nodes = nodes.withColumn("no", F.col("one_upto") - 1).drop("one", "one_upto")
    up = nodes.select(F.col("depth").alias("d"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("no").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    below = nodes.where("depth > 0").selectExpr("no", "depth - 1 AS d", "k1 ^ x1 AS p1", "k2 ^ x2 AS p2")
    children = written(below.join(up, ["d", "p1", "p2"]).select("no", "parent", "parent_conv_id").withColumn("nth", F.lit(1).cast("long")), "children")
    # numbers ascend with the smallest members, so siblings come in their order
    siblings = running(children, ["parent", "no"], sums=["nth"], group="parent", label="siblings").drop("nth", "parent_conv_id")
    after = siblings.selectExpr("parent", "nth_upto - 1 AS nth_upto", "no AS sibling")
    siblings = siblings.join(after, ["parent", "nth_upto"], "left").select("no", "parent", "sibling")
    kids = children.groupBy(F.col("parent").alias("no")).agg(F.count("*").alias("n_children"), F.min("no").alias("first"))
    nodes = written(nodes.join(kids, "no", "left").join(children.select("no", "parent_conv_id"), "no", "left").fillna(0, ["n_children"]), "tree")
    arcs = nodes.join(siblings, "no", "left").select(F.inline(F.expr("""array(
        struct(2 * no AS arc, coalesce(2 * first, 2 * no + 1) AS onward, cast(n_children = 0 AS long) AS leaf, (n_convs - 1) * n_bytes AS saved),
        struct(2 * no + 1 AS arc, coalesce(2 * sibling, 2 * parent + 1, -1L) AS onward, 0L AS leaf, 0L AS saved))""")))
    tour = running(list_ranked(arcs).withColumn("place", -F.col("left")), ["place"], sums=["leaf", "saved"], label="tour")
    # at the exit arc everything of the subtree is counted, at the enter arc all that comes before it and its own node
    of = lambda c: (F.max(f"{c}_upto") - F.min(F.col(f"{c}_upto") - F.col(c))).alias
    subtrees = tour.groupBy(F.expr("arc div 2").alias("no")).agg(of("leaf")("n_leaves"), of("saved")("saved_tokens"))
    last = steps.groupBy("conv_id").agg(F.max_by(F.struct(*KEY), "depth").alias("k"))
    ends = conversations.join(last, "conv_id", "left").select("conv_id", *(F.coalesce(f"k.{c}", nothing).alias(c) for c in KEY))
    rows = nodes.join(subtrees, "no").join(hashed_lists(ends), KEY, "left")
    return rows.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                       F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """:func:`prefix_trie` of ``conversations (conv_id, turn, role, text)`` as they stand, by the rules of :func:`numbered_turns`."""
    turns = numbered_turns(conversations)
    return prefix_trie(turns.withColumnRenamed("pos", "depth"), turns.where("pos = 1").select("conv_id"))


def rebuilt_turns(turns: DataFrame, every: int = 5, most: int = 8) -> tuple[DataFrame, DataFrame]:
    """Turns of conversations that begin like the conversation c - c % ``every``, and the conversations.

    Conversation c takes the first h = crc32(c) % (``most`` + 1) turns of that one and goes on with its own after its first h.
    """
    turns = turns.withColumn("base", F.expr(f"conv_id - conv_id % {every}")).withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1))
    conversations = turns.where("pos = 1").select("conv_id", "base", "h")
    heads = turns.where(f"conv_id = base and pos <= {most}").select("base", "pos", "a", "b", "n_bytes")
    borrowed = conversations.join(heads, "base").where("pos <= h").selectExpr("conv_id", "0 AS part", "pos", "a", "b", "n_bytes")
    own = turns.where("pos > h").selectExpr("conv_id", "1 AS part", "pos", "a", "b", "n_bytes")
    rows = running(borrowed.union(own).withColumn("depth", F.lit(1).cast("long")), ["conv_id", "part", "pos"], sums=["depth"], group="conv_id", label="rebuilt")
    return rows.select("conv_id", F.col("depth_upto").alias("depth"), "a", "b", "n_bytes"), conversations.select("conv_id")


def op13_conversation_trie(spark, sf_dir):
    return prefix_trie(*rebuilt_turns(numbered_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


_CRC = """xor(4294967295::BIGINT, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(c.conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda s, x: list_reduce(list_concat([xor(s, x)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)))"""
SQL = f"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, conv_id - conv_id % 5 AS base, {_CRC} % 9 AS h FROM (SELECT DISTINCT conv_id FROM turns) c),
rebuilt AS (
  SELECT c.conv_id, 0 AS part, t.pos, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.base AND t.pos <= c.h
  UNION ALL SELECT c.conv_id, 1, t.pos, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.pos > c.h),
paths AS (
  SELECT conv_id, list(md5(length(role) || ':' || role || text)) OVER (PARTITION BY conv_id ORDER BY part, pos) AS path, strlen(text) AS bytes FROM rebuilt),
members AS (SELECT conv_id, path, bytes FROM paths UNION ALL SELECT conv_id, []::VARCHAR[], 0 FROM convs),
nodes AS (SELECT path, len(path) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(bytes) AS bytes FROM members GROUP BY path),
kids AS (SELECT path[1:depth - 1] AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
tree AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM nodes n LEFT JOIN kids k ON k.path = n.path),
under AS (
  SELECT path[1:k] AS path, sum((n_children = 0)::BIGINT) AS n_leaves, sum((n_convs - 1) * bytes) AS saved
  FROM (SELECT *, unnest(range(0, depth + 1)) AS k FROM tree) GROUP BY 1),
ends AS (
  SELECT path, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends
  FROM (SELECT conv_id, arg_max(path, len(path)) AS path FROM members GROUP BY conv_id) GROUP BY path)
SELECT t.conv_id, t.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, t.n_convs::BIGINT AS n_convs, t.n_children::BIGINT AS n_children,
  u.n_leaves::BIGINT AS n_leaves, u.saved::BIGINT AS saved_tokens, coalesce(e.ends, sha256('')) AS ends_sha256
FROM tree t JOIN under u ON u.path = t.path LEFT JOIN ends e ON e.path = t.path
LEFT JOIN nodes p ON t.depth > 0 AND p.path = t.path[1:t.depth - 1]
"""
