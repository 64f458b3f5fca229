"""The trie of conversation prefixes, peeled from its leaves by messages.

A node is a sequence of turns that some conversation starts with.  It is told by
its depth and two 64-bit hashes of the sequence: the sums modulo 2^64 of turn
hash times R^position, so prefixes of one conversation are running sums, which
tasks form apart and shift by what came before: a conversation may span any number
of tasks.

The smallest member names a node.  The nodes of one name are prefixes of one
conversation, so they form a path, and the trie is a tree of paths: far fewer
than nodes, and a long conversation that nothing branches from is one of them.
Paths hold a counter of the paths that hang below them and the totals of their
own nodes.  In each round the paths whose counter is zero send their totals to the
path above and are done; counters go down by the messages received.  The last to
finish is the root's.  The messages, added to the nodes they came to, are then
summed along each path from below, in stretches of ``STRETCH`` nodes, so a long
path is many tasks.

Nothing but one row per task of the ordering is collected.  Nodes with more than a
thousandth of all nodes as children (there are fewer than a thousand of them) are
joined by broadcast; other joins have one row per key on one side.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from corrello.store import forget, keep, table

#: Odd multiplier of the running sums, and its inverse modulo 2^64.
R = 0x5851F42D4C957F2D
MASK = (1 << 64) - 1
R_INVERSE = pow(R, -1, 1 << 64)
#: Conversations of a family share the head of the one whose id is a multiple of it.
FAMILY, MOST_SHARED = 20, 4
#: Nodes of a path that are summed in one go; ids of one piece of a list of members.
STRETCH, PIECE_BITS = 1024, 14
HOT = 1000
#: Rounds after which at most so many paths left are finished in one task.
ROUNDS, FEW = 32, 50_000
NO_ENDS = hashlib.sha256(b"").hexdigest()
WORD = r"[^\x20\x09-\x0D]+"


def _powers(n: int) -> np.ndarray:
    out = np.full(n, R, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


_ORDERED = "conv_id long, part int, pos long, words long, before1 long, before2 long, upto1 long, upto2 long"


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Positions and running sums of the rows of one task, which come in order."""
    part = TaskContext.get().partitionId()
    conv, count, carry = None, 0, [0, 0]
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        hashes = [batch.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in (1, 2)]
        head = np.concatenate(([True], ids[1:] != ids[:-1]))
        if conv is None or ids[0] != conv:
            count, carry = 0, [0, 0]
        starts = np.flatnonzero(head)
        size = np.diff(np.append(starts, n))
        rel = np.arange(n) - np.repeat(starts, size)
        own = _powers(int(size.max()))[rel]
        first = size[0]
        own[:first] *= np.uint64(pow(R, count, 1 << 64))
        pos = rel.copy()
        pos[:first] += count
        before, upto = [], []
        for x, c in zip(hashes, carry, strict=True):
            term = x * own
            total = np.cumsum(term, dtype=np.uint64)
            total -= np.repeat(total[starts] - term[starts], size)
            total[:first] += np.uint64(c)
            upto.append(total)
            before.append(total - term)
        conv, count, carry = ids[-1], int(pos[-1]) + 1, [int(t[-1]) for t in upto]
        sums = [pa.array(x.view(np.int64)) for x in (*before, *upto)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(n, part, np.int32)), pa.array(pos), batch.column(3), *sums], [c.split()[0] for c in _ORDERED.split(", ")])


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """``(conv_id, pos, words, before1, before2, upto1, upto2)``: each turn's place in
    its conversation, the words of its text, and the hashes of the turns before it
    and up to it.

    Order is by turn, null first; turns that share a number are in the order of a hash
    of role and text.  Null roles and texts are empty; rows without a conv_id belong to
    no conversation and are left out."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").alias("turn"),
        F.xxhash64(F.lit(1), role, text).alias("h1"),
        F.xxhash64(F.lit(2), text, role).alias("h2"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
    )
    order = ["conv_id", F.col("turn").asc_nulls_first(), "h1", "h2"]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    turns = keep(dealt.select("conv_id", "h1", "h2", "words").mapInArrow(_running, _ORDERED), "trie-turns")
    edges = sorted((r["part"], r["low"], r["high"]) for r in turns.groupBy("part").agg(F.min("conv_id").alias("low"), F.max("conv_id").alias("high")).collect())
    cut = {a[2] for a, b in zip(edges, edges[1:], strict=False) if a[2] == b[1]}  # conversations that go on in the next task
    if not cut:
        return turns.drop("part")
    spark = conversations.sparkSession
    split = F.broadcast(spark.createDataFrame([(c,) for c in sorted(cut)], "conv_id long"))
    last = F.max(F.struct("pos", "upto1", "upto2")).alias("last")
    shift: dict[int, tuple[int, int, int, int]] = {}  # by task: the conversation that goes on there, and what came before
    at: dict[int, tuple[int, int, int]] = {}
    for r in turns.join(split, "conv_id", "left_semi").groupBy("conv_id", "part").agg(last).orderBy("conv_id", "part").collect():
        count, *sums = at.get(r["conv_id"], (0, 0, 0))
        if count:
            shift[r["part"]] = (r["conv_id"], count, *sums)
        power = pow(R, count, 1 << 64)
        at[r["conv_id"]] = (count + r["last"]["pos"] + 1, *((s + power * x) & MASK for s, x in zip(sums, r["last"][1:], strict=True)))

    def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, parts, pos = (batch.column(i).to_numpy(zero_copy_only=False).copy() for i in (0, 1, 2))
            sums = [batch.column(i).to_numpy(zero_copy_only=False).view(np.uint64).copy() for i in range(4, 8)]
            for part in set(np.unique(parts).tolist()) & shift.keys():
                conv, count, *before = shift[part]
                own = (parts == part) & (ids == conv)
                pos[own] += count
                for i, x in enumerate(sums):
                    x[own] = x[own] * np.uint64(pow(R, count, 1 << 64)) + np.uint64(before[i % 2])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pos), batch.column(3), *(pa.array(x.view(np.int64)) for x in sums)], names)

    names = [c.split()[0] for c in _ORDERED.split(", ") if not c.startswith("part")]
    return turns.mapInArrow(moved, ", ".join(c for c in _ORDERED.split(", ") if not c.startswith("part")))


def shared_turns(conv_id: Column) -> Column:
    """How many turns of its family's head a conversation takes: crc32 of its decimal id, modulo 4."""
    return F.pmod(F.crc32(conv_id.cast("string").cast("binary")), F.lit(MOST_SHARED)).cast("int")


_MEMBER = "conv_id long, depth long, k1 long, k2 long, p1 long, p2 long, words long, ends boolean"


def rebuilt_prefixes(turns: DataFrame) -> DataFrame:
    """One row per rebuilt conversation and prefix of it, the empty one included.

    A conversation is rebuilt from the first h turns of its family's head (as many as
    there are) and its own turns after its first h.  ``turns`` is the result of
    ``ordered_turns``; (k1, k2) is the hash of the prefix, (p1, p2) that of its parent,
    words those of its last text; ends: the conversation has no further turn."""
    shared = MOST_SHARED - 1
    heads = [F.max(F.when(F.col("pos") == i, F.struct("upto1", "upto2", "words"))).alias(f"a{i}") for i in range(shared)]
    convs = keep(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), *heads).withColumn("h", shared_turns(F.col("conv_id"))), "trie-convs")
    head = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("bn"), *(F.col(f"a{i}").alias(f"b{i}") for i in range(shared)))
    both = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY).join(head, "base", "left")
    taken = F.least(F.col("h").cast("long"), F.coalesce("bn", F.lit(0)))
    upto = lambda stem, count, i: F.coalesce(*(F.when(count == j + 1, F.col(f"{stem}{j}.upto{i}")) for j in range(shared)), F.lit(0))
    info = both.select(
        "conv_id", "h", taken.alias("m"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len"),
        *(upto("b", taken, i).alias(f"lead{i}") for i in (1, 2)), *(upto("a", F.col("h"), i).alias(f"skip{i}") for i in (1, 2)),
        *(f"b{i}" for i in range(shared)),
    )
    info = keep(info, "trie-info")
    zero, ends = F.lit(0).cast("long"), F.col("depth") == F.col("len")
    root = info.select("conv_id", zero.alias("depth"), *(zero.alias(c) for c in ("k1", "k2", "p1", "p2", "words")), (F.col("len") == 0).alias("ends"))
    led = root
    for i in range(shared):
        parent = [F.col(f"b{i - 1}.upto{x}") if i else zero for x in (1, 2)]
        some = info.where(F.col("m") > i).withColumn("depth", F.lit(i + 1).cast("long"))
        led = led.union(some.select("conv_id", "depth", f"b{i}.upto1", f"b{i}.upto2", *parent, f"b{i}.words", ends))
    own = turns.where(F.col("pos") >= shared_turns(F.col("conv_id"))).join(info.drop(*(f"b{i}" for i in range(shared))), "conv_id")
    own = own.select("conv_id", (F.col("m") + F.col("pos") - F.col("h") + 1).alias("depth"), "words", "len", (F.col("h") - F.col("m")).cast("int").alias("back"), "lead1", "lead2", "skip1", "skip2", "upto1", "upto2", "before1", "before2")
    scale = np.array([pow(R_INVERSE, i, 1 << 64) for i in range(MOST_SHARED)], np.uint64)

    def rehashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = lambda c: batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False)  # noqa: B023, E731
            by = scale[col("back")]
            keys = [(col(f"lead{i}").view(np.uint64) + by * (col(f"{c}{i}").view(np.uint64) - col(f"skip{i}").view(np.uint64))).view(np.int64) for c in ("upto", "before") for i in (1, 2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, keys), batch.column(2), pa.array(col("depth") == col("len"))], [c.split()[0] for c in _MEMBER.split(", ")])

    return led.union(own.mapInArrow(rehashed, _MEMBER))


_NODE = ["depth", "k1", "k2"]


def _digests(members: DataFrame) -> DataFrame:
    """``(depth, k1, k2, ends_sha256)`` of the nodes at which conversations end.

    Ids are written out in pieces by their upper bits, at most 2^PIECE_BITS of a node
    each; the pieces of a node are then hashed one after the other, in order."""
    piece = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids")
    pieces = members.where("ends").groupBy(*_NODE, F.shiftright("conv_id", PIECE_BITS).alias("at")).agg(piece)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None

        def done(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.array([r[i] for r in rows], pa.int64()) for i in range(3)), pa.array([r[3] for r in rows], pa.string())], [*_NODE, "ends_sha256"])

        for batch in batches:
            rows = []
            for d, a, b, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (d, a, b) == node:
                    state.update(b"," + ids.encode())
                    continue
                if node:
                    rows.append((*node, state.hexdigest()))
                node, state = (d, a, b), hashlib.sha256(ids.encode())
            yield done(rows)
        if node:
            yield done([(*node, state.hexdigest())])

    dealt = pieces.repartition(*_NODE).sortWithinPartitions(*_NODE, "at")
    return dealt.select(*_NODE, "ids").mapInArrow(hashed, "depth long, k1 long, k2 long, ends_sha256 string")


def trie_nodes(members: DataFrame) -> DataFrame:
    """``(conv_id, depth, parent_conv_id, n_convs, n_children, words, ends_sha256)`` per
    node of a written table of prefixes (``rebuilt_prefixes``); (conv_id, depth) is its key."""
    nodes = keep(members.groupBy(*_NODE).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("words").alias("words"), F.min("p1").alias("p1"), F.min("p2").alias("p2")), "trie-nodes")
    kids = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count(F.lit(1)).alias("n_children"))
    known = nodes.join(kids, _NODE, "left").join(_digests(members), _NODE, "left")
    known = keep(known.withColumns({"n_children": F.coalesce("n_children", F.lit(0)), "ends_sha256": F.coalesce("ends_sha256", F.lit(NO_ENDS))}), "trie-known")
    busy = F.col("n_children") > nodes.count() / HOT
    named = lambda df: df.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    common = F.broadcast(named(known.where(busy)))
    key = ["depth", "p1", "p2"]
    below = known.where("depth > 0")
    found = below.join(common, key).unionByName(below.join(common.drop("parent_conv_id"), key, "left_anti").join(named(known.where(~busy)), key))
    found = found.unionByName(known.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")))
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "words", "ends_sha256")


def _peel_here(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What the rounds would do, for the few paths of one task."""
    rows = pd.concat(list(frames), ignore_index=True)
    if rows.empty:
        return
    at = {c: i for i, c in enumerate(rows["conv_id"].tolist())}
    left, leaves, saved = (rows[c].tolist() for c in ("waiting", "n_leaves", "saved_tokens"))
    above = [at.get(p) if p == p and p is not None else None for p in rows["parent_conv_id"].tolist()]
    ready = [i for i, n in enumerate(left) if n == 0]
    while ready:
        i = ready.pop()
        up = above[i]
        if up is not None:
            leaves[up] += leaves[i]
            saved[up] += saved[i]
            left[up] -= 1
            if left[up] == 0:
                ready.append(up)
    yield rows.assign(waiting=0, n_leaves=leaves, saved_tokens=saved)


def peel(paths: DataFrame, rounds: int = ROUNDS, few: int = FEW) -> DataFrame:
    """Subtree totals of every path: ``paths`` holds ``(conv_id, parent_conv_id, top,
    n_leaves, saved_tokens)``, its own totals; the parent of the root's is null.

    Rounds go on until the root's path is done.  After ``rounds`` of them, if at most
    ``few`` paths are left, these are finished in one task by the same rule."""
    kids = paths.where("parent_conv_id is not null").groupBy(F.col("parent_conv_id").alias("conv_id")).agg(F.count(F.lit(1)).alias("waiting"))
    state = keep(paths.join(kids, "conv_id", "left").withColumn("waiting", F.coalesce("waiting", F.lit(0)).cast("long")), "trie-state")
    names = state.columns
    finished, left, turn = [], state.count(), 0
    while left:
        if turn >= rounds and left <= few:
            finished.append(keep(state.coalesce(1).mapInPandas(_peel_here, state.schema), "trie-done"))
            break
        done = keep(state.where("waiting = 0"), "trie-done")
        finished.append(done)
        told = done.where("parent_conv_id is not null").groupBy(F.col("parent_conv_id").alias("conv_id")).agg(F.count(F.lit(1)).alias("_n"), F.sum("n_leaves").alias("_l"), F.sum("saved_tokens").alias("_s"))
        rest = state.where("waiting > 0").join(told, "conv_id", "left")
        plus = lambda c, d: (F.col(c) + F.coalesce(d, F.lit(0))).alias(c)
        after = keep(rest.select("conv_id", "parent_conv_id", "top", plus("n_leaves", "_l"), plus("saved_tokens", "_s"), (F.col("waiting") - F.coalesce("_n", F.lit(0))).alias("waiting")).select(names), "trie-state")
        forget(state)
        state, before, turn = after, left, turn + 1
        left = state.count()
        if left == before:
            raise RuntimeError("paths wait for each other: the table is no tree")
    out = finished[0] if finished else state
    for more in finished[1:]:
        out = out.union(more)
    return out


def subtree_totals(nodes: DataFrame) -> DataFrame:
    """Add n_leaves and saved_tokens, over each node's subtree, to a written table of nodes."""
    own_leaf, own_saved = (F.col("n_children") == 0).cast("long"), (F.col("n_convs") - 1) * F.col("words")
    paths = nodes.groupBy("conv_id").agg(F.min_by("parent_conv_id", "depth").alias("parent_conv_id"), F.min("depth").alias("top"), F.sum(own_leaf).alias("n_leaves"), F.sum(own_saved).alias("saved_tokens"))
    done = peel(paths)
    sent = done.where("parent_conv_id is not null").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("top") - 1).alias("depth")).agg(F.sum("n_leaves").alias("_l"), F.sum("saved_tokens").alias("_s"))
    got = nodes.join(sent, ["conv_id", "depth"], "left")
    got = got.select(*nodes.columns, (own_leaf + F.coalesce("_l", F.lit(0))).alias("_l"), (own_saved + F.coalesce("_s", F.lit(0))).alias("_s"), F.floor(F.col("depth") / STRETCH).alias("_at"))
    got = keep(got, "trie-values")
    # from the end of each path up: whole stretches below, then within the stretch
    below = W.partitionBy("conv_id").orderBy(F.desc("_at")).rowsBetween(W.unboundedPreceding, -1)
    whole = got.groupBy("conv_id", "_at").agg(F.sum("_l").alias("l"), F.sum("_s").alias("s"))
    whole = whole.select("conv_id", "_at", F.coalesce(F.sum("l").over(below), F.lit(0)).alias("l"), F.coalesce(F.sum("s").over(below), F.lit(0)).alias("s"))
    within = W.partitionBy("conv_id", "_at").orderBy(F.desc("depth")).rowsBetween(W.unboundedPreceding, 0)
    summed = got.withColumns({"_l": F.sum("_l").over(within), "_s": F.sum("_s").over(within)}).join(whole, ["conv_id", "_at"])
    return summed.select(*nodes.columns, (F.col("_l") + F.col("l")).alias("n_leaves"), (F.col("_s") + F.col("s")).alias("saved_tokens"))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """``(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256)`` per node of the trie of rebuilt conversations.

    Null roles and texts are empty, null turns come first; turns that share a number are
    in the order of a hash of role and text; repeated rows are turns like others; rows
    without a conv_id are left out.  An empty table has no node, not even a root.  Columns
    other than conv_id, turn, role and text are not read.  Ids may be negative: the family's
    head of c is c - c % 20 with the remainder of the sign of c, as SQL has it."""
    members = keep(rebuilt_prefixes(ordered_turns(conversations)), "trie-members")
    nodes = keep(trie_nodes(members), "trie-named")
    return subtree_totals(nodes).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op13_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


_CRC = """xor(list_reduce(list_concat([4294967295], list_transform(range(1, len(CAST(conv_id AS VARCHAR)) + 1), lambda i: CAST(ord(CAST(conv_id AS VARCHAR)[i]) AS BIGINT))),
    lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"""

OP13_SQL = f"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (SELECT conv_id, {_CRC} % 4 AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (
  SELECT c.conv_id, 0 AS own, t.pos, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 20 AND t.pos < c.h
  UNION ALL SELECT c.conv_id, 1, t.pos, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos >= c.h
), s AS (
  SELECT conv_id, row_number() OVER w AS d, list({{'r': role, 't': text}}) OVER w AS key, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words
  FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY own, pos)
), i AS (
  SELECT conv_id, d, key, words FROM s UNION ALL SELECT conv_id, 0, [], 0 FROM c
), l AS (SELECT conv_id, max(d) AS len FROM i GROUP BY 1),
n AS (
  SELECT i.d, i.key, min(i.conv_id) AS conv_id, count(*) AS n_convs, max(words) AS words, sha256(coalesce(string_agg(CAST(i.conv_id AS VARCHAR), ',' ORDER BY i.conv_id) FILTER (l.len = i.d), '')) AS ends
  FROM i JOIN l USING (conv_id) GROUP BY 1, 2
), k AS (SELECT d - 1 AS d, key[1:d - 1] AS key, count(*) AS n FROM n WHERE d > 0 GROUP BY 1, 2),
f AS (SELECT n.*, coalesce(k.n, 0) AS kids FROM n LEFT JOIN k ON k.d = n.d AND k.key = n.key),
u AS (
  SELECT e AS d, key[1:e] AS key, sum(CASE WHEN kids = 0 THEN 1 ELSE 0 END) AS leaves, sum((n_convs - 1) * words) AS saved
  FROM (SELECT f.*, unnest(range(0, d + 1)) AS e FROM f) GROUP BY 1, 2
)
SELECT f.conv_id, f.d AS depth, p.conv_id AS parent_conv_id, f.n_convs, f.kids AS n_children, CAST(u.leaves AS BIGINT) AS n_leaves, CAST(u.saved AS BIGINT) AS saved_tokens, f.ends AS ends_sha256
FROM f JOIN u ON u.d = f.d AND u.key = f.key LEFT JOIN f p ON p.d = f.d - 1 AND p.key = f.key[1:f.d - 1]
"""
