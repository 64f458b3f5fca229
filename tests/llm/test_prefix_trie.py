"""op13 against plain dictionaries, with the awkward rows."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from corrello.llm import prefix_trie as pt

TURNS = "conv_id long, turn long, role string, text string, depth string"


def brute(rows):
    """Rows (conv_id, turn, role, text) in the order they are to be taken."""
    own = defaultdict(list)
    for c, _, role, text in rows:
        if c is not None:
            own[c].append((role or "", text or ""))
    nodes = defaultdict(list)
    ends = defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        seq = tuple(own.get(base, [])[:h] + own[c][h:])
        for d in range(len(seq) + 1):
            nodes[seq[:d]].append(c)
        ends[seq].append(c)
    kids = defaultdict(int)
    for s in nodes:
        if s:
            kids[s[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for s, m in nodes.items():
        own_saved = (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", s[-1][1])) if s else 0
        for d in range(len(s) + 1):
            leaves[s[:d]] += kids[s] == 0
            saved[s[:d]] += own_saved
    out = []
    for s, m in nodes.items():
        sha = hashlib.sha256(",".join(map(str, sorted(ends[s]))).encode()).hexdigest()
        out.append((min(m), len(s), min(nodes[s[:-1]]) if s else -1, len(m), kids[s], leaves[s], saved[s], sha))
    return sorted(out)


def plain(df):
    return sorted((r[0], r[1], -1 if r[2] is None else r[2], *r[3:]) for r in df.collect())


def talk(rng, families, longest=6):
    rows = []
    for c in range(families * 20):
        if rng.random() < 0.7:
            rows += [(c, t, rng.choice(("user", "assistant", None)), rng.choice(("hello", "hello there you", "", None, "a\nb  c"))) for t in range(rng.randrange(1, longest))]
    return rows


@pytest.mark.parametrize("few", [0, 50_000])
def test_trie_equals_dictionaries(spark, tmp_path, monkeypatch, few):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", str(not few).lower())
    monkeypatch.setattr(pt, "STRETCH", 3)
    monkeypatch.setattr(pt, "PIECE_BITS", 2)
    monkeypatch.setattr(pt, "HOT", 20)
    monkeypatch.setattr(pt.peel, "__defaults__", (1 if few else 32, few))
    rng = random.Random(2)
    rows = talk(rng, 6)
    rows += [(c, t, "user", f"copied {t}") for c in range(200, 260) for t in range(4)]  # one conversation, many times
    rows += [(400, t, "user", f"long {t % 7}") for t in range(300)] + [(401, t, "user", f"long {t % 7}") for t in range(280)] + [(419, None, None, None)]
    rows += [(-5, 0, "user", "x"), (-5, 1, "user", "y"), (None, 0, "user", "left out"), (1 << 61, 0, "user", "x y"), (440, None, "user", "first"), (440, -7, "user", "second")]
    rows += [(600 + i, t, "user", "deep" if t < i else f"own {i}") for i in range(0, 9) for t in range(i + 1)]  # paths that hang on each other
    rng.shuffle(rows)
    in_order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or 0))
    spark.createDataFrame([(*r, "clash") for r in rows], TURNS).write.parquet(f"{tmp_path}/conversations.parquet")
    try:
        assert plain(pt.op13_prefix_trie(spark, str(tmp_path))) == brute(in_order)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_a_conversation_may_span_tasks(spark):
    rows = [(c, t, "user", f"turn {t % 11} of {c % 2}") for c, n in ((3, 40), (7, 900), (8, 700), (27, 30)) for t in range(n)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame([(*r, "") for r in rows], TURNS)
        turns = pt.ordered_turns(df)
        assert sorted((r[0], r[1]) for r in turns.select("conv_id", "pos").collect()) == [(c, t) for c, t, *_ in rows]
        assert "MapInArrow" in turns._jdf.queryExecution().toString()  # the sums were shifted
        assert plain(pt.prefix_trie(df)) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_trie_equals_its_sql(spark, tmp_path):
    rows = talk(random.Random(4), 3)
    spark.createDataFrame([(*r, "clash") for r in rows], TURNS).coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = sorted((r[0], r[1], -1 if r[2] is None else r[2], *r[3:]) for r in con.execute(pt.OP13_SQL).fetchall())
    assert plain(pt.op13_prefix_trie(spark, str(tmp_path))) == want == brute(rows)


def test_ties_and_repeated_rows_have_a_place(spark):
    rows = [(1, 5, "user", x) for x in ("b", "a", "a", "c")] + [(1, None, "user", "z")]
    df = spark.createDataFrame([(*r, "") for r in rows], TURNS)
    got = plain(pt.prefix_trie(df))
    assert got == plain(pt.prefix_trie(df.repartition(3).orderBy(F.desc("text"))))
    h = zlib.crc32(b"1") % 4
    assert len(got) == 1 + 5 - h and got[0][3:6] == (1, 1 if h < 5 else 0, 1)


def test_no_rows_no_root(spark):
    empty = spark.createDataFrame([], TURNS)
    assert pt.prefix_trie(empty).count() == 0
    assert pt.prefix_trie(spark.createDataFrame([(None, 1, "user", "x", "")], TURNS)).count() == 0


def test_only_short_conversations_end_at_the_root(spark):
    some = [c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 >= 1]
    got = plain(pt.prefix_trie(spark.createDataFrame([(c, 0, "user", "gone", "") for c in some], TURNS)))
    assert got == brute([(c, 0, "user", "gone") for c in some]) and len(got) == 1
