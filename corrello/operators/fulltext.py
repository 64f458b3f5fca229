"""Full-text search over stored posting lists with positions.

``build`` cuts the documents into blocks and inverts each in its task: words become
terms (normal forms, made once per word), and a term's row of a block lists, as
differences in variable-length bytes, the documents of the block and the positions in
them.  Lists are written by hash of the term, so a query reads those of its terms and
no text.  As a block holds whole documents, its lists meet in one place: a phrase is
where positions follow each other, AND, OR and NOT are set operations on documents.
Each phrase, a single word being one, scores by BM25 with its own frequency.  Texts are
read of the documents shown, for their snippets.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from corrello.functions.porter import normal
from corrello.operators.search import B, K1, idf, parse_query, terms
from corrello.store import fresh_path, keep

BUCKETS = 64
#: A bucket is written by so many tasks, so that a frequent term is not one task's.
SPLIT = 8
#: Words of a block, and words whose term a task remembers.
BLOCK, REMEMBERED = 2_000_000, 500_000
_WORD = re.compile(r"[^\W_]+")


def _place(term: Column, buckets: int) -> Column:
    """The bucket of a term; documents' rows, which have none, lie in a bucket of their own."""
    return F.when(term.isNull(), -1).otherwise(F.pmod(F.xxhash64(term), F.lit(buckets))).cast("int")


def _pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers below 2^32 as bytes of 7 bits each, the last of a number below 128; and where each starts."""
    size = 1 + (values >= 1 << 7) + (values >= 1 << 14) + (values >= 1 << 21) + (values >= 1 << 28)
    at = np.concatenate(([0], np.cumsum(size)))
    out = np.zeros(at[-1], np.uint8)
    for k in range(int(size.max(initial=0))):
        own = size > k
        out[at[:-1][own] + k] = (values[own] >> (7 * k) & 127) | np.where(size[own] > k + 1, 128, 0)
    return out, at


def _unpack(raw: bytes) -> np.ndarray:
    part = np.frombuffer(raw, np.uint8).astype(np.int64)
    if not len(part):
        return part
    ends = np.flatnonzero(part < 128)
    starts = np.concatenate(([0], ends[:-1] + 1))
    within = np.arange(len(part)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((part & 127) << (7 * within), starts)


class _Terms(dict):
    """The term of a word, remembered."""

    def __init__(self, stemmed: bool) -> None:
        self.stemmed = stemmed

    def __missing__(self, word: str) -> str:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[word] = normal(word, self.stemmed)
        return found


class _Block:
    """The documents of a block, inverted when it is full."""

    def __init__(self, known: _Terms) -> None:
        self.known, self.rows, self.lengths, self.size = known, [], [], 0
        self.number: dict[str, int] = {}  # of a term
        self.of_word: dict[str, int] = {}
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, texts: list[str]) -> int:
        """Take in the texts of a document; returns how many words it has."""
        here: list[int] = []
        at: list[np.ndarray] = []
        start = 0
        for text in texts:
            words = _WORD.findall(text.lower())
            for w in words:
                n = self.of_word.get(w)
                if n is None:
                    n = self.of_word[w] = self.number.setdefault(self.known[w], len(self.number))
                here.append(n)
            at.append(np.arange(start, start + len(words)))
            start += len(words) + 1  # a place is left free, so that no phrase crosses
        if here:
            self.parts.append((np.array(here, np.int64), np.concatenate(at)))
            self.lengths.append(len(here))
            self.size += len(here)
        return len(here)

    def lists(self) -> tuple[pa.Array, pa.Array]:
        """Terms and their packed lists of (documents further on, positions further on)."""
        term = np.concatenate([p[0] for p in self.parts])
        pos = np.concatenate([p[1] for p in self.parts])
        doc = np.repeat(np.arange(len(self.parts)), self.lengths)
        order = np.argsort(term, kind="stable")
        term, pos, doc = term[order], pos[order], doc[order]
        head = np.concatenate(([True], term[1:] != term[:-1]))
        step = np.where(head, doc, doc - np.concatenate(([0], doc[:-1])))
        same = ~head & (step == 0)
        move = np.where(same, pos - np.concatenate(([0], pos[:-1])), pos)
        raw, at = _pack(np.stack([step, move], 1).ravel())
        first = at[2 * np.flatnonzero(head)]
        offsets = np.append(first, at[-1]).astype(np.int32)
        names = list(self.number)
        lists = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])
        return pa.array([names[t] for t in term[head].tolist()], pa.string()), lists


@dataclass
class Index:
    """An index in ``path`` over the ``columns`` of ``texts`` (with column id)."""

    spark: SparkSession
    path: str
    texts: DataFrame
    columns: list[str]
    stemmed: bool
    buckets: int

    def _read(self) -> DataFrame:
        kind = self.texts.schema["id"].dataType.simpleString()
        return self.spark.read.schema(f"block long, term string, list binary, ids array<{kind}>, lengths array<int>, bucket int").parquet(self.path)

    def lists(self, wanted: list[str]) -> DataFrame:
        """``(block, term, list)`` of the terms, from their buckets."""
        places = {r[0] for r in self.spark.createDataFrame([(t,) for t in wanted], "term string").select(_place(F.col("term"), self.buckets)).collect()}
        return self._read().where(F.col("bucket").isin(sorted(places)) & F.col("term").isin(wanted)).select("block", "term", "list")

    def documents(self) -> DataFrame:
        """``(block, ids, lengths)``: one row per block."""
        return self._read().where("bucket = -1").select("block", "ids", "lengths")


def build(df: DataFrame, id_col: str, columns: list[str], stemmed: bool = True, path: str | None = None, buckets: int = BUCKETS) -> Index:
    """Index the texts of ``columns``.

    A word is a run of letters and digits, in lower case and normal form.  Phrases do
    not cross columns.  Null texts are empty; rows of one id count as documents of
    their own and are found as one; documents without a word are not counted.  An empty
    table gives an index that finds nothing."""
    spark = df.sparkSession
    path = path or fresh_path(spark, "fulltext")
    rows = df.select(F.col(id_col).alias("id"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns])
    kind = rows.schema["id"].dataType

    def invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, made = _Terms(stemmed), TaskContext.get().partitionId() << 32
        block = _Block(known)
        id_type = None

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal block, made
            words, lists = block.lists()
            names = ["block", "term", "list", "ids", "lengths"]
            ids, lengths = pa.array([block.rows], pa.list_(id_type)), pa.array([block.lengths], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array([made]), pa.nulls(1, pa.string()), pa.nulls(1, pa.binary()), ids, lengths], names)
            for at in range(0, len(words), 50_000):
                n = len(words[at : at + 50_000])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, made)), words[at : at + n], lists[at : at + n], pa.nulls(n, ids.type), pa.nulls(n, lengths.type)], names)
            block, made = _Block(known), made + 1

        for batch in batches:
            id_type = batch.column(0).type
            for i in range(batch.num_rows):
                ident, *texts = (c[i].as_py() for c in batch.columns)
                if block.add(texts):
                    block.rows.append(ident)
                if block.size >= BLOCK:
                    yield from out()
        if block.size:
            yield from out()

    schema = StructType.fromDDL("block long, term string, list binary").add(StructField("ids", StructType.fromDDL(f"x array<{kind.simpleString()}>")["x"].dataType))
    schema = schema.add(StructField("lengths", StructType.fromDDL("x array<int>")["x"].dataType))
    made = rows.mapInArrow(invert, schema).withColumn("bucket", _place(F.col("term"), buckets))
    dealt = made.repartition("bucket", F.pmod(F.xxhash64("block"), F.lit(SPLIT))).sortWithinPartitions("bucket", "term")
    dealt.write.partitionBy("bucket").parquet(path)
    return Index(spark, path, rows, columns, stemmed, buckets)


def _phrases(tree: tuple) -> list[str]:
    return [tree[1]] if tree[0] == "term" else list(dict.fromkeys(p for x in tree[1:] for p in _phrases(x)))


def _fits(tree: tuple, found: dict[str, np.ndarray]) -> np.ndarray:
    """The documents that match, from those that hold each phrase."""
    if tree[0] == "term":
        return found[tree[1]]
    left, right = (_fits(x, found) for x in tree[1:])
    return {"and": np.intersect1d, "or": np.union1d, "not": np.setdiff1d}[tree[0]](left, right)


def _places(raw: bytes) -> np.ndarray:
    """Document << 32 | position of every entry of a list."""
    step, move = _unpack(raw).reshape(-1, 2).T
    doc = np.cumsum(step)
    head = np.flatnonzero(np.concatenate(([True], step[1:] > 0)))
    total = np.cumsum(move)
    size = np.diff(np.append(head, len(step)))
    return doc << 32 | total - np.repeat(total[head] - move[head], size)


def matches(index: Index, query: str) -> DataFrame:
    """``(id, length, counts, fits, marks)`` of every document that holds a phrase of the
    query: how often it holds each, whether it matches, and (position, words) of all hits."""
    tree = parse_query(query)
    phrases = _phrases(tree)
    words = {p: [normal(w, index.stemmed) for w in p.split()] for p in phrases}
    wanted = list(dict.fromkeys(w for ws in words.values() for w in ws))
    met = index.lists(wanted).groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("term", "list"))).alias("lists")).join(index.documents(), "block")
    kind = index.texts.schema["id"].dataType.simpleString()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.empty(0, np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                places = {t: _places(raw) for t, raw in batch.column(0)[i].as_py()}
                hits = {p: reduce(lambda a, b: np.intersect1d(a, b, assume_unique=True), [places.get(w, none) - j for j, w in enumerate(ws)]) for p, ws in words.items()}
                docs, counts = {}, {}
                for p, h in hits.items():
                    docs[p], counts[p] = np.unique(h >> 32, return_counts=True)
                any_ = reduce(np.union1d, docs.values())
                if not len(any_):
                    continue
                table = np.zeros((len(any_), len(phrases)), np.int32)
                for k, p in enumerate(phrases):
                    table[np.searchsorted(any_, docs[p]), k] = counts[p]
                fits = np.isin(any_, _fits(tree, docs))
                at = np.concatenate(list(hits.values()))
                long = np.concatenate([np.full(len(h), len(words[p])) for p, h in hits.items()])
                order = np.lexsort((long, at))
                at, long = at[order], long[order]
                ends = np.searchsorted(at >> 32, any_, "right")
                marks = pa.ListArray.from_arrays(
                    pa.array(np.concatenate(([0], ends)).astype(np.int32)),
                    pa.StructArray.from_arrays([pa.array((at & 0xFFFFFFFF).astype(np.int32)), pa.array(long.astype(np.int32))], ["at", "n"]),
                )
                counted = pa.ListArray.from_arrays(pa.array(np.arange(len(any_) + 1, dtype=np.int32) * len(phrases)), pa.array(table.ravel()))
                own = pa.array(any_)
                yield pa.RecordBatch.from_arrays([batch.column(1)[i].values.take(own), batch.column(2)[i].values.take(own), counted, pa.array(fits), marks], ["id", "length", "counts", "fits", "marks"])

    return met.select("lists", "ids", "lengths").mapInArrow(meet, f"id {kind}, length int, counts array<int>, fits boolean, marks array<struct<at:int,n:int>>")


def search(index: Index, query: str, limit: int | None = 20, shown: str | None = None, width: int = 12) -> DataFrame:
    """``(id, score, snippet)`` of the best documents that match (None: of all), best
    first, ties to the smaller id.

    ``query``: words, "phrases", AND, OR, NOT, parentheses; words beside each other are
    AND.  The snippet holds ``width`` words of the column ``shown`` (the first of the
    index) around what was found there, each hit in brackets."""
    met = keep(matches(index, query), "fulltext-met")
    k = len(_phrases(parse_query(query)))
    length = F.col("lengths")
    size = index.documents().agg(F.coalesce(F.sum(F.size(length)), F.lit(0)).alias("n"), F.sum(F.aggregate(length, F.lit(0).cast("long"), lambda s, x: s + x)).alias("words")).first()
    docs = met.agg(F.lit(0), *[F.count_if(F.col("counts")[i] > 0) for i in range(k)]).first()[1:]
    mean = (size["words"] or 0) / size["n"] if size["n"] else 1.0
    long = K1 * (1 - B + B * F.col("length") / F.lit(float(mean)))
    part = [idf(F.lit(float(size["n"])), F.lit(float(n))) * F.col("counts")[i] * (K1 + 1) / (F.col("counts")[i] + long) for i, n in enumerate(docs)]
    found = met.where("fits").withColumn("score", reduce(lambda a, b: a + b, part))
    best = found.groupBy("id").agg(F.max("score").alias("score"), F.max_by("marks", "score").alias("marks"))
    shown = shown or index.columns[0]
    texts = index.texts.select("id", *index.columns[: index.columns.index(shown) + 1])
    if limit is not None:
        best = keep(best.orderBy(F.desc("score"), "id").limit(limit), "fulltext-best")
        texts = texts.where(F.col("id").isin([r["id"] for r in best.select("id").collect()]))  # at most ``limit`` ids
    texts = texts.dropDuplicates(["id"])
    before = F.lit(0)
    for c in index.columns[: index.columns.index(shown)]:
        before = before + F.size(terms(F.col(c))) + 1
    cut = _snippet(width)(F.col(shown), before, F.col("marks.at"), F.col("marks.n"))
    return best.join(texts, "id").select("id", "score", cut.alias("snippet")).orderBy(F.desc("score"), "id")


def excerpt(text: str, places: list[tuple[int, int]], width: int = 12) -> str:
    """``width`` words of the text with the phrases (first word, number of words) in brackets.

    The window is the one with the most different hits, the earliest of these, and
    begins a third of its width before the first."""
    spans = [m.span() for m in _WORD.finditer(text)]
    if not spans:
        return text
    places = [(a, min(a + n, len(spans))) for a, n in places if 0 <= a < len(spans)]
    lead = width // 3
    tries = [max(0, min(a - lead, len(spans) - width)) for a, _ in places] or [0]
    start = max(tries, key=lambda s: (sum(s <= a and b <= s + width for a, b in places), -s))
    end = min(start + width, len(spans))
    opens, closes = {spans[a][0] for a, b in places if start <= a < end}, {spans[min(b, end) - 1][1] for a, b in places if start <= a < end}
    low, high = 0 if start == 0 else spans[start][0], len(text) if end == len(spans) else spans[end - 1][1]
    out = "".join(("]" if i in closes else "") + ("[" if i in opens else "") + (text[i] if i < high else "") for i in range(low, high + 1))
    return ("…" if low else "") + out + ("…" if high < len(text) else "")


def _snippet(width: int):
    @F.arrow_udf("string")
    def cut(texts: pa.Array, before: pa.Array, at: pa.Array, n: pa.Array) -> pa.Array:
        rows = zip(*(c.to_pylist() for c in (texts, before, at, n)), strict=True)
        return pa.array([excerpt(t or "", [(a - b, k) for a, k in zip(places or [], sizes or [], strict=True)], width) for t, b, places, sizes in rows], pa.string())

    return cut
