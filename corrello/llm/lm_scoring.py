"""Language-model scores: a word count model and a subword lattice.

Lattice: an existing subword vocabulary gives the pieces; their probabilities
are learned from the training fold (the vocabulary's own scores are merge ranks,
not probabilities).  A text is the sequence of its words, each "▁" + word, and
one end.  The probability of a word is the sum over all its segmentations into
pieces, by a forward recursion in log space; a character may always be spelled
as its bytes, so every text has one.  Words are segmented apart, so the sum over
all segmentations of a text is the product over its words.

Counting: each task counts its words, the shuffle adds up per word.  Each
distinct word is scored once.  The ``COMMON`` most frequent words (at most
``COMMON_BYTES`` bytes each, so a bounded table) are looked up while reading the
texts; only the rest of a text's words is shuffled to the word table.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from math import exp, log, log10

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corrello.store import keep, table

COMMON, COMMON_BYTES = 200_000, 64
#: One in so many words makes a longer one hot.
HOT_LONG = 10_000
#: Distinct words a counting task holds before it hands them on.
HELD = 250_000
SMOOTH = 0.1
END = ""  # the end token; no word is empty
_LN10 = log(10)


def _counts(text: str | None) -> Counter:
    """Words of a text (A-Z lower-cased, runs without ASCII white space), counted."""
    if not text:
        return Counter()
    return Counter([w.decode("utf-8", "surrogatepass") for w in text.encode("utf-8", "surrogatepass").lower().split()])


def count_words(docs: DataFrame, folds: int = 7, fold: int = 2) -> DataFrame:
    """``(word, c, total)``: occurrences in the training fold and in all texts;
    END counts texts.  A row with a null id belongs to the training fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        train, rest = Counter(), Counter()

        def flush() -> pa.RecordBatch:
            words = list(train.keys() | rest.keys())
            text = pa.array([w.decode("utf-8", "surrogatepass") for w in words], pa.string())
            c = np.fromiter((train[w] for w in words), np.int64, len(words))
            total = c + np.fromiter((rest[w] for w in words), np.int64, len(words))
            train.clear()
            rest.clear()
            return pa.RecordBatch.from_arrays([text, pa.array(c), pa.array(total)], ["word", "c", "total"])

        for batch in batches:
            for held, text in zip(batch.column(0), batch.column(1), strict=True):
                into = rest if held.as_py() else train
                into.update((text.as_py() or "").encode("utf-8", "surrogatepass").lower().split())
                into[b""] += 1
                if len(train) + len(rest) > HELD:
                    yield flush()
        yield flush()

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == fold, F.lit(False))
    parts = docs.select(held.alias("h"), F.col("text").cast("string").alias("text")).mapInArrow(run, "word string, c long, total long")
    return parts.groupBy("word").agg(F.sum("c").alias("c"), F.sum("total").alias("total"))


def vocabulary(model_path: str) -> tuple[dict[str, int], list[int]]:
    """Pieces by text, and the ids of the 256 byte pieces."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    pieces, spell = {}, [-1] * 256
    for i in range(sp.get_piece_size()):
        if sp.is_byte(i):
            spell[int(sp.id_to_piece(i)[3:-1], 16)] = i
        elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
            pieces[sp.id_to_piece(i)] = i
    return pieces, spell


def piece_counts(words: DataFrame, model_path: str) -> dict[int, int]:
    """Occurrences of each piece in the training words, as the vocabulary's own
    segmentation has them; at most one number per piece reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        total = np.zeros(sp.get_piece_size(), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                ids = sp.encode(part.column(0).to_pylist(), num_threads=1)
                size = np.fromiter(map(len, ids), np.int64, len(ids))
                flat = np.fromiter((i for x in ids for i in x), np.int64, int(size.sum()))
                np.add.at(total, flat, np.repeat(part.column(1).to_numpy(zero_copy_only=False), size))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["piece", "n"])

    known = words.where((F.col("c") > 0) & (F.col("word") != END)).select("word", "c")
    rows = known.mapInArrow(run, "piece long, n long").groupBy("piece").agg(F.sum("n").alias("n")).collect()
    return {r["piece"]: r["n"] for r in rows}


class Lattice:
    """log10 probabilities of words under piece probabilities."""

    def __init__(self, pieces: dict[str, int], spell: list[int], counts: dict[int, int], ends: int) -> None:
        kinds = len(pieces) + 256 + 1
        total = sum(counts.values()) + ends + SMOOTH * kinds
        self.end = log10((ends + SMOOTH) / total)
        self.piece = {p: log((counts.get(i, 0) + SMOOTH) / total) for p, i in pieces.items()}
        self.byte = [log((counts.get(i, 0) + SMOOTH) / total) for i in spell]
        self.stems = {p[:k] for p in pieces for k in range(1, len(p) + 1)}

    def word(self, word: str) -> float:
        """log10 of the sum over all segmentations of "▁" + word."""
        text = "▁" + word
        n, piece, stems = len(text), self.piece, self.stems
        into: list[list[float]] = [[] for _ in range(n + 1)]
        into[0].append(0.0)
        for i, ch in enumerate(text):
            terms = into[i]
            if len(terms) == 1:
                here = terms[0]
            else:
                top = max(terms)
                here = top + log(sum([exp(t - top) for t in terms]))
            into[i + 1].append(here + sum([self.byte[b] for b in ch.encode("utf-8", "surrogatepass")]))
            for j in range(i + 1, n + 1):
                part = text[i:j]
                if part not in stems:
                    break
                if part in piece:
                    into[j].append(here + piece[part])
            into[i] = []
        top = max(into[n])
        return (top + log(sum([exp(t - top) for t in into[n]]))) / _LN10


def score_words(words: DataFrame, lattice: Lattice) -> DataFrame:
    """Add ``logp`` (log10) to each distinct word."""
    broadcast = words.sparkSession.sparkContext.broadcast(lattice)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = broadcast.value
        for batch in batches:
            logp = [own.end if w == END else own.word(w) for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(logp, pa.float64())], ["word", "c", "total", "logp"])

    return words.select("word", "c", "total").mapInArrow(run, "word string, c long, total long, logp double")


def common_words(model: DataFrame, most: int | None = None) -> DataFrame:
    """The most frequent words, at most ``most`` of at most COMMON_BYTES bytes.

    A histogram over the logarithm of the frequency (a few hundred numbers) gives
    the frequency from which on the words fit, so no task returns more than its
    share.  Without a frequency that fits, there are none."""
    most = COMMON if most is None else most
    short = model.where(F.octet_length("word") <= COMMON_BYTES)
    level = F.floor(F.log2(F.col("total").cast("double")) * 16).cast("int")
    fits, cut = 0, None
    for row in short.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():
        fits += row["count"]
        if fits > most:
            break
        cut = row["level"]
    return short.where(level >= cut) if cut is not None else short.limit(0)


def _name(word: str) -> str:
    """A long word's name among the common ones; it holds a space, as no word does."""
    return " " + hashlib.md5(word.encode("utf-8", "surrogatepass")).hexdigest()


def hot_long_words(model: DataFrame) -> DataFrame:
    """Words above COMMON_BYTES that are more than one in HOT_LONG of all words, so
    fewer than HOT_LONG whatever the data, by name instead of letters: joined by
    word, each would be the key of very many rows."""
    total = model.agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]
    long = model.where((F.octet_length("word") > COMMON_BYTES) & (F.col("total") * HOT_LONG > total))
    return long.withColumn("word", F.concat(F.lit(" "), F.md5(F.encode("word", "utf-8"))))


def score_documents(docs: DataFrame, model_path: str) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)``
    for every row; null text is empty and has the end token only.  Rows may
    repeat; a null id is in the training fold."""
    spark = docs.sparkSession
    counts = keep(count_words(docs), "lm-words")
    row = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    tokens, distinct = int(row[0]), int(row[1])
    ends = counts.where(F.col("word") == END).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    lattice = Lattice(*vocabulary(model_path), piece_counts(counts, model_path), int(ends))
    model = keep(score_words(counts, lattice), "lm-model")
    bottom = log10(tokens + distinct + 1)
    top = common_words(model).select("word", "c", "logp").union(hot_long_words(model).select("word", "c", "logp"))
    common = spark.sparkContext.broadcast({r[0]: (r[1] > 0, log10(r[1] + 1) - bottom, r[2]) for r in top.collect()} | {END: (ends > 0, log10(ends + 1) - bottom, lattice.end)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, made = common.value, TaskContext.get().partitionId() << 33
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows, words, tfs, sums, summary = [], [], [], [], []
                for text in part.column(2):
                    made += 1
                    total = base = lat = seen = 0
                    for w, n in (_counts(text.as_py()) | {END: 1}).items():
                        total += n
                        if hit := known.get(w) or (len(w) > COMMON_BYTES // 4 and known.get(_name(w))):
                            seen += n * hit[0]
                            base += n * hit[1]
                            lat += n * hit[2]
                        else:
                            rows.append(made)
                            words.append(w)
                            tfs.append(n)
                    sums.append((total, seen, base, lat))
                    summary.append(made)
                rest = len(rows)
                empty = lambda kind: pa.nulls(rest, kind)
                cat = lambda left, right: pa.concat_arrays([left, right])
                cols = [
                    pa.array(rows + summary, pa.int64()),
                    # a key no word has (it holds a space), different in each row
                    pa.array(words + [f" {m}" for m in summary], pa.string()),
                    pa.array(tfs + [0] * len(summary), pa.int64()),
                    cat(empty(part.column(0).type), part.column(0)),
                    cat(empty(pa.bool_()), part.column(1)),
                    *(cat(empty(kind), pa.array([s[k] for s in sums], kind)) for k, kind in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.float64()))),
                ]
                yield pa.RecordBatch.from_arrays(cols, names)

    names = ["row", "word", "tf", "doc_id", "held_out", "n_tokens", "n_known", "base", "lat"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    parts = docs.select("doc_id", held.alias("held_out"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, f"row long, word string, tf long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, lat double"
    )
    met = parts.join(model.select("word", "c", "logp"), "word", "left")
    tf = F.col("tf")
    own = F.when(F.col("c").isNotNull(), tf * (F.log10(F.col("c") + 1) - bottom)).otherwise(0.0)
    return (
        met.groupBy("row")
        .agg(
            F.max("doc_id").alias("doc_id"),
            F.max("held_out").alias("held_out"),
            F.max("n_tokens").alias("n_tokens"),
            (F.max("n_known") + F.sum(F.when(F.col("c") > 0, tf).otherwise(0))).alias("n_known"),
            (F.max("base") + F.sum(own)).alias("base_score"),
            (F.max("lat") + F.sum(tf * F.coalesce("logp", F.lit(0.0)))).alias("score"),
        )
        .select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
    )


def op9_lm_scoring(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return score_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
