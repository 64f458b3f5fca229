"""Quality classifier: a byte-level convolutional network in numpy.

Bytes get learned vectors; filters of ``WIDTH`` bytes slide over the text in
steps of ``STRIDE``.  A document is cut into evenly sized chunks of at most
``CHUNK`` steps that overlap by ``WIDTH - STRIDE`` bytes, so every byte of the
whole text is seen.  Each chunk keeps the maximum of every filter; the mean and
the least of the chunks' maxima go through a logistic layer, which makes one
probability of them.  (The least shows one chunk of little variety in a long text.)

Training is on the driver from a bounded, documented sample: at most
``PER_CLASS`` labelled documents of each class, the lowest id hashes of those
that have a text.  Of a text above ``TRAIN_BYTES`` bytes pieces are learned from that lie
evenly over its whole length and have so many bytes together.  Scoring covers all rows and
whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corrello.store import keep, table

WIDTH, STRIDE, DIM, FILTERS, CHUNK = 8, 4, 8, 48, 64
PER_CLASS, TRAIN_BYTES, PIECES = 1_200, 32_768, 32
STEPS, BATCH, RATE = 500, 32, 0.01
#: A bad text weighs more in training, as the cut below favours keeping.
BAD_WEIGHT, CUT = 2.0, 0.3
#: Bytes of texts scored together in one numpy step, and of one text scored whole.
GROUP, BLOCK = 1 << 17, 1 << 19
#: Rows of a batch that are taken out of Arrow at a time.
ROWS = 1024
PAD = 256

Params = dict[str, np.ndarray]


def cut(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Concatenated symbols, the first window of each chunk, the first chunk of each text.

    Each text is padded with WIDTH blanks before and after, to a whole number of steps."""
    parts, chunk_at, text_at, windows = [], [], [], 0
    for text in texts:
        n = len(text) + 2 * WIDTH
        steps = -(-(n - WIDTH) // STRIDE) + 1
        body = np.full((steps - 1) * STRIDE + WIDTH, PAD, np.int16)
        body[WIDTH : WIDTH + len(text)] = np.frombuffer(text, np.uint8)
        text_at.append(len(chunk_at))
        count = -(-steps // CHUNK)
        chunk_at += [windows + steps * i // count for i in range(count)]
        windows += steps
        # windows that would span two texts are avoided: a text's symbols end on a step, see ``windows_of``
        parts.append(body)
    return np.concatenate(parts), np.array(chunk_at, np.int64), np.array(text_at, np.int64)


def windows_of(symbols: np.ndarray, params: Params) -> np.ndarray:
    """Byte vectors of each window, one row per window.

    Neighbouring texts share no window: each text adds (steps - 1) * STRIDE +
    WIDTH symbols, WIDTH being 2 * STRIDE, so one surplus window falls between
    two texts and is filled with blanks of both; it belongs to the chunk before."""
    vectors = params["bytes"][symbols]
    count = (len(symbols) - WIDTH) // STRIDE + 1
    step = vectors.strides[0]
    return np.lib.stride_tricks.as_strided(vectors, (count, WIDTH * DIM), (step * STRIDE, vectors.strides[1]), writeable=False)


def _starts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    symbols, chunk_at, text_at = cut(texts)
    # one surplus window per text boundary shifts the later ones
    owner = np.searchsorted(text_at, np.arange(len(chunk_at)), side="right") - 1
    return symbols, chunk_at + owner, text_at


def features(texts: list[bytes], params: Params) -> tuple[np.ndarray, ...]:
    """Mean and least of the chunks' maxima per text, and what the backward pass needs."""
    symbols, chunk_at, text_at = _starts(texts)
    windows = windows_of(symbols, params)
    act = windows @ params["filters"]
    top = np.maximum.reduceat(act, chunk_at, axis=0) + params["bias"]
    np.maximum(top, 0, out=top)
    size = np.diff(np.append(text_at, len(chunk_at))).astype(np.float32)
    pooled = np.concatenate((np.add.reduceat(top, text_at, axis=0) / size[:, None], np.minimum.reduceat(top, text_at, axis=0)), axis=1)
    return pooled, act, top, chunk_at, text_at, size, symbols


def probability(texts: list[bytes], params: Params) -> np.ndarray:
    """Score of each text, in steps of bounded memory; a text's chunks never
    depend on the texts beside it.  Long texts are summed over blocks of chunks."""
    out = np.empty(len(texts))
    group: list[int] = []
    held = 0

    def flush() -> None:
        nonlocal held
        if group:
            pooled = features([texts[i] for i in group], params)[0]
            out[group] = _sigmoid(pooled.astype(np.float64) @ params["out"] + params["c"][0])
        group.clear()
        held = 0

    for i, text in enumerate(texts):
        if len(text) > BLOCK:
            out[i] = _sigmoid(_long(text, params) @ params["out"] + params["c"][0])
            continue
        if held + len(text) > GROUP:
            flush()
        group.append(i)
        held += len(text) + 2 * WIDTH
    flush()
    return np.clip(out, 0.0, 1.0)


def _long(text: bytes, params: Params) -> np.ndarray:
    """Mean and least of the chunk maxima of one long text, a run of chunks at a time."""
    symbols, chunk_at, _ = cut([text])
    ends = np.append(chunk_at[1:], (len(symbols) - WIDTH) // STRIDE + 1)
    total, least = np.zeros(FILTERS), np.full(FILTERS, np.inf)
    for at in range(0, len(chunk_at), 256):
        low, high = chunk_at[at], ends[min(at + 256, len(ends)) - 1]
        act = windows_of(symbols[low * STRIDE : (high - 1) * STRIDE + WIDTH], params) @ params["filters"]
        top = np.maximum.reduceat(act, chunk_at[at : at + 256] - low, axis=0) + params["bias"]
        np.maximum(top, 0, out=top)
        total += top.sum(axis=0)
        least = np.minimum(least, top.min(axis=0))
    return np.concatenate((total / len(chunk_at), least))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def train(good: list[bytes], bad: list[bytes], seed: int = 7) -> Params:
    """Adam on balanced batches.  Without both classes the output is constant:
    1 if only good texts are known, 0 if only bad ones, 0.5 if none."""
    rng = np.random.default_rng(seed)
    p: Params = {
        "bytes": rng.normal(0, 0.5, (PAD + 1, DIM)).astype(np.float32),
        "filters": rng.normal(0, (WIDTH * DIM) ** -0.5, (WIDTH * DIM, FILTERS)).astype(np.float32),
        "bias": np.zeros(FILTERS, np.float32),
        "out": rng.normal(0, 0.1, 2 * FILTERS),
        "c": np.zeros(1),
    }
    if not good or not bad:
        p["out"] *= 0
        p["c"] += 40.0 if good else -40.0 if bad else 0.0
        return p
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    for step in range(1, STEPS + 1):
        pick = [(good, i, 1.0) for i in rng.integers(0, len(good), BATCH // 2)] + [(bad, i, 0.0) for i in rng.integers(0, len(bad), BATCH // 2)]
        y = np.array([t for _, _, t in pick])
        pooled, act, top, chunk_at, text_at, size, symbols = features([c[i] for c, i, _ in pick], p)
        prob = _sigmoid(pooled.astype(np.float64) @ p["out"] + p["c"][0])
        d = (prob - y) * np.where(y > 0, 1.0, BAD_WEIGHT) / len(y)
        g = {"out": pooled.T.astype(np.float64) @ d + 1e-4 * p["out"], "c": d.sum(keepdims=True)}
        owner = np.searchsorted(text_at, np.arange(len(chunk_at)), side="right") - 1
        by_mean, by_least = p["out"][:FILTERS], p["out"][FILTERS:]
        least = top == pooled[owner, FILTERS:]
        shared = np.add.reduceat(least.astype(np.float32), text_at, axis=0)[owner]
        d_top = (d[owner, None] * (by_mean / size[owner, None] + least * by_least / shared)).astype(np.float32) * (top > 0)
        g["bias"] = d_top.sum(axis=0)
        ends = np.append(chunk_at[1:], len(act))
        best = np.stack([s + act[s:e].argmax(axis=0) for s, e in zip(chunk_at, ends, strict=True)])  # (chunks, filters)
        windows = windows_of(symbols, p)
        rows = windows[best.ravel()].reshape(len(chunk_at), FILTERS, WIDTH * DIM)
        g["filters"] = np.einsum("cf,cfk->kf", d_top, rows, optimize=True)
        back = (d_top[:, :, None] * p["filters"].T[None, :, :]).reshape(-1, WIDTH, DIM)
        at = best.ravel()[:, None] * STRIDE + np.arange(WIDTH)[None, :]
        hit = symbols[at].ravel()
        g["bytes"] = np.stack([np.bincount(hit, back[:, :, k].ravel(), PAD + 1) for k in range(DIM)], axis=1)
        rate = RATE * (1 - step / (STEPS + 1))
        for k, grad in g.items():
            m, v = moment[k]
            m += 0.1 * (grad - m)
            v += 0.001 * (grad * grad - v)
            p[k] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(p[k].dtype)
    return p


def spread(text: bytes, most: int = TRAIN_BYTES, pieces: int = PIECES) -> bytes:
    """A text of at most ``most`` bytes whole; of a longer one ``pieces`` equal pieces, the
    first at its beginning, the last at its end, the others evenly between."""
    if len(text) <= most:
        return text
    size = most // pieces
    return b"".join(text[at : at + size] for at in ((len(text) - size) * i // (pieces - 1) for i in range(pieces)))


def raw_texts(texts: pa.Array) -> list[bytes]:
    """The bytes of each text as they are stored, valid UTF-8 or not; null is empty."""
    kind = pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary()
    return [t or b"" for t in texts.cast(kind).to_pylist()]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in runs of at most ROWS, so that few texts are there twice."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def training_texts(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> tuple[list[bytes], list[bytes]]:
    """Good and bad texts of the bounded sample, never from fold 0 (crc32 mod 5).

    Labels meet the documents before the sample is taken, so no place in it goes
    to an id without a text.  The length of a text has no say in it; see ``spread``."""
    usable = labels.where("doc_id is not null and quality is not null").where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    known = usable.select("doc_id", "quality").hint("merge").join(docs.where("text is not null").select("doc_id"), "doc_id")
    known = keep(known.distinct(), "quality-known")
    picked: dict = {}
    for quality in (0, 1):
        for row in known.where(F.col("quality") == quality).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).collect():
            picked.setdefault(row["doc_id"], quality)
    if not picked:
        return [], []
    own = docs.sparkSession.createDataFrame(list(picked.items()), f"_id {labels.schema['doc_id'].dataType.simpleString()}, _quality int")

    @F.arrow_udf("binary")
    def thinned(texts: pa.Array) -> pa.Array:
        return pa.array([spread(t) for t in raw_texts(texts)], pa.binary())

    rows = docs.where("text is not null").join(F.broadcast(own), F.col("doc_id") == F.col("_id")).select("doc_id", "_quality", thinned("text").alias("_text"))
    # a repeated row counts once, and is told apart before it comes to the driver
    rows = rows.groupBy("doc_id", "_quality").agg(F.min("_text").alias("_text"))
    found = sorted((r["doc_id"], r["_quality"], bytes(r["_text"])) for r in rows.collect())
    return [t for _, q, t in found if q == 1], [t for _, q, t in found if q == 0]


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row of ``docs``.

    Null text counts as empty; an empty text gets the score of blanks.  Texts of any
    length are read whole, in chunks.  Repeated rows are scored each, an empty table
    gives no rows, and columns other than doc_id and text are not read, so none clashes.
    held_out: crc32 of the id as text mod 5 is 0 (false for a null id)."""
    params = train(*training_texts(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            texts = raw_texts(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(probability(texts, params), pa.float64())], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, score double")
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", fold.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def op3_quality_classifier(spark, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def keep_likely_good(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents predicted 0 go.  Rows keep their own columns and
    their place: the score is added to each row, nothing is joined.

    The network learns from the labelled rows of the whole documents table, as
    the stage before has already removed nearly all bad texts from ``docs``."""
    params = train(*training_texts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            texts = raw_texts(batch.column(names.index("text")))
            yield batch.filter(pa.array(probability(texts, params) >= CUT))

    return docs.mapInArrow(run, docs.schema)
