"""Best-fit packing of token sequences with a bounded number of open bins.

Documents become pieces of at most ``SIZE`` tokens.  Each packing task streams
its pieces through at most ``OPEN_BINS`` open bins.  A bitset has bit f set when
an open bin has f free places, so the best fit of a piece of length n is the
lowest set bit at or above n.  When a bin must go, the fullest closes first.
Tasks pack independently; the number of tasks follows the tokens (``PER_TASK``),
so what each leaves half full is a constant share.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from corrello.store import keep, table

SIZE, OPEN_BINS, PER_TASK = 2048, 1024, 64_000_000
#: Words whose ids a worker remembers in each of two generations.  A worker lives on
#: after its task, and an executor has one or more per core.
CACHE = 200_000
#: New words encoded at a time, and the mark between them.
BATCH, MARK = 2_000, "\x02"
#: Bytes of text that are split into words at a time; longer texts go in parts.
PART = 2 << 20
#: Marks that only ever stand in a run of their own after a word.
TAIL = "!\"#$%&()*+,-./:;=?@[\\]^_`{}~"
_BLANK = re.compile(rb"[\t-\r ]")
_encoders: dict[str, WordEncoder] = {}


def sound(texts: pa.Array) -> pa.Array:
    """Texts that are no valid UTF-8 with U+FFFD for what is not, the others as they are."""
    try:
        texts.validate(full=True)
        return texts
    except pa.ArrowInvalid:
        stored = texts.cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary())
        return pa.array([None if t is None else t.decode("utf-8", "replace") for t in stored.to_pylist()], texts.type)


class WordEncoder:
    """Token ids of texts, by words between ASCII white space that are remembered.

    The tokenizer drops white space, and no token, normalisation or match spans
    it, so words may be encoded apart; its added tokens hold none and are found
    inside words.  A block of texts becomes one column of words and a dictionary
    of the different ones; only those are looked up, and only words not met
    before go to the tokenizer.  A word of letters with marks behind it is put
    together of the two.  Units of one run (letters, or marks) go to the
    tokenizer joined by spaces, as each ends in the one token that ends a run;
    others are joined by a mark that is a token of its own, and words that hold
    the mark go one by one.  When the young generation of remembered words is
    full, it becomes the old one; words found there are young again.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        mark = self._ids(MARK)
        self.mark = int(mark[0]) if len(mark) == 1 else None
        self.last = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)  # tokens that end a run
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.last[i] = token.endswith("</w>")
        self.young: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _put(self, part: list[str], ids: np.ndarray, ends: np.ndarray, skip: int) -> None:
        raw, start = ids.tobytes(), 0
        for w, end in zip(part, ends.tolist(), strict=True):
            self.young[w] = raw[4 * start : 4 * end]
            start = end + skip

    def _encode(self, words: list[str], single: bool) -> None:
        """Remember different ``words``; single: each should be one run."""
        for at in range(0, len(words), BATCH):
            part = words[at : at + BATCH]
            if single:
                ids = self._ids(" ".join(part))
                ends = np.flatnonzero(self.last[ids]) + 1
                if len(ends) == len(part) and ends[-1] == len(ids):  # every word has one such token at least
                    self._put(part, ids, ends, 0)
                    continue
            ids = self._ids(f" {MARK} ".join(part))
            self._put(part, ids, np.append(np.flatnonzero(ids == self.mark), len(ids)), 1)

    def _learn(self, words: list[str]) -> None:
        """Make every one of the different ``words``, none of which is young, young."""
        if len(self.young) > CACHE:
            self.old, self.young = self.young, {"": b""}
        young, old = self.young, self.old
        single: dict[str, None] = {}
        joined: list[str] = []
        made: list[tuple[str, str, str]] = []
        for w in words:
            known = old.get(w)
            if known is not None:
                young[w] = known
                continue
            core = w.rstrip(TAIL)
            if not core:
                single[w] = None
            elif core.isalpha():
                if len(core) == len(w):
                    single[w] = None
                elif core[-1] < "\u0250" and core[-1] != "\u0130":  # letters that stay letters when normalised
                    tail = w[len(core) :]
                    made.append((w, core, tail))
                    if core not in young:
                        single[core] = None
                    if tail not in young:
                        single[tail] = None
                else:
                    joined.append(w)
            elif self.mark is None or MARK in w:
                young[w] = self._ids(w).tobytes()
            else:
                joined.append(w)
        self._encode(list(single), True)
        self._encode(joined, False)
        for w, core, tail in made:
            young[w] = young[core] + young[tail]

    def block(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a column of texts without nulls, and where each text's begin
        (one more place than texts)."""
        split = pc.ascii_split_whitespace(texts)
        words = split.flatten().dictionary_encode()
        different = words.dictionary.to_pylist()
        raw = list(map(self.young.get, different))
        if None in raw:
            self._learn([w for w, r in zip(different, raw, strict=True) if r is None])
            young = self.young
            raw = [r if r is not None else young[w] for w, r in zip(different, raw, strict=True)]
        size = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
        pool = np.frombuffer(b"".join(raw), "<u4")
        which = words.indices.to_numpy(zero_copy_only=False)
        count = size[which]
        ends = np.concatenate(([0], np.cumsum(count)))
        place = np.repeat(((np.cumsum(size) - size)[which] - ends[:-1]).astype(np.int32), count)
        place += np.arange(ends[-1], dtype=np.int32)
        offsets = split.offsets.to_numpy(zero_copy_only=False)
        return pool[place], ends[offsets - offsets[0]]

    def long(self, text: bytes) -> bytes:
        """Ids of one text, a part of about PART bytes after the other."""
        out, at = [], 0
        while at < len(text):
            blank = _BLANK.search(text, at + PART)
            end = blank.start() if blank else len(text)
            out.append(self.block(pa.array([text[at:end]], pa.binary()).cast(pa.string()))[0].tobytes())
            at = end
        return b"".join(out)

    def column(self, texts: pa.Array) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text in turn; null is empty."""
        texts = pc.fill_null(sound(texts), "")
        sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
        at = 0
        while at < len(sizes):
            if sizes[at] > PART:
                yield self.long(texts[at].as_buffer().to_pybytes())
                at += 1
                continue
            end = at + max(1, int(np.searchsorted(np.cumsum(sizes[at:], dtype=np.int64), PART, side="right")))
            ids, starts = self.block(texts.slice(at, end - at))
            raw, cuts = ids.tobytes(), (4 * starts).tolist()
            for s, e in zip(cuts, cuts[1:], strict=False):
                yield raw[s:e]
            at = end

    def __call__(self, text: str) -> bytes:
        return next(self.column(pa.array([text], pa.string())))


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def token_pieces(docs: DataFrame, tokenizer_path: str, size: int = SIZE, with_ids: bool = False) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32[, ids])``: each document's ids,
    then id 0, cut every ``size`` tokens.  Null and empty texts are one piece of id 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path)
        for batch in batches:
            rows, start, length, crc, ids = [], [], [], [], []
            for i, raw in enumerate(encode.column(batch.column(1))):
                raw += b"\0\0\0\0"
                for at in range(0, len(raw), 4 * size):
                    part = raw[at : at + 4 * size]
                    rows.append(i)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(np.frombuffer(part, "<u4").astype(np.int32))
            start = np.array(start, np.int64)
            cols = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array((start // size).astype(np.int32)), pa.array(start), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                cols, names = [*cols, pa.array(ids, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(cols, names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


class OpenBins:
    """Bounded-space best fit.  ``add`` returns the bin a piece goes to and the
    place in it, and reports bins that closed through ``closed``."""

    def __init__(self, size: int, limit: int) -> None:
        self.size, self.limit, self.bits, self.count, self.made = size, limit, 0, 0, 0
        self.by_free: list[list[int]] = [[] for _ in range(size + 1)]

    def _take(self, free: int) -> int:
        own = self.by_free[free]
        found = own.pop()
        if not own:
            self.bits ^= 1 << free
        self.count -= 1
        return found

    def add(self, length: int) -> tuple[int, int]:
        fits = self.bits >> length << length
        if fits:
            free = (fits & -fits).bit_length() - 1
            found = self._take(free)
        else:
            if self.count >= self.limit:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
            found, free = self.made, self.size
            self.made += 1
        left = free - length
        if left:
            if not self.by_free[left]:
                self.bits |= 1 << left
            self.by_free[left].append(found)
            self.count += 1
        return found, self.size - free


def pack_pieces(pieces: DataFrame, size: int = SIZE, open_bins: int = OPEN_BINS, per_task: int = PER_TASK) -> DataFrame:
    """Add sequence_id and offset to pieces; each sequence is gapless from 0 and
    holds at most ``size`` tokens.  Rows may repeat; an empty table stays empty."""
    columns = pieces.columns
    at = columns.index("length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, base = OpenBins(size, open_bins), TaskContext.get().partitionId() << 40
        for batch in batches:
            placed = np.array([bins.add(n) for n in batch.column(at).to_pylist()], np.int64).reshape(-1, 2)
            extra = [pa.array(base + placed[:, 0]), pa.array(placed[:, 1].copy())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*columns, "sequence_id", "offset"])

    total = pieces.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    tasks = max(1, -(-total // per_task))
    # Dealt by the row's number, not by its id: an id that many rows share, or
    # none at all, still goes to every task.  In the order of that number a task that is
    # run again, after an executor was lost, packs as it did before.
    numbered = pieces.withColumn("_nth", F.monotonically_increasing_id())
    dealt = numbered.repartition(int(tasks), F.xxhash64("_nth")).sortWithinPartitions("_nth").select(*columns)
    schema = StructType([*pieces.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])
    return dealt.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """Cut, then pack.  The pieces (numbers only, no text) are written once, so
    texts are encoded once."""
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("word_bpe_49k.json")
    return pack_pieces(keep(token_pieces(docs, tokenizer_path), "pieces"))


def op10_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def pack_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the packing of all documents that are left."""
    return pack_documents(docs)
