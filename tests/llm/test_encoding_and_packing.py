"""op4 and op10 against the libraries, with the awkward rows."""

import hashlib
import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corrello.llm import byte_bpe, packing

ODD = ["a", "B", "é", "é", " ", "  ", "\n", "\t", "'s", "'re", "'", "1", "!", "$$", "\x1c", "\x85", "漢", "́", "<|endoftext|>", "\x02", "Σ"]


def codec():
    import public_tokenizers as p

    return byte_bpe.codec(p.path("byte_bpe_50k.tiktoken"), p.PATTERN)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(ODD), st.sampled_from([1, 1, 2, 30])), max_size=40), st.sampled_from([(16, 8), (50, 12), (7, 5)]))
def test_chunked_pre_tokens(parts, sizes):
    text = "".join(a * n for a, n in parts)
    code = codec()
    pieces = byte_bpe.pre_tokens(code.scan, text, *sizes)
    assert pieces == code.scan.findall(text)
    ids = code.encode(pieces)
    assert np.frombuffer(ids, "<u4").tolist() == code.bpe.encode_ordinary(text) and code.decode(ids) == text.encode()


def test_encode_documents(spark, docs, monkeypatch):
    import public_tokenizers as p

    monkeypatch.setattr(byte_bpe, "CHUNK", 400)
    monkeypatch.setattr(byte_bpe, "OVERLAP", 40)
    rng = random.Random(8)
    texts = [None, "", "Hello world", "same", "same", " " * 1500, "x" * 1500] + ["".join(rng.choice([*ODD, "the ", "word "]) for _ in range(1200)) for _ in range(4)]
    texts.append(texts[-1])
    path = p.path("byte_bpe_50k.tiktoken")
    got = byte_bpe.encode_documents(docs(list(enumerate(texts))).withColumn("n_tokens", F.lit("clash")), path, p.PATTERN, with_ids=True)
    rows = {r["doc_id"]: r for r in byte_bpe.decode_ids(got, path, p.PATTERN).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        want = codec().bpe.encode_ordinary(t or "")
        r = rows[i]
        assert r["n_tokens"] == len(want) and r["ids"] == want and bytes(r["decoded"]) == (t or "").encode()
        assert r["ids_sha256"] == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest() and r["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert byte_bpe.encode_documents(docs([]), path, p.PATTERN).count() == 0


def test_word_encoder_equals_tokenizer():
    import public_tokenizers as p

    encode, rng = packing.encoder(p.path("word_bpe_49k.json")), random.Random(1)
    for _ in range(400):
        text = "".join(rng.choice(ODD) for _ in range(rng.randint(0, 25)))
        assert np.frombuffer(encode(text), "<u4").tolist() == encode.tokenizer.encode(text, add_special_tokens=False).ids


def fresh_ids(text):
    import public_tokenizers as p
    from tokenizers import Tokenizer

    if not hasattr(fresh_ids, "own"):
        fresh_ids.own = Tokenizer.from_file(p.path("word_bpe_49k.json"))
    return fresh_ids.own.encode(text, add_special_tokens=False).ids


def test_word_encoder_equals_an_untouched_tokenizer(monkeypatch):
    import public_tokenizers as p

    encode, rng = packing.WordEncoder(p.path("word_bpe_49k.json")), random.Random(5)
    end, start = "<|endoftext|>", "<|startoftext|>"
    odd = [*ODD, end, start, end, start, "=\u0338", "İ", "ｆ", "\u0958", "don't", "word", "Word!!", "a,", "..", "<|", "\u00a0", "\u200b", "\x00"]
    texts = [end, f"a {end} b", f"a{end}b", f"{start}{end}", f"x{start} y", f"{end}!!", f"don't{end}'s", "İ!! İ İ, ab!! ab, ab", "क़!! क़,", "1st, 2nd.", "", " \n "]
    texts += ["".join(rng.choice(odd) for _ in range(rng.randint(0, 25))) for _ in range(600)]
    for cache, part in ((packing.CACHE, packing.PART), (20, 7)):
        monkeypatch.setattr(packing, "CACHE", cache)
        monkeypatch.setattr(packing, "PART", part)
        for text, raw in zip(texts, encode.column(pa.array(texts)), strict=True):
            assert np.frombuffer(raw, "<u4").tolist() == fresh_ids(text), text
    assert list(encode.column(pa.array([None, "a"], pa.string())))[0] == b"" and list(encode.column(pa.array([], pa.string()))) == []


def test_pieces_of_texts_with_added_tokens(spark, docs):
    import public_tokenizers as p

    texts = ["<|endoftext|>", "so <|startoftext|>it<|endoftext|> goes", None, "<|endoftext|> " * 3000]
    rows = packing.token_pieces(docs([(None, t) for t in texts]), p.path("word_bpe_49k.json"), with_ids=True).collect()
    got = sorted((r["piece"], r["length"], list(r["ids"])) for r in rows)
    want = []
    for t in texts:
        ids = [*fresh_ids(t or ""), 0]
        want += [(k, len(ids[k * 2048 : k * 2048 + 2048]), ids[k * 2048 : k * 2048 + 2048]) for k in range(-(-len(ids) // 2048))]
    assert got == sorted(want)


def test_packing(spark, docs):
    import public_tokenizers as p

    rng = random.Random(2)
    texts = [None, "", "word", "word"] + [" ".join(rng.choice(["the", "tion", "erst"]) for _ in range(rng.randint(1, 900))) for _ in range(60)] + ["the " * 5000]
    path = p.path("word_bpe_49k.json")
    frame = docs([*enumerate(texts), (2, "word")]).withColumn("offset", F.lit("clash"))
    rows = packing.pack_documents(frame, path).collect()
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in bins.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= packing.SIZE
    assert len(bins) <= 1.1 * sum(r["length"] for r in rows) / packing.SIZE + 2
    encode = packing.encoder(path)
    for i, t in enumerate(texts):
        ids = encode(t or "") + b"\0\0\0\0"
        own = sorted({(r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows if r["doc_id"] == i})
        assert own == [(k, k * 2048, len(ids[k * 8192 : k * 8192 + 8192]) // 4, zlib.crc32(ids[k * 8192 : k * 8192 + 8192])) for k in range(-(-len(ids) // 8192))]
    assert sum(r["doc_id"] == 2 for r in rows) == 2
    assert packing.pack_documents(docs([]), path).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=80), st.integers(1, 5))
def test_open_bins(lengths, limit):
    bins, used = packing.OpenBins(20, limit), {}
    for n in lengths:
        found, offset = bins.add(n)
        assert offset == used.get(found, 0) and offset + n <= 20
        used[found] = offset + n
        assert bins.count <= limit and bins.count == sum(map(len, bins.by_free))


def test_a_worker_holds_a_small_part_of_long_texts():
    import public_tokenizers

    encode = packing.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(5000)]
    texts = pa.array([" ".join(words)] * 400)  # 10 MB
    one = zlib.crc32(encode(texts[0].as_py()))
    tracemalloc.start()
    assert {zlib.crc32(ids) for ids in encode.column(texts)} == {one}
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 40e6
