"""op5, op7 and op8 by hand and by round trip, with the awkward rows."""

import hashlib
import json

from pyspark.sql import functions as F

from corrello.llm import chat_format, html_extract, warc

PAGES = "page_id long, url string, html string"


def test_round_trip_with_revisits(spark):
    big, other = "<p>" + "é" * 600, "<p>" + "x" * 2000
    rows = [(1, "http://a.example/ b", big), (2, "u", big), (3, None, big), (4, "u", "tiny"), (5, "u", "tiny"), (6, "u", None), (7, "u", ""), (8, "u", other), (8, "u", other), (None, "u", big), (9, "u", "WARC/1.1\r\n\r\n\x1f\x8b\x08" * 90)]
    got = warc.round_trip(spark.createDataFrame(rows, PAGES).withColumn("payload_digest", F.lit("clash"))).collect()
    assert len(got) == len(rows)
    kinds = {}
    for r in got:
        kinds.setdefault(r["page_id"], []).append((r["record_type"], r["refers_to"]))
        html = next(h for i, _, h in rows if i == r["page_id"]) or ""
        assert r["payload_bytes"] == len(html.encode()) and r["payload_digest"] == hashlib.sha1(html.encode()).hexdigest()
    assert kinds[3] == [("response", None)] and kinds[1] == kinds[2] == kinds[None] == [("revisit", 3)]
    assert kinds[4] == kinds[5] == kinds[6] == kinds[7] == [("response", None)] and kinds[8] == [("response", None)] * 2
    assert warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0


def test_salvage_covers_every_byte():
    pages = [b"<p>" + bytes([65 + i]) * 400 for i in range(6)]
    plain = [warc.page_record(i, "http://x.example/", p, hashlib.sha1(p).hexdigest(), None) for i, p in enumerate(pages)]
    for records in (plain, [warc.member(r) for r in plain]):
        data = b"".join(records)
        ends = [sum(map(len, records[: i + 1])) for i in range(6)]
        for at in list(range(0, len(data), 37)):
            for broken in (data[:at] + bytes([data[at] ^ 0x55]) + data[at + 1 :], data[:at] + data[at + 20 :], data[:at]):
                got = list(warc.salvage(broken))
                spans = sorted({(g[0], g[1]) for g in got})
                assert not broken or spans[0][0] == 0 and spans[-1][1] == len(broken)
                assert all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
                hurt = next(i for i, e in enumerate(ends) if at < e)
                ids = {g[2]["warc-record-id"] for g in got if len(g) == 4}
                alive = range(6) if broken != data[:at] else range(hurt)
                near = (hurt, hurt + 1) if len(broken) == len(data) - 20 else (hurt,)
                assert {f"<urn:page:{i}>" for i in alive if i not in near} <= ids


def foreign(kind, ident, block, *lines):
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:x:{ident}>", "WARC-Date: 2020-01-01T00:00:00Z", *lines, f"Content-Length: {len(block)}"]
    return b"WARC/1.0\r\n" + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_records_of_other_writers(spark, tmp_path):
    import base64

    block = b"HTTP/1.1 200 OK\r\n\r\n<p>body"
    sha = lambda n, d=block: hashlib.new(n, d)
    b32 = base64.b32encode(sha("sha1").digest()).decode()
    told = [f"sha256:{sha('sha256').hexdigest()}", f"SHA-1:{sha('sha1').hexdigest().upper()}", f"sha1:{b32.lower()}", f"sha1:{b32}", "sha-256:" + base64.b64encode(sha("sha256").digest()).decode(), "md5:" + sha("md5").hexdigest(), "blake9:zz", "sha1:odd", "sha1"]
    good = [foreign("response", i, block, f"WARC-Block-Digest: {d}", "X-Long: one", "  and more: two") for i, d in enumerate(told)]
    bad = [foreign("response", "b0", block, f"WARC-Block-Digest: sha256:{sha('sha256', b'x').hexdigest()}"), foreign("response", "b1", block, f"WARC-Payload-Digest: md5:{sha('md5').hexdigest()}")]
    visits = [foreign("revisit", "r0", b"", f"WARC-Payload-Digest: sha256:{sha('sha256').hexdigest()}", "X-Payload-Length: many"), foreign("revisit", "r1", b"", "WARC-Payload-Digest: sha1:???"), foreign("revisit", "r2", b"")]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(warc.member, good + bad + visits)))
    (tmp_path / "b.warc").write_bytes(b"".join(good))
    rows = warc.read_archives(spark, f"file://{tmp_path}").collect()
    ids = [r["record_id"] for r in rows if r["gap"] is None]
    assert sorted(ids) == sorted([f"<urn:x:{i}>" for i in range(len(told))] * 2 + ["<urn:x:r0>", "<urn:x:r1>", "<urn:x:r2>"])
    assert sorted(r["gap"] for r in rows if r["gap"]) == ["block digest differs", "payload digest differs"]
    found = {r["record_id"]: (r["payload_bytes"], r["payload_digest"]) for r in rows if r["record_type"] == "revisit"}
    assert found == {"<urn:x:r0>": (None, sha("sha256").hexdigest()), "<urn:x:r1>": (None, None), "<urn:x:r2>": (None, None)}


def test_reading_members_is_linear():
    import time

    def seconds(n):
        data = warc.member(warc.record("metadata", [("WARC-Record-ID", "<x>")], b"some text " * 40)) * n
        began = time.process_time()
        assert sum(len(g) == 4 for g in warc.salvage(data)) == n
        return time.process_time() - began

    assert seconds(16_000) < 12 * seconds(4_000)


def test_a_lost_record_is_noticed(spark, monkeypatch):
    import pytest

    real = warc.salvage
    monkeypatch.setattr(warc, "read_archives", lambda spark, folder, read=warc.read_archives: read(spark, folder).where("record_id is null or record_id <> '<urn:page:2>'"))
    with pytest.raises(RuntimeError, match="did not come back"):
        warc.round_trip(spark.createDataFrame([(1, "u", "a"), (2, "u", "b")], PAGES))
    assert warc.salvage is real


def test_main_text():
    page = (
        '<html><head><title>T</title></head><body class="no-sidebar"><nav><ul><li><a href="/a">Menu item</a></ul></nav><!-- <p>no</p> --><div class="ad">Buy this now, it is great. Really.</div>'
        "<article><h1>Head &amp; line</h1><p>Short.<p>Two\n  lines<br>here <b>bold</b>.<script>var a='</p>'</script><aside>Aside text, long enough to mislead a reader.</aside><p>AT&ampT &lt;x&gt; &am</article>"
        '<section id="comments"><article><p>I liked this article very much. Thank you.</p></article></section><form><p>Your name</p></form><footer>&copy; site</footer></body></html>'
    )
    assert html_extract.main_text(page) == "Head & line\n\nShort.\n\nTwo lines here bold.\n\nAT&T <x> &am"
    assert html_extract.main_text(page.split("</article>")[0]).endswith("&am")
    assert html_extract.main_text(None) == html_extract.main_text("") == html_extract.main_text("<nav><a href=x>m</a></nav>") == ""


def test_no_part_of_an_article_is_lost():
    text = html_extract.main_text
    assert text("<p>Short.</p>") == "Short." and text("One word") == "One word" and text("<body><h1>Title</h1><p>Ok</p></body>") == "Title\n\nOk"
    page = "<nav><a href=/>Home</a></nav><article><h1>Head</h1><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be.</p><div class='alert'><p>Mind the gap between both.</p></div></article>"
    assert text(page) == "Head\n\nLet x=2 be.\n\nMind the gap between both."


def test_learned_costs_and_what_the_cut_overrules():
    from corrello.llm.page_examples import labelled_pages, plain_pages

    model = html_extract.default_model()
    assert model == html_extract.learn(labelled_pages(html_extract.TRAIN_PAGES, 1) + plain_pages(html_extract.PLAIN_PAGES, 3), labelled_pages(html_extract.SCALE_PAGES, 2))
    blocks = by_sign = by_cut = overruled = 0
    for page, truth in labelled_pages(200, 9):  # pages that it has not seen
        own = html_extract.blocks_of(page)
        for block, cost, kept in zip(own, model.costs(own), model.labels(own), strict=True):
            blocks, by_sign, by_cut = blocks + 1, by_sign + ((cost > 0) != truth[block.text]), by_cut + (kept != truth[block.text])
            overruled += (cost > 0) != kept
    assert blocks > 3000 and overruled >= 8 and by_cut < by_sign and by_cut < 0.02 * blocks
    short = "<body><div>" + "".join(f"<p>{'many words make this a paragraph of the story ' * 3}{i}.</p>" for i in range(4)) + '<p><a href="/x">All of it a link</a></p>' + "<p>And here the story goes on for some more words, as it should.</p></div></body>"
    at = [b.text for b in html_extract.blocks_of(short)].index("All of it a link")
    assert model.costs(html_extract.blocks_of(short))[at] < 0 and "All of it a link" in html_extract.main_text(short)


def test_minimum_cut_equals_brute_force():
    import itertools
    import random

    rng = random.Random(6)
    for _ in range(200):
        n = rng.randint(1, 8)
        unary = [rng.choice([-3, -1, -0.5, 0.4, 1, 2.5]) + rng.random() * 0.01 for _ in range(n)]
        edges = [(a, b, rng.random() * 2) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.5]
        price = lambda lab: sum(u for u, k in zip(unary, lab, strict=True) if u > 0 and not k) + sum(-u for u, k in zip(unary, lab, strict=True) if u < 0 and k) + sum(w for a, b, w in edges if lab[a] != lab[b])  # noqa: E731, B023
        best = min(price(x) for x in itertools.product([False, True], repeat=n))
        assert abs(price(html_extract.minimum_cut(unary, edges)) - best) < 1e-6


def test_extract_rows(spark):
    rows = [(1, "u", "<article><p>Hé</p></article>"), (1, "u", "<article><p>Hé</p></article>"), (2, None, None), (None, "v", "<p>" * 5000 + "deep text here. And more.")]
    got = html_extract.extract(spark.createDataFrame(rows, PAGES).withColumn("n_chars", F.lit("clash"))).collect()
    assert sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in got) == [(0, "deep text here. And more.", 25), (1, "Hé", 2), (1, "Hé", 2), (2, "", 0)]
    assert html_extract.extract(spark.createDataFrame([], PAGES)).count() == 0


CHAT = "conv_id long, turn long, role string, text string"


def call(ident, name="find", needs=(), **arguments):
    return {"id": ident, "name": name, "arguments": arguments} | ({"depends_on": list(needs)} if needs else {})


def test_linking_order_and_validation(spark):
    calls = lambda *c: json.dumps({"tool_calls": list(c)})
    result = lambda i, v="ok": json.dumps({"tool_call_id": i, "content": v})
    rows = [
        (1, 0, "user", "hi {not json"), (1, 1, "tool", result("a")), (1, 2, "assistant", calls(call("a", q="x"))), (1, 3, "assistant", calls(call("b", needs=["a"], q=5))),
        (1, 4, "tool", result("zzz")), (1, 5, "assistant", calls(call("a", q="again"), {"name": "find"}, "junk")),
        (2, 0, "assistant", calls(call("p", needs=["q"], q="x"))), (2, 1, "assistant", calls(call("q", needs=["p"], q="x"))), (2, 2, None, None), (2, 2, None, None),
        (3, 0, "tool", result("c1")), (3, 1, "assistant", calls(call("c2", needs=["c1"], q="x"))), (3, 2, "assistant", calls(call("c1", q="x"))), (None, None, "user", ""),
    ]
    schema = {"find": {"type": "object", "properties": {"q": {"type": "string"}}, "required": ["q"], "additionalProperties": False}}
    frame = spark.createDataFrame(rows, CHAT).withColumn("message", F.lit("clash"))
    got = chat_format.format_chats(frame, schema).collect()
    assert len(got) == len(rows)
    by = {(r["conv_id"], r["turn"]): r for r in got}
    order = [r["turn"] for r in sorted((r for r in got if r["conv_id"] == 1), key=lambda r: (r["at"], r["depth"], r["turn"]))]
    assert order == [0, 2, 1, 3, 4, 5] and by[1, 1]["call_turn"] == 2
    assert by[1, 3]["errors"] == ["$.q: not string", "no result"] and by[1, 4]["errors"] == ["result without a call"]
    assert set(by[1, 5]["errors"]) == {"repeated call id", "no id", "arguments are not an object"}
    assert "cyclic" in by[2, 0]["errors"] and "cyclic" in by[2, 1]["errors"]
    third = [r["turn"] for r in sorted((r for r in got if r["conv_id"] == 3), key=lambda r: (r["at"], r["depth"], r["turn"]))]
    assert third == [2, 0, 1]
    assert by[1, 0]["message"] == '{"content":"hi {not json","role":"user"}' and by[2, 2]["message"] == '{"content":null,"role":null}'
    assert json.loads(by[1, 2]["message"])["tool_calls"] == [{"arguments": {"q": "x"}, "id": "a", "name": "find"}]
    assert chat_format.format_chats(spark.createDataFrame([], CHAT)).count() == 0


def test_schema_subset():
    schema = {"type": "object", "properties": {"n": {"type": "integer"}, "k": {"enum": ["a", "b"]}, "l": {"type": "array", "items": {"type": "number"}}}}
    assert chat_format.violations({"n": 2, "k": "a", "l": [1, 2.5]}, schema) == []
    assert chat_format.violations({"n": True, "k": "c", "l": [1, "x"]}, schema) == ["$.k: not one of the listed values", "$.l[1]: not number", "$.n: not integer"]


def test_texts_without_a_canonical_line_are_content(spark):
    texts = ['{"tool_calls":[{"id":"a","name":"n","arguments":{"x":1e999}}]}', '{"tool_calls":[{"id":"\\ud800","name":"n","arguments":{}}]}', '{"tool_call_id":"\\udfff"}', '{"a":' * 100_000, '{"x":NaN}', '{"x":1' + "0" * 5000 + "}", "{", "[1]"]
    got = chat_format.format_chats(spark.createDataFrame([(1, i, "user", t) for i, t in enumerate(texts)], CHAT), {"n": {"properties": {"x": {"type": "integer"}}}}).collect()
    assert {r["turn"]: json.loads(r["message"]) for r in got} == {i: {"content": t, "role": "user"} for i, t in enumerate(texts)}
    assert all(r["errors"] == [] and r["n_calls"] == 0 for r in got)
    fine = chat_format.read_message("a", '{"tool_calls":[{"id":"a","name":"n","arguments":{"x":1e300,"y":"\\ud83d\\ude00"}}]}', {})
    assert fine["calls"][0]["errors"] == [] and "\U0001f600" in fine["message"]


def slow_places(links):
    """Longest-waiting order by repeated passes over all links."""
    turn = {}
    for s, st, d, dt in links:
        turn[s], turn[d] = st, dt
    targets = {d for _, _, d, _ in links}
    place = {s: (turn[s], 0) for s in turn if s not in targets}
    for _ in range(len(links) + 1):
        for d in targets - place.keys():
            own = [s for s, _, x, _ in links if x == d]
            if all(s in place for s in own):
                at, depth = max(place[s] for s in own)
                place[d] = (at, depth + 1) if at >= turn[d] else (turn[d], 0)
    return sorted((d, *place.get(d, (turn[d], 0)), d not in place) for d in targets)


def test_places_by_task_and_in_rounds(spark, monkeypatch):
    import random

    rng = random.Random(7)
    rows, want = [], []
    for conv in range(12):
        n = rng.randint(2, 14)
        turn = {f"{conv}:{i}": rng.randint(0, 9) for i in range(n)}
        names = list(turn)
        links = {(a, turn[a], b, turn[b]) for a, b in (rng.sample(range(n), 2) for _ in range(rng.randint(1, 16))) if (a < b or rng.random() < 0.1) for a, b in [(names[a], names[b])]}
        rows += [(conv, *x) for x in links]
        want += slow_places(links) if links else []
    frame = spark.createDataFrame(rows, "conv_id long, src string, src_turn long, dst string, dst_turn long")
    for limit in (50_000, 6, 0):
        monkeypatch.setattr(chat_format, "LINKS", limit)
        assert sorted(map(tuple, chat_format._places(frame).collect())) == sorted(want)
    assert chat_format._places(frame.limit(0)).count() == 0


def test_turns_as_calls(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "q"), (1, 2, "assistant", "r"), (1, 3, "user", "x" * 1001), (1, 6, "user", None), (1, 9, "assistant", "late"), (2, 0, "user", ""), (2, 0, "user", ""), (None, 1, "user", "t"), (3, None, "assistant", "t"), (3, 1, None, None)]
    got = chat_format.format_chats(chat_format.turns_as_calls(spark.createDataFrame(rows, CHAT)), chat_format.REPLY).collect()
    by = {(r["conv_id"], r["turn"]): r for r in got}
    assert len(got) == len(rows) and by[1, 2]["call_turn"] == 1 and by[1, 1]["n_calls"] == 1 and by[1, 1]["errors"] == []
    assert by[1, 3]["errors"] == ["$.prompt: longer than 1000", "no result"] and by[1, 6]["errors"] == ["$.prompt: missing", "depends on an unknown call", "no result"]
    assert by[1, 9]["errors"] == ["result without a call"] and by[2, 0]["errors"] == ["$.prompt: shorter than 1", "no result"]
    assert by[None, 1]["message"] == '{"content":"t","role":"user"}' and by[3, 1]["message"] == '{"content":null,"role":null}'
    assert json.loads(by[1, 3]["message"])["tool_calls"][0]["depends_on"] == ["1/1"]
