"""Chat formatting with tool-call linking.

A message whose text is a JSON object may carry ``tool_calls`` (a list of
``{"id", "name", "arguments", "depends_on"}``) or answer one with
``tool_call_id``.  Calls and results of a conversation are linked by a hash join
on (conversation, call id).  Arguments are validated against the tool's schema.
Every message is one line of canonical JSON: sorted keys, no spaces.

Order is topological: a result comes after its call, a call after the results
of the calls it depends on, and otherwise turns rule.  Only the narrow links
take part: the links of one conversation are settled in one task, in one pass;
conversations with more than ``LINKS`` links are settled in rounds over all
tasks (one per link of their longest chain), each of which hands what it settled
on to the links that are still open.  What is left hangs on a cycle.
Rows stay rows, so a conversation of any length is never collected.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corrello.store import forget, keep, table

#: Links of a conversation up to which one task settles them.
LINKS = 50_000

Schemas = dict[str, dict]
_TYPES = {"string": str, "object": dict, "array": list, "boolean": bool, "null": type(None)}


def canonical(value) -> str:
    return json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"), allow_nan=False)


def _is(value, kind: str) -> bool:
    if kind in ("number", "integer"):
        if isinstance(value, bool) or not isinstance(value, (int, float)):
            return False
        return kind == "number" or value == int(value)
    return kind not in _TYPES or isinstance(value, _TYPES[kind])


def violations(value, schema: dict, path: str = "$") -> list[str]:
    """What a value breaks of a JSON-schema subset: type, enum, required,
    properties, additionalProperties, items, minimum, maximum, minLength, maxLength."""
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(_is(value, k) for k in kinds):
        return [f"{path}: not {'/'.join(kinds)}"]
    out = [f"{path}: not one of the listed values"] if "enum" in schema and value not in schema["enum"] else []
    if _is(value, "number"):
        out += [f"{path}: below {schema['minimum']}"] if value < schema.get("minimum", value) else []
        out += [f"{path}: above {schema['maximum']}"] if value > schema.get("maximum", value) else []
    if isinstance(value, str):
        out += [f"{path}: shorter than {schema['minLength']}"] if len(value) < schema.get("minLength", 0) else []
        out += [f"{path}: longer than {schema['maxLength']}"] if len(value) > schema.get("maxLength", len(value)) else []
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{path}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k in sorted(value):
            if k in known:
                out += violations(value[k], known[k], f"{path}.{k}")
            elif schema.get("additionalProperties") is False:
                out.append(f"{path}.{k}: unknown")
    if isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            out += violations(x, schema["items"], f"{path}[{i}]")
    return out


def _refuse(constant: str):
    raise ValueError(constant)


def _finite(number: str) -> float:
    value = float(number)
    return value if abs(value) <= 1.7976931348623157e308 else _refuse(number)


def _object(text: str | None) -> dict | None:
    """The JSON object that a text is.  None for anything else, and for what has
    no canonical line: numbers beyond a double, halves of surrogate pairs,
    nesting that is too deep.  Such a text is content as it stands."""
    if not text or not text.lstrip().startswith("{"):
        return None
    try:
        value = json.loads(text, parse_constant=_refuse, parse_float=_finite)
        canonical(value).encode("utf-8")
    except (ValueError, RecursionError):  # UnicodeEncodeError is a ValueError
        return None
    return value if isinstance(value, dict) else None


def read_message(role: str | None, text: str | None, schemas: Schemas) -> dict:
    """One message: its canonical line, its calls with errors, the call it answers."""
    body = _object(text)
    calls, answers = [], None
    message: dict = {"role": role, "content": text}
    if body is not None and isinstance(body.get("tool_calls"), list):
        made = []
        for raw in body["tool_calls"]:
            raw = raw if isinstance(raw, dict) else {}
            call_id, name, args = raw.get("id"), raw.get("name"), raw.get("arguments")
            errors = []
            if isinstance(args, str):
                args = _object(args)
            if not isinstance(args, dict):
                errors.append("arguments are not an object")
                args = None
            elif name not in schemas:
                errors += ["unknown tool"] if schemas else []
            else:
                errors += violations(args, schemas[name])
            if not isinstance(call_id, str) or not call_id:
                errors.append("no id")
                call_id = None
            needs = [x for x in raw.get("depends_on") or [] if isinstance(x, str)] if isinstance(raw.get("depends_on"), list) else []
            calls.append({"call_id": call_id, "name": name if isinstance(name, str) else None, "needs": needs, "errors": errors})
            made.append({"id": call_id, "name": name, "arguments": args} | ({"depends_on": needs} if needs else {}))
        message = {"role": role, "content": body.get("content"), "tool_calls": made}
    elif body is not None and isinstance(body.get("tool_call_id"), str):
        answers = body["tool_call_id"]
        message = {"role": role, "content": body.get("content"), "tool_call_id": answers}
    return {"message": canonical(message), "calls": calls, "answers": answers}


_CALL = "array<struct<call_id:string,name:string,needs:array<string>,errors:array<string>>>"


def read_messages(rows: DataFrame, schemas: Schemas) -> DataFrame:
    """Add message_key, message, calls and answers to (conv_id, turn, role, text)."""
    keyed = rows.select("conv_id", "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in ("conv_id", "turn", "role", "text")]
    keyed = keyed.withColumn("message_key", F.sha2(F.concat_ws("\x01", *parts), 256))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keyed.schema if f.name != "text")
    call = pa.list_(pa.struct([("call_id", pa.string()), ("name", pa.string()), ("needs", pa.list_(pa.string())), ("errors", pa.list_(pa.string()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [read_message(r, t, schemas) for r, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            cols = [batch.column(0), batch.column(1), batch.column(2), batch.column(4)]
            cols += [pa.array([g["message"] for g in got], pa.string()), pa.array([g["calls"] for g in got], call), pa.array([g["answers"] for g in got], pa.string())]
            yield pa.RecordBatch.from_arrays(cols, ["conv_id", "turn", "role", "message_key", "message", "calls", "answers"])

    return keyed.mapInArrow(run, f"{kinds}, message string, calls {_CALL}, answers string")


_PLACE = "message_key string, at long, depth long, cyclic boolean"
Link = tuple[str, int | None, str, int | None]


def _placed(dst_turn: int | None, at: int | None, depth: int) -> tuple[int | None, int]:
    """Place of a message after its last prerequisite's."""
    return (at, depth + 1) if at is not None and dst_turn is not None and at >= dst_turn else (dst_turn, 0)


def settle(links: Iterable[Link]) -> list[tuple[str, int | None, int, bool]]:
    """``(message_key, at, depth, cyclic)`` of the targets of one conversation's links."""
    turn: dict[str, int | None] = {}
    before: defaultdict[str, list[str]] = defaultdict(list)
    after: defaultdict[str, list[str]] = defaultdict(list)
    for src, src_turn, dst, dst_turn in links:
        turn[src], turn[dst] = src_turn, dst_turn
        before[dst].append(src)
        after[src].append(dst)
    waits = {dst: len(own) for dst, own in before.items()}
    place = {src: (turn[src], 0) for src in after if src not in waits}
    ready = list(place)
    while ready:
        for dst in after[ready.pop()]:
            waits[dst] -= 1
            if not waits[dst]:
                at, depth = max((place[src] for src in before[dst]), key=lambda p: (p[0] is not None, p[0] or 0, p[1]))
                place[dst] = _placed(turn[dst], at, depth)
                ready.append(dst)
    return [(dst, *place[dst], False) if dst in place else (dst, turn[dst], 0, True) for dst in before]


def _settle_by_conversation(links: DataFrame) -> DataFrame:
    """Conversations within LINKS: each comes to one task as a run of sorted rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for _, own in groupby(rows, key=lambda r: r[0]):
            found = settle(r[1:] for r in own)
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], ["message_key", "at", "depth", "cyclic"])

    dealt = links.repartition("conv_id").sortWithinPartitions("conv_id")
    return dealt.select("conv_id", "src", "src_turn", "dst", "dst_turn").mapInArrow(run, _PLACE)


def _settle_in_rounds(links: DataFrame) -> list[DataFrame]:
    """Any conversations; a message is settled when all its prerequisites are.
    What a round settles is written once and handed to the open links."""
    waits = links.select(F.col("dst").alias("src")).distinct().withColumn("_w", F.lit(True))
    start = links.join(waits, "src", "left")
    open_ = keep(start.select("src", "dst", "dst_turn", F.col("_w").isNull().alias("done"), F.col("src_turn").alias("at"), F.lit(0).cast("long").alias("depth")), "chat-open")
    out: list[DataFrame] = []
    while not open_.isEmpty():
        last = F.max(F.struct("at", "depth")).alias("b")
        ready = open_.groupBy("dst").agg(F.first("dst_turn").alias("dst_turn"), F.min("done").alias("done"), last).where("done")
        late = F.coalesce(F.col("b.at") >= F.col("dst_turn"), F.lit(False))
        at = F.when(late, F.col("b.at")).otherwise(F.col("dst_turn"))
        depth = F.when(late, F.col("b.depth") + 1).otherwise(F.lit(0)).cast("long")
        placed = keep(ready.select(F.col("dst").alias("message_key"), at.alias("at"), depth.alias("depth"), F.lit(False).alias("cyclic")), "chat-placed")
        if placed.isEmpty():
            out.append(open_.select(F.col("dst").alias("message_key"), F.col("dst_turn").alias("at"), F.lit(0).cast("long").alias("depth"), F.lit(True).alias("cyclic")).distinct())
            break
        out.append(placed)
        rest = open_.join(placed.select(F.col("message_key").alias("dst")), "dst", "left_anti")
        given = placed.select(F.col("message_key").alias("src"), F.col("at").alias("_at"), F.col("depth").alias("_depth"))
        rest = rest.join(given, "src", "left")
        new = F.col("_depth").isNotNull()
        held = open_
        open_ = keep(rest.select("src", "dst", "dst_turn", (F.col("done") | new).alias("done"), F.when(new, F.col("_at")).otherwise(F.col("at")).alias("at"), F.coalesce("_depth", "depth").alias("depth")), "chat-open")
        forget(held)
    return out


def _places(links: DataFrame) -> DataFrame:
    """``(message_key, at, depth, cyclic)`` of messages that have prerequisites.

    ``links``: (conv_id, src, src_turn, dst, dst_turn), src before dst, each once."""
    links = keep(links, "chat-links")
    sizes = keep(links.groupBy("conv_id").count().where(F.col("count") > LINKS).select("conv_id"), "chat-large")
    if sizes.isEmpty():
        return keep(_settle_by_conversation(links), "chat-places")
    small = _settle_by_conversation(links.join(sizes, "conv_id", "left_anti"))
    return keep(reduce(DataFrame.union, _settle_in_rounds(links.join(sizes, "conv_id", "left_semi")), small), "chat-places")


def format_chats(rows: DataFrame, schemas: Schemas | None = None) -> DataFrame:
    """One row per message: ``(conv_id, turn, role, at, depth, n_calls,
    call_turn, errors, message)``; sorting a conversation by (at, depth, turn)
    gives its topological order.

    Null roles and texts become JSON nulls, text that is no such JSON object is
    content as it stands.  errors (sorted, distinct) name broken arguments,
    unknown or repeated ids, results without a call, unanswered calls and cycles.
    A repeated call id belongs to its first message (by turn).  Repeated rows
    stay repeated.  Other input columns are left out.
    """
    messages = keep(read_messages(rows, schemas or {}), "chat-messages")
    listed = messages.where(F.size("calls") > 0).select("message_key", "conv_id", "turn", F.posexplode("calls").alias("nth", "call")).distinct()
    calls = listed.select("message_key", "conv_id", "turn", "nth", F.col("call.call_id").alias("call_id"), F.col("call.needs").alias("needs"), F.col("call.errors").alias("errors"))
    calls = keep(calls, "chat-calls")
    first = calls.where("call_id is not null").groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "message_key", "nth")).alias("first"))
    first = keep(first.select("conv_id", "call_id", "first.*"), "chat-first")
    owner = first.select("conv_id", "call_id", F.col("message_key").alias("call_key"), F.col("turn").alias("call_turn"))
    copies = calls.where("call_id is not null").join(first.select("conv_id", "call_id", "message_key", "nth"), ["conv_id", "call_id", "message_key", "nth"], "left_anti")
    results = messages.where("answers is not null").select("message_key", "conv_id", "turn", F.col("answers").alias("call_id")).distinct()
    linked = keep(results.join(owner, ["conv_id", "call_id"], "left"), "chat-linked")
    answered = linked.where("call_key is not null")
    needs = calls.select("conv_id", "message_key", "turn", F.explode("needs").alias("call_id"))
    after = needs.join(answered.select("conv_id", "call_id", F.col("message_key").alias("src"), F.col("turn").alias("src_turn")), ["conv_id", "call_id"])
    direct = needs.join(owner.select("conv_id", "call_id", F.col("call_key").alias("src"), F.col("call_turn").alias("src_turn")), ["conv_id", "call_id"])
    turn = lambda c: F.col(c).cast("long")
    edges = (
        answered.select("conv_id", F.col("call_key").alias("src"), turn("call_turn").alias("src_turn"), F.col("message_key").alias("dst"), turn("turn").alias("dst_turn"))
        .union(after.select("conv_id", "src", turn("src_turn"), "message_key", turn("turn")))
        .union(direct.select("conv_id", "src", turn("src_turn"), "message_key", turn("turn")))
        .distinct()
    )
    places = _places(edges)
    waiting = first.join(answered.select("conv_id", "call_id").distinct(), ["conv_id", "call_id"], "left_anti")
    unknown = needs.join(owner, ["conv_id", "call_id"], "left_anti")
    errors = (
        calls.select("message_key", F.explode("errors").alias("e"))
        .union(copies.select("message_key", F.lit("repeated call id")))
        .union(waiting.select("message_key", F.lit("no result")))
        .union(unknown.select("message_key", F.lit("depends on an unknown call")))
        .union(linked.where("call_key is null").select("message_key", F.lit("result without a call")))
        .union(places.where("cyclic").select("message_key", F.lit("cyclic")))
    )
    per_message = errors.groupBy("message_key").agg(F.sort_array(F.collect_set("e")).alias("errors"))
    facts = places.join(per_message, "message_key", "full").join(linked.select("message_key", "call_turn"), "message_key", "full")
    out = messages.join(facts.select("message_key", "at", "depth", "errors", "call_turn"), "message_key", "left")
    return out.select(
        "conv_id",
        "turn",
        "role",
        F.coalesce("at", turn("turn")).alias("at"),
        F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
        F.size("calls").alias("n_calls"),
        "call_turn",
        F.coalesce("errors", F.array().cast("array<string>")).alias("errors"),
        "message",
    )


#: The tool that the registered query's calls name, and its schema.
REPLY: Schemas = {
    "reply": {
        "type": "object",
        "properties": {"prompt": {"type": "string", "minLength": 1, "maxLength": 1000}, "turn": {"type": "integer", "minimum": 0}},
        "required": ["prompt", "turn"],
        "additionalProperties": False,
    }
}


def turns_as_calls(turns: DataFrame) -> DataFrame:
    """Plain conversations (conv_id, turn, role, text) as calls of ``reply`` and results.

    A user's turn calls the tool with its text and needs the call two turns
    before; an assistant's turn answers the call of the turn before it.  Turns of
    other roles, and rows without conv_id or turn, stay as they are."""
    before = lambda n: F.concat_ws("/", F.col("conv_id").cast("string"), (F.col("turn") - n).cast("string"))
    needs = F.when(F.col("turn") >= 2, F.array(before(2)))
    args = F.struct(F.col("text").alias("prompt"), F.col("turn"))
    call = F.struct(before(0).alias("id"), F.lit("reply").alias("name"), args.alias("arguments"), needs.alias("depends_on"))
    known = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    asked = F.to_json(F.struct(F.array(call).alias("tool_calls")))
    answer = F.to_json(F.struct(before(1).alias("tool_call_id"), F.col("text").alias("content")))
    text = F.when(known & (F.col("role") == "user"), asked).when(known & (F.col("role") == "assistant"), answer).otherwise(F.col("text"))
    return turns.select("conv_id", "turn", "role", text.alias("text"))


def op5_chat_formatting(spark, sf_dir: str) -> DataFrame:
    """All conversations, every turn as a call or a result of ``reply``."""
    rows = format_chats(turns_as_calls(table(spark, sf_dir, "conversations")), REPLY)
    return rows.withColumn("errors", F.array_join("errors", "; "))


OP5_SQL = """
WITH m AS (
  SELECT conv_id, turn, role, text,
         coalesce(role = 'user' AND conv_id IS NOT NULL AND turn IS NOT NULL, false) AS asks,
         coalesce(role = 'assistant' AND conv_id IS NOT NULL AND turn IS NOT NULL, false) AS answers
  FROM conversations
), calls AS (
  SELECT DISTINCT conv_id, turn FROM m WHERE asks
), results AS (
  SELECT DISTINCT conv_id, turn FROM m WHERE answers
)
SELECT m.conv_id, m.turn, m.role, m.turn AS at, CAST(0 AS BIGINT) AS depth,
       CAST(CASE WHEN asks THEN 1 ELSE 0 END AS INTEGER) AS n_calls,
       CASE WHEN answers THEN before.turn END AS call_turn,
       concat_ws('; ',
         CASE WHEN asks AND text IS NULL THEN '$.prompt: missing' END,
         CASE WHEN asks AND length(text) > 1000 THEN '$.prompt: longer than 1000' END,
         CASE WHEN asks AND text = '' THEN '$.prompt: shorter than 1' END,
         CASE WHEN asks AND m.turn < 0 THEN '$.turn: below 0' END,
         CASE WHEN asks AND m.turn >= 2 AND needed.turn IS NULL THEN 'depends on an unknown call' END,
         CASE WHEN asks AND result.turn IS NULL THEN 'no result' END,
         CASE WHEN answers AND before.turn IS NULL THEN 'result without a call' END) AS errors,
       CASE WHEN asks THEN
              '{"content":null,"role":"user","tool_calls":[{"arguments":{' || coalesce('"prompt":' || CAST(to_json(text) AS VARCHAR) || ',', '') || '"turn":' || m.turn || '},'
              || CASE WHEN m.turn >= 2 THEN '"depends_on":["' || m.conv_id || '/' || (m.turn - 2) || '"],' ELSE '' END
              || '"id":"' || m.conv_id || '/' || m.turn || '","name":"reply"}]}'
            WHEN answers THEN
              '{"content":' || coalesce(CAST(to_json(text) AS VARCHAR), 'null') || ',"role":"assistant","tool_call_id":"' || m.conv_id || '/' || (m.turn - 1) || '"}'
            ELSE '{"content":' || coalesce(CAST(to_json(text) AS VARCHAR), 'null') || ',"role":' || coalesce(CAST(to_json(role) AS VARCHAR), 'null') || '}' END AS message
FROM m
LEFT JOIN calls before ON before.conv_id = m.conv_id AND before.turn = m.turn - 1
LEFT JOIN calls needed ON needed.conv_id = m.conv_id AND needed.turn = m.turn - 2
LEFT JOIN results result ON result.conv_id = m.conv_id AND result.turn = m.turn + 1
"""
