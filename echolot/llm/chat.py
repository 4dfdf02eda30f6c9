"""Chat formatting: tool calls are linked to their results, ordered, validated and serialised as canonical JSON.

A message is a row (conv_id, turn, role, text). A text that is a JSON object with tool_calls, a list of objects with
id, name and arguments, makes calls; one with tool_call_id is a result; any other text is a plain message. Calls and
results meet by a hash join on conversation and identifier. An argument {"$result": id} makes its call depend on the
result of another. Order is topological: a node's effective turn is the largest of its own and those it depends on,
and depth counts the dependencies met at that turn, so sorting by (conv_id, at_turn, depth, turn, seq) puts every call
before its result and every result before the calls that use it. Both come from rounds of joins over calls and
results alone, as many as the longest chain; no conversation is gathered in one task.

Each output row is one message, call or result with its JSON: sorted keys, no spaces, UTF-8 unescaped. status is
message, linked, no_result (a call without), no_call (a result without), repeated (an identifier used again by a later
call or result; it is kept and not linked) or cycle (calls that wait for each other, or for what never ends). valid
is null but for calls: whether name is known and the arguments meet its schema. Null texts are plain messages with
null content, null conversations are one conversation; broken JSON is a plain message, and so is JSON with NaN, with
numbers beyond a double's or of over 200 levels (arguments given as such a text stay a text). Lone surrogates are
written as \\udXXX, in identifiers too. Repeated rows stay, their calls count as repeated. Very long texts are handled
whole. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_paths, hide_null, materialize, ship, show_null, with_rows

#: Schemas of the tools in production: JSON Schema's type, properties, required, additionalProperties, enum, items.
TOOLS = {
    "search": {"type": "object", "properties": {"query": {"type": "string"}, "limit": {"type": "integer"}}, "required": ["query"], "additionalProperties": False},
    "calculate": {"type": "object", "properties": {"expression": {"type": "string"}}, "required": ["expression"], "additionalProperties": False},
    "fetch": {"type": "object", "properties": {"url": {"type": "string"}}, "required": ["url"], "additionalProperties": False},
}
#: Deeper texts and arguments are not taken apart.
MOST_LEVELS = 200
_LONE = re.compile("[\ud800-\udfff]")
_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None), "number": (int, float), "integer": int}
NODE = "conv_id long, turn long, role string, seq int, kind string, call_id string, name string, valid boolean, needs array<string>, json string"


def escaped(s: str) -> str:
    """s with lone surrogates, which UTF-8 can't hold, as \\udXXX."""
    return _LONE.sub(lambda m: f"\\u{ord(m[0]):04x}", s)


def canonical(x) -> str:
    return escaped(json.dumps(x, sort_keys=True, ensure_ascii=False, allow_nan=False, separators=(",", ":")))


def _no_number(name: str):
    raise ValueError(f"{name} is not JSON")


def read_json(text: str):
    """The value of a JSON text of at most MOST_LEVELS levels and finite numbers; else ValueError."""
    try:
        x = json.loads(text, parse_constant=_no_number)
    except RecursionError:
        raise ValueError("too many levels") from None
    level = [x]
    for _ in range(MOST_LEVELS):
        if not level:
            return x
        if any(isinstance(v, float) and v in (float("inf"), -float("inf")) for v in level):
            raise ValueError("too large a number")
        level = [w for v in level if isinstance(v, (dict, list)) for w in (v.values() if isinstance(v, dict) else v)]
    raise ValueError("too many levels")


def _same(a, b) -> bool:
    """JSON's equality: true is not 1."""
    return canonical(a) == canonical(b)


def meets(x, schema: dict) -> bool:
    """Whether x meets the schema, whose type may be a list; a reference to a result meets any."""
    if isinstance(x, dict) and set(x) == {"$result"}:
        return True
    kinds = schema.get("type") or []
    kinds = kinds if isinstance(kinds, list) else [kinds]
    if kinds and not any(isinstance(x, _TYPES[k]) and not (isinstance(x, bool) and k in ("number", "integer")) for k in kinds):
        return False
    if "enum" in schema and not any(_same(x, v) for v in schema["enum"]):
        return False
    if isinstance(x, dict):
        own = schema.get("properties", {})
        if any(k not in x for k in schema.get("required", ())) or schema.get("additionalProperties") is False and any(k not in own for k in x):
            return False
        return all(meets(v, own[k]) for k, v in x.items() if k in own)
    if isinstance(x, list) and "items" in schema:
        return all(meets(v, schema["items"]) for v in x)
    return True


def references(x) -> list[str]:
    if isinstance(x, dict):
        if set(x) == {"$result"}:
            return [x["$result"] if isinstance(x["$result"], str) else canonical(x["$result"])]
        return [r for v in x.values() for r in references(v)]
    return [r for v in x for r in references(v)] if isinstance(x, list) else []


def nodes_of(role: str | None, text: str | None, tools: dict) -> list[tuple]:
    """(seq, kind, call_id, name, valid, needs, json) of a message."""
    got = None
    if text and text.lstrip()[:1] == "{":
        try:
            got = read_json(text)
        except ValueError:
            got = None
    plain = [(0, "message", None, None, None, [], canonical({"content": text, "role": role}))]
    if isinstance(got, dict) and isinstance(got.get("tool_call_id"), str):
        return [(0, "result", escaped(got["tool_call_id"]), None, None, [], canonical({"content": got.get("content"), "role": role, "tool_call_id": got["tool_call_id"]}))]
    calls = got.get("tool_calls") if isinstance(got, dict) else None
    if not isinstance(calls, list) or not calls or not all(isinstance(c, dict) and isinstance(c.get("id"), str) for c in calls):
        return plain
    out = [] if got.get("content") is None else [(0, "message", None, None, None, [], canonical({"content": got["content"], "role": role}))]
    for k, c in enumerate(calls, 1):
        args, name = c.get("arguments"), c.get("name")
        if isinstance(args, str):
            try:
                args = read_json(args)
            except ValueError:
                pass
        ok = isinstance(name, str) and name in tools and meets(args, tools[name])
        needs = sorted({escaped(r) for r in references(args)})
        out.append((k, "call", escaped(c["id"]), escaped(name) if isinstance(name, str) else None, ok, needs, canonical({"arguments": args, "id": c["id"], "name": name, "role": role})))
    return out


def format_chat(messages: DataFrame, tools: dict | None = None) -> DataFrame:
    """conv_id, turn, seq, role, kind, call_id, name, valid, status, peer_turn, at_turn, depth, json."""
    spark = messages.sparkSession
    ship(spark)
    tools = TOOLS if tools is None else tools

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(c, t, r, *n) for c, t, r, x in zip(pdf["conv_id"].tolist(), pdf["turn"].tolist(), pdf["role"], pdf["text"], strict=True) for n in nodes_of(r, x, tools)]
            yield pd.DataFrame(rows, columns=["conv_id", "turn", "role", "seq", "kind", "call_id", "name", "valid", "needs", "json"])

    nodes = materialize(messages.select(hide_null("conv_id"), hide_null("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")).mapInPandas(
        with_rows(parse), NODE).withColumn("uid", F.monotonically_increasing_id()), "chat")
    tool = nodes.where("kind <> 'message'")
    done = nodes.where("kind = 'message'").withColumns({"status": F.lit("message"), "peer_turn": F.lit(None).cast("long"), "at_turn": F.col("turn"), "depth": F.lit(0)})
    if not tool.isEmpty():
        done = done.unionByName(_linked(tool))
    return done.select(show_null("conv_id").alias("conv_id"), show_null("turn").alias("turn"), "seq", "role", "kind", "call_id", "name", "valid", "status", show_null("peer_turn").alias("peer_turn"), show_null("at_turn").alias("at_turn"), "depth", "json")


def _linked(tool: DataFrame) -> DataFrame:
    """status, peer_turn, at_turn and depth for calls and results."""
    spark = tool.sparkSession
    first = F.row_number().over(Window.partitionBy("conv_id", "call_id", "kind").orderBy("turn", "seq", "json", "uid"))
    tool = materialize(tool.withColumn("again", first > 1), "chat-tool")
    calls = tool.where("kind = 'call' and not again").select("conv_id", "call_id", F.col("uid").alias("call_uid"), F.col("turn").alias("call_turn"))
    results = tool.where("kind = 'result' and not again").select("conv_id", "call_id", F.col("uid").alias("result_uid"), F.col("turn").alias("result_turn"))
    links = calls.join(results, ["conv_id", "call_id"])
    uses = tool.where("kind = 'call'").select("conv_id", F.col("uid").alias("after"), F.explode("needs").alias("call_id"))
    edges = materialize(links.select(F.col("call_uid").alias("before"), F.col("result_uid").alias("after")).union(
        uses.join(results, ["conv_id", "call_id"]).select(F.col("result_uid").alias("before"), "after")).distinct(), "chat-edges")
    peers = links.select(F.col("call_uid").alias("uid"), F.col("result_turn").alias("peer_turn")).union(links.select(F.col("result_uid").alias("uid"), F.col("call_turn").alias("peer_turn")))
    # Kahn's rounds: what waits for nothing is placed, and places what waits for it alone
    # until none is left: each round places a node or is the last, and what it was made from is deleted
    base = tool.select("uid", "turn")
    paths: dict[str, list[str]] = {"waiting": [], "placed": [], "ready": []}

    def kept(df: DataFrame, what: str) -> DataFrame:
        before, paths[what] = paths[what], []
        df = materialize(df, f"chat-{what}", paths[what])
        stale.extend(before)
        return df

    stale: list[str] = []
    placed = kept(base.join(edges.select(F.col("after").alias("uid")), "uid", "left_anti").select("uid", F.col("turn").alias("at_turn"), F.lit(0).alias("depth")), "placed")
    waiting, ready = edges, placed
    while not ready.isEmpty():
        open_ids = ready.select(F.col("uid").alias("before"))
        met = edges.join(open_ids, "before").select("after").distinct()
        waiting = kept(waiting.join(open_ids, "before", "left_anti"), "waiting")
        free = met.join(waiting.select("after").distinct(), "after", "left_anti")
        best = edges.join(free, "after").join(placed.withColumnRenamed("uid", "before"), "before").groupBy("after").agg(F.max(F.struct("at_turn", "depth")).alias("p"))
        new = best.withColumnRenamed("after", "uid").join(base, "uid").select(
            "uid", F.greatest("turn", "p.at_turn").alias("at_turn"), F.when(F.col("p.at_turn") >= F.col("turn"), F.col("p.depth") + 1).otherwise(0).alias("depth"))
        ready = kept(new, "ready")
        placed = kept(placed.union(ready), "placed")
        drop_paths(spark, stale)
    out = tool.join(peers, "uid", "left").join(placed, "uid", "left").withColumn(
        "status", F.when(F.col("again"), "repeated").when(F.col("at_turn").isNull(), "cycle").when(F.col("peer_turn").isNotNull(), "linked").otherwise(F.concat(F.lit("no_"), F.when(F.col("kind") == "call", "result").otherwise("call"))))
    out = materialize(out.withColumns({"at_turn": F.coalesce("at_turn", "turn"), "depth": F.coalesce("depth", F.lit(0))}).drop("again"), "chat-linked")
    drop_paths(spark, [x for v in paths.values() for x in v])
    return out
