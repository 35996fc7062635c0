"""Chat formatting: tool-call linking.

Input are event rows of conversations: *calls* (id, tool name, JSON arguments)
and *results* (id of the call they answer, content).

* Calls and results are brought together by a hash join on (conversation, id),
  after each side has been reduced to one row per id: the first by turn counts,
  later ones with the same id are marked ``duplicate``.
* An argument ``{"$ref": "<id>"}`` anywhere means that a call needs the result of
  another call of its conversation.  Calls get topological levels: in one task
  for a conversation of up to ``in_task`` such edges.  In a longer one, chains of
  calls that need one other each are first contracted by pointer doubling (as many
  rounds as the logarithm of the longest chain); if more than ``in_task`` edges are
  left after that, these are worked off by rounds, one for each step of the longest
  way through calls that need several others.  What is left without progress lies
  on or behind a cycle.
* Arguments are validated against the tool's JSON schema.
* Every event is serialised as canonical JSON: sorted keys, no blanks, the
  shortest numbers, text as UTF-8.

No step gathers more than ``in_task`` edges of a conversation: joins and counts
are keyed by call id, so a conversation with a large share of all rows is spread
like any other.  The order
of a conversation is given by ``level``, ``turn`` and ``call_id``.
"""

from __future__ import annotations

import json
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexlab.llm.common import batches
from lexlab.session import drop_staged, scratch_path, stage_table


# ---- canonical JSON ----------------------------------------------------------------
def _number(x) -> str:
    if isinstance(x, bool):
        return "true" if x else "false"
    if isinstance(x, int):
        return str(x)
    if not math.isfinite(x):
        raise ValueError("not a JSON number")
    if x == int(x) and abs(x) < 1e21:
        return str(int(x))
    mantissa, _, exponent = repr(x).partition("e")
    return f"{mantissa}e{'+' if int(exponent) > 0 else ''}{int(exponent)}" if exponent else mantissa


_LONE = re.compile("[\ud800-\udfff]")  # Python joins pairs, so what is left is half of one


def _escaped(text: str) -> str:
    """``text`` with lone surrogates, which UTF-8 does not have, as JSON escapes."""
    return _LONE.sub(lambda m: f"\\u{ord(m.group()):04x}", text)


def _string(text: str) -> str:
    return _escaped(json.dumps(text, ensure_ascii=False))


def canonical(value) -> str:
    """Canonical JSON text: keys in order of their UTF-16 units, no blanks."""
    if value is None:
        return "null"
    if isinstance(value, (bool, int, float)):
        return _number(value)
    if isinstance(value, str):
        return _string(value)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(canonical(v) for v in value) + "]"
    keys = sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"))
    return "{" + ",".join(f"{_string(k)}:{canonical(value[k])}" for k in keys) + "}"


# ---- schemas ----------------------------------------------------------------------
_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def _is(value, kind: str) -> bool:
    if kind in ("integer", "number"):
        if isinstance(value, bool) or not isinstance(value, (int, float)):
            return False
        return kind == "number" or isinstance(value, int) or value == int(value)
    return isinstance(value, _TYPES[kind])


def problems(value, schema: dict, path: str = "$") -> list[str]:
    """What a value lacks of a JSON schema (type, enum, const, required,
    properties, additionalProperties, items and the usual bounds).  A reference
    ``{"$ref": id}`` stands for a value of any type."""
    if isinstance(value, dict) and set(value) == {"$ref"} and isinstance(value["$ref"], str):
        return []
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(_is(value, k) for k in kinds):
        return [f"{path}: not {' or '.join(kinds)}"]
    out = []
    if "enum" in schema and canonical(value) not in {canonical(v) for v in schema["enum"]}:
        out.append(f"{path}: not in enum")
    if "const" in schema and canonical(value) != canonical(schema["const"]):
        out.append(f"{path}: not the constant")
    if isinstance(value, str):
        if len(value) < schema.get("minLength", 0):
            out.append(f"{path}: shorter than {schema['minLength']}")
        if len(value) > schema.get("maxLength", math.inf):
            out.append(f"{path}: longer than {schema['maxLength']}")
    elif isinstance(value, (int, float)) and not isinstance(value, bool):
        if value < schema.get("minimum", -math.inf):
            out.append(f"{path}: less than {schema['minimum']}")
        if value > schema.get("maximum", math.inf):
            out.append(f"{path}: more than {schema['maximum']}")
    elif isinstance(value, list):
        if len(value) < schema.get("minItems", 0) or len(value) > schema.get("maxItems", math.inf):
            out.append(f"{path}: number of items")
        if isinstance(schema.get("items"), dict):
            for i, v in enumerate(value):
                out += problems(v, schema["items"], f"{path}[{i}]")
    elif isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{path}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k in sorted(value):
            if k in known:
                out += problems(value[k], known[k], f"{path}.{k}")
            elif schema.get("additionalProperties") is False:
                out.append(f"{path}.{k}: not allowed")
            elif isinstance(schema.get("additionalProperties"), dict):
                out += problems(value[k], schema["additionalProperties"], f"{path}.{k}")
    return out


def references(value) -> list[str]:
    """Ids of the calls that a value refers to, in order, once each."""
    if isinstance(value, dict):
        if set(value) == {"$ref"} and isinstance(value["$ref"], str):
            return [value["$ref"]]
        value = [value[k] for k in sorted(value)]
    found = [r for v in value for r in references(v)] if isinstance(value, list) else []
    return list(dict.fromkeys(found))


MAX_DEPTH = 100  # of nested arrays and objects in arguments; deeper ones are invalid


class _Beyond(ValueError):
    """A number that a double cannot hold."""


def _finite(text: str) -> float:
    x = float(text)
    if not math.isfinite(x):
        raise _Beyond(text)
    return x


def _not_json(text: str):
    raise ValueError(text)


def _depth(value) -> int:
    """Levels of nested arrays and objects, up to one more than ``MAX_DEPTH``."""
    level, depth = [value], 0
    while level and depth <= MAX_DEPTH:
        level = [v for x in level if isinstance(x, (list, dict)) for v in (x.values() if isinstance(x, dict) else x)
                 if isinstance(v, (list, dict))]
        depth += 1
    return depth


def _parsed(text: str | None):
    """``(value, error)`` of JSON arguments."""
    if text is None:
        return None, "no arguments"
    try:
        value = json.loads(text, parse_constant=_not_json, parse_float=_finite)
    except _Beyond:
        return None, "number out of range"
    except ValueError:
        return None, "not JSON"
    except RecursionError:
        return None, f"nested deeper than {MAX_DEPTH}"
    return (None, f"nested deeper than {MAX_DEPTH}") if _depth(value) > MAX_DEPTH else (value, None)


# ---- linking ------------------------------------------------------------------------
def _first_of(rows: DataFrame, name: str) -> DataFrame:
    """The first row per (conversation, id) by turn, then by a hash of its canonical
    JSON, and how many there are; only of equal rows the scan's number decides."""
    return (rows.filter(F.col("call_id").isNotNull()).groupBy("conv", "call_id")
            .agg(F.min(F.struct("turn", F.xxhash64("json").alias("content"), "row")).alias(name), F.count(F.lit(1)).alias(f"n_{name}")))


def _sorted(edges: list[tuple]) -> dict[str, int]:
    """Levels of the calls of one conversation that need others; those on or
    behind a cycle are left out.  An edge may have the number of levels that it
    spans as a third part."""
    needs: dict[str, set[str]] = {}
    serves: dict[str, list[tuple[str, int]]] = {}
    for by, needed, *span in edges:
        if needed not in needs.setdefault(by, set()):
            needs[by].add(needed)
            serves.setdefault(needed, []).append((by, span[0] if span else 1))
    level = dict.fromkeys((n for n in serves if n not in needs), 0)
    ready, out = list(level), {}
    while ready:
        call = ready.pop()
        for by, span in serves.get(call, ()):
            needs[by].discard(call)
            out[by] = max(out.get(by, 0), span + (out[call] if call in out else 0))
            if not needs[by]:
                ready.append(by)
    return {c: k for c, k in out.items() if not needs[c]}


def _sorted_in_tasks(edges: DataFrame) -> DataFrame:
    """``conv, call_id, level`` of the calls that need others: a task for each conversation."""
    def sort(frames):
        for batch in frames:
            at, calls, levels = [], [], []
            for i, own in enumerate(batch.column(1).to_pylist()):
                for call, level in _sorted([(e["needs_by"], e["needed"], e["span"]) for e in own]).items():
                    at.append(i)
                    calls.append(call)
                    levels.append(level)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(calls, pa.string()),
                                              pa.array(levels, pa.int32())], names=["conv", "call_id", "level"])

    return (edges.groupBy("conv").agg(F.collect_list(F.struct("needs_by", "needed", "span")).alias("e"))
            .mapInArrow(sort, "conv string, call_id string, level int"))


def _chains(single: DataFrame) -> DataFrame:
    """Of calls that need one other (``conv, call_id, root, span``), where
    their chain ends, and in how many steps; calls on or behind a cycle of such
    calls are left out."""
    spark, path = single.sparkSession, scratch_path(single.sparkSession, "chains")
    inner = single.select("conv", F.col("call_id").alias("root"))
    single.join(inner, ["conv", "root"], "left_anti").select(single.columns).write.parquet(path)
    active = stage_table(single.join(inner, ["conv", "root"], "left_semi").select(single.columns), "active")
    reach, most = 1, single.count()
    while reach < most and not active.isEmpty():
        ended = spark.read.schema(single.schema).parquet(path).withColumn("ended", F.lit(True))
        onward = ended.unionByName(active.withColumn("ended", F.lit(False))).select(
            "conv", F.col("call_id").alias("root"), F.col("root").alias("next"), F.col("span").alias("more"), "ended")
        moved = stage_table(active.join(onward, ["conv", "root"]).select(
            "conv", "call_id", F.col("next").alias("root"), (F.col("span") + F.col("more")).alias("span"), "ended"), "active")
        moved.filter("ended").drop("ended").write.mode("append").parquet(path)
        drop_staged(active)
        active, reach = moved.filter("NOT ended").drop("ended"), 2 * reach
    return spark.read.schema(single.schema).parquet(path)


def _rounds(free: DataFrame, edges: DataFrame) -> DataFrame:
    """``conv, call_id, level`` of the calls that need others, by rounds of joins."""
    spark, path = edges.sparkSession, scratch_path(edges.sparkSession, "levels")
    schema = "conv string, call_id string, level int"
    spark.createDataFrame([], schema).write.parquet(path)
    ready = free.withColumn("level", F.lit(0))
    left = stage_table(edges.withColumn("at", F.lit(None).cast("int")), "edges")
    while not left.isEmpty():
        got = ready.select("conv", F.col("call_id").alias("needed"), F.col("level").alias("got"))
        met = stage_table(left.join(got, ["conv", "needed"], "left").withColumn("at", F.coalesce("at", F.col("got") + F.col("span")))
                          .drop("got"), "edges")
        ready = stage_table(met.groupBy("conv", F.col("needs_by").alias("call_id"))
                            .agg(F.max("at").alias("level"), F.max(F.col("at").isNull()).alias("open"))
                            .filter("NOT open").drop("open"), "ready")
        if ready.isEmpty():
            break
        ready.write.mode("append").parquet(path)
        drop_staged(left)
        left = stage_table(met.join(ready.select("conv", F.col("call_id").alias("needs_by")), ["conv", "needs_by"], "left_anti"), "edges")
        drop_staged(met)
    return spark.read.schema(schema).parquet(path)


def _long_levels(free: DataFrame, edges: DataFrame, in_task: int) -> DataFrame:
    """``conv, call_id, level`` of the calls that need others, for conversations
    that are not gathered: chains are contracted, the rest is sorted."""
    by = ["conv", "needs_by"]
    single = (edges.groupBy(*by).agg(F.min("needed").alias("root"), F.count(F.lit(1)).alias("n")).filter("n = 1")
              .select("conv", F.col("needs_by").alias("call_id"), "root", F.lit(1).alias("span")))
    single = stage_table(single, "single")
    chains = _chains(single)
    # calls that need several, each by the ends of the chains that it needs; what
    # needs a cycle needs itself
    ends = (single.select("conv", "call_id").join(chains, ["conv", "call_id"], "left")
            .select("conv", F.col("call_id").alias("needed"), "root", "span", F.lit(True).alias("chained")))
    several = (edges.join(single.select("conv", F.col("call_id").alias("needs_by")), by, "left_anti").drop("span")
               .join(ends, ["conv", "needed"], "left")
               .select(*by, F.when(F.col("chained"), F.coalesce("root", "needs_by")).otherwise(F.col("needed")).alias("needed"),
                       (F.coalesce("span", F.lit(0)) + 1).alias("span")))
    several = stage_table(several.groupBy(*by, "needed").agg(F.max("span").alias("span")), "several")
    large = stage_table(several.groupBy("conv").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > in_task).select("conv"), "long")
    levels = _sorted_in_tasks(several.join(large, "conv", "left_anti"))
    if not large.isEmpty():
        levels = levels.unionByName(_rounds(free.join(large, "conv", "left_semi"), several.join(large, "conv", "left_semi")))
    levels = stage_table(levels, "levels")
    at = free.withColumn("level", F.lit(0)).unionByName(levels).select("conv", F.col("call_id").alias("root"), "level")
    return levels.unionByName(chains.join(at, ["conv", "root"]).select("conv", "call_id", (F.col("level") + F.col("span")).alias("level")))


def _levels(nodes: DataFrame, edges: DataFrame, in_task: int) -> DataFrame:
    """``conv, call_id, level`` of the calls that can be ordered: level 0 needs
    nothing, level k something of level k - 1.

    Conversations of up to ``in_task`` edges are sorted in a task each; larger
    ones are never gathered as they are."""
    edges = stage_table(edges.withColumn("span", F.lit(1)), "edges")
    free = nodes.join(edges.select("conv", F.col("needs_by").alias("call_id")), ["conv", "call_id"], "left_anti")
    free = stage_table(free, "free")
    large = stage_table(edges.groupBy("conv").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > in_task).select("conv"), "long")
    done = free.withColumn("level", F.lit(0)).unionByName(_sorted_in_tasks(edges.join(large, "conv", "left_anti")))
    if large.isEmpty():
        return done
    return done.unionByName(_long_levels(free.join(large, "conv", "left_semi"), edges.join(large, "conv", "left_semi"), in_task))


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict], *, in_task: int = 10_000) -> DataFrame:
    """One row per call and per result.

    ``calls``: ``conv_id, turn, call_id, name, arguments``; ``results``:
    ``conv_id, turn, call_id, content``.  Output: ``conv_id, turn, kind`` (call
    or result), ``call_id, status, other_turn, level, in_cycle, valid, errors,
    json``.

    ``status``: ``linked``; ``no_result`` (call); ``orphan`` (result without a
    call, or of a call that comes later); ``duplicate`` (an id seen before);
    ``no_id`` (null id, never linked).  ``other_turn`` is the partner's turn.
    References to ids without a call are reported in ``errors`` and order
    nothing; ``level`` is null for calls that are not linked into the order
    (duplicates, no id) and on or behind a cycle, which ``in_cycle`` marks.
    Null or broken arguments, numbers beyond a double, more than ``MAX_DEPTH`` levels and
    unknown tools are invalid (such arguments stay as text); half surrogate pairs stay
    JSON escapes; empty and very long texts are kept whole; a null conversation is a conversation of its
    own; repeated rows are duplicates of the first; other columns are ignored;
    empty tables give an empty result.
    """
    c = calls.select(F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), "call_id", "name", "arguments")
    r = results.select(F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), "call_id", "content")
    conv_type = c.schema["conv"].dataType
    # row: tells rows of one id and turn apart
    c = c.withColumn("row", F.monotonically_increasing_id())
    r = r.withColumn("row", F.monotonically_increasing_id())
    schema = T.StructType([T.StructField("conv", conv_type), T.StructField("turn", T.LongType()), T.StructField("call_id", T.StringType()),
                           T.StructField("row", T.LongType()), T.StructField("refs", T.ArrayType(T.StringType())),
                           T.StructField("errors", T.ArrayType(T.StringType())), T.StructField("json", T.StringType())])

    def check(frames):
        for batch in batches(frames):
            refs, errors, texts = [], [], []
            for turn, call, name, args in zip(*(batch.column(k).to_pylist() for k in range(1, 5))):
                value, error = _parsed(args)
                found = [error] if error else []
                if not error:
                    found = problems(value, schemas[name]) if name in schemas else [f"no tool {name}"]
                refs.append([] if error else [_escaped(r) for r in references(value)])
                errors.append([_escaped(e) for e in found])
                event = {"type": "call", "id": call, "name": name, "arguments": args if error else value}
                texts.append(canonical(event))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), batch.column(5), pa.array(refs, pa.list_(pa.string())),
                 pa.array(errors, pa.list_(pa.string())), pa.array(texts, pa.string())], names=schema.names)

    def spell(frames):
        for batch in batches(frames):
            texts = [canonical({"type": "result", "id": call, "content": body})
                     for call, body in zip(batch.column(2).to_pylist(), batch.column(4).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(texts, pa.string())],
                                             names=["conv", "turn", "call_id", "row", "json"])

    said = T.StructType(schema.fields[:4] + [schema.fields[-1]])
    def stored(rows: DataFrame, name: str) -> DataFrame:
        # a null conversation joins with itself: joins run on a key that is never null
        never_null = F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("null"))
        return stage_table(rows.withColumnRenamed("conv", "conv_id").withColumn("conv", never_null), name)

    c = stored(c.select("conv", "turn", "call_id", "name", "arguments", "row").mapInArrow(check, schema), "calls")
    r = stored(r.select("conv", "turn", "call_id", "row", "content").mapInArrow(spell, said), "results")
    first_c, first_r = _first_of(c, "call"), _first_of(r, "result")
    ids = stage_table(first_c.join(first_r, ["conv", "call_id"], "full"), "ids")

    known = ids.filter("call IS NOT NULL").select("conv", "call_id", "call")
    heads = c.join(known.select("conv", "call_id", F.col("call.row").alias("row")), ["conv", "call_id", "row"], "left_semi")
    wants = heads.select("conv", F.col("call_id").alias("needs_by"), F.explode("refs").alias("needed")).distinct()
    has_call = known.select("conv", F.col("call_id").alias("needed"))
    edges = wants.join(has_call, ["conv", "needed"], "left_semi")
    unknown = (wants.join(has_call, ["conv", "needed"], "left_anti").groupBy("conv", F.col("needs_by").alias("call_id"))
               .agg(F.array_sort(F.collect_set(F.concat(F.lit("no call "), F.col("needed")))).alias("unknown")))
    levels = _levels(known.select("conv", "call_id"), edges, in_task)
    # one row per id: what every event of that id needs to know
    about = stage_table(ids.join(levels, ["conv", "call_id"], "left").join(unknown, ["conv", "call_id"], "left"), "about")

    no_errors = F.array().cast("array<string>")
    is_head = F.col("row") == F.col("call.row")
    out_c = (c.join(about, ["conv", "call_id"], "left")
             .withColumn("all_errors", F.concat("errors", F.when(is_head, F.coalesce("unknown", no_errors)).otherwise(no_errors)))
             .select("conv_id", "turn", F.lit("call").alias("kind"), "call_id",
                     F.when(F.col("call_id").isNull(), "no_id").when(~is_head, "duplicate")
                     .when(F.col("result.turn") >= F.col("turn"), "linked").otherwise("no_result").alias("status"),
                     F.when(is_head & (F.col("result.turn") >= F.col("turn")), F.col("result.turn")).alias("other_turn"),
                     F.when(is_head, F.col("level")).alias("level"),
                     (F.coalesce(is_head, F.lit(False)) & F.col("level").isNull()).alias("in_cycle"),
                     (F.size("all_errors") == 0).alias("valid"), F.concat_ws("; ", "all_errors").alias("errors"), "json"))
    is_head = F.col("row") == F.col("result.row")
    answers = F.col("call.turn") <= F.col("turn")
    out_r = (r.join(about, ["conv", "call_id"], "left")
             .select("conv_id", "turn", F.lit("result").alias("kind"), "call_id",
                     F.when(F.col("call_id").isNull(), "no_id").when(~is_head, "duplicate")
                     .when(answers, "linked").otherwise("orphan").alias("status"),
                     F.when(is_head & answers, F.col("call.turn")).alias("other_turn"),
                     F.when(is_head & answers, F.col("level")).alias("level"), F.lit(False).alias("in_cycle"),
                     F.lit(True).alias("valid"), F.lit("").alias("errors"), "json"))
    return out_c.unionByName(out_r)


# ---- the query's events ------------------------------------------------------------
SCHEMAS = {
    "answer": {"type": "object", "required": ["text", "n_words", "turn"], "additionalProperties": False,
               "properties": {"text": {"type": "string", "minLength": 1}, "n_words": {"type": "integer", "minimum": 1, "maximum": 120},
                              "turn": {"type": "integer", "minimum": 0}, "context": {"type": "object"}}},
    "translate": {"type": "object", "required": ["text", "turn", "context"], "properties": {
        "text": {"type": "string", "maxLength": 4000}, "n_words": {"type": "integer"}, "turn": {"type": "integer"},
        "context": {"type": "object"}}},
}


def events(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results out of plain conversations: an assistant's turn is a
    call whose arguments hold its text and refer to the call two turns before;
    any other turn after the first, also one without a role, is the result of the
    call one turn before."""
    call = F.concat(F.lit("call_"), F.col("conv_id").cast("string"), F.lit("_"))
    text = F.coalesce("text", F.lit(""))
    args = F.to_json(F.struct(
        F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")).alias("n_words"), text.alias("text"), "turn",
        F.when(F.col("turn") >= 2, F.struct(F.concat(call, (F.col("turn") - 2).cast("string")).alias("$ref"))).alias("context")))
    calls = conversations.filter("role = 'assistant'").select(
        "conv_id", "turn", F.concat(call, F.col("turn").cast("string")).alias("call_id"),
        F.when(F.pmod("conv_id", F.lit(4)) == 0, "translate").otherwise("answer").alias("name"), args.alias("arguments"))
    results = conversations.filter("NOT (role <=> 'assistant') AND turn > 0").select(
        "conv_id", "turn", F.concat(call, (F.col("turn") - 1).cast("string")).alias("call_id"), F.col("text").alias("content"))
    return calls, results
