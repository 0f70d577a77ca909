"""Chat formatting: tool calls linked to their results, ordered, validated and serialised, in DataFrame functions only.

Inputs are flat tables, so a conversation of any length is never gathered into one row: every call stays a row, results are
found by a hash join on (conversation, call identifier), dependencies are ordered by rounds of joins and aggregates,
and arguments are checked against a schema table by joins on the argument's name.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import ranked
from .common import cut, fresh


def json_string(text) -> F.Column:
    """Canonical JSON string literal: `\\"`, `\\\\`, short escapes and \\u00xx for control characters, all else as it is; null: null."""
    out = F.regexp_replace(text, r'([\\"])', r"\\$1")
    for raw, escape in (("\b", "b"), ("\f", "f"), ("\n", "n"), ("\r", "r"), ("\t", "t")):
        out = F.replace(out, F.lit(raw), F.lit("\\" + escape))
    rare = out.rlike("[\\x00-\\x1f]")
    full = out
    for c in range(32):
        if chr(c) not in "\b\f\n\r\t":
            full = F.replace(full, F.lit(chr(c)), F.lit(f"\\u{c:04x}"))
    return F.coalesce(F.concat(F.lit('"'), F.when(rare, full).otherwise(out), F.lit('"')), F.lit("null"))


def json_object(fields: dict) -> F.Column:
    """Canonical JSON object: keys in order of code points, no white space. Values are JSON texts."""
    parts = []
    for i, name in enumerate(sorted(fields)):
        parts += [F.lit(("," if i else "") + f'"{name}":'), fields[name]]
    return F.concat(F.lit("{"), *parts, F.lit("}"))


def json_arguments(names, values) -> F.Column:
    """Canonical JSON object of two aligned arrays: argument names and their string values, sorted by name."""
    pair = F.sort_array(F.arrays_zip(names.alias("n"), values.alias("v")))
    return F.concat(F.lit("{"), F.array_join(F.transform(pair, lambda p: F.concat(json_string(p["n"]), F.lit(":"), json_string(p["v"]))), ","), F.lit("}"))


def calls_of(turns: DataFrame) -> DataFrame:
    """Calls of plain conversations (conv_id, turn, role, text): each request, a user's turn, is a call to `reply`.

    Its identifier is `call-<turn>`, it comes after the request two turns before, and its arguments are the request's text
    and its language-independent length. Returns conv_id, call_id, name, args map, after (array of identifiers).
    """
    at = F.col("turn")
    call = lambda t: F.concat(F.lit("call-"), t.cast("string"))
    args = F.map_from_arrays(F.array(F.lit("length"), F.lit("text")), F.array(F.length(F.coalesce("text", F.lit(""))).cast("string"), F.col("text")))
    return turns.where("role = 'user'").select("conv_id", "turn", call(at).alias("call_id"), F.lit("reply").alias("name"), args.alias("args"), F.when(at >= 2, F.array(call(at - 2))).otherwise(F.array().cast("array<string>")).alias("after"))


def results_of(turns: DataFrame) -> DataFrame:
    """Results of plain conversations: each assistant's turn answers the request of the turn before."""
    return turns.where("role = 'assistant'").select("conv_id", F.concat(F.lit("call-"), (F.col("turn") - 1).cast("string")).alias("call_id"), F.col("text").alias("content"))


def _jumped(state: DataFrame, most: int) -> DataFrame:
    """state (conv_id, call_id, ptr, hops, n) with every ptr moved along calls with one dependency to an anchor, a call with none or several.

    Pointer jumping: chains double what they skip in each round, so a chain of `most` calls takes log2(most) rounds. Chains that lead into a
    cycle never reach an anchor.
    """
    key = ["conv_id", "ptr"]
    for _ in range(most.bit_length() + 1):
        target = state.where("ptr is not null").select("conv_id", F.col("call_id").alias("ptr"), F.col("ptr").alias("far"), F.col("hops").alias("more"))
        after = state.join(target, key, "left").select("conv_id", "call_id", F.coalesce("far", "ptr").alias("ptr"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops"), "n", F.col("far").isNotNull().alias("moved"))
        after = cut(after)
        if after.where("moved").isEmpty():
            break
        state = after.drop("moved")
    return state


def ordered(calls: DataFrame) -> DataFrame:
    """calls with `depth`: 0 without dependencies in the conversation, else 1 + the largest depth of those; in or behind cycles: null.

    Calls with a single dependency are skipped by pointer jumping, so a long chain costs a logarithmic number of rounds. Kahn's algorithm
    then orders the calls with several: one's depth is fixed once all it comes after have one. Identifiers that no call
    of the conversation has are ignored, and so are duplicates. Null conversations and identifiers have depth null.
    """
    key = ["conv_id", "call_id"]
    nodes = cut(calls.select(*key).where("conv_id is not null and call_id is not null").distinct())
    edges = cut(calls.select(*key, F.explode("after").alias("dep")).distinct().join(nodes.select("conv_id", F.col("call_id").alias("dep")), ["conv_id", "dep"]))
    degree = edges.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min("dep").alias("only"))
    one = F.col("n") == 1
    state = cut(nodes.join(degree, key, "left").select(*key, F.when(one, F.col("only")).alias("ptr"), F.when(one, 1).otherwise(0).alias("hops"), F.coalesce("n", F.lit(0)).alias("n")))
    longest = nodes.groupBy("conv_id").agg(F.count(F.lit(1)).alias("c")).agg(F.max("c")).first()[0] or 1
    state = _jumped(state, longest)
    anchor = state.where("n <> 1").select("conv_id", F.col("call_id").alias("anchor"))
    # from a call with several dependencies to the anchor behind each of them, and how far that is
    behind = state.select("conv_id", F.col("call_id").alias("dep"), F.coalesce("ptr", "call_id").alias("anchor"), (F.col("hops") + 1).alias("far"))
    links = cut(edges.join(state.where("n > 1").select(*key), key).join(behind, ["conv_id", "dep"]))
    fixed = cut(state.where("n = 0").select("conv_id", F.col("call_id").alias("anchor"), F.lit(0).alias("depth")))
    todo = cut(links.groupBy(*key).agg(F.count(F.lit(1)).alias("open"), F.lit(0).alias("best")))
    fresh, levels = fixed, [fixed]
    while not todo.isEmpty():
        met = fresh.join(links, ["conv_id", "anchor"]).groupBy(*key).agg(F.count(F.lit(1)).alias("met"), F.max(F.col("depth") + F.col("far")).alias("top"))
        left = cut(todo.join(met, key, "left").select(*key, (F.col("open") - F.coalesce("met", F.lit(0))).alias("open"), F.greatest("best", F.coalesce("top", F.lit(0))).alias("best")))
        fresh = left.where("open = 0").select("conv_id", F.col("call_id").alias("anchor"), F.col("best").alias("depth"))
        todo = left.where("open > 0")
        if fresh.isEmpty():
            break
        levels.append(fresh)
        if len(levels) > 16:  # keeps the plan small
            levels = [cut(functools.reduce(DataFrame.unionByName, levels))]
    known = functools.reduce(DataFrame.unionByName, levels)
    # a pointer that ends at a call with one dependency is caught in a cycle and finds no anchor
    depth = state.select(*key, "hops", F.coalesce("ptr", "call_id").alias("anchor")).join(known.join(anchor, ["conv_id", "anchor"], "left_semi"), ["conv_id", "anchor"])
    return calls.join(depth.select(*key, (F.col("depth") + F.col("hops")).cast("int").alias("depth")), key, "left")


#: Argument schemas of the built-in call: name, argument, type, required, largest length (code points, null: any).
SCHEMAS = [("reply", "text", "string", True, None), ("reply", "length", "integer", True, 18)]
SCHEMA_TYPE = "name string, arg string, type string, required boolean, most int"
#: What a value of each type looks like.
INTEGER, NUMBER = r"^-?[0-9]+$", r"^-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$"
#: Schema rows that are broadcast at most.
MAX_SCHEMA = 10_000


def json_number(text) -> F.Column:
    """Canonical JSON number of a number's text: no leading zeros, no zeros that end a fraction, no `-0`, exponent as `e` without plus sign or leading zeros."""
    sign, rest = F.regexp_extract(text, r"^(-?)0*(.*)$", 1), F.regexp_extract(text, r"^-?0*(.*)$", 1)
    rest = F.when(rest.rlike(r"^[0-9]"), rest).otherwise(F.concat(F.lit("0"), rest))
    rest = F.regexp_replace(F.regexp_replace(rest, r"(\.[0-9]*?)0+(?=$|[eE])", "$1"), r"\.(?=$|[eE])", "")
    rest = F.regexp_replace(F.regexp_replace(rest, r"[eE]\+?(-?)0*(?=[0-9])", "e$1"), r"e-?0$", "")
    zero = rest.rlike(r"^0(e|$)")
    return F.when(zero, F.lit("0")).otherwise(F.concat(sign, rest))


def fits(type_, value) -> F.Column:
    """Whether a value's text is of a schema type: string, integer, number or boolean; unknown types fit any value."""
    return F.when(type_ == "integer", value.rlike(INTEGER)).when(type_ == "number", value.rlike(NUMBER)).when(type_ == "boolean", value.isin("true", "false")).otherwise(F.lit(True))


def json_value(type_, value) -> F.Column:
    """Canonical JSON of a value by its schema type; what does not fit the type, or has none, is a string; null: null."""
    plain = F.when(type_.isin("integer", "number"), json_number(value)).when(type_ == "boolean", value)
    return F.coalesce(F.when(fits(type_, value), plain), json_string(value))


def checked(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """calls with `valid`, `errors` (sorted array) and `arguments`: each argument against the schema of its call's name.

    Errors: `unknown tool`, `missing <arg>`, `unexpected <arg>`, `type <arg>`, `long <arg>`. A null value counts as missing.
    Types: string, integer, number, boolean. `arguments` is the canonical JSON object of the arguments, sorted by name, each as its
    schema's type has it. schemas: at most MAX_SCHEMA rows, checked; of rows that repeat a call's argument the least counts for its type.
    Columns of calls with these names are replaced.
    """
    if schemas.limit(MAX_SCHEMA + 1).count() > MAX_SCHEMA:
        raise ValueError("too many schema rows")
    tool, spec = fresh(calls, "tool", "spec")
    specs = F.broadcast(schemas.groupBy(F.col("name").alias(tool)).agg(F.sort_array(F.collect_list(F.struct("arg", "type", "required", "most"))).alias(spec)))
    joined = calls.join(specs, calls["name"] == specs[tool], "left")

    def of(s):
        value = F.col("args")[s["arg"]]
        return F.when(value.isNull(), F.when(s["required"], F.concat(F.lit("missing "), s["arg"]))).when(~fits(s["type"], value), F.concat(F.lit("type "), s["arg"])).when(F.length(value) > s["most"], F.concat(F.lit("long "), s["arg"]))

    known = F.transform(spec, lambda s: s["arg"])
    more = F.transform(F.array_except(F.map_keys("args"), known), lambda a: F.concat(F.lit("unexpected "), a))
    errors = F.when(F.col(spec).isNull(), F.array(F.lit("unknown tool"))).otherwise(F.sort_array(F.concat(F.filter(F.transform(spec, of), lambda e: e.isNotNull()), F.coalesce(more, F.array().cast("array<string>")))))

    def pair(entry):
        type_ = F.get(F.filter(spec, lambda s: s["arg"] == entry["key"]), 0)["type"]
        return F.concat(json_string(entry["key"]), F.lit(":"), json_value(F.coalesce(type_, F.lit("string")), entry["value"]))

    arguments = F.concat(F.lit("{"), F.array_join(F.transform(F.sort_array(F.map_entries("args")), pair), ","), F.lit("}"))
    out = joined.withColumns({"errors": errors, "arguments": F.coalesce(arguments, F.lit("{}"))})
    return out.withColumn("valid", F.size("errors") == 0).drop(tool, spec)


def answers(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Every result as a row: conv_id, call_id, number (from 0 in order of content, null first), content, and canonical JSON `message`.

    Results are found by a hash join with the calls' identifiers; those that no call asked for, or with null identifiers, are
    left out. Numbers come from a global order, so a call with very many results is never ordered in one task.
    """
    asked = calls.select("conv_id", "call_id").where("conv_id is not null and call_id is not null").distinct()
    found = results.select("conv_id", "call_id", "content").join(asked, ["conv_id", "call_id"], "left_semi")
    placed = cut(ranked(found, [F.col("conv_id"), F.col("call_id"), F.col("content")], "at"))
    first = placed.groupBy("conv_id", "call_id").agg(F.min("at").alias("first"))
    out = placed.join(first, ["conv_id", "call_id"]).select("conv_id", "call_id", (F.col("at") - F.col("first")).alias("number"), "content")
    return out.withColumn("message", json_object({"id": json_string(F.col("call_id")), "number": F.col("number").cast("string"), "result": json_string(F.col("content"))}))


def linked(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row per call with depth, valid, errors, arguments, n_results, content (least result) and canonical JSON `message`.

    `arguments` has values of their schema's types; in `message`, a digest, all are strings and the least result stands for all: answers()
    gives each. Calls that repeat (conv_id, call_id) stay rows of their own and share results. Null identifiers link to nothing. Calls
    without a result have content null. Empty tables give no rows.
    """
    found = results.where("call_id is not null").groupBy("conv_id", "call_id").agg(F.count(F.lit(1)).alias("n_results"), F.min("content").alias("content"))
    out = checked(ordered(calls), schemas).join(found, ["conv_id", "call_id"], "left").withColumn("n_results", F.coalesce("n_results", F.lit(0)))
    entries = F.sort_array(F.map_entries("args"))
    arguments = json_arguments(F.transform(entries, lambda e: e["key"]), F.transform(entries, lambda e: e["value"]))
    call = json_object({"arguments": arguments, "id": json_string(F.col("call_id")), "name": json_string(F.col("name"))})
    return out.withColumn("message", json_object({"call": call, "depth": F.coalesce(F.col("depth").cast("string"), F.lit("null")), "result": json_string(F.col("content")), "valid": F.col("valid").cast("string")}))
