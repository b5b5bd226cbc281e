"""Chat formatting with tool-call linking, in DataFrame functions only.

Conversations are rows (conversation, turn, role, text). Calls are written in a text as
`<tool_call>{"id", "name", "arguments", "after"}</tool_call>`, results as the JSON text of a turn with
role `tool` and a `tool_call_id`, tools as `<tools>[{"name", "parameters"}]</tools>` of a system turn.
Calls and results are joined on (conversation, identifier). The topological order puts a result after
its call and a call after the results of the calls that it names in `after`: each message has a
`place` (the largest turn among itself and all that it waits for) and a `depth` (the most steps that it
waits for a message of that turn); sorted by place, depth, turn a conversation is in order. Both come
from rounds in which a message hears from what it waits for and from the message that its present place
comes from, so paths double with each round; rounds go on until nothing moves. More steps than a
conversation has waiting messages are possible on a circle only: that is how circles are found.
Arguments are validated against the tool's schema (unknown and missing names, types, enumerations; in
nested objects and arrays too, a level of all arguments at a time). A message is serialised as canonical
JSON: keys sorted, no white space.

A result row is a message, so a conversation of any length is never gathered; messages without calls,
results or tools pass by every join, and only those that wait or are waited for take part in rounds.
Defined results: null texts are empty content; null roles are null; calls that aren't JSON objects with
an id count as malformed and stay in the content; arguments that no canonical form is known of (repeated
keys, nesting beyond the parser's limit) are kept as a JSON string and count as malformed and invalid; an
identifier used by several calls is linked to the first of them by turn and counted as repeated; results
without a call are orphans; what waits in a circle, or is put after one by waiting for it, is cyclic and
keeps its own turn as place; repeated rows are repeated messages; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import forgotten, written

CALL = r"(?s)<tool_call>(.*?)</tool_call>"
TOOLS = r"(?s)<tools>(.*?)</tools>"
_CALL_TYPE = "id string, name string, arguments variant, after array<string>"
_TOOL_TYPE = "array<struct<name: string, parameters: variant>>"
#: JSON schema types and how the types of parsed values begin.
TYPES = {"string": "STRING", "integer": r"BIGINT|DECIMAL\([0-9]+,0\)", "number": "BIGINT|DECIMAL|DOUBLE|FLOAT", "boolean": "BOOLEAN", "object": "OBJECT", "array": "ARRAY", "null": "VOID"}


def messages(turns: DataFrame, *, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), text.alias("text"))
    special = (F.coalesce(F.col("role") == "tool", F.lit(False)) | F.col("text").contains("<tool_call>") | F.col("text").contains("<tools>")).alias("special")
    return rows.select("*", special)


def canonical(role: Column, turn: Column, conv: Column, content: Column, calls: Column | None = None, call_id: Column | None = None) -> Column:
    """One object, keys in order; absent members are left out."""
    members = [content.alias("content"), conv.alias("conv_id"), role.alias("role")]
    members += [call_id.alias("tool_call_id")] if call_id is not None else []
    members += [calls.alias("tool_calls")] if calls is not None else []
    return F.to_json(F.struct(*members, turn.alias("turn")))


def argument_faults(given: DataFrame) -> DataFrame:
    """(row, part, faults) of given (row, part, schema, value; JSON texts): how many names are unknown or missing and how many values of a wrong type or outside their enumeration, at any depth."""
    form = F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair])
    no_names = F.expr("cast(array() as array<string>)")
    level, found = given, []
    while True:
        s, v = F.try_parse_json("schema"), F.try_parse_json("value")
        one = level.select("row", "part", s.alias("s"), v.alias("v"), F.schema_of_variant(v).alias("kind"))
        member = lambda name, kind: F.try_variant_get("s", f"$.{name}", kind)
        parsed = one.select(
            "row", "part", "v", "kind", F.coalesce(F.when(member("type", "string").startswith("["), member("type", "array<string>")), F.array(member("type", "string"))).alias("types"), member("enum", "array<variant>").alias("allowed"),
            F.from_json(F.to_json(member("properties", "variant")), "map<string, variant>").alias("known"), F.coalesce(member("required", "array<string>"), no_names).alias("required"),
            F.coalesce(F.to_json(member("additionalProperties", "variant")), F.lit("false")).alias("others"), F.to_json(member("items", "variant")).alias("items"),
            F.when(F.col("kind").startswith("OBJECT"), F.from_json(F.to_json("v"), "map<string, variant>")).alias("members"), F.when(F.col("kind").startswith("ARRAY"), F.try_variant_get("v", "$", "array<variant>")).alias("elements"),
        )
        forms = F.filter(F.transform("types", lambda t: F.try_element_at(form, t)), lambda t: t.isNotNull())
        wrong = (F.size(forms) > 0) & ~F.exists(forms, lambda t: F.rlike(F.col("kind"), F.concat(F.lit("^("), t, F.lit(")"))))
        outside = F.col("allowed").isNotNull() & ~F.exists("allowed", lambda a: F.to_json(a) == F.to_json("v"))
        names, known = F.map_keys("members"), F.map_keys("known")
        unknown = F.when(F.col("known").isNotNull() & (F.col("others") == "false"), F.size(F.array_except(names, known)))
        missing = F.size(F.array_except("required", names))
        number = lambda c: F.coalesce(c.cast("int"), F.lit(0))
        faults = number(wrong) + number(outside) + F.when(F.col("members").isNotNull(), number(unknown) + number(missing)).otherwise(F.lit(0))
        empty = F.expr("cast(array() as array<struct<schema: string, value: string>>)")
        below = F.transform(F.filter(F.map_entries("members"), lambda e: F.map_contains_key("known", e["key"])), lambda e: F.struct(F.to_json(F.try_element_at("known", e["key"])).alias("schema"), F.to_json(e["value"]).alias("value")))
        each = F.when(F.col("items").isNotNull(), F.transform("elements", lambda x: F.struct(F.col("items").alias("schema"), F.to_json(x).alias("value"))))
        made = written(parsed.select("row", "part", faults.alias("faults"), F.concat(F.coalesce(F.when(F.col("known").isNotNull(), below), empty), F.coalesce(each, empty)).alias("below")))
        found.append(made.select("row", "part", "faults"))
        level = made.select("row", "part", F.explode("below").alias("x")).select("row", "part", "x.schema", "x.value")
        if level.isEmpty():
            every = found[0]
            for f in found[1:]:
                every = every.unionByName(f)
            return every.groupBy("row", "part").agg(F.sum("faults").alias("faults"))


def places(rows: DataFrame, waits: DataFrame) -> DataFrame:
    """(row, place, depth, cyclic) of the rows (row, conv_id, turn) that wait or are waited for; waits: (late, early)."""
    takes_part = waits.select(F.col("late").alias("row")).unionByName(waits.select("early").withColumnRenamed("early", "row")).distinct()
    some = written(rows.select("row", "conv_id", "turn").join(takes_part, "row"))
    most = some.groupBy(F.col("conv_id").alias("m_conv")).agg(F.count(F.lit(1)).alias("most"))
    now = written(some.join(most, F.col("conv_id").eqNullSafe(F.col("m_conv"))).select("row", "turn", "most", F.col("turn").alias("place"), F.lit(0).cast("long").alias("depth"), F.col("row").alias("source"), F.lit(False).alias("moved")))
    forgotten(some)
    while True:
        heard = waits.join(now.select(F.col("row").alias("early"), "place", (F.col("depth") + 1).alias("depth"), "source"), "early").select(F.col("late").alias("row"), "place", "depth", "source")
        # The message that the place comes from may have heard of a later one itself.
        through = now.where("source <> row").select("row", "source", F.col("depth").alias("steps")).join(now.select(F.col("row").alias("source"), "place", "depth", F.col("source").alias("next")), "source")
        heard = heard.unionByName(through.select("row", "place", (F.col("depth") + F.col("steps")).alias("depth"), F.col("next").alias("source")))
        best = heard.groupBy(F.col("row").alias("b_row")).agg(F.max(F.struct("place", "depth", "source")).alias("b"))
        moves = F.col("b").isNotNull() & (F.col("depth") <= F.col("most")) & (F.struct("b.place", "b.depth") > F.struct("place", "depth"))
        both = now.drop("moved").join(best, F.col("row") == F.col("b_row"), "left").withColumn("moves", F.coalesce(moves, F.lit(False)))
        later = written(both.select("row", "turn", "most", *(F.when(F.col("moves"), F.col(f"b.{c}")).otherwise(F.col(c)).alias(c) for c in ("place", "depth", "source")), F.col("moves").alias("moved")))
        forgotten(now)
        now = later
        if now.where("moved").isEmpty():
            cyclic = F.col("depth") > F.col("most")
            return now.select("row", F.when(cyclic, F.col("turn")).otherwise(F.col("place")).alias("place"), F.when(cyclic, F.lit(0)).otherwise(F.col("depth")).alias("depth"), cyclic.alias("cyclic"))


def link_calls(special: DataFrame) -> DataFrame:
    """The messages with calls, results or tools, linked, placed and checked."""
    rows = special.withColumn("row", F.monotonically_increasing_id())


    def with_arguments(p: Column) -> Column:
        """The source may hold arguments that the parser gives up; they are kept as text."""
        ident, name = (F.coalesce(p["call"][c], F.get_json_object(p["source"], f"$.{c}")) for c in ("id", "name"))
        raw = F.when(p["call"]["arguments"].isNull(), F.get_json_object(p["source"], "$.arguments"))
        call = F.struct(ident.alias("id"), name.alias("name"), F.coalesce(p["call"]["arguments"], raw.cast("variant")).alias("arguments"), p["call"]["after"].alias("after"), raw.isNotNull().alias("lost"))
        return F.struct(p["source"].alias("source"), call.alias("call"))

    parsed = F.transform(F.regexp_extract_all("text", F.lit(CALL), F.lit(1)), lambda x: F.struct(x.alias("source"), F.from_json(x, _CALL_TYPE).alias("call")))
    good = F.when(F.coalesce(F.col("role") != "tool", F.lit(True)), F.filter(F.transform(parsed, with_arguments), lambda p: p["call"]["id"].isNotNull()))
    answer = F.when(F.col("role") == "tool", F.from_json("text", "tool_call_id string, content variant"))
    tools = F.when(F.col("role") == "system", F.flatten(F.transform(F.regexp_extract_all("text", F.lit(TOOLS), F.lit(1)), lambda x: F.coalesce(F.from_json(x, _TOOL_TYPE), F.from_json(F.lit("[]"), _TOOL_TYPE)))))
    rows = written(rows.select("*", F.coalesce(F.size(parsed), F.lit(0)).alias("n_marked"), F.transform(good, lambda p: p["call"]).alias("calls"), answer["tool_call_id"].alias("answers"), tools.alias("tools")))
    calls = written(rows.select("row", "conv_id", "turn", F.posexplode("calls").alias("part", "call")).select("row", "conv_id", "turn", "part", F.col("call.id").alias("id"), F.col("call.name").alias("name"), F.to_json("call.arguments").alias("arguments"), F.col("call.after").alias("after"), F.col("call.lost").alias("lost")))
    first = calls.groupBy("conv_id", "id").agg(F.min(F.struct("turn", "row", "part")).alias("of"), F.count(F.lit(1)).alias("uses"))
    first = written(first.select(F.col("conv_id").alias("f_conv"), F.col("id").alias("f_id"), F.col("of.row").alias("f_row"), "uses"))
    same_call = lambda conv, ident: F.col(conv).eqNullSafe(F.col("f_conv")) & (F.col(ident) == F.col("f_id"))
    answered = rows.where(F.col("answers").isNotNull()).select("row", "conv_id", "answers").join(first, same_call("conv_id", "answers"), "left")
    linked = written(answered.select("row", F.col("f_row").alias("call_row"), "conv_id", "answers"))
    # What waits for what, by message: a result for its call, a call for the results of the calls that it names.
    named = calls.select(F.col("row").alias("late"), "conv_id", F.explode("after").alias("needs"))
    results = linked.where(F.col("call_row").isNotNull())
    waits = results.select(F.col("row").alias("late"), F.col("call_row").alias("early"))
    waits = written(waits.unionByName(named.join(results.select(F.col("conv_id").alias("r_conv"), F.col("answers").alias("r_id"), F.col("row").alias("early")), F.col("conv_id").eqNullSafe(F.col("r_conv")) & (F.col("needs") == F.col("r_id"))).select("late", "early")).distinct())
    placed = places(rows, waits).withColumnsRenamed({"place": "p_place", "depth": "p_depth"})
    # A tool's schema holds for its conversation; of several of one name, the first turn's.
    schemas = rows.select("conv_id", "turn", F.explode("tools").alias("tool")).select("conv_id", "turn", F.col("tool.name").alias("tool_name"), F.coalesce(F.to_json("tool.parameters"), F.lit("{}")).alias("schema"))
    schemas = written(schemas.groupBy(F.col("conv_id").alias("s_conv"), "tool_name").agg(F.min(F.struct("turn", "schema"))["schema"].alias("schema")))
    ruled = written(calls.join(schemas, F.col("conv_id").eqNullSafe(F.col("s_conv")) & (F.col("name") == F.col("tool_name")), "left"))
    faults = argument_faults(ruled.where("schema is not null").select("row", "part", "schema", F.coalesce("arguments", F.lit("{}")).alias("value")))
    checked = ruled.join(faults, ["row", "part"], "left").join(first.select("f_conv", "f_id", "uses"), same_call("conv_id", "id"), "left")
    checked = checked.join(linked.where("call_row is not null").select(F.col("conv_id").alias("l_conv"), F.col("answers").alias("l_id")).distinct(), F.col("conv_id").eqNullSafe(F.col("l_conv")) & (F.col("id") == F.col("l_id")), "left")
    per_message = checked.groupBy("row").agg(
        F.sum(F.when(F.col("l_id").isNotNull(), 1).otherwise(0)).alias("n_linked"),
        F.sum(F.when(F.col("uses") > 1, 1).otherwise(0)).alias("n_repeated"),
        F.sum(F.when(F.col("schema").isNull() | F.col("lost") | (F.coalesce("faults", F.lit(0)) > 0), 1).otherwise(0)).alias("n_invalid"),
        F.sum(F.col("lost").cast("int")).alias("n_lost"),
    )
    out = rows.join(placed, "row", "left").join(per_message, "row", "left").join(linked.select("row", "call_row"), "row", "left")
    listed = F.transform("calls", lambda c: F.struct(c["arguments"].alias("arguments"), c["id"].alias("id"), c["name"].alias("name")))
    bare = F.trim(F.regexp_replace("text", CALL, ""))
    json = (
        F.when(F.col("answers").isNotNull(), canonical(F.col("role"), F.col("turn"), F.col("conv_id"), F.to_json(F.from_json("text", "content variant")["content"]), call_id=F.col("answers")))
        .when(F.size("calls") > 0, canonical(F.col("role"), F.col("turn"), F.col("conv_id"), bare, calls=listed))
        .otherwise(canonical(F.col("role"), F.col("turn"), F.col("conv_id"), F.col("text")))
    )
    n_calls = F.coalesce(F.size("calls"), F.lit(0))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select(
        "conv_id", "turn", "role", F.coalesce("p_place", "turn").cast("long").alias("place"), F.coalesce("p_depth", F.lit(0)).cast("long").alias("depth"),
        n_calls.cast("long").alias("n_calls"), zero("n_linked"), zero("n_repeated"), zero("n_invalid"),
        F.when(F.coalesce(F.col("role") == "tool", F.lit(False)), F.lit(0)).otherwise(F.col("n_marked") - n_calls + F.coalesce("n_lost", F.lit(0))).cast("long").alias("n_malformed"),
        (F.coalesce(F.col("role") == "tool", F.lit(False)) & F.col("call_row").isNull()).alias("orphan"), F.coalesce("cyclic", F.lit(False)).alias("cyclic"), json.alias("json"),
    )


def format_conversations(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row a message: conv_id, turn, role, place, depth, n_calls, n_linked, n_repeated, n_invalid, n_malformed, orphan, cyclic, json."""
    rows = messages(turns, conv_col=conv_col, turn_col=turn_col, role_col=role_col, text_col=text_col)
    nothing = F.lit(0).cast("long")
    plain = rows.where(~F.col("special")).select(
        "conv_id", "turn", "role", F.col("turn").cast("long").alias("place"), nothing.alias("depth"),
        *(nothing.alias(c) for c in ("n_calls", "n_linked", "n_repeated", "n_invalid", "n_malformed")), F.lit(False).alias("orphan"), F.lit(False).alias("cyclic"),
        canonical(F.col("role"), F.col("turn"), F.col("conv_id"), F.col("text")).alias("json"),
    )
    return plain.unionByName(link_calls(rows.where("special").drop("special")))
