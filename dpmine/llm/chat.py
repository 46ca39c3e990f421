"""Chat formatting: tool calls linked to their results, ordered, validated and written as canonical JSON.

DataFrame operations only.  Calls and results meet in one hash join on (conversation, call id), after both sides were
reduced to a row per id.  Where every dependency of a conversation points to an earlier place, the places are a
topological order already, which one join of the dependencies with the calls shows; only the other conversations go
through rounds that settle the calls whose dependencies are settled.  Arguments are parsed as variants, so canonical
JSON (sorted keys, no white space) and the type checks need no string handling.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dpmine.session import materialize

#: JSON type -> pattern of the variant type that it allows.
TYPES = {"string": "STRING", "integer": "(TINYINT|SMALLINT|INT|BIGINT|DECIMAL\\(\\d+,0\\))", "number": "(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL.*)",
         "boolean": "BOOLEAN", "array": "ARRAY<.*", "object": "OBJECT<.*", "null": "VOID"}

SCHEMA_COLUMNS = "name string, fields array<struct<field:string,type:string,required:boolean>>, closed boolean"


def _errors(arguments: Column, parsed: Column, known: Column, fields: Column, closed: Column) -> Column:
    """What is wrong with a call's arguments, in the order of the schema's fields, then of the extra names."""
    is_object = F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))
    values = F.from_json(F.when(is_object, arguments), "map<string,variant>")
    names = F.coalesce(F.map_keys(values), F.array().cast("array<string>"))
    allowed = F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv])
    missing = F.transform(F.filter(fields, lambda f: f["required"] & ~F.array_contains(names, f["field"])),
                          lambda f: F.concat(F.lit("missing:"), f["field"]))
    wrong = F.transform(
        F.filter(fields, lambda f: F.array_contains(names, f["field"]) & ~F.coalesce(
            F.regexp_like(F.schema_of_variant(F.element_at(values, f["field"])), F.concat(F.lit("^"), allowed[f["type"]], F.lit("$"))),
            F.lit(False))),
        lambda f: F.concat(F.lit("type:"), f["field"]))
    extra = F.transform(F.array_sort(F.filter(names, lambda n: ~F.exists(fields, lambda f: f["field"] == n))),
                        lambda n: F.concat(F.lit("extra:"), n))
    return (F.when(~known, F.array(F.lit("unknown_tool"))).when(~is_object, F.array(F.lit("not_an_object")))
            .otherwise(F.concat(missing, wrong, F.when(closed, extra).otherwise(F.array().cast("array<string>")))))


def _levels(calls: DataFrame) -> DataFrame:
    """``conv_id, call_id, level``: places where they are a topological order, else rounds; null level: on a cycle.

    ``calls`` has ``conv_id, call_id, place, depends_on``; ids are unique in a conversation.  A dependency that isn't
    in the conversation binds nothing.
    """
    edges = calls.select("conv_id", "call_id", "place", F.explode("depends_on").alias("needs"))
    target = calls.select("conv_id", F.col("call_id").alias("needs"), F.col("place").alias("needs_place"))
    edges = materialize(edges.join(target, ["conv_id", "needs"]), "edges")
    late = edges.filter("needs_place is null or place is null or needs_place >= place").select("conv_id").distinct()
    late = materialize(late, "late")
    if late.isEmpty():
        return calls.select("conv_id", "call_id", F.col("place").alias("level"))
    done = calls.join(late, "conv_id", "left_anti").select("conv_id", "call_id", F.col("place").alias("level"))
    todo = materialize(calls.join(late, "conv_id", "left_semi").select("conv_id", "call_id"), "todo")
    open_edges = materialize(edges.join(late, "conv_id", "left_semi").select("conv_id", "call_id", "needs"), "edges")
    level = 0
    while True:
        ready = materialize(todo.join(open_edges.select("conv_id", "call_id").distinct(), ["conv_id", "call_id"], "left_anti")
                            .withColumn("level", F.lit(level).cast("long")), "ready")
        if ready.isEmpty():
            return done.union(todo.withColumn("level", F.lit(None).cast("long")))
        done = done.union(ready)
        todo = materialize(todo.join(ready, ["conv_id", "call_id"], "left_anti"), "todo")
        open_edges = materialize(open_edges.join(ready.select("conv_id", F.col("call_id").alias("needs")), ["conv_id", "needs"],
                                                 "left_anti").select("conv_id", "call_id", "needs"), "edges")
        level += 1


def format_tool_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row per different (conversation, call id) of either side.

    ``calls``: ``conv_id, call_id, place, name, arguments`` (JSON text), ``depends_on`` (ids); ``results``: ``conv_id,
    call_id, content``; ``schemas``: :data:`SCHEMA_COLUMNS`, one row a tool.  Gives ``conv_id, call_id, name, level``
    (topological: sort by level, place, id), ``place, n_calls, n_results, errors`` and ``json``, the canonical record.

    Of calls that share an id the least by (place, name, arguments) is kept and ``duplicate_call`` noted; of results
    the least content (``duplicate_result``).  ``no_result``, ``no_call``, ``cycle``, ``unknown_tool``,
    ``not_an_object``, ``missing:x``, ``type:x`` and ``extra:x`` are the other errors.  A null conversation or call id
    never links: such calls and results are rows of their own.  Null arguments are not an object; an empty table on
    either side only empties its part.
    """
    keyed = lambda df: df.filter(F.col("conv_id").isNotNull() & F.col("call_id").isNotNull())
    loose = lambda df: df.filter(F.col("conv_id").isNull() | F.col("call_id").isNull())
    fields = ["place", "name", "arguments", "depends_on"]
    ids = F.coalesce(F.array_sort(F.array_distinct(F.array_compact("depends_on"))), F.array().cast("array<string>"))
    calls = calls.select("conv_id", "call_id", F.col("place").cast("long").alias("place"), "name", "arguments", ids.alias("depends_on"))
    one = (keyed(calls).groupBy("conv_id", "call_id")
           .agg(F.min(F.struct(*fields)).alias("c"), F.count("*").alias("n_calls")).select("conv_id", "call_id", "c.*", "n_calls"))
    one = materialize(one, "calls")
    got = (keyed(results).groupBy("conv_id", "call_id")
           .agg(F.min("content").alias("content"), F.count("*").alias("n_results")))
    levels = _levels(one.select("conv_id", "call_id", "place", "depends_on"))
    linked = one.join(levels, ["conv_id", "call_id"]).join(got, ["conv_id", "call_id"], "full_outer")
    rest = loose(calls).withColumns({"n_calls": F.lit(1).cast("long"), "level": F.col("place")})
    linked = linked.unionByName(rest, allowMissingColumns=True).unionByName(
        loose(results).select("conv_id", "call_id", "content", F.lit(1).cast("long").alias("n_results")), allowMissingColumns=True)
    linked = linked.withColumns({"n_calls": F.coalesce("n_calls", F.lit(0).cast("long")),
                                 "n_results": F.coalesce("n_results", F.lit(0).cast("long"))})
    tools = schemas.select("name", "fields", "closed", F.lit(True).alias("known"))
    linked = linked.join(tools, "name", "left").withColumns({
        "parsed": F.try_parse_json("arguments"), "known": F.coalesce("known", F.lit(False)),
        "fields": F.coalesce("fields", F.array().cast("array<struct<field:string,type:string,required:boolean>>"))})
    note = lambda condition, name: F.when(condition, F.array(F.lit(name))).otherwise(F.array().cast("array<string>"))
    is_call = F.col("n_calls") > 0
    errors = F.concat(
        note(~is_call, "no_call"), note(F.col("n_results") == 0, "no_result"), note(F.col("n_calls") > 1, "duplicate_call"),
        note(F.col("n_results") > 1, "duplicate_result"), note(is_call & F.col("level").isNull() & F.col("place").isNotNull(), "cycle"),
        F.when(is_call, _errors(F.col("arguments"), F.col("parsed"), F.col("known"), F.col("fields"),
                                F.coalesce("closed", F.lit(False)))).otherwise(F.array().cast("array<string>")))
    linked = linked.withColumn("errors", errors)
    record = F.struct(  # keys in order
        F.col("parsed").alias("arguments"), "call_id", "conv_id",
        F.coalesce("depends_on", F.array().cast("array<string>")).alias("depends_on"), "errors", "level", "name",
        F.col("content").alias("result"))
    return linked.select("conv_id", "call_id", "name", "level", "place", "n_calls", "n_results", "errors",
                         F.to_json(record, {"ignoreNullFields": "false"}).alias("json"))


def calls_of_conversations(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of plain conversations (``conv_id, turn, role, text``).

    A user's turn is a call named by its place and length (``plan`` for the first turn, ``lookup`` up to 80 characters,
    else ``search``) with the text as its query, depending on the turn before the last; a turn of the assistant
    is the result of the turn before it; other roles take no part.
    """
    call_id = lambda turn: F.concat(F.lit("call_"), F.col("conv_id").cast("string"), F.lit("_"), turn.cast("string"))
    turn = F.col("turn").cast("long")
    name = F.when(turn == 0, "plan").when(F.length("text") <= 80, "lookup").otherwise("search")
    calls = turns.filter("role = 'user'").select(
        "conv_id", call_id(turn).alias("call_id"), turn.alias("place"), name.alias("name"),
        F.to_json(F.struct(turn.alias("turn"), F.col("text").alias("query"), F.when(turn >= 2, call_id(turn - 2)).alias("after"))
                  ).alias("arguments"),
        F.when(turn >= 2, F.array(call_id(turn - 2))).otherwise(F.array().cast("array<string>")).alias("depends_on"))
    results = turns.filter("role = 'assistant'").select("conv_id", call_id(turn - 1).alias("call_id"), F.col("text").alias("content"))
    return calls, results
