"""Mixing sources to target weights: min-cost flow over membership patterns, then a seeded choice of documents.

Documents are summed by membership pattern (the set of sources they belong to).  Words flow from patterns to source
quotas; using a pattern's words for the first, second, third time costs 0, 1, 2 a word.  What a pattern gives is dealt
to its documents: every one the same number of times, and a seeded part of them once more.
"""

from __future__ import annotations

import json
from collections import deque
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dpmine.llm.common import WORD, row_key
from dpmine.session import materialize

MAX_REPEAT = 3         # a document is used that often at most
SEED = 42
BUCKETS = 1 << 16      # hash ranges of the seeded choice: only one of them per pattern is sorted
MAX_PATTERNS = 100_000
ROUNDS = 4             # passes in hash order; what they leave is filled by counts of sizes
PLACE = ("_bucket", "_hash", "_row_id", "_row_hash", "_copy")
_STEP = "struct<most:bigint,after:struct<{0}>,to:struct<{0}>>".format(
    "_bucket:bigint,_hash:bigint,_row_id:bigint,_row_hash:bigint,_copy:int")


def word_count(text: str | Column) -> Column:
    """Number of words; null: 0."""
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: dict, weights: dict, max_repeat: int = MAX_REPEAT) -> dict:
    """Share of all words by weight; what passes ``max_repeat`` times a source's size is shared again by weight."""
    total, open_, out = sum(sizes.values()), set(sizes), {}
    while open_:
        left, weight = total - sum(out.values()), sum(weights[s] for s in open_)
        share = {s: Fraction(left * weights[s]) / weight for s in open_}
        over = {s for s in open_ if share[s] > max_repeat * sizes[s]}
        if not over:
            return {s: float(v) for s, v in (out | share).items()}
        out |= {s: max_repeat * sizes[s] for s in over}
        open_ -= over
    return {s: float(v) for s, v in out.items()}


def route(words: dict, members: dict, quota: dict, max_repeat: int = MAX_REPEAT) -> dict:
    """Min-cost maximum flow: words each pattern gives to each source, ``{(pattern, source): n}``.

    All arcs of one repetition level cost the same, so augmenting along breadth-first shortest paths, level by level,
    takes the cheapest path each time; a path may take back what an earlier one gave.
    """
    given = {(p, s): 0 for p in words for s in members[p]}
    takers: dict = {}
    for p in words:
        for s in members[p]:
            takers.setdefault(s, []).append(p)
    need = dict(quota)
    for _ in range(max_repeat):
        spare = dict(words)
        while True:
            back: dict = {("p", p): None for p in spare if spare[p] > 0}
            queue, end = deque(back), None
            while queue and end is None:
                node = queue.popleft()
                if node[0] == "p":
                    for s in members[node[1]]:
                        if ("s", s) not in back:
                            back["s", s] = node
                            if need.get(s, 0) > 0:
                                end = ("s", s)
                                break
                            queue.append(("s", s))
                else:
                    for p in takers.get(node[1], ()):
                        if given[p, node[1]] > 0 and ("p", p) not in back:
                            back["p", p] = node
                            queue.append(("p", p))
            if end is None:
                break
            path = [end]
            while back[path[-1]] is not None:
                path.append(back[path[-1]])
            path.reverse()                                       # p, s, p, s, ...
            push = min(spare[path[0][1]], need[end[1]],
                       *(given[path[i + 1][1], path[i][1]] for i in range(1, len(path) - 1, 2)))
            for i in range(0, len(path) - 1):
                if i % 2 == 0:
                    given[path[i][1], path[i + 1][1]] += push
                else:
                    given[path[i + 1][1], path[i][1]] -= push
            spare[path[0][1]] -= push
            need[end[1]] -= push
    return given


def pattern(sources: Column) -> Column:
    """A membership set as text: its sources in order (null last) as a JSON array."""
    return F.coalesce(F.to_json(F.array_sort(F.array_distinct(sources))), F.lit("[]"))


def _place(bucket: Column | int, rest: int) -> Column:
    """The place in a bucket before (``rest`` -1) or after (1) all its documents."""
    end = F.lit(rest * ((1 << 63) - 1)).cast("long")
    return F.struct((F.lit(bucket) if isinstance(bucket, int) else bucket).cast("long").alias("_bucket"), end.alias("_hash"),
                    end.alias("_row_id"), end.alias("_row_hash"), F.lit(rest).cast("int").alias("_copy"))


def _forward(rows: DataFrame, plan: DataFrame, by: list[str]) -> DataFrame:
    """``*by, to, run``: the last place up to which documents after ``after`` fit into ``left`` words, and their words.

    Documents without words or of more than ``left`` are passed over; the first other one that does not fit ends the run.
    Sums by hash range find the range of that one, and only that range is sorted.  Groups without a fitting document have
    no row.
    """
    known = rows.join(F.broadcast(plan), by).filter((F.col("size") > 0) & (F.col("size") <= F.col("left")) & (F.col("pos") > F.col("after")))
    in_order = W.partitionBy(*by).orderBy("_bucket").rowsBetween(W.unboundedPreceding, 0)
    sums = known.groupBy(*by, "_bucket", "left").agg(F.sum("size").alias("n")).withColumn("upto", F.sum("n").over(in_order))
    full = F.col("upto") <= F.col("left")
    whole = materialize(sums.groupBy(*by).agg(F.max(F.when(full, F.col("_bucket"))).alias("last"), F.max(F.when(full, F.col("upto"))).alias("got"),
                                              F.min(F.when(~full, F.col("_bucket"))).alias("next")), "mix-cut")
    ranked = W.partitionBy(*by).orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    inside = (known.join(F.broadcast(whole), by).filter(F.col("_bucket") == F.col("next"))
              .withColumn("run", F.coalesce("got", F.lit(0)) + F.sum("size").over(ranked)).filter("run <= left")
              .groupBy(*by).agg(F.max("pos").alias("at"), F.max("run").alias("run")))
    ends = whole.join(F.broadcast(inside), by, "left").select(
        *by, F.coalesce("at", F.when(F.col("last").isNotNull(), _place(F.col("last"), 1))).alias("to"),
        F.coalesce("run", "got").alias("run"))
    return materialize(ends.filter("to is not null"), "mix-cut")


def mix(docs: DataFrame, sources: Column, key: str = "doc_id", text: str = "text", weights: dict | None = None,
        max_repeat: int = MAX_REPEAT, seed: int = SEED) -> DataFrame:
    """One row per input row: ``key, _row_id, _row_hash, _copy, members, size, times, taken``, and the plan's columns.

    ``sources`` is an array column of the sources a document belongs to (null is a source of its own, the last one;
    an empty or null array belongs to none and is not taken).  Without ``weights`` the sources in code point order weigh 1, 2,
    3, repeating.  ``source_size`` and ``target`` belong to the first member.  ``taken = times * size``; documents
    without words are taken no time.  Rows that are equal in id and text are told apart by ``_copy`` (from 1).
    Only the membership patterns and sources (at most ``MAX_PATTERNS``, else an error) reach the driver.
    """
    spark = docs.sparkSession
    a, b = row_key(key, text)
    rows = docs.select(docs[key].cast("long").alias("_key"), a, b, word_count(docs[text]).alias("size"),
                       pattern(sources).alias("members"))
    rows = rows.withColumn("_copy", F.row_number().over(W.partitionBy("_row_id", "_row_hash").orderBy("members")))
    rows = materialize(rows.withColumn("_hash", F.xxhash64(F.lit(seed), "_row_id", "_row_hash", "_copy")), "mix-rows")

    groups = rows.groupBy("members").agg(F.sum("size").alias("n")).limit(MAX_PATTERNS + 1).collect()
    if len(groups) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    words = {r["members"]: int(r["n"] or 0) for r in groups}
    members = {p: json.loads(p) for p in words}
    names = sorted({s for p in words for s in members[p]}, key=lambda s: (s is None, s or ""))
    sizes = {s: sum(n for p, n in words.items() if s in members[p]) for s in names}
    weights = weights or {s: i % 3 + 1 for i, s in enumerate(names)}
    if sum(words.values()) == 0:
        aim = {s: 0.0 for s in names}
    else:
        aim = targets(sizes, weights, max_repeat)
        if any(len(m) > 1 for m in members.values()):      # a word of several sources counts once in the whole
            scale = sum(n for p, n in words.items() if members[p]) / sum(sizes.values())
            aim = {s: v * scale for s, v in aim.items()}
    given = route(words, members, {s: round(v) for s, v in aim.items()}, max_repeat)
    plan = []
    for p, n in words.items():
        flow = sum(given[p, s] for s in members[p])
        whole = min(max_repeat, flow // n) if n else 0
        first = members[p][0] if members[p] else None
        plan.append((p, int(whole), int(flow - whole * n), sizes.get(first, 0), float(aim.get(first, 0.0))))
    plan_rows = spark.createDataFrame(plan, "members string, whole long, extra long, source_size long, target double")

    # the extra words of a pattern: documents in hash order as long as they fit; then those that still can fit, from there on
    rows = rows.withColumn("_bucket", F.pmod(F.shiftrightunsigned("_hash", 40), F.lit(BUCKETS))).withColumn("pos", F.struct(*PLACE))
    state = plan_rows.withColumns({"left": F.col("extra"), "after": _place(-1, -1), "steps": F.array().cast(f"array<{_STEP}>")})
    state = materialize(state, "mix-plan")                # a row per pattern
    for _ in range(ROUNDS):
        ends = _forward(rows, state.select("members", "left", "after"), ["members"])
        step = F.struct(F.col("left").alias("most"), "after", "to")
        state = materialize(state.join(F.broadcast(ends), "members", "left").select(
            *plan_rows.columns, (F.col("left") - F.coalesce("run", F.lit(0))).alias("left"),
            F.coalesce("to", "after").alias("after"),
            F.when(F.col("to").isNull(), F.col("steps")).otherwise(F.concat("steps", F.array(step))).alias("steps")), "mix-plan")
        if state.filter(F.col("left") * 100 > F.col("extra")).isEmpty():
            break
    # ... and what is still missing: of each size, largest first, as many documents as fit ...
    known = rows.filter("size > 0").join(F.broadcast(state), "members").withColumn(
        "in_run", F.exists("steps", lambda s: (F.col("size") <= s["most"]) & (F.col("pos") > s["after"]) & (F.col("pos") <= s["to"])))
    rest = known.filter(~F.col("in_run") & (F.col("size") < 2 * F.col("left")))
    fits = lambda acc, d: F.when(d["size"] <= acc["left"], F.struct(
        (acc["left"] - F.least(d["n"], F.floor(acc["left"] / d["size"])) * d["size"]).alias("left"),
        F.concat(acc["fit"], F.array(F.struct(d["size"].alias("size"), (F.least(d["n"], F.floor(acc["left"] / d["size"]))
                                                                        * d["size"]).alias("words")))).alias("fit"))).otherwise(acc)
    fill = (rest.filter("size <= left").groupBy("members", "size").agg(F.count("*").alias("n"))
            .groupBy("members").agg(F.sort_array(F.collect_list(F.struct("size", "n")), asc=False).alias("sizes"))
            .join(F.broadcast(state.select("members", "left", "after")), "members")
            .withColumn("fill", F.aggregate("sizes", F.struct("left", F.array().cast("array<struct<size:bigint,words:bigint>>").alias("fit")), fits)))
    fill = materialize(fill.select("members", F.col("fill.left").alias("short"), "after", "fill.fit"), "mix-fill")
    some = fill.select("members", "after", F.explode("fit").alias("f")).select("members", "f.size", F.col("f.words").alias("left"), "after")
    some = _forward(rows, some, ["members", "size"]).select("members", "size", F.col("to").alias("fill_to"))
    # ... and at last the smallest of the others if the sum is nearer with it than without
    rest = (rest.join(F.broadcast(some), ["members", "size"], "left").join(F.broadcast(fill.select("members", "short")), "members", "left")
            .filter(F.col("fill_to").isNull() | (F.col("pos") > F.col("fill_to"))))
    over = (rest.filter(F.col("size") < 2 * F.coalesce("short", "left")).groupBy("members")
            .agg(F.min(F.struct("size", "pos")).alias("over")).select("members", F.col("over.pos").alias("over")))
    more = known.select("members", "in_run", *rows.drop("members").columns, "whole", "source_size", "target", "after")
    more = (more.join(F.broadcast(some), ["members", "size"], "left").join(F.broadcast(over), "members", "left")
            .withColumn("one", F.col("in_run") | F.coalesce((F.col("pos") > F.col("after")) & (F.col("pos") <= F.col("fill_to")), F.lit(False))
                        | F.coalesce(F.col("pos") == F.col("over"), F.lit(False)))
            .withColumn("times", F.col("whole") + F.col("one").cast("int")))
    none = rows.filter("size = 0").join(F.broadcast(plan_rows), "members").withColumn("times", F.lit(0).cast("long"))
    out = more.unionByName(none, allowMissingColumns=True)
    return out.select(F.col("_key").alias(key), "_row_id", "_row_hash", "_copy", "members", "size", "source_size", "target",
                      F.col("times").cast("int").alias("times"), (F.col("times") * F.col("size")).cast("long").alias("taken"))


def take(docs: DataFrame, mixed: DataFrame, sources: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with each row as many times as ``mixed`` (:func:`mix` of the same rows and sources) says; columns unchanged."""
    a, b = row_key(key, text)
    marked = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), a, b, pattern(sources).alias("_members"))
    marked = marked.withColumn("_copy", F.row_number().over(W.partitionBy("_row_id", "_row_hash").orderBy("_members")))
    used = mixed.filter("times > 0").select("_row_id", "_row_hash", "_copy", "times")
    return (marked.join(used, ["_row_id", "_row_hash", "_copy"])
            .select("_row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("_row.*"))
