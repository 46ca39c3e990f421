"""Readers and writers of the pipeline's file formats.

All readers declare their schema (no inference) and validate with
``raise_error`` expressions, so a malformed line fails the job where it is
read instead of a driver-side loop.  Writers keep Spark's partitioned output;
an ordered run is a range-partitioned sort whose part files concatenate in
order, never a single task.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dpmine.operators.groups import explode_groups, to_nested
from dpmine.operators.ordinal import line_ordinals
from dpmine.sources.commits import delete, exists, rename

# fixed values: characters Python's str.strip() removes
PY_SPACE = r"[\t\n\x0B\f\r\x1C-\x1F\x85\p{Z}]"

SIDE = T.StructType([T.StructField("doc_id", T.ArrayType(T.LongType())),
                     T.StructField("score", T.ArrayType(T.DoubleType()))])
GROUP_SCHEMA = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("query", T.StringType()),
                             T.StructField("positives", SIDE), T.StructField("negatives", SIDE)])


def _strip(col):
    return F.regexp_replace(col, f"^{PY_SPACE}+|{PY_SPACE}+$", "")


def _line_key():
    """Orders rows by their place in the input: file name, block offset, position in the task."""
    return F.struct(F.input_file_name().alias("f"), F.input_file_block_start().alias("b"),
                    F.monotonically_increasing_id().alias("m"))


def _keep_last(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Per key, the columns of the row read last (a dict-style overwrite) — one aggregation, no sort."""
    g = df.groupBy(*keys).agg(*[F.max_by(c, "_line").alias(c) for c in cols])
    return g


def _fail_unless(ok, message: str, value):
    """Column that is ``value`` when ``ok`` holds, else fails the task with ``message``."""
    return F.when(ok, value).otherwise(F.raise_error(F.concat(F.lit(message + ": "), F.col("value"))))


# ---------------------------------------------------------------- corpus
def read_corpus(spark: SparkSession, path: str, id_col: str | None = None) -> DataFrame:
    """JSON lines (optionally gzip) → ``pid, title, contents``.

    With ``id_col`` the id is read from the data.  Otherwise ``pid`` is the
    line ordinal over the files in name order (blank lines don't count), from
    ``line_ordinals``: a counting pass over the input splits, no sort and no
    exchange of the text.  gzip files are not splittable (one task per file);
    spread them with a ``repartition`` where the next step does not shuffle
    anyway.
    """
    schema = "title string, contents string"
    if id_col:
        df = spark.read.schema(f"{schema}, {id_col} long").json(path)
        return df.select(F.col(id_col).alias("pid"), "title", "contents")
    lines = line_ordinals(spark, path, "pid")
    return lines.select("pid", F.from_json("value", schema).alias("row")).select("pid", "row.title", "row.contents")


def save_bucketed_corpus(corpus: DataFrame, table: str, path: str, buckets: int) -> DataFrame:
    """Store the corpus once as a table bucketed and sorted by ``pid`` (files under ``path``).

    Every later lookup (training tables per epoch, scoring per round) joins
    on ``pid`` against it without shuffling the corpus again: only the id side
    is exchanged, into the table's buckets.
    """
    (corpus.select("pid", "title", "contents").write.mode("overwrite").bucketBy(buckets, "pid").sortBy("pid")
     .option("path", path).saveAsTable(table))
    return corpus.sparkSession.table(table)


def write_corpus(corpus: DataFrame, path: str, order: str = "pid", compression: str = "gzip") -> None:
    """``title, contents`` as JSON lines in ``order`` (part files concatenate in order)."""
    corpus.orderBy(order).select("title", "contents").write.mode("errorifexists").option(
        "compression", compression).json(path)


# ---------------------------------------------------------------- queries
def read_queries(spark: SparkSession, path: str, keep: str = "all") -> DataFrame:
    """TSV ``qid \\t query`` lines (no header, no quoting) → ``qid, query``; a line must have two fields.

    ``keep="last"``: a repeated qid keeps the text of its last line (the
    reference reads queries into a dict).
    """
    lines = spark.read.text(path).select(_strip(F.col("value")).alias("value"), _line_key().alias("_line"))
    parts = F.split(F.col("value"), "\t")
    checked = lines.select("_line", _fail_unless(F.size(parts) == 2, "query line needs two tab fields", parts)
                           .alias("p"))
    out = checked.select(F.col("p")[0].cast("long").alias("qid"), F.col("p")[1].alias("query"), "_line")
    if keep == "last":
        return _keep_last(out, ["qid"], ["query"])
    return out.drop("_line")


def write_queries(queries: DataFrame, path: str) -> None:
    """TSV ``qid \\t query``; a text with a tab or a line break fails the write (the format cannot hold it)."""
    ok = ~F.col("query").rlike("[\t\r\n]")
    line = F.when(ok, F.concat_ws("\t", F.col("qid").cast("string"), F.col("query"))).otherwise(
        F.raise_error(F.concat(F.lit("query text holds a tab or line break: qid "), F.col("qid").cast("string"))))
    queries.orderBy("qid").select(line.alias("value")).write.mode("errorifexists").text(path)


def duplicate_qids(queries: DataFrame) -> DataFrame:
    return queries.groupBy("qid").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


# ---------------------------------------------------------------- qrels
def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """Whitespace-separated ``qid iter pid rel`` → ``qid, pid, rel, line`` (``rel`` parsed, not used by default).

    ``line`` orders the judgements as in the file; ``hard_negatives(qrels_order="line")`` keeps that order, which
    decides which positives survive a later cap.
    """
    lines = spark.read.text(path).select(_strip(F.col("value")).alias("value"), _line_key().alias("line"))
    parts = F.split(F.col("value"), r"\s+")
    checked = lines.select("line", _fail_unless(F.size(parts) == 4, "qrels line needs four fields", parts).alias("p"))
    return checked.select(F.col("p")[0].cast("long").alias("qid"), F.col("p")[2].cast("long").alias("pid"),
                          F.col("p")[3].cast("int").alias("rel"), "line")


def write_qrels(qrels: DataFrame, path: str) -> None:
    line = F.concat_ws("\t", F.col("qid").cast("string"), F.lit("0"), F.col("pid").cast("string"),
                       F.col("rel").cast("string"))
    qrels.select(line.alias("value")).write.mode("errorifexists").text(path)


# ---------------------------------------------------------------- runs
RUN_SCHEMA = "qid long, pid long, rank int"


def read_run(spark: SparkSession, path: str, max_rank: int = 1000, over: str = "skip", keep: str = "all") -> DataFrame:
    """TSV ``qid \\t pid \\t rank`` → ``qid, pid, rank``.

    Ranks below 1 fail.  Ranks above ``max_rank`` are skipped
    (``over="skip"``, the mining reader) or fail (``over="error"``, the
    evaluation reader).  ``keep="last"``: a repeated ``(qid, rank)`` keeps
    the pid of its last line (the reference's array-slot overwrite).
    """
    lines = spark.read.text(path).select(_strip(F.col("value")).alias("value"), _line_key().alias("_line"))
    parts = F.split(F.col("value"), r"\s+")
    checked = lines.select("value", "_line",
                           _fail_unless(F.size(parts) == 3, "run line needs three fields", parts).alias("p"))
    run = checked.select("value", "_line", F.col("p")[0].cast("long").alias("qid"),
                         F.col("p")[1].cast("long").alias("pid"), F.col("p")[2].cast("int").alias("rank"))
    limit = F.lit(max_rank)
    ok = (F.col("rank") >= 1) & ((F.col("rank") <= limit) | F.lit(over == "skip"))
    run = run.select("qid", "pid", "_line", _fail_unless(ok, "run rank out of range", F.col("rank")).alias("rank"))
    run = run.filter(F.col("rank") <= limit)
    if keep == "last":
        return _keep_last(run, ["qid", "rank"], ["pid"]).select("qid", "pid", "rank")
    return run.select("qid", "pid", "rank")


def run_conflicts(run: DataFrame) -> DataFrame:
    """``(qid, rank)`` given more than once (the file reader would keep the last line)."""
    return run.groupBy("qid", "rank").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def write_run(run: DataFrame, path: str, ordered: bool = True) -> None:
    """TSV ``qid \\t pid \\t rank``; ``ordered`` sorts by ``qid, rank`` across part files (range partitioned)."""
    out = run.select("qid", "pid", "rank")
    if ordered:
        out = out.orderBy("qid", "rank")
    out.write.mode("errorifexists").option("sep", "\t").csv(path)


# ---------------------------------------------------------------- groups
def read_groups(spark: SparkSession, path: str) -> DataFrame:
    """Training-group JSON lines → nested ``qid, query, positives, negatives``."""
    df = spark.read.schema(GROUP_SCHEMA).json(path)
    return df.select(F.col("query_id").alias("qid"), "query", "positives", "negatives")


def read_groups_long(spark: SparkSession, path: str) -> DataFrame:
    return explode_groups(read_groups(spark, path))


def write_groups(long: DataFrame, queries: DataFrame | None, path: str) -> None:
    """Long groups → one JSON object per query, lists in ``pos`` order."""
    nested = to_nested(long, queries)
    cols = [F.col("qid").alias("query_id")] + (["query"] if queries is not None else []) + ["positives", "negatives"]
    nested.select(*cols).write.mode("errorifexists").json(path)


def save_bucketed_groups(long: DataFrame, table: str, path: str, buckets: int) -> DataFrame:
    """Store long groups once as a table bucketed and sorted by ``qid`` (files under ``path``).

    Every epoch's draw (``assemble_groups`` with another ``epoch``) then reads the buckets as they are: drawing needs a
    query's rows together, and they are, so no epoch shuffles the groups again.
    """
    rows = long.select("qid", "role", "pos", "pid", "score").repartition(buckets, "qid")
    rows.write.mode("overwrite").bucketBy(buckets, "qid").sortBy("qid").option("path", path).saveAsTable(table)
    return long.sparkSession.table(table)


# ---------------------------------------------------------------- embeddings and scores
def write_embeddings(vectors: DataFrame, path: str, id_col: str = "id", vec_col: str = "vec") -> None:
    vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec")) \
        .write.mode("errorifexists").parquet(path)


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id long, vec array<double>").parquet(path)


# ---------------------------------------------------------------- stages
def fingerprint(df: DataFrame) -> str:
    """What a frame reads: its plan and the path, size and time of every file under it.

    Equal for equal plans over unchanged files, also in another session.  Of rows that come from the driver only the plan
    is known, not what they hold.
    """
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    seen = []
    for name in sorted(df.inputFiles()):
        path = jvm.org.apache.hadoop.fs.Path(name)
        status = path.getFileSystem(conf).getFileStatus(path)
        seen.append([name, status.getLen(), status.getModificationTime()])
    plan = re.sub(r"#\d+L?|\[id=[^]]*\]|0x[0-9a-f]+|@[0-9a-f]+", "", df._jdf.queryExecution().optimizedPlan().toString())
    return hashlib.sha1(json.dumps([plan, seen]).encode()).hexdigest()[:16]


class Stage:
    """A stage output written once under ``root/name-<params hash>`` and reused while it exists.

    ``get(build)`` reads the stored table when it is there, else writes ``build()`` as parquet beside it and publishes it
    by one rename, so a table that is there is whole.  A parameter, an input file (path, size, time) or an input's plan
    that changes makes another folder: a stale output is never picked up.  ``inputs`` are frames; what a stage stored is
    an input like any other, and as it is written once, a chain of stages is keyed from end to end.
    """

    def __init__(self, spark: SparkSession, root: str, name: str, params: dict | None = None, inputs: list[DataFrame] = ()):
        keyed = {**(params or {}), **({"inputs": [fingerprint(df) for df in inputs]} if inputs else {})}
        digest = hashlib.sha1(json.dumps(keyed, sort_keys=True, default=str).encode()).hexdigest()[:10]
        self.spark, self.path = spark, f"{root.rstrip('/')}/{name}-{digest}"

    def exists(self) -> bool:
        return exists(self.spark, self.path + "/_SUCCESS")

    def get(self, build) -> DataFrame:
        if not self.exists():
            held = f"{self.path}.{uuid.uuid4().hex[:12]}.tmp"
            build().write.parquet(held)
            delete(self.spark, self.path)                   # whole folders only: this one has no _SUCCESS
            if not rename(self.spark, held, self.path):     # another writer was first
                delete(self.spark, held)
        return self.spark.read.parquet(self.path)
