"""Row ordinals, head samples and batches.

The sorted frame is written once; every row keeps the place (sorted partition,
row in it) at which it was written.  Counts per partition become offsets, and
the rows are numbered from the stored place, so a second read of the frame can
never see other partition bounds.  Never a global, un-partitioned window over
rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dpmine.session import materialize

_LOW_BITS = 33  # monotonically_increasing_id: partition index << 33 | row index


def _placed(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` sorted and stored, with its stored place in ``_part`` and ``_idx``."""
    s = materialize(df.orderBy(*order).withColumn("_mid", F.monotonically_increasing_id()), "sorted")
    return s.withColumn("_part", F.shiftright("_mid", _LOW_BITS)).withColumn(
        "_idx", F.col("_mid").bitwiseAND(F.lit((1 << _LOW_BITS) - 1)))


def with_ordinal(df: DataFrame, order_cols: list[str], name: str = "ordinal", total: str | None = None) -> DataFrame:
    """Add a dense 0-based ``ordinal`` in the order of ``order_cols`` (must be a total order).

    ``total`` also adds the row count as a column (taken from the same
    per-partition counts, so it costs nothing extra).
    """
    s = _placed(df, order_cols)
    counts = s.groupBy("_part").agg(F.count(F.lit(1)).alias("_cnt"))     # a row per sorted partition
    offsets = counts.select("_part", (F.sum("_cnt").over(Window.orderBy("_part").rowsBetween(
        Window.unboundedPreceding, -1))).alias("_off"), F.sum("_cnt").over(Window.partitionBy()).alias("_all"))
    out = s.join(F.broadcast(offsets), "_part").withColumn(
        name, (F.coalesce(F.col("_off"), F.lit(0)) + F.col("_idx")).cast("long"))
    if total:
        out = out.withColumn(total, F.col("_all").cast("long"))
    return out.drop("_mid", "_part", "_idx", "_off", "_all")


MOST_SPLITS = 4_000_000     # whose offsets are broadcast (about 100 bytes each)


def line_ordinals(spark: SparkSession, path: str, name: str = "ordinal") -> DataFrame:
    """``value`` and the 0-based ordinal of every line that is not blank, over the files in name order.

    The text is never sorted or exchanged.  A first pass counts the lines of each input split (file and block start) and
    notes the row number at which the split begins in its task; running sums of the counts are the splits' offsets, and
    a row's ordinal is its split's offset and its distance from there.  Both passes read the same splits; where they
    differ (a setting that cuts the input was changed between the two) rows fail instead of getting another number.
    """
    lines = spark.read.text(path).filter(F.trim("value") != "").select(
        "value", F.xxhash64(F.input_file_name()).alias("_file"), F.input_file_block_start().alias("_block"),
        F.spark_partition_id().alias("_task"), F.monotonically_increasing_id().alias("_mid"), F.input_file_name().alias("_name"))
    splits = materialize(lines.groupBy("_task", "_file", "_block").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first"), F.min("_name").alias("_name")), "splits")
    if splits.count() > MOST_SPLITS:
        raise ValueError(f"more than {MOST_SPLITS} input splits: read with a larger spark.sql.files.maxPartitionBytes")
    before = Window.orderBy("_name", "_block").rowsBetween(Window.unboundedPreceding, -1)       # a row a split
    offsets = splits.select("_task", "_file", "_block", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    numbered = lines.drop("_name").join(F.broadcast(offsets), ["_task", "_file", "_block"], "left")
    place = F.when(F.col("_first").isNull() | (F.col("_mid") < F.col("_first")), F.raise_error(F.lit(
        "the input's splits changed between counting and reading")).cast("long")).otherwise(F.col("_off") + F.col("_mid") - F.col("_first"))
    return numbered.select("value", place.cast("long").alias(name))


def head_sample(df: DataFrame, n: int, order_cols: list[str]) -> DataFrame:
    """The first ``n`` rows in ``order_cols`` order (a top-n, not a full sort)."""
    return df.orderBy(*order_cols).limit(n)


def batches(df: DataFrame, size: int, order_cols: list[str], name: str = "batch") -> DataFrame:
    """Consecutive batches of ``size`` rows in order (the last one may be short)."""
    return with_ordinal(df, order_cols).withColumn(name, F.floor(F.col("ordinal") / size).cast("long"))


def ordinal_within(df: DataFrame, key: str, order_cols: list[str], name: str = "pos") -> DataFrame:
    """0-based position of each row inside its ``key`` group, in ``order_cols`` order (a total order).

    Safe for hot keys: the range-partitioned sort on ``(key, order…)`` splits
    a key that holds a large share of the rows over several partitions;
    per (partition, key) counts — at most one row per key and partition —
    give each piece its offset.  No task ever holds a whole group.
    """
    s = _placed(df, [key, *order_cols])
    pieces = s.groupBy("_part", key).agg(F.min("_idx").alias("_first"), F.count(F.lit(1)).alias("_cnt"))
    w = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select("_part", key, "_first", F.coalesce(F.sum("_cnt").over(w), F.lit(0)).alias("_off"))
    out = s.join(pieces, ["_part", key])
    return out.withColumn(name, (F.col("_off") + F.col("_idx") - F.col("_first")).cast("int")).drop(
        "_mid", "_part", "_idx", "_first", "_off")
