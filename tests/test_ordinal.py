"""B1, F13, S1 on wide rows: no row lost, whatever the partitions and the adaptive settings."""

import pytest
from pyspark.sql import functions as F

from dpmine.operators import ordinal as O
from dpmine.sources import io as IO

DOCS = "/root/testdata/sf0.1/documents.parquet"


@pytest.mark.parametrize("parts, adaptive", [("1", "true"), ("8", "true"), ("200", "true"), ("8", "false"), ("200", "false")])
def test_ordinals_are_dense(spark, parts, adaptive):
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        docs = spark.read.parquet(DOCS)
        n = docs.count()
        out = O.with_ordinal(docs, ["doc_id"])
        row = out.agg(F.count("*"), F.countDistinct("ordinal"), F.min("ordinal"), F.max("ordinal"),
                      F.count(F.when(F.col("ordinal") != F.col("doc_id"), 1)), F.count("text")).first()
        assert tuple(row) == (n, n, 0, n - 1, 0, n)
        hot = docs.withColumn("k", F.when(F.col("doc_id") % 3 == 0, 0).otherwise(F.col("doc_id") % 50))
        within = O.ordinal_within(hot, "k", ["doc_id"])
        row = within.groupBy("k").agg(F.count("*").alias("n"), F.countDistinct("pos").alias("d"), F.max("pos").alias("m"))
        assert row.filter("n <> d or m <> n - 1").count() == 0 and within.count() == n
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_corpus_over_many_files(spark, tmp_path):
    docs = spark.read.parquet(DOCS).select(F.col("source").alias("title"), F.col("text").alias("contents"), "doc_id")
    path = str(tmp_path / "corpus")
    docs.repartitionByRange(8, "doc_id").sortWithinPartitions("doc_id").select("title", "contents").write.json(path)
    got = IO.read_corpus(spark, path)
    want = docs.select(F.col("doc_id").alias("pid"), "title", "contents")
    assert got.count() == want.count() and got.exceptAll(want).count() == 0
