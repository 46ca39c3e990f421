"""The score table (S9, H2): ``qid, pid, score`` with a commit log, files bucketed by the pair, and compaction.

    root/log/00000000.json …     what is committed (``commits.CommitLog``)
    root/data/piece=<name>/…     one folder of bucket files for each committed batch or compaction

Every piece is written with one file a bucket of ``(qid, pid)``, and the table
is read as a bucketed one: a join on the pair exchanges the other side only,
however large the table has grown, and a hot query's pairs lie in all buckets.
"""

from __future__ import annotations

import hashlib
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dpmine.sources.commits import CommitLog, delete, folders

KEYS = ["qid", "pid"]


class ScoreCache:
    """Scores by pair under one folder; a batch of new scores is there as a whole or not at all.

    ``scorer_id`` keys the table by model as well (a new teacher starts an empty one).  ``buckets`` is fixed when the
    first batch is written.
    """

    SCHEMA = "qid long, pid long, score double"

    def __init__(self, spark: SparkSession, root: str, scorer_id: str | None = None, buckets: int = 16):
        self.spark, self.root = spark, root.rstrip("/") + (f"/scorer={scorer_id}" if scorer_id else "")
        self.log, self._buckets = CommitLog(spark, f"{self.root}/log"), buckets
        self._table = "dpmine_scores_" + hashlib.sha1(self.root.encode()).hexdigest()[:16]

    # ---- state
    def _state(self) -> tuple[int, int, dict[str, dict]]:
        """(last entry, buckets, committed pieces by name)."""
        last, entries = self.log.entries()
        pieces: dict[str, dict] = {}
        buckets = self._buckets
        for e in entries:
            buckets = e["buckets"]
            for name in e.get("remove", []):
                pieces.pop(name, None)
            pieces.update({p["piece"]: p for p in e["add"]})
        return last, buckets, pieces

    def batches(self) -> list[str]:
        """Names of the committed batches."""
        return sorted(b for p in self._state()[2].values() for b in p["batches"])

    # ---- reading
    def _read(self, pieces: list[str], buckets: int) -> DataFrame:
        if not pieces:
            return self.spark.createDataFrame([], self.SCHEMA + ", batch string, piece string")
        quoted = lambda x: x.replace("\\", "\\\\").replace("'", "\\'")
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self._table} ({self.SCHEMA}, batch string, piece string) USING parquet "
                       f"PARTITIONED BY (piece) CLUSTERED BY (qid, pid) SORTED BY (qid, pid) INTO {buckets} BUCKETS "
                       f"LOCATION '{quoted(self.root)}/data'")
        self.spark.sql(f"ALTER TABLE {self._table} ADD IF NOT EXISTS " + " ".join(
            f"PARTITION (piece = '{quoted(p)}') LOCATION '{quoted(self.root)}/data/piece={quoted(p)}'" for p in pieces))
        return self.spark.table(self._table).filter(F.col("piece").isin(pieces))

    def read(self) -> DataFrame:
        """The committed scores as of now: batches committed later are not in this frame, uncommitted files never."""
        _, buckets, pieces = self._state()
        return self._read(sorted(pieces), buckets).select("qid", "pid", "score")

    def _batch(self, batch: str) -> DataFrame:
        _, buckets, pieces = self._state()
        own = sorted(n for n, p in pieces.items() if batch in p["batches"])
        return self._read(own, buckets).filter(F.col("batch") == batch).select("qid", "pid", "score")

    # ---- writing
    def _write(self, rows: DataFrame, name: str, buckets: int) -> dict:
        """Write ``qid, pid, score, batch`` as one piece, one sorted file a bucket; returns its name and rows."""
        piece = f"{re.sub(r'[^A-Za-z0-9_.-]', '_', name)}-{uuid.uuid4().hex[:12]}"
        held, path = f"{self._table}_{uuid.uuid4().hex[:12]}", f"{self.root}/data/piece={piece}"
        (rows.repartition(buckets, *KEYS).write.bucketBy(buckets, *KEYS).sortBy(*KEYS).option("path", path).saveAsTable(held))
        self.spark.sql(f"DROP TABLE {held}")                     # the files stay: the table was external
        return {"piece": piece, "rows": self.spark.read.schema(self.SCHEMA).parquet(path).count()}

    def append_new(self, new: DataFrame, batch: str) -> DataFrame:
        """Write the keys of ``new`` that the table lacks as batch ``batch``; return that batch.

        Idempotent: a batch already committed (a rerun after a failure) is returned as it is, and what an interrupted
        write left is neither read nor taken for scored.  When another writer commits meanwhile, only the keys that are
        still missing are kept, from the scores already written.
        """
        rows = new.select("qid", "pid", "score").dropDuplicates(KEYS)
        while True:
            last, buckets, pieces = self._state()
            if any(batch in p["batches"] for p in pieces.values()):
                return self._batch(batch)
            have = self._read(sorted(pieces), buckets).select(*KEYS)
            piece = self._write(rows.join(have, KEYS, "left_anti").withColumn("batch", F.lit(batch)), batch, buckets)
            if self.log.commit({"buckets": buckets, "add": [{**piece, "batches": [batch]}]}, last):
                return self._batch(batch)
            rows = self.spark.read.schema(self.SCHEMA).parquet(f"{self.root}/data/piece={piece['piece']}")

    def compact(self, small: int = 1_000_000, least: int = 2) -> int:
        """Merge the pieces of under ``small`` rows into one, if there are ``least`` of them; returns how many.

        Batch names stay with their rows.  Readers see the old pieces or the new one, never both; the old files stay for
        readers that have begun, until ``vacuum``.
        """
        last, buckets, pieces = self._state()
        merged = sorted(n for n, p in pieces.items() if p["rows"] < small)
        if len(merged) < least:
            return 0
        rows = self._read(merged, buckets).select("qid", "pid", "score", "batch")
        piece = {**self._write(rows, "compacted", buckets), "batches": sorted(b for n in merged for b in pieces[n]["batches"])}
        rest = [p for n, p in sorted(pieces.items()) if n not in merged]
        done = self.log.commit({"snapshot": True, "buckets": buckets, "add": [*rest, piece]}, last)
        return len(merged) if done else 0

    def vacuum(self) -> list[str]:
        """Delete folders that the log does not name (left by interrupted writes and compactions); returns their names.

        Call it while nobody writes and no earlier reader is at work.
        """
        pieces = self._state()[2]
        gone = [n for n in folders(self.spark, f"{self.root}/data") if n.startswith("piece=") and n[6:] not in pieces]
        for name in gone:
            delete(self.spark, f"{self.root}/data/{name}")
        return gone
