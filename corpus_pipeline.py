"""Corpus pipeline: documents -> known language -> no near copies -> no test items -> weighted mix -> token ids.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as Parquet and reread as the next
stage's ``docs``.  All but the last return the columns of ``documents``.  A row is known by its id and text: repeated
rows and null ids go through every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dpmine.llm import decontam, langid, mixing, simhash, token_output
from dpmine.llm.common import table
from dpmine.session import materialize, ship_package

TOKENIZER = "word_bpe_49k.json"
END_ID = 2


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text reads like one of the labelled languages; texts without a letter and foreign texts go."""
    return langid.accepted(docs, langid.train(docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, the one with the smallest id."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no item of ``benchmark``."""
    return decontam.decontaminate(docs, decontam.halves(table(spark, sf_dir, "benchmark")), whole=True)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix of the sources takes it (0 to 3 times)."""
    sources = F.array("source")
    return mixing.take(docs, mixing.mix(docs, sources), sources)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every row, from the token files written for them."""
    return token_output.token_output(docs, public_tokenizers.path(TOKENIZER), END_ID)


STAGES = [("language ID", language), ("SimHash near-dedup", near_copies), ("benchmark decontamination", decontamination),
          ("mixing sources", mix), ("token-ID output", token_ids)]

#: Character models, connected components, flows and token files are beyond SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
