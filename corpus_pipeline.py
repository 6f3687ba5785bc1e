"""The corpus pipeline: language ID, line dedup, SimHash near-dedup, benchmark decontamination, SentencePiece."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stratum.llm import decontaminate, langid, linededup, pieces, simhash
from stratum.llm.common import settle, table

#: Each takes (spark, docs, sf_dir); all but the last return the columns of documents.
STAGES = [
    ("language_id", langid.stage),
    ("line_dedup", linededup.stage),
    ("simhash_dedup", simhash.stage),
    ("decontaminate", decontaminate.stage),
    ("sentencepiece", pieces.stage),
]

#: Fingerprints, rolling hashes and sampling can't be said in SQL; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settle(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), docs)
    return STAGES[-1][1](spark, docs, sf_dir)
