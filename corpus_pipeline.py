"""The training-data pipeline: rules, classifier, near-duplicate removal, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corrello.llm.packing import pack_stage
from corrello.llm.quality_classifier import keep_likely_good
from corrello.llm.quality_rules import keep_good
from corrello.llm.simhash import drop_near_duplicates
from corrello.store import keep, table

STAGES = [
    ("quality_rules", keep_good),
    ("quality_classifier", keep_likely_good),
    ("simhash_near_dedup", drop_near_duplicates),
    ("best_fit_packing", pack_stage),
]

#: The hashes, the network and the tokenizer have no SQL form; tests/llm holds
#: the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
