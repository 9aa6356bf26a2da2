"""The corpus pipeline: quality rules, line dedup, near-dedup, mixing, tokens.

Each stage works on all rows of its predecessor. Every stage but the last returns the
columns of its input; the last adds the token ids. Rows, with their ids and text, are
decided as the operators' modules state, nulls included; an empty table gives an empty
table of the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm import lines, minhash, mixing, pieces, quality
from quantloom.llm.common import table
from quantloom.llm.queries import MODEL_PATH


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.quality_rules(docs).where("kept").select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has go. A document that had words and has none
    left repeats earlier ones whole, and goes with them."""
    out = lines.dedup_lines(docs)
    emptied = (F.col("n_removed_lines") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return out.where(~F.coalesce(emptied, F.lit(False))).select(*docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the smallest id."""
    gone = minhash.near_duplicates(docs).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the order of the mix."""
    return (
        mixing.mix_sources(docs)
        .repartitionByRange("mix_slot", "mix_row")
        .sortWithinPartitions("mix_slot", "mix_row")
        .select(*docs.columns)
    )


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the check that they decode to its text."""
    return pieces.encode_decode(docs, pieces.read_model(spark, MODEL_PATH))


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("minhash_near_dedup", near_dedup_stage),
    ("mix_sources", mixing_stage),
    ("sentencepiece", token_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs


#: SQL can't express permutations, schedules and token ids: the tests hold the stages against brute force.
ORACLE_SQL = None

QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {}
