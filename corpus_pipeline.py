"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns what it keeps with the columns of ``documents``; the
last one returns the pieces of the packed sequences. Nulls, empty texts, repeated rows and empty tables
pass through by the rules that each operator states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlight.llm import mixing, packing, quality, simhash, toxicity
from meshlight.llm.queries import byte_bpe, prepared, remainder, table
from meshlight.session import written

_OWN = "__doc_"


def _set_apart(docs: DataFrame) -> DataFrame:
    """The columns under names that no operator adds."""
    return docs.select(*[F.col(f"`{c}`").alias(_OWN + c) for c in docs.columns])


def _restored(df: DataFrame, docs: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{_OWN}{c}`").alias(c) for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that pass the base rules and the label model.

    The texts are read once for the model and once for the verdicts, so that none is shuffled.
    """
    prepared(spark)
    model = quality.fit(quality.signals(docs, keep=[]))
    judged = quality.judged(quality.signals(_set_apart(docs), _OWN + "text"), model)
    return _restored(judged.where("kept"), docs)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose toxicity is below one half; the model learns from the labels' training rows."""
    labels = table(spark, sf_dir, "labels").where(remainder("doc_id", 5) != 0)
    model = toxicity.train(docs, labels)
    scored = toxicity.scored(_set_apart(docs), model, _OWN + "text")
    return _restored(scored.where(F.col("toxicity") < 0.5), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates."""
    return _restored(simhash.representatives(_set_apart(docs), _OWN + "text", _OWN + "doc_id"), docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or drop documents so that sources come to their target weights."""
    mixed = mixing.mixed(_set_apart(docs), _OWN + "text", _OWN + "doc_id", _OWN + "source")
    return _restored(mixing.repeated(mixed), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences, with a checksum of their token ids."""
    pieces = packing.packed(docs, byte_bpe(), keep=["doc_id"])
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", toxicity_filter),
    ("simhash near duplicates", near_duplicates),
    ("source mixing", source_mixing),
    ("packing", pack),
]

# Label models, Newton steps and bin packing cannot be said in SQL; tests hold the stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepared(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
