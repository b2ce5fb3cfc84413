"""A corpus through five of the training-data operators, each stage written before the next reads it."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.llm import compression, decontaminate, mixing, simhash, substrings
from sedimenta.llm.tables import discard, fold_of, staged, table

#: What the first stage last learnt, by application and folder.
_LEARNT: dict[tuple[str, str], compression.Model] = {}


def _classifier(docs: DataFrame, spark: SparkSession, sf_dir: str) -> compression.Model:
    """Labels of the held-out fold aren't learnt."""
    return compression.fit(docs, table(spark, sf_dir, "labels"), fold_of(F.col("doc_id"), 4) != 2)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier takes for good text."""
    model = _LEARNT[spark.sparkContext.applicationId, sf_dir] = _classifier(docs, spark, sf_dir)
    return compression.accepted(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group of exact and near copies."""
    return simhash.deduplicated(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated passages; a text of which no word is left goes."""
    found = substrings.cut(docs.select("doc_id", "text", F.struct("*").alias("row")), ("row",))
    kept = found.where("_n_removed = 0 OR _n_removed < _n_words")
    n_chars = F.when(F.col("_n_removed") > 0, F.length("_kept")).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)
    changed = {"text": F.col("_kept"), "n_chars": n_chars}
    return kept.select(*(changed.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, nor an edited one."""
    return decontaminate.cleaned(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with how many words it takes of each, repeats counted.

    Documents weigh as the classifier scores them. It is learnt from all documents again, as stages hand on the columns of documents only
    and hardly any bad text is left here. A folder that holds no documents, as those given to the first stage came from elsewhere, takes what that stage learnt.
    """
    try:
        model = _classifier(table(spark, sf_dir, "documents"), spark, sf_dir)
    except AnalysisException:
        model = _LEARNT.get((spark.sparkContext.applicationId, sf_dir))
        if model is None:
            raise
    weight = "_weight"
    while weight in docs.columns:
        weight += "_"
    weighed = compression.weighed(docs, model, weight)
    return mixing.mixed(weighed, tuple(docs.columns), F.col(weight)).where("taken > 0")


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mix),
]

#: Compression, fingerprints and alignment aren't SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, staged(stage(spark, docs, sf_dir))
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
