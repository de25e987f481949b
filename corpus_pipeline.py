"""A corpus pipeline: language identification, line dedup, near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of documents. Null texts, ties, repeated
rows, empty tables and extra columns are handled as each operator states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import language, line_dedup, mixing, packing, simhash
from tessera.llm._shared import finished, stored
from tessera.llm.queries import vocabulary


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without letters, and mixtures of which no language has a third. Texts with letters but no known n-gram
    stay, and all with letters where no language can be learned."""
    model = language.train(docs.filter(language.fold_of(F.col("doc_id")) != 2))
    found = language.identify(docs, model, basis_col="_basis")
    clear = (F.col("_basis") == language.MIXTURE) & (F.col("score") >= 1 / 3)
    return found.filter(clear | (F.col("_basis") == language.LETTERS)).select(docs.columns)


def remove_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on ten sites or more stay once; documents of nothing else go."""
    out = line_dedup.dedup_lines(docs).filter((F.col("n_removed") == 0) | (F.trim(F.replace("text", F.lit("\n"), F.lit(""))) != ""))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts whose five-word shingles have a similarity of 0.8 or more are linked; the document with the smallest id of each component
    stays, once if its row repeats; rows without an id stay."""
    found = stored(simhash.near_copies(docs))
    copies = stored(found.filter(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("_copy")).distinct())
    out = docs.join(copies, F.col("doc_id") == F.col("_copy"), "left_anti")
    repeats = found.filter(F.col("doc_id") == F.col("component_id")).groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1")
    if not repeats.take(1):
        return out
    return out.filter(F.col("doc_id").isNotNull()).dropDuplicates(["doc_id"]).unionByName(out.filter(F.col("doc_id").isNull()))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, the document that it takes in part if at least by half; ties in the hashed order go to
    the smaller id."""
    thin = stored(docs.select("doc_id", "source", mixing.words_in(F.col("text")).alias("size")))
    mixed = mixing.mix(docs, mixing.make_plan(thin))
    times = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    return mixed.select("row", F.explode(F.array_repeat(F.lit(1), times)).alias("_time")).select("row.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(docs, vocabulary()).drop("slot")


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", remove_common_lines),
    ("simhash_near_dedup", keep_one_of_near_copies),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: Mixture inference, fingerprints and tokens are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's rows are a table for the next one; what a stage stores on its way, and its own input, goes when its rows are
    written. The last stage's rows are not written here."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = finished(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), docs)
    return STAGES[-1][1](spark, docs, sf_dir)
