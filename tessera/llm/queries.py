"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import audio, language, line_dedup, lm_scoring, mixing, neighbours, packing, periodic, prefix_trie, secrets, simhash, suffix_dedup, tokens
from tessera.llm._shared import stored


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(documents(spark, sf_dir))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "source", "shards", "place")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.held_out_predictions(documents(spark, sf_dir))


def op9_adaptive_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(documents(spark, sf_dir))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_telephony_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = audio.telephony(documents(spark, sf_dir))
    return out.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -32, 32)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
        "format",
        F.length("pcm").cast("long").alias("pcm_bytes"),
        F.sha2("pcm", 256).alias("pcm_sha256"),
    )


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(documents(spark, sf_dir), vocabulary())


def _is_kind(k: int):
    return lambda span: span["kind"] == k


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = secrets.RULES
    out = secrets.secret_spans(documents(spark, sf_dir), rules)

    def joined(spans):
        kinds = F.array(*(F.lit(r.kind) for r in rules))
        one = lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))
        return F.array_join(F.transform(spans, one), ",")

    n_base = sum(r.base for r in rules)
    counts = [F.size(F.filter("spans", _is_kind(k))).cast("long").alias(f"n_{r.kind}") for k, r in enumerate(rules[:n_base])]
    base = F.filter("spans", lambda s: s["kind"] < n_base)
    return out.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(documents(spark, sf_dir), vocabulary()).drop("slot")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text; a tenth of the texts, told by the ids' checksums, go over into a repeated stretch of their words."""
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    h = F.crc32(F.col("doc_id").cast("string"))
    planted = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, words).alias("words"))
    n = F.size("words").cast("long")
    planted = planted.withColumn("a", F.when(n > 0, F.col("g") % n)).withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8)))
    a, p, left = F.col("a").cast("int"), F.col("p").cast("int"), (n - F.col("a")).cast("int")
    again = F.slice(F.flatten(F.array_repeat(F.slice("words", a + 1, p), F.ceil(left / p).cast("int"))), 1, left)
    text = F.array_join(F.concat(F.slice("words", F.lit(1), a), again), " ")
    return planted.select("doc_id", F.when(F.col("p").isNotNull(), text).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periodic.periodic_runs(with_planted_runs(documents(spark, sf_dir)))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    line = lambda r: F.concat(F.concat_ws(",", *(r[k].cast("string") for k in ("start", "length", "period"))), F.lit("\n"))
    out = out.withColumn("longest", longest)
    length, period = F.col("longest.length"), -F.col("longest.period")
    return out.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("longest.start")).alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor((1000 * length - (1000 * length) % period) / period).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
        "n_words",
    )


def op12_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_documents(documents(spark, sf_dir), vocabulary())


def rebuilt_conversations(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns and conversations in which each one's first turns, up to five by its id's checksum, are those of its hundred's first one."""
    n_head = F.crc32(F.col("conv_id").cast("string")) % 6
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    convs = convs.select("conv_id", "n", (F.col("conv_id") - F.col("conv_id") % 100).alias("base"), n_head.alias("h"))
    sizes = convs.filter(F.col("conv_id") == F.col("base")).select("base", F.col("n").alias("n_base"))
    convs = stored(convs.join(sizes, "base", "left").withColumn("n_head", F.least("h", F.coalesce("n_base", F.lit(0)))))
    heads = turns.filter((F.col("conv_id") % 100 == 0) & (F.col("pos") <= 5)).withColumnRenamed("conv_id", "base")
    heads = heads.join(convs.select("base", "conv_id", "h"), "base").filter("pos <= h").select(*turns.columns)
    own = turns.join(convs.select("conv_id", "h", "n_head"), "conv_id").filter("pos > h").withColumn("pos", F.col("n_head") + F.col("pos") - F.col("h"))
    return heads.unionByName(own.select(*turns.columns)), convs.select("conv_id")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefix_trie.numbered_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    nodes, ends = prefix_trie.prefix_trie(*rebuilt_conversations(turns))
    hashes = stored(prefix_trie.list_hashes(ends))
    none = F.sha2(F.lit(""), 256)
    return nodes.join(hashes, ["conv_id", "depth"], "left").withColumn("ends_sha256", F.coalesce("sha256", none)).drop("sha256")


QUERIES = {
    f.__name__: f
    for f in (
        op1_suffix_dedup,
        op2_source_mixing,
        op3_language_id,
        op4_telephony_audio,
        op5_line_dedup,
        op6_token_counts,
        op7_secret_scans,
        op8_best_fit_packing,
        op9_adaptive_neighbours,
        op10_simhash_near_dedup,
        op11_periodic_runs,
        op12_lm_scoring,
        op13_prefix_trie,
    )
}
SQL: dict[str, str] = {"op5_line_dedup": line_dedup.SQL, "op13_prefix_trie": prefix_trie.SQL}
