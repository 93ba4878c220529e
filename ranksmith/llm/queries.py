"""One query for each operator over its whole table, with the settings of production."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ranksmith.llm import (
    decontaminate,
    mixing,
    oracles,
    pii,
    ppm,
    quality,
    resampling,
    secrets,
    simhash,
    suffixdedup,
    tokenfiles,
    toxicity,
    urls,
    valuecodes,
)

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
WEIGHTS = (3.0, 1.0, 2.0)
END_ID = 1


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def counted(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def op1_suffix_array_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"]
    )
    n_hit = F.aggregate("hits", F.lit(0).cast("bigint"), lambda total, run: total + run["end"] - run["start"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("item_ids").cast("bigint").alias("n_items"),
        digest(F.array_join("item_ids", ",")).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
        "longest_match",
    )


def op2_zstd_novelty_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"), keep=["doc_id"])
    base = F.filter("secrets", lambda s: s["kind"] != "novel")
    return found.select(
        "doc_id",
        *[counted(F.col("secrets"), kind) for kind in ("assign", "access", "hex")],
        digest(listed(base)).alias("base_sha256"),
        listed(F.col("secrets")).alias("spans"),
    )


def op3_checked_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal(table(spark, sf_dir, "documents"), keep=["doc_id"])
    base = F.filter("personal", lambda s: s["kind"] != "iban")
    return found.select(
        "doc_id",
        *[counted(F.col("personal"), kind) for kind in ("email", "ip", "card", "phone")],
        digest(listed(base)).alias("base_sha256"),
        listed(F.col("personal")).alias("spans"),
        F.array_join(F.transform("personal", lambda s: s["score"].cast("string")), ",").alias("scores"),
    )


def op4_ppm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 10 == 0
    return ppm.score_documents(documents.withColumn("held_out", held_out), trains=~F.col("held_out"), keep=["doc_id", "held_out"])


def op5_hashed_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    return urls.judge_urls(table(spark, sf_dir, "pages"), rules, keep=["page_id"])


def op6_entropy_balanced_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), WEIGHTS, share=1.5, cap=2.0, keep=["doc_id"])
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op7_mcd_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_quality(table(spark, sf_dir, "documents"), keep=["doc_id"])


def op8_bucket_pointer_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.remove_repeats(table(spark, sf_dir, "documents"), keep=["doc_id"]).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", digest(F.col("kept")).alias("kept_sha256")
    )


def op9_pfor_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfiles.token_table(
        table(spark, sf_dir, "documents"), tokenizer_path(), END_ID, by_word=True, keep=["doc_id"]
    )


def op10_bit_sliced_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), keep=["doc_id"]).select(
        "doc_id", "fingerprint", "component_id"
    )


def op11_value_dictionary_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return valuecodes.code_vectors(table(spark, sf_dir, "embeddings"), keep=["vec_id"])


def op12_gumbel_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])


def op13_factorization_machine_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0
    found = toxicity.score_toxicity(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), trains=~held_out, keep=["doc_id"]
    )
    return found.select("doc_id", held_out.alias("held_out"), "score", "predicted")


# What SQL can say of four operators: their results without the columns that the dealt methods add.


def secret_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_zstd_novelty_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def personal_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_checked_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op6_entropy_balanced_mix(spark, sf_dir)
    return found.select("doc_id", "size", "source_size", F.round("target", 3).alias("target"))


def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_mcd_quality(spark, sf_dir).select("doc_id", *quality.COUNTS, "base_failed")


_RULES = ", ".join(f"('{host}', '{path}', '{action}')" for host, path, action in RULES)

ORACLES: dict[str, str] = {
    "op5_hashed_url_rules": f"""
WITH rules(rule_host, rule_path, action) AS (VALUES {_RULES}),
rests AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
parsed AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{urls.UPPER}', '{urls.LOWER}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM rests)
SELECT page_id, any_value(host) AS host, any_value(path) AS path,
       arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
       coalesce(arg_max(action, length(rule_host || rule_path)), 'allow') AS verdict
FROM parsed LEFT JOIN rules
  ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
GROUP BY page_id""",
    "op11_value_dictionary_codes": oracles.value_codes(),
    "op12_gumbel_importance_resample": oracles.resampled(),
    "secret_counts": oracles.secret_counts(),
    "personal_counts": oracles.personal_counts(),
    "mix_targets": oracles.mix_targets(WEIGHTS),
    "quality_counts": oracles.quality_counts(),
}

QUERIES = {
    f.__name__: f
    for f in (
        op1_suffix_array_decontamination,
        op2_zstd_novelty_secrets,
        op3_checked_pii,
        op4_ppm_scores,
        op5_hashed_url_rules,
        op6_entropy_balanced_mix,
        op7_mcd_quality,
        op8_bucket_pointer_dedup,
        op9_pfor_token_files,
        op10_bit_sliced_simhash,
        op11_value_dictionary_codes,
        op12_gumbel_importance_resample,
        op13_factorization_machine_toxicity,
        secret_counts,
        personal_counts,
        mix_targets,
        quality_counts,
    )
}
