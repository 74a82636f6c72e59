"""The opN_ queries: each applies its operator to a whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmend.llm.common import crc_mod, table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridmend.llm.toxicity import score_documents, train

    docs = table(spark, sf_dir, "documents")
    held = crc_mod("doc_id", 5) == 0
    model = train(docs, table(spark, sf_dir, "labels"), ~held)
    scored = score_documents(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id", held.alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted")
    )


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridmend.llm.langid import label_documents, train

    docs = table(spark, sf_dir, "documents")
    held = crc_mod("doc_id", 4) == 2
    found = label_documents(docs, train(docs, ~held))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op3_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridmend.llm.unit_dedup import MIN_PASSAGE, dedup_documents

    left = dedup_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), "sentence", MIN_PASSAGE)
    spans = F.transform("removed", lambda s: F.concat_ws(":", s["start"], s["end"]))
    return left.select("doc_id", F.size("removed").cast("long").alias("n_removed"), "n_shared", F.array_join(spans, ",").alias("removed"), "text")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from gridmend.llm.pieces import encode_documents

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridmend.llm.sharding import shard_documents

    placed = shard_documents(table(spark, sf_dir, "documents"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridmend.llm.secrets import scan_documents

    found = scan_documents(table(spark, sf_dir, "documents"))
    spans = F.expr("transform(kinds, (k, i) -> concat_ws(':', k, starts[i], ends[i]))")
    count = lambda kind: F.expr(f"cast(size(filter(kinds, k -> k = '{kind}')) as long)").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        count("assign"),
        count("access"),
        count("hex"),
        F.sha2(F.array_join(F.filter(spans, lambda s: F.split(s, ":")[0].isin("assign", "access", "hex")), ","), 256).alias("base_sha256"),
        F.array_join(spans, ",").alias("spans"),
    )



def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridmend.llm.decontaminate import NEAR_TERMS, mark_documents

    marked = mark_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), near_terms=NEAR_TERMS)
    return marked.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        "n_near",
    )


def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridmend.llm.line_dedup import mark_documents

    marked = mark_documents(table(spark, sf_dir, "documents"))
    return marked.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), F.array_join("removed", ",").alias("removed"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridmend.llm.simhash import group_documents

    groups = group_documents(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")



def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridmend.llm.quality import judge_documents

    judged = judge_documents(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_language": op2_language,
    "op3_units": op3_units,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_sharding": op5_sharding,
    "op6_secrets": op6_secrets,
    "op7_decontamination": op7_decontamination,
    "op8_lines": op8_lines,
    "op9_simhash": op9_simhash,
    "op10_quality": op10_quality,
    "pipeline": pipeline,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {}
