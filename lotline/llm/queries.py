"""The registered queries of this folder, over the tables of a data directory."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotline.llm import (
    backoff_lm,
    bpe,
    exact_dedup,
    grid_join,
    hd_language,
    interleave_shards,
    oracle,
    ordinal_toxicity,
    partition_join,
    prefix_trie,
    seekable_ids,
    string_tiling,
    structure_repair,
    url_gbt,
)
from lotline.llm.common import shared_folder, ship

URL_RULES = ["block net/", "allow example.net/en/", "block example.com/de/", "allow org/fr/"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op1_grid_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid_join.link(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", threshold=0.9)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.encode_decode(table(spark, sf_dir, "documents"), tokenizer_path())
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                      F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op3_hd_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    prototypes = hd_language.fit(hd_language.training_rows(docs))
    texts = docs.select("doc_id", hd_language.held_out().alias("held_out"), "text")
    return hd_language.predict(texts, prototypes).select("doc_id", "held_out", "lang_pred", "score")


def op4_interleave_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = interleave_shards.interleave(table(spark, sf_dir, "documents"), shards=8)
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op5_seekable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "seekable-ids")
    seekable_ids.write(table(spark, sf_dir, "documents"), path, tokenizer_path(), end_id=1)
    out = seekable_ids.read(spark, path)
    return out.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op6_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return string_tiling.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_backoff_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = backoff_lm.score(docs, backoff_lm.training())
    return out.select("doc_id", backoff_lm.held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_url_gbt(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = url_gbt.judge(table(spark, sf_dir, "pages"), url_gbt.parse_rules(URL_RULES))
    return out.select("page_id", "host", "path", "rule", "verdict")


def op9_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = ordinal_toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return ordinal_toxicity.predict(docs.select("doc_id", "text"), model).drop("text")


def op10_partition_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partition_join.join_groups(table(spark, sf_dir, "documents"), k=3, percent=90)


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(*prefix_trie.rebuilt(table(spark, sf_dir, "conversations")))


def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return structure_repair.repair(structure_repair.damage(conversations), conversations)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_grid_join": op1_grid_join,
        "op2_bpe": op2_bpe,
        "op3_hd_language": op3_hd_language,
        "op4_interleave_shards": op4_interleave_shards,
        "op5_seekable_ids": op5_seekable_ids,
        "op6_string_tiling": op6_string_tiling,
        "op7_backoff_lm": op7_backoff_lm,
        "op8_url_gbt": op8_url_gbt,
        "op9_ordinal_toxicity": op9_ordinal_toxicity,
        "op10_partition_join": op10_partition_join,
        "op11_exact_dedup": op11_exact_dedup,
        "op12_prefix_trie": op12_prefix_trie,
        "op13_structure_repair": op13_structure_repair,
    }


def oracle_sql() -> dict[str, str]:
    """SQL where it can express the query; the others are tested against brute force."""
    return dict(oracle.SQL)
