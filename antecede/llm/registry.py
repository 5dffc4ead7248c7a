"""The queries of this folder, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, chat, decontam, embedgraph, exactdup, langid, maxent, neardup, packing, resampling, sqltext, toxicity, urlmodel, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A conversation whose texts look like the template's own marks.
HARD_TEXT = "\\### Assistant: </turn> ok"


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.sql("SELECT -7L AS conv_id, turn, role, :text AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)", args={"text": HARD_TEXT})
    return chat.digests(chat.format_chats(turns.unionByName(hard)))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.read_archive(warc.write_archive(_table(spark, sf_dir, "pages")))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"))


def op4_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedgraph.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = _table(spark, sf_dir, "documents"), toxicity.held_out(3, 1)
    out = langid.identify(docs, langid.train(docs.where(~held)))
    return out.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return urlmodel.judge(pages, urlmodel.train(pages))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = _table(spark, sf_dir, "documents"), toxicity.held_out(10, 0)
    out = maxent.score(docs, ~held)
    return out.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path())


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = _table(spark, sf_dir, "documents"), toxicity.held_out(4, 2)
    model = toxicity.train(docs.where(~held), _table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", "predicted", "sentences")


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.with_inertia(*centroids.cluster(_table(spark, sf_dir, "embeddings")))


def op13_exactdup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdup.exact_duplicates(_table(spark, sf_dir, "documents"), digest_all=True)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat": op1_chat,
    "op2_warc": op2_warc,
    "op3_minhash": op3_minhash,
    "op4_embeddings": op4_embeddings,
    "op5_decontamination": op5_decontamination,
    "op6_language": op6_language,
    "op7_url_filter": op7_url_filter,
    "op8_lm_score": op8_lm_score,
    "op9_packing": op9_packing,
    "op10_toxicity": op10_toxicity,
    "op11_resampling": op11_resampling,
    "op12_centroids": op12_centroids,
    "op13_exactdup": op13_exactdup,
}

ORACLES: dict[str, str] = {
    "op1_chat": sqltext.CHATS,
    "op2_warc": sqltext.ARCHIVE,
    "op3_minhash": sqltext.NEAR_DUPLICATES,
    "op5_decontamination": sqltext.CONTAMINATED,
    "op12_centroids": sqltext.CENTROIDS,
    "op13_exactdup": sqltext.EXACT_DUPLICATES,
}
