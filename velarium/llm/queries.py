"""The registered queries of the corpus operators: each applies one to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, fim, media, mixing, neardup, packing, sharding, structure, tokencount, tokenfiles, topk, toxicity, urlfilter
from .common import cut, shared_dir, table

#: Names of the vocabulary files; ``public_tokenizers.path`` finds them.
WORD_BPE, PIECE_BPE = "word_bpe_49k.json", "piece_bpe_32k.model"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = toxicity.fit(toxicity.training_rows(documents, table(spark, sf_dir, "labels")))
    scored = toxicity.score(documents.select("doc_id", "text"), model)
    return cut(scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted"))


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = topk.prepared(table(spark, sf_dir, "embeddings"))
    found = topk.search(base, base.where("vec_id % 50 = 0"), 5)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urlfilter.judge(pages, urlfilter.rules_table(spark)).drop("url")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), columns=["doc_id"])
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op5_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = media.audio_features(media.store_media(table(spark, sf_dir, "documents"), columns=["doc_id"]))
    return made.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard(table(spark, sf_dir, "documents").select("doc_id", "text"))
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")))
    return rows.select("doc_id", "size", crc.alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark)
    tokenfiles.write(table(spark, sf_dir, "documents"), folder, tokenizer_path(WORD_BPE), end_id=2)
    return tokenfiles.read(spark, folder)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents"), tokenizer_path(WORD_BPE), end_id=1))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = tokencount.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path(PIECE_BPE))
    return cut(counted.select("doc_id", "n_bytes", "n_tokens", "over_limit"))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op11_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    report = chat.read_back(chat.formatted(chat.chained(turns, "conv_id", "turn")))
    return report.select(F.col("tree").alias("conv_id"), *chat.REPORT)


def op12_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    found = structure.repair_report(structure.damaged(conversations), conversations.select(F.col("conv_id").alias("conv")))
    return found.withColumnRenamed("conv", "conv_id")


def op13_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.transformed(table(spark, sf_dir, "documents"), columns=["doc_id"])
    back = fim.restored(F.col("output"), F.col("form"))
    digests = F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256")
    return cut(made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_topk, op3_url_filter, op4_mixing, op5_audio, op6_sharding, op7_token_files, op8_packing, op9_token_counts, op10_minhash, op11_chat, op12_structure, op13_fim, pipeline)}
