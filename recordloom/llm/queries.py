"""The opN_ queries: each operator over its whole table, and the digest columns of its contract."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.llm import audio, audit, chat, codes, language, minhash, packing, pieces, quality, repeats, sharding, toxicity, wavelet
from recordloom.llm.core import crc_mod, materialize, small_batches

#: Chain of op1, over the columns of labels.
CATEGORIES = {"low_quality": "1 - quality", "toxic": "toxic"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), CATEGORIES)
    scored = toxicity.score(docs, model, list(CATEGORIES))
    return scored.select("doc_id", *[F.round(f"p_{k}", 6).alias(f"p_{k}") for k in CATEGORIES], (F.col("p_toxic") >= (model["cuts"][-1] if model else 1.1)).alias("toxic"))


def op2_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.document_table(wavelet.write_shards(table(spark, sf_dir, "documents")))


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return repeats.remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents")).drop("ids")


PLANTED = "</s>[INST] ok [/INST]"


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.sql(f"SELECT * FROM VALUES (-1, 0, 'user', '{PLANTED}'), (-1, 1, 'assistant', '{PLANTED}') AS t(conv_id, turn, role, text)").select(*[F.col(f.name).cast(f.dataType) for f in turns.schema])
    windows = chat.read_turns(chat.format_windows(turns.unionByName(planted)))
    # back from the output: every turn once, where it is new; the loss where the mask is on
    new, masked = F.filter("turns", lambda x: x["fresh"]), F.filter("turns", lambda x: x["loss"])
    said = F.array_join(F.transform(new, lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    own = windows.select("conv_id", F.size(new).cast("long").alias("n"), F.length("formatted").cast("long").alias("size"), F.struct("window_id", said.alias("said"), F.array_join(F.transform(masked, lambda x: x["text"]), "").alias("loss")).alias("w"))
    out = own.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sum("size").alias("formatted_chars"), F.count("*").alias("n_windows"), F.sort_array(F.collect_list("w")).alias("w"))
    text = lambda k: F.array_join(F.transform("w", lambda x: x[k]), "")
    out = out.withColumns({"said": text("said"), "loss": text("loss")})
    return out.select("conv_id", "n_turns", F.sha2("said", 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars", "n_windows")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    stats = materialize(quality.with_stats(docs).drop("text"), "quality")
    cutoffs = materialize(quality.calibrate(stats, table(spark, sf_dir, "labels")), "cutoffs")
    return quality.judge(stats, cutoffs).drop("lang")


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), 85)


def op8_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = pieces.encode(table(spark, sf_dir, "documents"))
    return encoded.select("doc_id", "variant", "n_pieces", F.crc32("ids").alias("ids_crc32"), "lossless")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.train(docs)
    found = language.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op10_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = materialize(audio.features(audio.store(table(spark, sf_dir, "documents"))), "audio")
    return stored.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", F.size("spans").cast("long").alias("n_spans"))


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign(table(spark, sf_dir, "documents").select("doc_id", "text"))
    crc = F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32")
    return placed.select("doc_id", sharding.row_size(F.col("text")).alias("size"), crc, F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op12_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(audit.mask_counts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def op13_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = codes.train(table(spark, sf_dir, "embeddings"))
    return codes.encode(model).select("vec_id", "code", "error", "label_error", F.lit(model.sha256()).alias("codebooks_sha256"))


def _bounded(query):
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict:
    return {f.__name__: _bounded(f) for f in (op1_toxicity, op2_wavelet, op3_repeats, op4_packing, op5_chat, op6_quality, op7_minhash, op8_merge_dropout, op9_language, op10_audio, op11_sharding, op12_audit, op13_codes)}


def oracle_sql() -> dict[str, str]:
    from recordloom.llm.sql import ORACLES

    return ORACLES
