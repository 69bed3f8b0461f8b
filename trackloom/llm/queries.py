"""Registered queries of the corpus operators: thin digests of what the operators return."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, huffman, langid, mixing, packing, sanitise, simhash, suffix_tree, telephony


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = r"\### Assistant: </turn> ok"
    two = F.array(*[F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(k).cast("long").alias("turn"), F.lit(role).alias("role"), F.lit(odd).alias("text")) for k, role in enumerate(("user", "assistant"))])
    extra = spark.range(1).select(F.explode(two).alias("t")).select("t.*")
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(extra)
    out = chat.format_conversations(turns)
    read = out.withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("segments")))
    flat = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(flat.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


OP1_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
u AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k,
    count(*) OVER (PARTITION BY conv_id) AS n FROM t),
v AS (
  SELECT *,
    CASE WHEN k = 1 THEN role IN ('system', 'user') ELSE (before, role) IN (('system', 'user'), ('user', 'assistant'), ('assistant', 'user')) END
      AND (k < n OR role = 'assistant') AS ok,
    length(replace(replace(replace(text, '\', '\0'), '###', '\1'), '</turn>', '\2')) + 4 + 2 + 8
      + CASE WHEN role IN ('system', 'user', 'assistant') THEN length(role)
             ELSE 1 + length(replace(replace(replace(replace(replace(role, '\', '\0'), '###', '\1'), '</turn>', '\2'), ':', '\3'), chr(10), '\4')) END AS chars
  FROM u)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars, bool_and(ok) AS valid
FROM v GROUP BY conv_id
"""


def op2_hash_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"))


def op3_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_tree.score(_table(spark, sf_dir, "documents"), ~suffix_tree.held_out())
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_huffman_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = huffman.write(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return huffman.read(spark, path).select("doc_id", "start", F.expr("length(ids) div 4").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op5_bigru_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.train(docs.filter(~langid.held_out(F.col("doc_id"))))
    return langid.predict(docs, model).select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op6_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sanitise.find(_table(spark, sf_dir, "documents"))
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return out.select("doc_id", *(count(k) for k in sanitise.KINDS[:4]), F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def op7_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_rake_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(_table(spark, sf_dir, "documents"), keep=["doc_id"])
    return out.select(F.col("row.doc_id").alias("doc_id"), *(f"{d}_{x}" for x in ("class", "target") for d in mixing.TARGETS), "tokens", "weight", "probability", "sampled")


def op9_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = telephony.decode(telephony.store(_table(spark, sf_dir, "documents")))
    facts = out.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -32, 32)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "features",
        "pcm",
    )
    stored = telephony.store_pcm(facts)  # the digest is that of the column as it stands there
    return stored.select(*facts.columns[:7], F.concat("features", F.lit(";pcm="), F.lower(F.lpad(F.hex(F.crc32("pcm")), 8, "0"))).alias("feature"))


def op10_simhash_byte_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def queries() -> dict:
    found = {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


def oracle_sql() -> dict:
    return {"op1_chat_formatting": OP1_SQL}
