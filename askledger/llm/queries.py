"""The text operators as registered queries: production parameters, whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askledger.llm import alignment, chat, decontamination, language, language_model, near_duplicates, neighbours, packing, personal, secrets, sharding, spelling, toxicity
from askledger.llm.common import id_remainder, read


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(read(spark, sf_dir, "documents"))


def op2_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.linked_turns(read(spark, sf_dir, "conversations"))


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.digest(personal.find(read(spark, sf_dir, "documents")))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = F.coalesce(id_remainder("doc_id", 5) == 0, F.lit(True))
    profiles = language.learn(docs, ~held_out)
    net = toxicity.train(docs, read(spark, sf_dir, "labels"), ~held_out, profiles)
    return toxicity.score(docs, net, profiles).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = F.coalesce(id_remainder("doc_id", 4) == 2, F.lit(True))
    found = language.predict(docs, language.learn(docs, ~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = F.coalesce(id_remainder("doc_id", 10) == 0, F.lit(True))
    return language_model.score(docs, held_out, language_model.train(docs, ~held_out))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(read(spark, sf_dir, "documents")))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling(read(spark, sf_dir, "documents"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment(read(spark, sf_dir, "documents"))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digest(sharding.shard(read(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_dedup": op1_near_dedup,
    "op2_tool_calls": op2_tool_calls,
    "op3_personal_data": op3_personal_data,
    "op4_toxicity": op4_toxicity,
    "op5_packing": op5_packing,
    "op6_neighbours": op6_neighbours,
    "op7_decontamination": op7_decontamination,
    "op8_language_id": op8_language_id,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_secrets": op10_secrets,
    "op11_spelling": op11_spelling,
    "op12_alignment": op12_alignment,
    "op13_sharding": op13_sharding,
}

ORACLE_SQL: dict[str, str] = {
    "op1_near_dedup": near_duplicates.ORACLE_SQL,
    "op2_tool_calls": chat.ORACLE_SQL,
    "op10_secrets": secrets.oracle_sql(),
    "op11_spelling": spelling.oracle_sql(),
}
