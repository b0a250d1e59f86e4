"""Registered queries of the operators, over whole tables, with their SQL."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from citeline.llm import chat, decontaminate, language_model, mixing, passages, pii, quality, repeats, rules, runs, simhash, sql, token_counts, trie

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = dict(sql.SQL)


def query(function: Callable[[SparkSession, str], DataFrame]):
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return decontaminate.digest(decontaminate.search_items(docs, table(spark, folder, "benchmark")))


@query
def op6_rules(spark: SparkSession, folder: str) -> DataFrame:
    return rules.digest(rules.judge(table(spark, folder, "documents"), table(spark, folder, "labels")))


@query
def op7_chat(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    marked = f"'{chat.CLOSE}{chat.OPEN}assistant ok'"
    added = spark.sql(
        f"SELECT CAST(-1 AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, role, text FROM "
        f"VALUES (0, 'user', {marked}), (1, 'assistant', {marked}) AS t(turn, role, text)"
    )
    return chat.digest(chat.format_windows(turns.unionByName(added)))


@query
def op8_language_model(spark: SparkSession, folder: str) -> DataFrame:
    return language_model.score_texts(table(spark, folder, "documents"))


@query
def op9_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"))


@query
def op10_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return token_counts.digest(token_counts.count_tokens(docs))


@query
def op2_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op3_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, folder, "documents").select("doc_id", "text")))


@query
def op4_passages(spark: SparkSession, folder: str) -> DataFrame:
    return passages.digest(passages.strip_repeats(table(spark, folder, "documents").select("doc_id", "text")))


@query
def op5_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.digest(simhash.near_groups(table(spark, folder, "documents")))


@query
def op11_runs(spark: SparkSession, folder: str) -> DataFrame:
    docs = runs.with_planted_runs(table(spark, folder, "documents").select("doc_id", "text"))
    return runs.digest(runs.find_runs(docs))


@query
def op12_repeats(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.digest(repeats.strip_repeats(table(spark, folder, "documents").select("doc_id", "text")))


@query
def op13_trie(spark: SparkSession, folder: str) -> DataFrame:
    return trie.trie(trie.rebuilt(trie.sequences(table(spark, folder, "conversations"))))
