"""Threads, keys and deduplication: joins and windows over message tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convan.plans import bindings as B


def pair_replies(messages: DataFrame, responder: str) -> DataFrame:
    """Every reply of the responder with the message that it answers. Replies without a known message drop."""
    asked = messages.where(F.col("author") != responder).select(F.col("msg_id").alias("customer_msg_id"), F.col("text").alias("customer_text"))
    replies = messages.where((F.col("author") == responder) & F.col("reply_to").isNotNull()).select(F.col("msg_id").alias("brand_msg_id"), F.col("text").alias("brand_text"), "reply_to")
    return replies.join(asked, F.col("reply_to") == F.col("customer_msg_id")).select("customer_msg_id", "customer_text", "brand_msg_id", "brand_text")


def attach_parent(messages: DataFrame, brand: str) -> DataFrame:
    """Messages with the message before them and whose it is: brand, same or other author."""
    parent = messages.select(F.col("msg_id").alias("parent_id"), F.col("author").alias("p"), F.col("text").alias("parent_text"))
    kind = F.when(F.col("p") == brand, "brand").when(F.col("p") == F.col("author"), "same").otherwise("other")
    return messages.join(parent, F.col("reply_to") == F.col("parent_id")).select("msg_id", "parent_id", kind.alias("parent_author"), "parent_text")


def stitch_replies(parts: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """One row per key: its parts joined by a blank in order (nulls last, ties by text), and how many there are. Null texts count, but add nothing.

    Parts are dealt by ranges of key and order, so a key with many parts lies in many tasks. Each range joins its own parts of a
    key; what meets by key has one row per range, and only its joined text is as long as all of them."""
    dealt = parts.select(F.col(key).alias("_key"), F.col(order).isNull().alias("_none"), F.col(order).alias("_order"), F.col(text).alias("_text")).repartitionByRange("_key", "_none", "_order", "_text")
    ordered = F.array_sort(F.collect_list(F.struct("_none", "_order", "_text")))["_text"]
    ranges = dealt.groupBy("_key", F.spark_partition_id().alias("_range")).agg(ordered.alias("_texts"))
    joined = ranges.select("_key", F.size("_texts").alias("_n"), F.struct("_range", F.when(F.exists("_texts", lambda x: x.isNotNull()), F.array_join("_texts", " ")).alias("_text")).alias("_piece"))
    whole = joined.groupBy("_key").agg(F.array_sort(F.collect_list("_piece"))["_text"].alias("_texts"), F.sum("_n").cast("int").alias("n_parts"))
    return whole.select(F.col("_key").alias(key), F.array_join("_texts", " ").alias("reply"), "n_parts")


def dedupe(df: DataFrame, keys: list[str], order: list[str], keep: str) -> DataFrame:
    """The first or last row of each key in an order, nulls never first: deterministic, unlike dropDuplicates.

    Partial aggregates keep one row per key and task, so a key with many rows is no burden."""
    last = keep == "last"
    place = F.struct(*(f for c in order for f in ((F.col(c).isNotNull() if last else F.col(c).isNull()).alias(f"_{c}"), F.col(c))))
    best = F.max_by if last else F.min_by
    return df.groupBy(*keys).agg(best(F.struct(*df.columns), place).alias("_row")).select("_row.*")


def rescored(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Rows, keys, keys with several rows, and keys whose value differs between first and last. Keys meet by digest, so that a long text isn't shuffled; a null key is one."""
    by = df.groupBy(F.sha2(F.col(key).cast("string"), 256)).agg(F.count("*").alias("n"), F.min_by(value, order).alias("first"), F.max_by(value, order).alias("last"))
    return by.agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_keys"), F.count_if(F.col("n") > 1).alias("n_repeated"), F.count_if(~F.col("first").eqNullSafe(F.col("last"))).alias("n_changed"))


def unseen(df: DataFrame, used: DataFrame, key: str) -> DataFrame:
    return df.join(used.select(key), key, "left_anti")


def all_used(sources: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """Distinct (source, id) of all sources; a source may hold ids in several columns. Null ids are none."""
    parts = [df.select(F.lit(name).alias("source"), F.explode(F.array(*(F.col(c).cast("long") for c in cols))).alias("id")) for name, (df, cols) in sources.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("id is not null").distinct()


def used_ids(sources: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """Distinct ids of each source, and those of their union as source "*"; sources without ids have no row."""
    used = all_used(sources)
    return used.groupBy("source").agg(F.count("*").alias("n_ids")).unionByName(used.select("id").distinct().agg(F.lit("*").alias("source"), F.count("*").alias("n_ids")))


def _docs(spark, d):
    return B.table(spark, d, "documents")


QUERIES = {
    "pair_replies": lambda s, d: pair_replies(B.msgs(s, d), "assistant"),
    "attach_parent": lambda s, d: attach_parent(B.msgs(s, d), "assistant"),
    "stitch_replies": lambda s, d: stitch_replies(B.msgs(s, d).where("author = 'assistant'"), "conv_id", "turn", "text"),
    "dedupe_first": lambda s, d: dedupe(_docs(s, d), ["source", "lang"], ["n_chars", "doc_id"], "first").select("source", "lang", "doc_id"),
    "rescored": lambda s, d: rescored(_docs(s, d), "text", "doc_id", "source"),
    "unseen": lambda s, d: unseen(_docs(s, d), B.table(s, d, "labels"), "doc_id").select("doc_id"),
    "used_ids": lambda s, d: used_ids({"documents": (_docs(s, d), ["doc_id"]), "labels": (B.table(s, d, "labels"), ["doc_id"]), "lines": (B.table(s, d, "lineitem"), ["l_orderkey", "l_partkey", "l_suppkey"])}),
    "leaks": lambda s, d: B.table(s, d, "labels").select("doc_id").intersect(_docs(s, d).select("doc_id")),
}
ORACLE_SQL = {
    "pair_replies": f"WITH {B.SQL_MSGS} SELECT q.msg_id AS customer_msg_id, q.text AS customer_text, r.msg_id AS brand_msg_id, r.text AS brand_text FROM msgs r JOIN msgs q ON r.reply_to = q.msg_id WHERE r.author = 'assistant' AND q.author <> 'assistant'",
    "attach_parent": f"WITH {B.SQL_MSGS} SELECT m.msg_id, p.msg_id AS parent_id, CASE WHEN p.author = 'assistant' THEN 'brand' WHEN p.author = m.author THEN 'same' ELSE 'other' END AS parent_author, p.text AS parent_text FROM msgs m JOIN msgs p ON m.reply_to = p.msg_id",
    "stitch_replies": f"WITH {B.SQL_MSGS} SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS reply, CAST(count(*) AS INT) AS n_parts FROM msgs WHERE author = 'assistant' GROUP BY conv_id",
    "dedupe_first": "SELECT source, lang, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source, lang ORDER BY n_chars, doc_id) = 1",
    "rescored": "WITH k AS (SELECT text, count(*) AS n, arg_min(source, doc_id) AS f, arg_max(source, doc_id) AS l FROM documents GROUP BY text) SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_keys, count(*) FILTER (n > 1) AS n_repeated, count(*) FILTER (f IS DISTINCT FROM l) AS n_changed FROM k",
    "unseen": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "used_ids": "WITH i AS (SELECT 'documents' AS source, doc_id AS id FROM documents UNION ALL SELECT 'labels', doc_id FROM labels UNION ALL SELECT 'lines', unnest([l_orderkey, l_partkey, l_suppkey]) FROM lineitem) SELECT source, count(DISTINCT id) AS n_ids FROM i GROUP BY source UNION ALL SELECT '*', count(DISTINCT id) FROM i",
    "leaks": "SELECT doc_id FROM labels INTERSECT SELECT doc_id FROM documents",
}
