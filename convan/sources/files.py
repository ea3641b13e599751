"""Readers and sinks of messages, predictions and run logs. Paths are any that Spark can read."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from convan.functions.scratch import new_path
from convan.plans import bindings as B

MESSAGES = "msg_id long, author string, inbound boolean, created_at string, text string, reply_to long"


def read_messages(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Messages from CSV with quoted line breaks and doubled quotes; only the columns asked for are parsed."""
    df = spark.read.schema(MESSAGES).csv(path, header=True, multiLine=True, quote='"', escape='"', encoding="UTF-8")
    return df.select(*columns) if columns else df


def write_messages(df: DataFrame, path: str) -> None:
    """CSV that read_messages gives back: empty texts are quoted, nulls are bare."""
    df.write.csv(path, header=True, quote='"', escape='"', quoteAll=False, emptyValue='""', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def parse_tweet_time(text: Column) -> Column:
    """Times such as "Wed Oct 11 06:55:44 +0000 2017"; null where they can't be read."""
    return F.try_to_timestamp(F.substring(text, 5, 1000), F.lit("MMM dd HH:mm:ss Z yyyy"))


def read_predictions(spark: SparkSession, path: str, namespace: str) -> DataFrame:
    """One namespace of an append-only JSONL log (a missing namespace is v1): the first row of each id, by seq."""
    log = spark.read.schema("namespace string, item long, seq long, label string").json(path)
    own = log.where(F.coalesce("namespace", F.lit("v1")) == namespace)
    return own.groupBy("item").agg(F.min_by("label", "seq").alias("label"))


def read_ids_lenient(spark: SparkSession, path: str, n_ids: int) -> DataFrame:
    """The leading id columns of ragged CSV lines, whatever follows them; lines without digits there give nulls."""
    cells = F.split("value", ",", n_ids + 1)
    return spark.read.text(path).select(*(F.regexp_extract(F.coalesce(F.get(cells, F.lit(i)), F.lit("")), "^[ \"]*([0-9]{1,18})[ \"]*$", 1).try_cast("long").alias(f"id_{i}") for i in range(n_ids)))


def ids_from_text(df: DataFrame, text: str, pattern: str) -> DataFrame:
    """Distinct matches of a pattern's first group in free text."""
    return df.select(F.explode(F.regexp_extract_all(text, F.lit(pattern), 1)).alias("id")).distinct()


def append_checked(df: DataFrame, path: str) -> None:
    """Appends to a Parquet table, or refuses and names the columns that are missing or new."""
    have = df.sparkSession.read.parquet(path).columns
    if missing := [c for c in have if c not in df.columns]:
        raise ValueError(f"missing columns: {missing}")
    if extra := [c for c in df.columns if c not in have]:
        raise ValueError(f"new columns: {extra}")
    df.select(*have).write.mode("append").parquet(path)


def write_frozen(df: DataFrame, path: str) -> None:
    """Writes a table once; a second call fails and leaves it as it is."""
    df.write.mode("errorifexists").parquet(path)


def backfill_columns(old: DataFrame, new: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """Old and new rows in one table; what older rows lack has its constant."""
    both = old.unionByName(new, allowMissingColumns=True)
    return both.select(*(F.coalesce(F.col(c), F.lit(defaults[c])).alias(c) if c in defaults else F.col(c) for c in both.columns))


def write_manifest(counts: DataFrame, path: str) -> None:
    """A one-row JSON record of the total and a map of counts by source; sources are few."""
    counts.agg(F.sum("n_ids").alias("total"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "n_ids")))).alias("counts")).coalesce(1).write.json(path)


def _messages(s, d):
    m = B.msgs(s, d)
    return m.select("msg_id", "author", (F.col("author") == "user").alias("inbound"), F.lit("Wed Oct 11 06:55:44 +0000 2017").alias("created_at"), F.concat(F.lit('He said "no",\n'), "text").alias("text"), "reply_to")


def _csv(s, d, columns=None):
    path = new_path(s, "messages")
    write_messages(_messages(s, d), path)
    return read_messages(s, path, columns)


def _log(s, d):
    p, path = B.preds(s, d), new_path(s, "predictions")
    row = lambda ns, seq, label: F.struct(F.lit(ns).alias("namespace"), F.lit(seq).alias("seq"), F.col(label).alias("label"))
    p.select("item", F.explode(F.array(row(None, 1, "a"), row("v1", 2, "b"), row("v2", 3, "b"))).alias("r")).select("item", "r.*").write.json(path)
    return read_predictions(s, path, "v1")


def _ragged(s, d):
    path = new_path(s, "ragged")
    B.table(s, d, "orders").select(F.concat_ws(",", F.col("o_orderkey"), F.when(F.col("o_custkey") % 3 > 0, F.col("o_custkey").cast("string")).otherwise(F.lit("none")), F.lit("a"), F.when(F.col("o_orderkey") % 2 == 0, F.lit("b,\"c"))).alias("value")).write.text(path)
    return read_ids_lenient(s, path, 2).withColumn("id_1", F.coalesce("id_1", F.lit(-1)))


def _appended(s, d):
    path, p = new_path(s, "appended"), B.preds(s, d)
    write_frozen(p.select("item", "a"), path)
    append_checked(p.select(F.col("b").alias("a"), "item"), path)
    return s.read.parquet(path).groupBy("a").agg(F.count("*").alias("n"), F.sum("item").alias("total"))


def _frozen(s, d):
    """A table written once, a second time refused, and what is there then."""
    path, p = new_path(s, "frozen"), B.preds(s, d).select("item", "a")
    write_frozen(p, path)
    try:
        write_frozen(p.where("a = 'en'"), path)
        refused = False
    except AnalysisException:
        refused = True
    return s.read.parquet(path).groupBy("a").agg(F.count("*").alias("n")).withColumn("refused", F.lit(refused))


def _manifest(s, d):
    from convan.operators.threads import used_ids

    path = new_path(s, "manifest")
    write_manifest(used_ids({"documents": (B.table(s, d, "documents"), ["doc_id"]), "labels": (B.table(s, d, "labels"), ["doc_id"])}).where("source <> '*'"), path)
    return s.read.schema("total long, counts map<string, long>").json(path).select("total", F.col("counts")["documents"].alias("documents"), F.col("counts")["labels"].alias("labels"))


_TEXT_TIME = 'date_format(ts, "EEE MMM dd HH:mm:ss") || " +0000 " || date_format(ts, "yyyy")'
QUERIES = {
    "read_messages": lambda s, d: _csv(s, d).withColumn("reply_to", F.coalesce("reply_to", F.lit(-1))),
    "read_columns": lambda s, d: _csv(s, d, ["msg_id", "author"]),
    "parse_tweet_time": lambda s, d: B.table(s, d, "events").select("event_id", F.coalesce(F.unix_seconds(parse_tweet_time(F.when(F.col("event_id") % 7 == 0, "not a time").otherwise(F.expr(_TEXT_TIME)))), F.lit(-1)).alias("seconds")),
    "read_predictions": _log,
    "read_ids_lenient": _ragged,
    "ids_from_text": lambda s, d: ids_from_text(B.table(s, d, "pages"), "html", 'href="([^"]+)"'),
    "append_checked": _appended,
    "write_frozen": _frozen,
    "backfill_columns": lambda s, d: backfill_columns(B.preds(s, d).select("item", "a"), B.preds(s, d).select("item", "a", "b"), {"b": "old"}),
    "write_manifest": _manifest,
}
ORACLE_SQL = {
    "read_messages": f"WITH {B.SQL_MSGS} SELECT msg_id, author, author = 'user' AS inbound, 'Wed Oct 11 06:55:44 +0000 2017' AS created_at, 'He said \"no\",' || chr(10) || text AS text, coalesce(reply_to, -1) AS reply_to FROM msgs",
    "read_columns": f"WITH {B.SQL_MSGS} SELECT msg_id, author FROM msgs",
    "parse_tweet_time": "SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN CAST(floor(epoch(ts)) AS BIGINT) ELSE -1 END AS seconds FROM events",
    "read_predictions": f"WITH {B.SQL_PREDS} SELECT item, a AS label FROM preds",
    "read_ids_lenient": "SELECT o_orderkey::BIGINT AS id_0, CASE WHEN o_custkey % 3 > 0 THEN o_custkey::BIGINT ELSE -1 END AS id_1 FROM orders",
    "ids_from_text": "SELECT DISTINCT unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS id FROM pages",
    "write_frozen": f"WITH {B.SQL_PREDS} SELECT a, count(*) AS n, true AS refused FROM preds GROUP BY a",
    "append_checked": f"WITH {B.SQL_PREDS}, u AS (SELECT item, a FROM preds UNION ALL SELECT item, b FROM preds) SELECT a, count(*) AS n, CAST(sum(item) AS BIGINT) AS total FROM u GROUP BY a",
    "backfill_columns": f"WITH {B.SQL_PREDS} SELECT item, a, 'old' AS b FROM preds UNION ALL SELECT item, a, b FROM preds",
    "write_manifest": "SELECT (SELECT count(DISTINCT doc_id) FROM documents) + (SELECT count(DISTINCT doc_id) FROM labels) AS total, (SELECT count(DISTINCT doc_id) FROM documents) AS documents, (SELECT count(DISTINCT doc_id) FROM labels) AS labels",
}
