"""Structured Streaming jobs. Each takes a streaming (or static) table and gives one back; queries run them with availableNow."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convan.functions.scratch import new_path
from convan.operators.evaluation import route
from convan.operators.review import is_bare_greeting
from convan.plans import bindings as B

DEFAULTS = {"user": "auto", "assistant": "auto"}


def triage_stream(messages: DataFrame, longest: int = 4000, *also: str) -> DataFrame:
    """The lane of each message: rejected when empty or too long, greeting, else what the routing policy says. Stateless."""
    rows = messages.select("msg_id", F.col("author").alias("intent"), "text", F.lit(1.0).alias("confidence"), *(F.coalesce(F.col("text").rlike(p), F.lit(False)).alias(n) for n, p in (("legal_sensitive", "(?i)lawyer|legal"), ("abusive_content", "(?i)stupid|idiot"), ("wants_human", "(?i)human|agent"))))
    bad = F.coalesce(F.trim("text"), F.lit("")) == ""
    return route(rows, DEFAULTS).select("msg_id", *also, F.when(bad | (F.length("text") > longest), "reject").when(is_bare_greeting(F.col("text")), "greeting").otherwise(F.col("reason")).alias("lane"))


def split_stream(messages: DataFrame, path: str, state: str, longest: int = 4000) -> DataFrame:
    """Messages triaged into two sinks under path: `lanes` (msg_id, lane) and `rejects` (msg_id, reason: empty or too_long). Gives back both.

    A micro-batch writes its own folder in either sink and replaces what a run of it that didn't finish has left there, so a
    batch that is played again adds nothing. With the same path and state a later run goes on where the last one stopped."""
    spark = messages.sparkSession

    def both(batch: DataFrame, number: int) -> None:
        rows = triage_stream(batch, longest, "text")
        bad = F.col("lane") == "reject"
        reason = F.when(F.coalesce(F.trim("text"), F.lit("")) == "", "empty").otherwise("too_long")
        rows.where(~bad).select("msg_id", "lane").write.mode("overwrite").parquet(f"{path}/lanes/batch={number}")
        rows.where(bad).select("msg_id", reason.alias("reason")).write.mode("overwrite").parquet(f"{path}/rejects/batch={number}")

    messages.writeStream.foreachBatch(both).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return sinks(spark, path)


def sinks(spark: SparkSession, path: str) -> DataFrame:
    """msg_id, sink (lanes or rejects) and what it says, of the sinks that split_stream() has filled."""
    read = lambda name, col: spark.read.schema(f"msg_id long, {col} string, batch long").parquet(f"{path}/{name}").select("msg_id", F.lit(name).alias("sink"), F.col(col).alias("says"))
    return read("lanes", "lane").unionByName(read("rejects", "reason"))


def score_logged(events: DataFrame, key: str, scorer: Callable[[DataFrame], DataFrame], log: str, state: str) -> DataFrame:
    """Each key scored once, whenever it comes again: a micro-batch scores the keys that the append-only log lacks, and appends
    them as a folder of its own. Gives back the log.

    The log takes the place of state in the stream: nothing is kept in memory between batches, and only its key column is read. A
    batch that is played again leaves its own folder out of what is known, and replaces it. Null keys are never scored; of
    rows of a batch with one key the scorer sees one, the least by its columns. scorer keeps the key column."""
    spark = events.sparkSession

    def step(batch: DataFrame, number: int) -> None:
        rows = batch.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.min(F.struct(*batch.columns)).alias("_row")).select("_row.*")
        if number:  # the folder of batch 0 is the first, so there is a log to look into from 1 on
            known = spark.read.parquet(log).where(F.col("batch") != number).select(key)
            rows = rows.join(known.hint("merge"), key, "left_anti")
        scorer(rows).write.mode("overwrite").parquet(f"{log}/batch={number}")

    events.writeStream.foreachBatch(step).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(log).drop("batch")


def score_once(events: DataFrame, key: str, ts: str, delay: str) -> DataFrame:
    """Each key once, also across restarts; state older than the watermark goes. Replays come within the delay."""
    return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def quota_stream(events: DataFrame, key: str, ts: str, length: str, step: str, cap: int, delay: str) -> DataFrame:
    """Sliding windows in which a key has more than cap rows."""
    w = events.withWatermark(ts, delay).groupBy(F.window(ts, length, step).alias("w"), key).agg(F.count("*").alias("calls"))
    return w.where(F.col("calls") > cap).select(key, F.unix_seconds("w.start").alias("start"), "calls")


def stream_windows(events: DataFrame, ts: str, length: str, delay: str) -> DataFrame:
    """Rows, routed rows and mean value of tumbling windows; rows later than the watermark are dropped."""
    w = events.withWatermark(ts, delay).groupBy(F.window(ts, length).alias("w")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "purchase").alias("purchases"), F.round(F.avg("value"), 4).alias("value"))
    return w.select(F.unix_seconds("w.start").alias("start"), "n", "purchases", "value")


def drained(stream: DataFrame, name: str, path: str | None = None, state: str | None = None) -> DataFrame:
    """The stream run over all that is there, and its sink read back. With the same path and state it goes on where it stopped.

    Windows are appended when the watermark passes them, so each is written once, over any number of micro-batches."""
    spark = stream.sparkSession
    path, state = path or new_path(spark, name), state or new_path(spark, "state")
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def _stream(spark: SparkSession, df: DataFrame, files: int | None = None) -> DataFrame:
    """A table as a file stream, written by as many tasks as the table has, or as so many files of which each is a micro-batch."""
    path = new_path(spark, "arrivals")
    (df.repartition(files) if files else df).write.parquet(path)
    stream = spark.readStream.schema(df.schema)
    return (stream.option("maxFilesPerTrigger", 1) if files else stream).parquet(path)


def closed(df: DataFrame, ts: str) -> DataFrame:
    """The rows, and one without values long after the last, so that the watermark passes all windows of the table; its own window stays open."""
    last = df.agg((F.max(ts) + F.expr("INTERVAL 3650 DAYS")).alias(ts)).where(F.col(ts).isNotNull())
    return df.unionByName(last, allowMissingColumns=True)


def _events(s, d):
    return B.table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _replayed(s, d, files):
    """All events twice, the second time as a replay, over several micro-batches."""
    e = _events(s, d).select("event_id", "ts", "event_type")
    return _stream(s, e.unionByName(e), files)


QUERIES = {
    "triage_stream": lambda s, d: drained(triage_stream(_stream(s, B.msgs(s, d))), "triage"),
    "triage_sinks": lambda s, d: split_stream(_stream(s, B.msgs(s, d), 3), new_path(s, "sinks"), new_path(s, "state")),
    "score_once": lambda s, d: score_logged(_replayed(s, d, 3), "event_id", lambda df: df.select("event_id", "event_type"), new_path(s, "log"), new_path(s, "state")),
    "quota_stream": lambda s, d: drained(quota_stream(_stream(s, closed(_events(s, d), "ts")), "user_id", "ts", "1 day", "12 hours", 2, "1 hour"), "quota"),
    "stream_windows": lambda s, d: drained(stream_windows(_stream(s, closed(_events(s, d), "ts")), "ts", "1 day", "1 hour"), "windows"),
}
_TRIAGE = f"""WITH {B.SQL_MSGS}, w AS (SELECT *, regexp_extract_all(lower(coalesce(text, '')), '[a-z'']+') AS w FROM msgs) SELECT msg_id, CASE WHEN coalesce(trim(text), '') = '' OR length(text) > 4000 THEN 'reject'
        WHEN len(w) <= 4 AND len(list_filter(w, lambda x: x IN ('hi', 'hello', 'hey'))) > 0 AND len(list_filter(w, lambda x: x NOT IN ('hi', 'hello', 'hey', 'there', 'all', 'team', 'please', 'thanks'))) = 0 THEN 'greeting'
        WHEN regexp_matches(text, '(?i)lawyer|legal') THEN 'legal' WHEN regexp_matches(text, '(?i)human|agent') THEN 'human' WHEN regexp_matches(text, '(?i)stupid|idiot') THEN 'abuse' WHEN author IN ('user', 'assistant') THEN 'default_auto' ELSE 'unknown_class' END AS lane FROM w"""
ORACLE_SQL = {
    "triage_stream": _TRIAGE,
    "triage_sinks": f"""WITH t AS ({_TRIAGE}), k AS (SELECT conv_id * 1000 + turn AS msg_id, text FROM conversations) SELECT msg_id, CASE WHEN lane = 'reject' THEN 'rejects' ELSE 'lanes' END AS sink,
        CASE WHEN lane <> 'reject' THEN lane WHEN coalesce(trim(text), '') = '' THEN 'empty' ELSE 'too_long' END AS says FROM t JOIN k USING (msg_id)""",
    "score_once": "SELECT event_id, event_type FROM events",
    "quota_stream": "WITH w AS (SELECT user_id, unnest([t, t - 43200]) AS start FROM (SELECT user_id, CAST(floor(epoch(ts) / 43200) AS BIGINT) * 43200 AS t FROM events)) SELECT user_id, start, count(*) AS calls FROM w GROUP BY ALL HAVING count(*) > 2",
    "stream_windows": "SELECT CAST(floor(epoch(ts) / 86400) AS BIGINT) * 86400 AS start, count(*) AS n, count(*) FILTER (event_type = 'purchase') AS purchases, round(avg(value), 4) AS value FROM events GROUP BY 1",
}
