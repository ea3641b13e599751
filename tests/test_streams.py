"""Streams with sinks of their own: batches played again, restarts, defined cases."""

import shutil

from pyspark.sql import functions as F

from convan.streaming.streams import score_logged, sinks, split_stream

MSGS = "msg_id long, author string, text string"


def arrive(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def forget(state, batch):
    """Takes the commit of a batch back, as if the run had died before it."""
    for x in (f"{state}/commits/{batch}", f"{state}/commits/.{batch}.crc"):
        shutil.move(x, f"{x}.lost")


def test_two_sinks_over_a_restart_and_a_replay(spark, tmp_path):
    path, out, state = (f"{tmp_path}/{x}" for x in ("in", "out", "state"))
    first = [(1, "user", "call my lawyer"), (2, "user", "  "), (3, "user", None), (4, "user", "x" * 4001), (5, "user", "hello there")]
    got = split_stream(arrive(spark, path, first, MSGS), out, state)
    want = [(1, "lanes", "legal"), (2, "rejects", "empty"), (3, "rejects", "empty"), (4, "rejects", "too_long"), (5, "lanes", "greeting")]
    assert sorted(map(tuple, got.collect())) == want
    stream = arrive(spark, path, [(6, "user", "an agent please"), (7, "user", "")], MSGS)
    want += [(6, "lanes", "human"), (7, "rejects", "empty")]
    assert sorted(map(tuple, split_stream(stream, out, state).collect())) == want
    forget(state, 1)
    assert sorted(map(tuple, split_stream(stream, out, state).collect())) == want == sorted(map(tuple, sinks(spark, out).collect()))
    assert sorted(map(tuple, split_stream(stream, out, state).collect())) == want  # nothing new


def test_keys_are_scored_once_over_batches_restarts_and_replays(spark, tmp_path):
    path, log, state, schema = f"{tmp_path}/in", f"{tmp_path}/log", f"{tmp_path}/state", "k long, v string"
    calls = spark.sparkContext.accumulator(0)

    def score(df):
        counted = df.rdd.map(lambda r: (calls.add(1), r)[1])
        return spark.createDataFrame(counted, df.schema).withColumn("score", F.upper("v"))

    got = score_logged(arrive(spark, path, [(1, "b"), (1, "a"), (2, "c"), (None, "d")], schema), "k", score, log, state)
    assert sorted(map(tuple, got.collect())) == [(1, "a", "A"), (2, "c", "C")] and calls.value == 2
    stream = arrive(spark, path, [(1, "z"), (3, "e"), (3, "e")], schema)
    want = [(1, "a", "A"), (2, "c", "C"), (3, "e", "E")]
    assert sorted(map(tuple, score_logged(stream, "k", score, log, state).collect())) == want and calls.value == 3
    forget(state, 1)
    assert sorted(map(tuple, score_logged(stream, "k", score, log, state).collect())) == want and calls.value == 4  # the batch alone is scored again
    stream = arrive(spark, path, [(2, "y")], schema)
    assert sorted(map(tuple, score_logged(stream, "k", score, log, state).collect())) == want and calls.value == 4
