"""Defined cases that the test tables don't hold: nulls, empty tables, ties and refusals."""

import pytest
from pyspark.sql import functions as F

from convan.functions.scratch import new_path, ranked
from convan.operators.editing import apply_edits
from convan.operators.evaluation import assemble, calibration_gap, confusion_matrix, fingerprint, route
from convan.operators.guard import HOSTS, NO_CONTENT, STOP_WORDS, guard_verdicts, is_generic, sanitize
from convan.operators.judging import version_classes, version_moves
from convan.operators.policies import route_triggers, select_rule, vote_summary
from convan.operators.review import flags_from_string, has_flag, migrate_categories, rank_correlation
from convan.operators.sampling import coverage_plan, stratified_folds
from convan.operators.text import contaminated
from convan.operators.threads import dedupe
from convan.operators.vectors import vector_top_k
from convan.sources.files import append_checked, parse_tweet_time, read_messages, write_frozen


def test_ranks_cover_each_class_also_null(spark):
    df = spark.createDataFrame([(i, None if i % 3 == 0 else "x") for i in range(200)], "id long, c string").repartition(7)
    got = {r.id: r.rank for r in ranked(df, [F.col("id")], ("c",)).collect()}
    for keep in (lambda i: i % 3 == 0, lambda i: i % 3):
        assert [got[i] for i in range(200) if keep(i)] == list(range(1, sum(1 for i in range(200) if keep(i)) + 1))


def test_dedupe_puts_nulls_last(spark):
    df = spark.createDataFrame([("k", None, 1), ("k", 5, 2), ("k", 3, 3), (None, None, 4)], "k string, o int, v int")
    assert {r.k: r.v for r in dedupe(df, ["k"], ["o"], "first").collect()} == {"k": 3, None: 4}
    assert {r.k: r.v for r in dedupe(df, ["k"], ["o"], "last").collect()} == {"k": 2, None: 4}


def test_vector_search_leaves_out_unusable_vectors_and_breaks_ties_by_id(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [3.0, 0.0]), (4, [0.0, 0.0]), (5, None), (6, []), (7, [-1.0, 0.0])], "id long, v array<double>")
    got = vector_top_k(df.where("id = 2"), df, "id", "v", 5, block=2).orderBy("rank").collect()
    assert [(r.doc_id, r.similarity) for r in got] == [(1, 1.0), (3, 1.0)]
    assert vector_top_k(df.where("id < 0"), df, "id", "v", 5).count() == 0


def test_guard_takes_null_and_empty_texts(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "see https://bad.test/a and https://www.example.com/b"), (4, "Hi [Name]")], "id long, t string")
    assert [(r.ok, r.note) for r in guard_verdicts(df, "id", "t", HOSTS).orderBy("id").collect()] == [(True, ""), (True, ""), (False, "https://bad.test/a"), (False, "[Name]")]
    out = sanitize(df, "id", "t", HOSTS).orderBy("id").collect()
    assert [(r.text, r.ok) for r in out] == [("", False), ("", False), ("see and https://www.example.com/b", False), ("Hi", False)]
    assert [r.g for r in df.orderBy("id").select(is_generic(F.col("t"), STOP_WORDS + NO_CONTENT).alias("g")).collect()] == [True, True, False, True]


def test_blank_edits_keep_the_label(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id long, l string")
    edits = spark.createDataFrame([(1, " ", "r"), (3, "c", "q")], "id long, label string, rule string")
    assert [(r.label, r.rule, r.changed) for r in apply_edits(base, edits, "id", "l").orderBy("id").collect()] == [("a", None, False), ("b", None, False), ("c", "q", True)]


def test_votes_without_labels_have_no_majority(spark):
    runs = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, None), (2, "fr"), (2, None)], "item long, label string")
    base = spark.createDataFrame([(1, "a")], "item long, label string")
    got = {r.item: (r.n_unique, r.all_agree, r.majority, r.any_risky, r.complete) for r in vote_summary(runs, base, "item", 3, ["fr"]).collect()}
    assert got == {1: (2, False, "a", False, True), 2: (1, False, None, True, True)}


def test_base_rule_stays_when_none_is_worth_it(spark):
    scores = spark.createDataFrame([("a", 5, 4, 1), ("b", 20, 3, 9)], "rule string, escalated long, missed long, false_alarms long")
    assert select_rule(scores, "a").first().rule == "a"


def test_refusals(spark):
    df, path = spark.createDataFrame([(1, "a")], "id long, l string"), new_path(spark, "t")
    write_frozen(df, path)
    with pytest.raises(Exception, match="(?i)exist"):
        write_frozen(df, path)
    with pytest.raises(ValueError, match=r"missing columns: \['l'\]"):
        append_checked(df.select("id"), path)
    with pytest.raises(ValueError, match=r"new columns: \['z'\]"):
        append_checked(df.withColumn("z", F.lit(1)), path)
    with pytest.raises(ValueError, match="unknown triggers"):
        route_triggers(df, {}, ["nothing"], df, "id")


def test_times_and_csv(spark, tmp_path):
    times = spark.createDataFrame([("Wed Oct 11 06:55:44 +0000 2017",), ("later",), (None,)], "t string").select(parse_tweet_time(F.col("t")).cast("long").alias("s"))
    assert [r.s for r in times.collect()] == [1507704944, None, None]
    (tmp_path / "m.csv").write_text('msg_id,author,inbound,created_at,text,reply_to\n1,u,true,x,"a ""b""\n😀",\n')
    r = read_messages(spark, f"file://{tmp_path}/m.csv").first()
    assert (r.text, r.inbound, r.reply_to) == ('a "b"\n😀', True, None)


def test_route_in_order(spark):
    flags = ("triage", "disputes", "legal_sensitive", "wants_human", "churn_risk", "abusive_content")
    rows = [(0, "en", 0.1, *[True] * 6)] + [(k, "en", 0.9, *[i >= k - 1 for i in range(6)]) for k in range(1, 8)] + [(8, "fr", 0.9, *[None] * 6), (9, "xx", 0.9, *[False] * 6), (10, "en", None, *[False] * 6), (11, "en", 0.4, *[False, *[True] * 5])]
    df = spark.createDataFrame(rows, "item int, intent string, confidence double, " + ", ".join(f"{f} boolean" for f in flags))
    got = {r.item: (r.reason, r.pred) for r in route(df, {"en": "auto", "fr": "escalate"}).collect()}
    want = ["triage", "triage", "disputing_turn", "legal", "human", "churn", "abuse", "default_auto", "default_escalate", "unknown_class", "low_confidence", "low_confidence"]
    assert got == {i: (x, x != "default_auto") for i, x in enumerate(want)}
    assert route(df.select("item", "intent", "confidence"), {"en": "auto"}).where("item = 1").first().reason == "default_auto"


def test_assemble_counts_missing_as_wrong_and_escalated(spark):
    gold = spark.createDataFrame([(1, "en", False), (2, None, True), (3, "de", False)], "item int, gold string, escalate boolean")
    preds = spark.createDataFrame([(1, "a", "en", False), (2, "a", None, None), (9, "a", "en", False)], "item int, version string, intent string, pred boolean")
    got = {r.item: tuple(r)[3:] for r in assemble(gold, preds, ["a", "b"]).collect()}
    lost = ("__missing__", False, True)
    assert got == {1: ("en", True, False, *lost), 2: (*lost, *lost), 3: (*lost, *lost)}
    m = {r.gold: tuple(r)[1:] for r in confusion_matrix(assemble(gold, preds, ["a", "b"]), "gold", "a_intent", ["en", "de"]).collect()}
    assert m == {"en": (1, 0, 0), None: (0, 0, 1), "de": (0, 0, 1)}


def test_contaminated_at_every_offset(spark):
    """A shared window is found wherever it lies in a text, over block borders too."""
    item = "the quick brown fox jumps over the lazy dog again and again until night"
    texts = [(k, "z" * k + " " + item[5:45] + " " + "y" * (700 - k)) for k in range(0, 700, 13)] + [(1000, item[5:44]), (1001, None), (1002, "short one"), (1003, "z" * 900)]
    refs = spark.createDataFrame([(1, item), (2, "short one"), (3, None)], "item_id int, text string")
    got = {r.doc_id: r.hits for r in contaminated(spark.createDataFrame(texts, "doc_id int, text string"), refs, "doc_id", "item_id", "text").collect()}
    own = {i: len({t[a : a + 40] for a in range(len(t) - 39)} & {item[a : a + 40] for a in range(len(item) - 39)}) for i, t in texts if t and len(t) >= 40}
    assert got == {i: n for i, n in own.items() if n} | {1002: 1}


def test_flag_strings(spark):
    df = spark.createDataFrame([(" a;; b ,c",), ("",), (None,)], "t string")
    got = df.select(flags_from_string(F.col("t")).alias("f"), has_flag(F.col("t"), "b").alias("h")).collect()
    assert [(r.f, r.h) for r in got] == [(["a", "b", "c"], True), ([], False), ([], False)]


def test_dissolved_categories(spark):
    df = spark.createDataFrame([(1, "x", 9), (2, "x", 1), (3, "x", None), (4, "y", 9), (5, None, 9)], "id long, c string, v int")
    got = {r.id: r.category for r in migrate_categories(df, "id", "c", {"y": "z"}, {"x": [("v > 5", "big"), ("v > 0", "small")]}).collect()}
    assert got == {1: "big", 2: "small", 3: None, 4: "z", 5: None}


def test_rank_correlation(spark):
    df = spark.createDataFrame([("g", 1, 1), ("g", 2, 2), ("g", 2, 3), ("g", 4, 5), ("h", 1, 2), ("h", 1, 3), ("i", None, 1)], "g string, a int, b int")
    assert {r.g: r.spearman for r in rank_correlation(df, "a", "b", "g").collect()} == {"g": 0.948683, "h": None}


def test_calibration_gap_needs_rows(spark):
    df = spark.createDataFrame([(0.1, False)] * 20 + [(0.9, True)] * 19 + [(None, True)], "s double, h boolean")
    assert calibration_gap(df, "s", "h").first().asDict() == {"n_low": 20, "n_high": 19, "low": 0.0, "high": 1.0, "gap": None}
    assert calibration_gap(df.unionByName(df), "s", "h").first().gap == 1.0


def test_fingerprints(spark):
    a = spark.createDataFrame([(1, "x\r\ny"), (2, None)], "k long, t string")
    b = spark.createDataFrame([(2, None), (1, "x\ny")], "k long, t string")
    turned = spark.createDataFrame([(2, "x\ny"), (1, None)], "k long, t string")
    one = lambda df, order=None: fingerprint(df, ["t"], order).first()
    assert one(a) == one(b) == one(turned)
    assert one(a, ["k"]) == one(b, ["k"]) != one(turned, ["k"])
    assert one(a.limit(0)).xor == "0" * 16


def test_folds_and_plan_by_class(spark):
    df = spark.createDataFrame([(i, "a" if i < 8 else "b") for i in range(11)], "id long, c string")
    assert {r.fold for r in stratified_folds(df, "id", "c", 5, 1).collect()} == {0, 1, 2}
    got = {r.c: (r.have, r.need, r.available) for r in coverage_plan(df, df.where("id < 3"), "c", 5, ["a", "b", "none"]).collect()}
    assert got == {"a": (8, 0, 3), "b": (3, 2, 0), "none": (0, 5, 0)}


def test_moved_labels(spark):
    df = spark.createDataFrame([(1, "x", "x", "y"), (2, "y", "x", "y"), (3, "z", "x", "y"), (4, "x", "x", None), (5, "x", "x", "x")], "id long, p string, o string, n string")
    assert {r.id: (r.effect, r.excluded) for r in version_moves(df, "id", "p", "o", "n").collect()} == {1: (-1, False), 2: (1, False), 3: (0, False), 4: (0, True)}
    assert {r.cls: r.change for r in version_classes(df, "p", "o", "n").collect()} == {"x": "improved", "y": "not comparable"}


def _arrive(spark, path, days):
    from datetime import datetime, timedelta

    rows = [(i, datetime(2024, 1, 1, 12) + timedelta(days=d), "view", 1.0) for i, d in days]
    spark.createDataFrame(rows, "event_id long, ts timestamp, event_type string, value double").coalesce(1).write.mode("append").parquet(path)


def test_late_rows_are_dropped_and_windows_written_once(spark, tmp_path):
    from convan.streaming.streams import drained, stream_windows

    path = f"file://{tmp_path}/in"
    for days in ([(1, 0), (2, 0), (3, 1)], [(4, 20)], [(5, 0), (6, 21)], [(7, 60)], [(8, 61)]):
        _arrive(spark, path, days)
    arrivals = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = drained(stream_windows(arrivals, "ts", "1 day", "1 hour"), "late", f"file://{tmp_path}/out", f"file://{tmp_path}/state").collect()
    start = min(r.start for r in got)
    assert sorted(((r.start - start) // 86400, r.n) for r in got) == [(0, 2), (1, 1), (20, 1), (21, 1), (60, 1)]


def test_keys_are_scored_once_across_a_restart(spark, tmp_path):
    from convan.streaming.streams import drained, score_once

    path, out, state = (f"file://{tmp_path}/{x}" for x in ("in", "out", "state"))
    seen = []
    for days in ([(1, 0), (2, 1), (1, 0)], [(1, 0), (2, 1), (3, 2)]):
        _arrive(spark, path, days)
        arrivals = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
        seen.append(sorted(r.event_id for r in drained(score_once(arrivals, "event_id", "ts", "30 days"), "once", out, state).collect()))
    assert seen == [[1, 2], [1, 2, 3]]


def test_conflicting_pairs_equal_brute_force(spark):
    import random
    from itertools import combinations

    from convan.operators.text import conflicting_pairs, tfidf

    draw = random.Random(5)
    words = [f"w{i}" for i in range(12)]
    rows = [(i, " ".join(draw.choices(words, k=draw.randint(1, 9))), draw.choice("ab")) for i in range(120)]
    rows += [(i + 200, t, x) for i, t, x in rows[:40]] + [(900, None, "a"), (901, "", "b"), (902, "w1 w2", None)]
    df = spark.createDataFrame(rows, "id long, text string, label string")
    got = {(r.a, r.b): (r.n_pairs, r.similarity) for r in conflicting_pairs(df, "id", "text", "label", 0.45).collect()}
    assert got == {(r.a, r.b): (r.n_pairs, r.similarity) for r in conflicting_pairs(df, "id", "text", "label", 0.45, postings=7).collect()}  # terms dealt into buckets
    classes = {}
    for i, t, x in rows:
        if x is not None:
            classes.setdefault((t or "", x), []).append(i)
    reps = spark.createDataFrame([(min(ids), t) for (t, _), ids in classes.items()], "id long, text string")
    vectors = {}
    for r in tfidf(reps, "id", "text", 1, 1.0).collect():
        vectors.setdefault(r.id, {})[r.term] = r.w
    want = {}
    for ((_, x), p), ((_, y), q) in combinations(classes.items(), 2):
        a, b = sorted((min(p), min(q)))
        sim = round(sum(w * vectors.get(b, {}).get(t, 0) for t, w in vectors.get(a, {}).items()), 6)
        if x != y and sim >= 0.45:
            want[a, b] = (len(p) * len(q), sim)
    assert len(want) > 10 and got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 2e-6 for k in want)


def test_text_classifier_on_rows_not_seen(spark):
    from convan.operators.models import QUERIES, fit_text_classifier

    rows = QUERIES["out_of_fold"](spark, "/root/testdata/sf0.01").toPandas()
    assert rows["doc_id"].is_unique and rows["fold"].nunique() == 5
    assert (rows["lang"] == rows["predicted"]).mean() > 0.9
    with pytest.raises(ValueError):
        fit_text_classifier(spark.createDataFrame([("a", "x")] * 9, "text string, label string"), "text", "label")


def test_hits_in_order_of_the_text(spark):
    """Starts in characters, also behind letters beyond 16 bits; families that overlap; a text of many hits."""
    import re

    from convan.operators.guard import FAMILIES, placeholder_hits

    texts = ["[a] 🙂é {b} [c]", "{{x}} at http://bad.test/q and https://example.org", "@12345@67890[Z]", "", None, "__name__ " * 300 + "[end]"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = [(r.id, r.start, r.name, r.match) for r in placeholder_hits(df, "id", "t", HOSTS).orderBy("id", "nth").collect()]
    want = []
    for i, t in enumerate(texts):
        found = [(m.start(), n, m[0]) for n, p in FAMILIES.items() for m in re.finditer(p, t or "")]
        found += [(m.start(), "unverified_url", m[0]) for m in re.finditer(r"https?://[^ )]+", t or "") if "bad" in m[0]]
        want += [(i, *x) for x in sorted(found)]
    assert got == want and len(got) > 300
    only = placeholder_hits(df, "id", "t", HOSTS, {"mine": "at"}).collect()
    assert {(r.name, r.start) for r in only} == {("mine", 6), ("unverified_url", 9)}


def test_quota_of_a_hot_key_is_dealt_by_time(spark):
    """Half of all rows of one key, over many spans, ties, rows at the very edge of the window and rows without a time; no task sees more than its spans."""
    import random
    from collections import Counter
    from datetime import datetime, timedelta

    from convan.operators.evaluation import over_quota

    draw, start = random.Random(2), datetime(2024, 1, 1)
    rows = [(i, 0 if i % 2 else draw.randint(1, 9), start + timedelta(seconds=draw.choice([draw.randint(0, 4000), 60 * draw.randint(0, 60)])), "x") for i in range(800)] + [(900 + i, 0, None, "x") for i in range(3)]
    df = spark.createDataFrame(rows, "id int, user int, t timestamp, calls_before string")
    got = {(r.id, r.calls) for r in over_quota(df, "user", "t", 60, 2).collect()}
    want = set()
    for i, u, t, _ in rows:
        n = sum(v == u and (s is None if t is None else s is not None and t - timedelta(seconds=60) <= s <= t) for _, v, s, _ in rows)
        if n > 2:
            want.add((i, n))
    assert got == want and any(t is None for i, _, t, _ in rows if i in {x for x, _ in got})
    spread = Counter((r.user, int((r.t - start).total_seconds()) // 60) for r in df.where("t is not null").collect())
    assert max(spread.values()) < 0.1 * len(rows)


def test_steps_of_a_fit_have_few_tasks(spark):
    """A table of 24 files: only what reads it once has a task for each, not the steps of the fits, whose tasks send a gradient each."""
    from convan.operators.models import fit_text_classifier, out_of_fold, predict

    names = {"spark.sql.files.maxPartitionBytes": "64k", "spark.sql.files.openCostInBytes": "64k", "spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    sc = spark.sparkContext._jsc.sc()
    none = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)

    def wide() -> int:
        sc.listenerBus().waitUntilEmpty(30_000)
        return sum(s.numTasks() > 8 and "treeAggregate" in s.name() for s in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(sc.statusStore().stageList(None, False, False, none, None)))

    try:
        rows = [(i, f"{'ab cd ef' if i % 3 else 'gh ij kl'} w{i % 7} w{i % 11}", "xy"[i % 3 > 0]) for i in range(240)]
        df = spark.createDataFrame(rows, "id long, text string, label string").repartition(24)
        before = wide()
        out = out_of_fold(df, "id", "text", "label", features=256).collect()
        assert len(out) == 240 and all(r.label == r.predicted for r in out)
        assert all(r.label == r.predicted for r in predict(fit_text_classifier(df, "text", "label", features=256), df, "text").collect())
        assert wide() == before
    finally:
        for n, v in old.items():
            spark.conf.set(n, v)
