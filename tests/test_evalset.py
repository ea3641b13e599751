"""Evaluation sets: counts of what is left out, pins, and every kind of problem on its own."""

import pytest

from convan.operators import evalset as E

LONG = "this sentence is long enough to hold a window of forty characters and more"


@pytest.fixture(scope="module")
def tables(spark):
    pool = [(1, "In use"), (2, "in use!"), (3, "..."), (4, None), (5, f"quotes: {LONG}"), (6, "Twice"), (7, "twice."), (8, "alone"), (9, "also alone")]
    return spark.createDataFrame([(*r, "x") for r in pool], "k long, t string, why string"), spark.createDataFrame([(1,), (1,), (77,)], "k long"), spark.createDataFrame([(1, LONG)], "r long, t string")


def test_counts_and_context(spark, tables):
    pool, used, refs = tables
    parents = spark.createDataFrame([(8, 4, "said before")], "k long, parent_id long, parent_text string")
    found, counts = E.draw_eval_set(pool, used, refs, "k", "r", "t", 2, 5, parents)
    assert counts.first().asDict() == {"pool": 9, "lost_to_id": 1, "lost_to_text": 3, "lost_to_window": 1, "lost_to_repeats": 1, "eligible": 3, "drawn": 2}
    rows = found.collect()
    assert sorted(r.eval_index for r in rows) == [1, 2] and {r.k for r in rows} <= {6, 8, 9}
    every, _ = E.draw_eval_set(pool, used, refs, "k", "r", "t", 10, 5, parents)
    assert {(r.k, r.parent_text) for r in every.collect()} == {(6, None), (8, "said before"), (9, None)}
    found, counts = E.draw_eval_set(pool.limit(0), used, refs, "k", "r", "t", 2, 5)
    assert found.count() == 0 and set(counts.first()) == {0}


def test_pins(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, None)], "k long, t string"), spark.createDataFrame([(1, "x"), (2, "~~")], "k long, t string")
    pins = lambda **t: E.table_pins({n: (df, ["k", "t"]) for n, df in t.items()})
    got = {r.name: r.state for r in E.table_drift(pins(same=a, gone=a, other=a), pins(same=a.orderBy("t"), other=b, fresh=b)).collect()}
    assert got == {"same": "ok", "gone": "missing", "other": "changed", "fresh": "new"}


@pytest.mark.parametrize(
    "rows, labels, want",
    [
        ([(8, 1), (9, 2)], [8], []),
        ([(1, 1), (9, 2)], [], [("leak", "1")]),
        ([(5, 1), (8, 2)], [], [("quoted", "5")]),
        ([(8, 1), (8, 2)], [], [("repeated_id", "8")]),
        ([(6, 1), (7, 2)], [], [("repeated_text", "6"), ("repeated_text", "7")]),
        ([(8, 1), (9, 3)], [], [("index_gap", None)]),
        ([(8, 0), (9, 1)], [], [("index_gap", None)]),
        ([(8, 1)], [9, 9], [("label_outside", "9")]),
        ([], [], []),
    ],
)
def test_each_problem(spark, tables, rows, labels, want):
    pool, used, refs = tables
    items, marks = spark.createDataFrame(rows, "k long, eval_index int"), spark.createDataFrame([(x,) for x in labels], "k long")
    clean, pinned = spark.createDataFrame([("documents", "ok")], "name string, state string"), E.table_pins({"set": (items, ["k", "eval_index"])})
    check = lambda items, drift: sorted(map(tuple, E.eval_set_problems(items, pool, used, refs, marks, drift, pinned, "k", "r", "t").collect()))
    assert check(items, clean) == want
    if not want and rows:
        assert check(items.withColumn("eval_index", items.eval_index * 1 + 0), clean.replace("ok", "changed")) == [("drift", "documents")]
        assert check(spark.createDataFrame([(9, 1), (8, 2)], "k long, eval_index int"), clean) == [("set_changed", None)]


def test_contaminated_reads_texts_once(spark):
    """One pass over the texts, long ones, short ones and blank ones; windows at every place of a text over several blocks."""
    from convan.operators.text import contaminated

    quote = "a quoted passage of more than forty letters in all"
    filler = " ".join(f"word{i}" for i in range(300))
    rows = [(0, None), (1, " "), (2, "Short, one"), (3, "other short"), (4, filler)] + [(10 + i, filler[: i * 37] + " zz " + quote + " zz " + filler) for i in range(30)]
    refs = spark.createDataFrame([(1, quote), (2, "short one"), (3, None)], "ref long, text string")
    df = spark.createDataFrame(rows, "doc long, text string")
    out = contaminated(df, refs, "doc", "ref", "text")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert sum("doc#" in line and "Relation" in line or "LogicalRDD [doc#" in line for line in plan.splitlines()) == 1
    assert {(r.doc, r.hits) for r in out.collect()} == {(2, 1)} | {(10 + i, len(quote) - 39) for i in range(30)}


@pytest.mark.parametrize(
    "rows, labels, changed, want",
    [
        ([(8, 1), (9, 2)], [(8, 1)], False, []),
        ([(1, 1), (5, 2)], [], False, [("leak", "1"), ("quoted", "5")]),
        ([(6, 1), (7, 2)], [], True, [("drift", "documents"), ("repeated_text", "6"), ("repeated_text", "7"), ("set_changed", None)]),
        ([(8, 1), (8, 3)], [], False, [("index_gap", None), ("repeated_id", "8")]),
        ([(8, 1), (9, 2), (6, 3)], [(6, 1), (6, 1), (9, 1), (8, 0), (77, None)], False, [("label_beyond", "6"), ("label_of_other_set", "77"), ("label_of_other_set", "8"), ("label_outside", "77")]),
    ],
)
def test_verify_eval_set_takes_every_step(spark, tables, rows, labels, changed, want):
    """Of a set of which two items are scored; a label is for this set (1), an older one (0), or doesn't say (null)."""
    from convan.operators.judging import verify_eval_set

    pool, used, refs = tables
    items, drift = spark.createDataFrame(rows, "k long, eval_index int"), spark.createDataFrame([("documents", "changed" if changed else "ok")], "name string, state string")
    pinned = E.table_pins({"set": (items.limit(1) if changed else items, ["k", "eval_index"])})
    own = pinned.first()["xor"]
    marks = spark.createDataFrame([(k, {1: own, 0: "0" * 16}.get(x)) for k, x in labels], "k long, set_hash string")
    got = verify_eval_set(items, pool, used, refs, marks, drift, pinned, "k", "r", "t", 2).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
