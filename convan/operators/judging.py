"""Scores of replies by several judges, and checks of evaluation sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convan.functions.scratch import ranked, saved
from convan.operators.editing import _EVAL, _docs, build_eval_set
from convan.operators.evalset import _PINS, _drift, eval_set_problems, table_pins
from convan.plans import bindings as B



def field_agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """Equal values (blank equals blank), rows where both are blank, and distinct values of either."""
    x, y = F.coalesce(F.col(a), F.lit("")), F.coalesce(F.col(b), F.lit(""))
    return df.agg(F.count("*").alias("n"), F.round(F.avg((x == y).cast("double")), 6).alias("exact"), F.count_if((x == "") & (y == "")).alias("both_blank"), F.countDistinct(x).alias("values_a"), F.countDistinct(y).alias("values_b"))


def field_distribution(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rows of each value in either of two columns; blank and null are one value."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f), F.lit("")).alias("value")) for f in (a, b)))).alias("x"))
    return long.groupBy("x.field", "x.value").agg(F.count("*").alias("n"))


def flag_agreement(df: DataFrame, a: str, b: str, flags: list[str]) -> DataFrame:
    """Precision, recall and F1 of each flag in a set column b against a; a flag that neither sets is marked as never set."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(f).alias("flag"), F.array_contains(a, f).alias("t"), F.array_contains(b, f).alias("p")) for f in flags))).alias("x")).select("x.*")
    c = long.groupBy("flag").agg(F.count_if(F.col("t") & F.col("p")).alias("h"), F.count_if("t").alias("t"), F.count_if("p").alias("p"))
    share = lambda n, m: F.round(F.coalesce(n / F.nullif(m, F.lit(0)), F.lit(0.0)), 6)
    return c.select("flag", share(F.col("h"), F.col("p")).alias("precision"), share(F.col("h"), F.col("t")).alias("recall"), share(2 * F.col("h"), F.col("p") + F.col("t")).alias("f1"), (F.col("p") + F.col("t") == 0).alias("never_set"))


def window_accuracy(df: DataFrame, key: str, gold: str, pred: str) -> DataFrame:
    """Accuracy by chunks of an order: max(10, n // 5) rows each, chunks under 5 rows left out."""
    r = ranked(df.select(key, (F.col(gold) == F.col(pred)).cast("double").alias("_hit")), [F.col(key)])
    size = r.agg(F.greatest(F.lit(10), F.floor(F.count("*") / 5)).alias("_size"))  # one row
    chunk = F.floor((F.col("rank") - 1) / F.col("_size")).alias("chunk")
    return r.crossJoin(F.broadcast(size)).groupBy(chunk).agg(F.count("*").alias("n"), F.round(F.avg("_hit"), 6).alias("accuracy")).where("n >= 5")


def window_range(windows: DataFrame) -> DataFrame:
    """Windows, the least and greatest accuracy among them, and the range."""
    return windows.agg(F.count("*").alias("n_windows"), F.min("accuracy").alias("least"), F.max("accuracy").alias("most"), F.round(F.max("accuracy") - F.min("accuracy"), 6).alias("range"))


def boundary_table(df: DataFrame, gold: str, a: str, b: str, sides: dict[str, tuple[list[str], list[str]]]) -> DataFrame:
    """Per pair of class sets, over rows whose gold label is in either: accuracy of two versions, and errors across the boundary."""
    cells = []
    for name, (left, right) in sides.items():
        inside = F.col(gold).isin(left) | F.col(gold).isin(right)
        across = lambda c, left=left, right=right: (F.col(gold).isin(left) & F.col(c).isin(right)) | (F.col(gold).isin(right) & F.col(c).isin(left))
        cells.append(F.struct(F.lit(name).alias("side"), inside.alias("inside"), across(a).alias("x"), across(b).alias("y")))
    long = df.select((F.col(a) == F.col(gold)).alias("ra"), (F.col(b) == F.col(gold)).alias("rb"), F.explode(F.array(*cells)).alias("c")).where("c.inside")
    return long.groupBy("c.side").agg(F.count("*").alias("n"), F.count_if("ra").alias("right_a"), F.count_if("rb").alias("right_b"), F.count_if("c.x").alias("cross_a"), F.count_if("c.y").alias("cross_b"), F.count_if(F.col("c.x") & ~F.col("c.y")).alias("cross_fixed"), F.count_if(~F.col("c.x") & F.col("c.y")).alias("cross_new"))


def version_effect(df: DataFrame, pred: str, versions: list[str]) -> DataFrame:
    """Accuracy of one prediction under each version of the labels; a null label can't be scored. One pass."""
    long = df.select(pred, F.explode(F.array(*(F.struct(F.lit(v).alias("version"), F.col(v).alias("label")) for v in versions))).alias("x"))
    return long.groupBy("x.version").agg(F.count("*").alias("n_rows"), F.count("x.label").alias("n_scored"), F.count_if(F.col("x.label") == F.col(pred)).alias("n_right"))


def version_moves(df: DataFrame, key: str, pred: str, old: str, new: str) -> DataFrame:
    """Rows whose label moved from one version to the next, with the effect on the prediction's score: 1, -1 or 0; excluded where either label is null (then 0)."""
    hit = lambda v: (F.col(v) == F.col(pred)).cast("int")
    return df.where(~F.col(old).eqNullSafe(F.col(new))).select(key, F.col(old).alias("old"), F.col(new).alias("new"), F.coalesce(hit(new) - hit(old), F.lit(0)).alias("effect"), (F.col(old).isNull() | F.col(new).isNull()).alias("excluded"))


def version_classes(df: DataFrame, pred: str, old: str, new: str) -> DataFrame:
    """Per class that either version has: accuracy under each, and whether it improved, worsened or stayed; a class that a version lacks has no accuracy there and counts as not comparable."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(v).alias("v"), F.col(c).alias("cls"), (F.col(c) == F.col(pred)).cast("double").alias("hit")) for v, c in (("old", old), ("new", new))))).alias("x")).select("x.*").where("cls is not null")
    per = long.groupBy("cls").agg(*(F.round(F.avg(F.when(F.col("v") == v, F.col("hit"))), 6).alias(v) for v in ("old", "new")))
    return per.withColumn("change", F.when(F.col("old").isNull() | F.col("new").isNull(), "not comparable").when(F.col("new") > F.col("old"), "improved").when(F.col("new") < F.col("old"), "worsened").otherwise("same"))


def adjudication_rollup(df: DataFrame, cls: str, verdict: str) -> DataFrame:
    """Verdicts per class: for the label, for the model, open, and the accuracy now, after, and at best (open rows won)."""
    v = F.col(verdict)
    return df.groupBy(cls).agg(F.count("*").alias("n"), F.count_if(v == "gold").alias("for_gold"), F.count_if(v == "model").alias("for_model"), F.count_if(v == "open").alias("open"), F.round(F.avg((v == "right").cast("double")), 6).alias("now"), F.round(F.avg(v.isin("right", "model").cast("double")), 6).alias("after"), F.round(F.avg(v.isin("right", "model", "open").cast("double")), 6).alias("at_best"))


def verdict_counts(df: DataFrame, by: str, verdict: str, verdicts: list[str]) -> DataFrame:
    """Rows of each value of `by` (a class, a side) with each verdict, and in all; null values are a group."""
    return df.groupBy(by).agg(F.count("*").alias("n"), *(F.count_if(F.col(verdict) == v).alias(f"n_{v}") for v in verdicts))


def settling_rules(df: DataFrame, key: str, verdict: str, rule: str, unsettled: str = "open", residual: str = "residual") -> DataFrame:
    """Of the rows without a verdict: how many each rule settles, and the smallest key; rows without a rule are residual, which nothing settles."""
    left = df.where(F.col(verdict) == unsettled).groupBy(F.coalesce(F.nullif(F.trim(rule), F.lit("")), F.lit(residual)).alias("rule"))
    return left.agg(F.count("*").alias("n"), F.min(key).alias("first")).withColumn("settled", F.col("rule") != residual)


def rule_violations(df: DataFrame, key: str, label: str, rule: str, winners: dict[str, list[str]], excludes: dict[str, list[str]], exceptions: list[int]) -> DataFrame:
    """Labels that contradict their recorded rule: not a winner of it, or excluded by it; known exceptions are marked."""
    problem = None
    for r, ok in winners.items():
        c = (F.col(rule) == r) & ~F.col(label).isin(ok)
        problem = F.when(c, "not_winner") if problem is None else problem.when(c, "not_winner")
    for r, no in excludes.items():
        c = (F.col(rule) == r) & F.col(label).isin(no)
        problem = F.when(c, "excluded") if problem is None else problem.when(c, "excluded")
    return df.select(key, rule, label, problem.alias("problem"), F.col(key).isin(exceptions).alias("known")).where("problem is not null")


def stale_exceptions(df: DataFrame, key: str, violations: DataFrame, exceptions: list[int]) -> DataFrame:
    """Listed exceptions that aren't real any more: their row is gone, or breaks no rule now."""
    listed = df.sparkSession.createDataFrame([(e,) for e in sorted(set(exceptions))], f"{key} long")
    there = df.where(F.col(key).isin(exceptions)).select(key).distinct().withColumn("_there", F.lit(True))
    out = listed.join(violations.where("known").select(key).hint("merge"), key, "left_anti").join(there.hint("merge"), key, "left")
    return out.select(key, F.when(F.col("_there"), "no violation").otherwise("no row").alias("reason"))


def score_table(evals: DataFrame) -> DataFrame:
    """Mean score and share of deflections per judge, rubric and config; groups are never pooled. Marks judges of the config's own family."""
    g = evals.groupBy("judge", "rubric", "config").agg(F.count("*").alias("n"), F.round(F.avg("overall"), 6).alias("overall"), F.round(F.avg(F.col("deflects").cast("double")), 6).alias("deflection"))
    return g.withColumn("same_family", F.substring_index("judge", "/", 1) == F.substring_index("config", ":", 1))


def judge_pair(evals: DataFrame, a: str, b: str) -> DataFrame:
    """Two judges on the items and configs that both scored under the rubric that most judges used (of several the last by
    name), each by its last verdict: agreement of scores and of the deflection flag."""
    used = evals.groupBy("rubric").agg(F.countDistinct("judge").alias("n")).agg(F.max_by("rubric", F.struct("n", "rubric")).alias("rubric"))  # one row
    evals = evals.join(F.broadcast(used), "rubric", "left_semi")
    last = lambda j, n: evals.where(F.col("judge") == j).groupBy("item", "config").agg(F.max_by("overall", F.struct("at", "overall")).alias(n), F.max_by("deflects", F.struct("at", "overall")).alias(f"_{n}"))
    p = last(a, "x").join(last(b, "y").hint("merge"), ["item", "config"])
    return p.agg(F.count("*").alias("n"), F.count_if(F.col("x") == F.col("y")).alias("exact"), F.count_if(F.abs(F.col("x") - F.col("y")) <= 1).alias("within_1"), F.round(F.avg(F.col("x") - F.col("y")), 6).alias("bias"), F.round(F.avg(F.col("_x").eqNullSafe(F.col("_y")).cast("double")), 6).alias("same_flag"))


def fixed_text_spread(evals: DataFrame) -> DataFrame:
    """Configs whose replies are one fixed text: range, deviation, mean and flags of their scores. Replies are compared by hash."""
    g = evals.groupBy("config").agg(F.min(F.md5("reply")).alias("_a"), F.max(F.md5("reply")).alias("_b"), (F.max("overall") - F.min("overall")).alias("range"), F.round(F.stddev_samp("overall"), 6).alias("std"), F.round(F.avg("overall"), 6).alias("mean"), F.count_if("deflects").alias("flags"))
    return g.where("_a = _b").drop("_a", "_b")


def config_label(kind: Column, version: Column, filter_: Column, temperature: Column, tag: Column, production: float) -> Column:
    """kind:version[:filter][:tTEMPERATURE][:tag]; a part that is blank, null or the production temperature leaves no trace."""
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    shown = F.regexp_replace(temperature.cast("double").cast("string"), r"\.0$", "")
    return F.concat_ws(":", blank(kind), blank(version), blank(filter_), F.when(temperature != production, F.concat(F.lit("t"), shown)), blank(tag))


def list_configs(evals: DataFrame, label: Column) -> DataFrame:
    """Labels of configs with their numbers of items."""
    return evals.groupBy(label.alias("config")).agg(F.countDistinct("item").alias("n_items"))


def prefix_unchanged(log: DataFrame, then: DataFrame, seq: str, value: str) -> DataFrame:
    """Of the rows that a log had then: how many are lost, changed, or as they were; and rows added since."""
    p, n = then.select(seq, F.md5(value).alias("_p"), F.lit(1).alias("_was")), log.select(seq, F.md5(value).alias("_n"), F.lit(1).alias("_is"))
    j = p.join(n.hint("merge"), seq, "full")
    both = F.col("_was").isNotNull() & F.col("_is").isNotNull()
    return j.agg(F.count_if(F.col("_is").isNull()).alias("lost"), F.count_if(both & ~F.col("_p").eqNullSafe(F.col("_n"))).alias("changed"), F.count_if(both & F.col("_p").eqNullSafe(F.col("_n"))).alias("same"), F.count_if(F.col("_was").isNull()).alias("added"))


def verify_eval_set(items: DataFrame, texts: DataFrame, used: DataFrame, refs: DataFrame, labels: DataFrame, drift: DataFrame, pinned: DataFrame, key: str, ref_key: str, text: str, scored: int) -> DataFrame:
    """problem and item of all that must not hold before a label, a prediction or a report on a frozen set is trusted; none is a clean set.

    Those of eval_set_problems(): drift, set_changed, leak, quoted, repeated_id, repeated_text, index_gap, label_outside. And of labels (key,
    set_hash): label_beyond, whose item is numbered above the first `scored`, and label_of_other_set, not made for the set as it was pinned."""
    tag = lambda df, name: df.select(F.lit(name).alias("problem"), F.col(key).cast("string").alias("item"))
    within, beyond = items.where(F.col("eval_index") <= scored).select(key), items.where(F.col("eval_index") > scored).select(key)
    late = labels.select(key).distinct().join(beyond.hint("merge"), key, "left_semi").join(within.hint("merge"), key, "left_anti")
    known = pinned.where("name = 'set'").agg(F.max("xor").alias("_set"))  # one row, null without a pin
    other = labels.crossJoin(F.broadcast(known)).where(F.col("set_hash").isNull() | F.col("_set").isNull() | (F.col("set_hash") != F.col("_set"))).select(key).distinct()
    problems = eval_set_problems(items, texts, used, refs, labels, drift, pinned, key, ref_key, text)
    return problems.unionByName(tag(late, "label_beyond")).unionByName(tag(other, "label_of_other_set"))


def _evals(s, d):
    """Scores of every document under two configs by two judges."""
    star = lambda c: F.least(F.lit(5), 1 + F.floor(c)).cast("int")
    u = B.uniform("doc_id", 9) % 3
    a, b = star(F.col("n_chars") / 400), star(F.length(F.regexp_replace("text", "[^ ]", "")) / 60)
    cell = lambda c, j, v, r: F.struct(F.lit(c).alias("config"), F.lit(j).alias("judge"), v.cast("int").alias("overall"), r.alias("reply"))
    cells = F.array(cell("m:one", "m/x", a, F.lit("canned")), cell("m:one", "h/y", b, F.lit("canned")), cell("h:two", "m/x", F.greatest(F.lit(1), a - (u == 0).cast("int")), F.col("text")), cell("h:two", "h/y", F.least(F.lit(5), b + (u == 1).cast("int")), F.col("text")))
    return B.table(s, d, "documents").select(F.col("doc_id").alias("item"), F.lit("v2").alias("rubric"), (F.col("n_chars") < 60).alias("deflects"), F.col("doc_id").alias("at"), F.explode(cells).alias("c")).select("item", "rubric", "deflects", "at", "c.*")


def _two_rubrics(s, d):
    """Scores of which one judge gave some under another rubric, and whose flags differ by judge."""
    other = (F.col("judge") == "h/y") & (F.col("item") % 7 == 0)
    return _evals(s, d).withColumn("rubric", F.when(other, "v3").otherwise(F.col("rubric"))).withColumn("deflects", F.col("deflects") | ((F.col("judge") == "h/y") & (F.col("item") % 5 == 0)))


SIDES = {"de_fr": (["de"], ["fr"]), "en_es": (["en"], ["es"]), "north_south": (["en", "de"], ["fr", "es"])}
_flagged = lambda s, d: B.route_in(s, d).select(*(F.array_compact(F.array(*(F.when(F.col(x), F.lit(n)) for n, x in p))).alias(c) for c, p in (("x", (("legal", "legal_sensitive"), ("human", "wants_human"))), ("y", (("legal", "abusive_content"), ("human", "wants_human"))))))
_set = lambda s, d: build_eval_set(_docs(s, d), B.table(s, d, "labels"), B.table(s, d, "benchmark"), 100, 11)
_versions = lambda s, d: B.preds(s, d).withColumn("v2", F.when(B.uniform("item", 22) % 4 > 0, F.col("gold")))
_verdict = lambda: F.when(F.col("a") == F.col("gold"), "right").when(B.uniform("item", 21) % 3 == 0, "gold").when(B.uniform("item", 21) % 3 == 1, "model").otherwise("open")
EXCEPTIONS = [-1, *range(100)]


def _violations(s, d, exceptions):
    ruled = B.preds(s, d).withColumn("rule", F.concat(F.lit("r"), (B.uniform("item", 23) % 3).cast("string")))
    return rule_violations(ruled, "item", "a", "rule", {"r0": ["en", "de"]}, {"r1": ["fr"]}, exceptions)


def _verified(s, d, items):
    """A frozen set, pinned as it is. Labels of quality 1 are for it, others for an older one; the first 80 items are scored."""
    docs, pins = B.table(s, d, "documents"), table_pins({"set": (items, ["doc_id", "eval_index"])})
    labels = B.table(s, d, "labels").crossJoin(F.broadcast(pins.select("xor"))).withColumn("set_hash", F.when(F.col("quality") == 1, F.col("xor")).otherwise("0" * 16))
    return verify_eval_set(items, docs, docs.where("doc_id % 4 = 0"), B.table(s, d, "benchmark"), labels, _drift(s, d), pins, "doc_id", "item_id", "text", 80)


QUERIES = {
    "field_agreement": lambda s, d: field_agreement(B.preds(s, d).select(F.nullif("a", F.lit("en")).alias("a"), F.nullif("b", F.lit("en")).alias("b")), "a", "b"),
    "field_distribution": lambda s, d: field_distribution(B.preds(s, d).select(F.nullif("a", F.lit("en")).alias("a"), F.nullif("b", F.lit("en")).alias("b")), "a", "b"),
    "flag_agreement": lambda s, d: flag_agreement(_flagged(s, d), "x", "y", ["legal", "human", "churn"]),
    "window_accuracy": lambda s, d: window_accuracy(B.preds(s, d), "item", "gold", "b"),
    "window_range": lambda s, d: window_range(window_accuracy(B.preds(s, d), "item", "gold", "b")),
    "boundary_table": lambda s, d: boundary_table(B.preds(s, d), "gold", "a", "b", SIDES),
    "version_effect": lambda s, d: version_effect(_versions(s, d), "a", ["gold", "v2", "b"]),
    "version_moves": lambda s, d: version_moves(_versions(s, d).withColumn("v3", F.when(F.col("v2").isNotNull(), F.col("b"))), "item", "a", "gold", "v3"),
    "version_classes": lambda s, d: version_classes(_versions(s, d), "a", "gold", "b"),
    "adjudication_rollup": lambda s, d: adjudication_rollup(B.preds(s, d).withColumn("v", _verdict()), "gold", "v"),
    "rule_violations": lambda s, d: _violations(s, d, [3, 5, 8]),
    "stale_exceptions": lambda s, d: stale_exceptions(B.preds(s, d), "item", _violations(s, d, EXCEPTIONS), EXCEPTIONS),
    "score_table": lambda s, d: score_table(_evals(s, d)),
    "judge_pair": lambda s, d: judge_pair(_two_rubrics(s, d), "m/x", "h/y"),
    "fixed_text_spread": lambda s, d: fixed_text_spread(_evals(s, d)),
    "list_configs": lambda s, d: list_configs(_evals(s, d), config_label(F.col("config"), F.col("rubric"), F.when(F.col("judge") == "h/y", "f1").otherwise(" "), F.when(F.col("item") % 3 == 0, 0.0).otherwise(0.7), F.when(F.col("item") % 5 == 0, "rerun"), 0.7)),
    "verdict_sides": lambda s, d: verdict_counts(B.preds(s, d).withColumn("v", _verdict()).withColumn("side", F.when(F.col("gold").isin("en", "de"), "north").otherwise("south")), "side", "v", ["right", "gold", "model", "open"]),
    "settling_rules": lambda s, d: settling_rules(B.preds(s, d).withColumn("v", _verdict()).withColumn("rule", F.when(B.uniform("item", 24) % 4 > 0, F.concat(F.lit("r"), (B.uniform("item", 24) % 4).cast("string")))), "item", "v", "rule"),
    "prefix_unchanged": lambda s, d: prefix_unchanged(_docs(s, d).where("doc_id % 17 <> 4"), _docs(s, d).where("doc_id % 5 < 4").withColumn("text", F.when(F.col("doc_id") % 11 == 0, "x").otherwise(F.col("text"))), "doc_id", "text"),
    "verify_eval_set": lambda s, d: _verified(s, d, saved(_set(s, d), "frozen")),
}
_u = B.sql_uniform
_EV = f"""r AS (SELECT doc_id, text, n_chars, {_u("doc_id", 9)} % 3 AS u, CAST(least(5, 1 + floor(n_chars / 400)) AS INT) AS a, CAST(least(5, 1 + floor(length(regexp_replace(text, '[^ ]', '', 'g')) / 60)) AS INT) AS b FROM documents),
    evals AS (SELECT doc_id AS item, 'v2' AS rubric, n_chars < 60 AS deflects, unnest([{{'config': 'm:one', 'judge': 'm/x', 'overall': a}}, {{'config': 'm:one', 'judge': 'h/y', 'overall': b}}, {{'config': 'h:two', 'judge': 'm/x', 'overall': greatest(1, a - (u = 0)::INT)}}, {{'config': 'h:two', 'judge': 'h/y', 'overall': least(5, b + (u = 1)::INT)}}], recursive := true) FROM r)"""


_V = f"v AS (SELECT item, gold, CASE WHEN a = gold THEN 'right' WHEN {_u('item', 21)} % 3 = 0 THEN 'gold' WHEN {_u('item', 21)} % 3 = 1 THEN 'model' ELSE 'open' END AS v FROM preds)"
ORACLE_SQL = {
    "list_configs": f"WITH {_EV} SELECT config || ':v2' || CASE WHEN judge = 'h/y' THEN ':f1' ELSE '' END || CASE WHEN item % 3 = 0 THEN ':t0' ELSE '' END || CASE WHEN item % 5 = 0 THEN ':rerun' ELSE '' END AS config, count(DISTINCT item) AS n_items FROM evals GROUP BY 1",
    "verdict_sides": f"WITH {B.SQL_PREDS}, {_V} SELECT CASE WHEN gold IN ('en', 'de') THEN 'north' ELSE 'south' END AS side, count(*) AS n, " + ", ".join(f"count(*) FILTER (v = '{x}') AS n_{x}" for x in ("right", "gold", "model", "open")) + " FROM v GROUP BY 1",
    "settling_rules": f"WITH {B.SQL_PREDS}, {_V}, r AS (SELECT item, CASE WHEN {_u('item', 24)} % 4 > 0 THEN 'r' || ({_u('item', 24)} % 4) ELSE 'residual' END AS rule FROM v WHERE v = 'open') SELECT rule, count(*) AS n, min(item) AS first, rule <> 'residual' AS settled FROM r GROUP BY rule",
    "field_agreement": f"WITH {B.SQL_PREDS}, p AS (SELECT coalesce(nullif(a, 'en'), '') AS a, coalesce(nullif(b, 'en'), '') AS b FROM preds) SELECT count(*) AS n, round(avg((a = b)::INT), 6) AS exact, count(*) FILTER (a = '' AND b = '') AS both_blank, count(DISTINCT a) AS values_a, count(DISTINCT b) AS values_b FROM p",
    "field_distribution": f"WITH {B.SQL_PREDS} SELECT 'a' AS field, coalesce(nullif(a, 'en'), '') AS value, count(*) AS n FROM preds GROUP BY ALL UNION ALL SELECT 'b', coalesce(nullif(b, 'en'), ''), count(*) FROM preds GROUP BY ALL",
    "window_range": f"WITH {B.SQL_PREDS}, r AS (SELECT (row_number() OVER (ORDER BY item) - 1) // greatest(10, count(*) OVER () // 5) AS chunk, (gold = b)::INT AS h FROM preds), w AS (SELECT round(avg(h), 6) AS v FROM r GROUP BY chunk HAVING count(*) >= 5) SELECT count(*) AS n_windows, min(v) AS least, max(v) AS most, round(max(v) - min(v), 6) AS range FROM w",
    "version_moves": f"WITH {B.SQL_PREDS}, v AS (SELECT item, a, gold, CASE WHEN {_u('item', 22)} % 4 > 0 AND gold IS NOT NULL THEN b END AS v FROM preds) SELECT item, gold AS old, v AS new, coalesce((v = a)::INT - (gold = a)::INT, 0) AS effect, gold IS NULL OR v IS NULL AS excluded FROM v WHERE gold IS DISTINCT FROM v",
    "version_classes": f"WITH {B.SQL_PREDS}, l AS (SELECT gold AS cls, (gold = a)::INT AS o, NULL AS n FROM preds UNION ALL SELECT b, NULL, (b = a)::INT FROM preds), c AS (SELECT cls, round(avg(o), 6) AS old, round(avg(n), 6) AS new FROM l WHERE cls IS NOT NULL GROUP BY cls) SELECT *, CASE WHEN old IS NULL OR new IS NULL THEN 'not comparable' WHEN new > old THEN 'improved' WHEN new < old THEN 'worsened' ELSE 'same' END AS change FROM c",
    "stale_exceptions": f"WITH {B.SQL_PREDS}, p AS (SELECT item, a, {_u('item', 23)} % 3 AS r FROM preds), e AS (SELECT unnest(range(-1, 100)) AS item) SELECT e.item, CASE WHEN p.item IS NULL THEN 'no row' ELSE 'no violation' END AS reason FROM e LEFT JOIN p USING (item) WHERE p.item IS NULL OR NOT ((r = 0 AND a NOT IN ('en', 'de')) OR (r = 1 AND a = 'fr'))",
    "flag_agreement": f"WITH {B.SQL_ROUTE}, l AS (SELECT 'legal' AS flag, legal_sensitive AS t, abusive_content AS p FROM route_in UNION ALL SELECT 'human', wants_human, wants_human FROM route_in UNION ALL SELECT 'churn', false, false FROM route_in), c AS (SELECT flag, count(*) FILTER (t AND p) AS h, count(*) FILTER (t) AS t, count(*) FILTER (p) AS p FROM l GROUP BY flag) SELECT flag, round(coalesce(h / nullif(p, 0)::DOUBLE, 0), 6) AS precision, round(coalesce(h / nullif(t, 0)::DOUBLE, 0), 6) AS recall, round(coalesce(2 * h / nullif(p + t, 0)::DOUBLE, 0), 6) AS f1, p + t = 0 AS never_set FROM c",
    "window_accuracy": f"WITH {B.SQL_PREDS}, r AS (SELECT (row_number() OVER (ORDER BY item) - 1) // greatest(10, count(*) OVER () // 5) AS chunk, (gold = b)::INT AS h FROM preds) SELECT chunk, count(*) AS n, round(avg(h), 6) AS accuracy FROM r GROUP BY chunk HAVING count(*) >= 5",
    "boundary_table": f"WITH {B.SQL_PREDS}, s(side, l, r) AS (VALUES ('de_fr', ['de'], ['fr']), ('en_es', ['en'], ['es']), ('north_south', ['en', 'de'], ['fr', 'es'])), x AS (SELECT side, a = gold AS ra, b = gold AS rb, (gold IN l AND a IN r) OR (gold IN r AND a IN l) AS x, (gold IN l AND b IN r) OR (gold IN r AND b IN l) AS y FROM preds, s WHERE gold IN l OR gold IN r) SELECT side, count(*) AS n, count(*) FILTER (ra) AS right_a, count(*) FILTER (rb) AS right_b, count(*) FILTER (x) AS cross_a, count(*) FILTER (y) AS cross_b, count(*) FILTER (x AND NOT y) AS cross_fixed, count(*) FILTER (y AND NOT x) AS cross_new FROM x GROUP BY side",
    "version_effect": f"WITH {B.SQL_PREDS}, l AS (SELECT 'gold' AS version, a, gold AS l FROM preds UNION ALL SELECT 'v2', a, CASE WHEN {_u('item', 22)} % 4 > 0 THEN gold END FROM preds UNION ALL SELECT 'b', a, b FROM preds) SELECT version, count(*) AS n_rows, count(l) AS n_scored, count(*) FILTER (l = a) AS n_right FROM l GROUP BY version",
    "adjudication_rollup": f"WITH {B.SQL_PREDS}, v AS (SELECT gold, CASE WHEN a = gold THEN 'right' WHEN {_u('item', 21)} % 3 = 0 THEN 'gold' WHEN {_u('item', 21)} % 3 = 1 THEN 'model' ELSE 'open' END AS v FROM preds) SELECT gold, count(*) AS n, count(*) FILTER (v = 'gold') AS for_gold, count(*) FILTER (v = 'model') AS for_model, count(*) FILTER (v = 'open') AS open, round(avg((v = 'right')::INT), 6) AS now, round(avg((v IN ('right', 'model'))::INT), 6) AS after, round(avg((v <> 'gold')::INT), 6) AS at_best FROM v GROUP BY gold",
    "rule_violations": f"WITH {B.SQL_PREDS}, p AS (SELECT item, 'r' || ({_u('item', 23)} % 3) AS rule, a FROM preds) SELECT item, rule, a, CASE WHEN rule = 'r0' THEN 'not_winner' ELSE 'excluded' END AS problem, item IN (3, 5, 8) AS known FROM p WHERE (rule = 'r0' AND a NOT IN ('en', 'de')) OR (rule = 'r1' AND a = 'fr')",
    "score_table": f"WITH {_EV} SELECT judge, rubric, config, count(*) AS n, round(avg(overall), 6) AS overall, round(avg(deflects::INT), 6) AS deflection, split_part(judge, '/', 1) = split_part(config, ':', 1) AS same_family FROM evals GROUP BY judge, rubric, config",
    "judge_pair": f"WITH {_EV}, p AS (SELECT x.overall AS x, y.overall AS y, x.deflects = (y.deflects OR item % 5 = 0) AS f FROM evals x JOIN evals y USING (item, config) WHERE x.judge = 'm/x' AND y.judge = 'h/y' AND item % 7 <> 0) SELECT count(*) AS n, count(*) FILTER (x = y) AS exact, count(*) FILTER (abs(x - y) <= 1) AS within_1, round(avg(x - y), 6) AS bias, round(avg(f::INT), 6) AS same_flag FROM p",
    "fixed_text_spread": f"WITH {_EV} SELECT config, max(overall) - min(overall) AS range, round(stddev_samp(overall), 6) AS std, round(avg(overall), 6) AS mean, count(*) FILTER (deflects) AS flags FROM evals WHERE config = 'm:one' GROUP BY config",
    "prefix_unchanged": "WITH t AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'x' ELSE text END AS p FROM documents WHERE doc_id % 5 < 4), n AS (SELECT doc_id, text AS q FROM documents WHERE doc_id % 17 <> 4), j AS (SELECT t.doc_id AS a, n.doc_id AS b, p, q FROM t FULL JOIN n ON t.doc_id = n.doc_id) SELECT count(*) FILTER (b IS NULL) AS lost, count(*) FILTER (a = b AND p IS DISTINCT FROM q) AS changed, count(*) FILTER (a = b AND p IS NOT DISTINCT FROM q) AS same, count(*) FILTER (a IS NULL) AS added FROM j",
    "verify_eval_set": f"""WITH {_EVAL}, {_PINS}, own AS (SELECT id, norm FROM n WHERE id IN (SELECT doc_id FROM e))
        SELECT 'drift' AS problem, name AS item FROM state WHERE state <> 'ok' UNION ALL SELECT 'leak', doc_id::VARCHAR FROM e WHERE doc_id % 4 = 0 UNION ALL SELECT 'quoted', id::VARCHAR FROM own WHERE id IN (SELECT id FROM bad)
        UNION ALL SELECT 'repeated_id', doc_id::VARCHAR FROM e GROUP BY doc_id HAVING count(*) > 1 UNION ALL SELECT 'repeated_text', id::VARCHAR FROM own WHERE norm IN (SELECT norm FROM own GROUP BY norm HAVING count(*) > 1)
        UNION ALL SELECT 'index_gap', NULL FROM (SELECT count(*) AS n, min(eval_index) AS low, max(eval_index) AS high, count(DISTINCT eval_index) AS k FROM e) WHERE n > 0 AND (low <> 1 OR high <> n OR k <> n)
        UNION ALL SELECT 'label_outside', doc_id::VARCHAR FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM e) UNION ALL SELECT 'label_beyond', doc_id::VARCHAR FROM labels WHERE doc_id IN (SELECT doc_id FROM e WHERE eval_index > 80) UNION ALL SELECT 'label_of_other_set', doc_id::VARCHAR FROM labels WHERE quality IS DISTINCT FROM 1""",
}
