"""Routing policies beyond the base rule, votes over runs, and the choice between rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convan.operators.evaluation import _ROUTED, DEFAULTS, route
from convan.plans import bindings as B

RISKY = ["fr"]
TRIGGERS = ["long_text", "shouts"]


def route_triggers(df: DataFrame, defaults: dict[str, str], triggers: list[str], signals: DataFrame, key: str) -> DataFrame:
    """The base decision, with signals of another run as further reasons to escalate, after the overrides and before the class default.

    A trigger that the run doesn't have is refused; a row without signals has none set."""
    if missing := [t for t in triggers if t not in signals.columns]:
        raise ValueError(f"unknown triggers: {missing}")
    rows = route(df, defaults).join(signals.select(key, *triggers).hint("merge"), key, "left")
    first = F.array_compact(F.array(*(F.when(F.col(t), F.lit(t)) for t in triggers)))
    late = F.col("reason").startswith("default_") | (F.col("reason") == "unknown_class")
    reason = F.when(late & (F.size(first) > 0), F.get(first, 0)).otherwise(F.col("reason"))
    return rows.withColumn("reason", reason).withColumn("pred", F.col("reason") != "default_auto").drop(*triggers)


def route_variants(df: DataFrame, key: str, a: str, b: str, risky: list[str], threshold: float = 0.5) -> DataFrame:
    """Escalate by class alone, or also when unsure, when two models differ, or either."""
    base, unsure, differ = F.coalesce(F.col(a).isin(risky), F.lit(False)), F.coalesce(F.col("confidence") < threshold, F.lit(True)), ~F.col(a).eqNullSafe(F.col(b))
    return df.select(key, base.alias("plain"), (base | unsure).alias("confidence"), (base | differ).alias("disagreement"), (base | unsure | differ).alias("both"))


def vote_summary(runs: DataFrame, base: DataFrame, key: str, n: int, risky: list[str]) -> DataFrame:
    """Per item of (key, label) rows, one a run: distinct labels, unanimity, the label of more than half of the runs, any
    risky label, whether all n runs are there, and the share of runs with the base label. Null labels vote for nothing."""
    c = runs.groupBy(key, "label").agg(F.count("*").alias("_n"))
    c = c.join(base.select(key, F.col("label").alias("_base")).hint("merge"), key, "left")
    s = c.groupBy(key).agg(F.count("label").alias("n_unique"), F.sum("_n").alias("n_runs"), F.max_by("label", F.struct("_n", "label")).alias("_top"), F.max(F.when(F.col("label").isNotNull(), F.col("_n"))).alias("_most"), F.bool_or(F.coalesce(F.col("label").isin(risky), F.lit(False))).alias("any_risky"), F.sum(F.when(F.col("label") == F.col("_base"), F.col("_n")).otherwise(0)).alias("_same"))
    return s.select(key, "n_unique", ((F.col("n_unique") == 1) & (F.col("_most") == F.col("n_runs"))).alias("all_agree"), F.when(F.col("_most") * 2 > F.col("n_runs"), F.col("_top")).alias("majority"), "any_risky", (F.col("n_runs") == n).alias("complete"), F.round(F.col("_same") / F.col("n_runs"), 6).alias("same_share"))


def additive_policies(base: DataFrame, votes: DataFrame, key: str, runner_up_risky: str) -> DataFrame:
    """A: the base rule. B: or a risky runner-up. C: or runs that differ. D: or any run with a risky label."""
    j = base.join(votes.hint("merge"), key, "left")
    a, no = F.col("pred"), F.lit(False)
    return j.select(key, a.alias("a"), (a | F.coalesce(F.col(runner_up_risky), no)).alias("b"), (a | ~F.coalesce(F.col("all_agree"), F.lit(True))).alias("c"), (a | F.coalesce(F.col("any_risky"), no)).alias("d"))


def rule_scores(df: DataFrame, rules: list[str], truth: str) -> DataFrame:
    """Per rule: escalated, missed and false alarms. One pass."""
    long = df.select(truth, F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.col(r).alias("on")) for r in rules))).alias("x"))
    on, t = F.col("x.on"), F.col(truth)
    return long.groupBy("x.rule").agg(F.count_if(on).alias("escalated"), F.count_if(~on & t).alias("missed"), F.count_if(on & ~t).alias("false_alarms"))


def select_rule(scores: DataFrame, base: str, ratio: float = 2.0) -> DataFrame:
    """The rule with the fewest misses among those that remove some and add at most `ratio` false alarms for each; ties
    by false alarms, escalated and name. Without one, the base rule. Scores have one row per rule."""
    b = scores.where(F.col("rule") == base).select(F.col("missed").alias("_m"), F.col("false_alarms").alias("_f"))
    fits = (F.col("missed") < F.col("_m")) & (F.col("false_alarms") - F.col("_f") <= ratio * (F.col("_m") - F.col("missed")))
    rows = scores.crossJoin(F.broadcast(b)).where(fits | (F.col("rule") == base))  # b is one row
    return rows.orderBy((F.col("rule") == base) & ~fits, "missed", "false_alarms", "escalated", "rule").limit(1).select("rule", "escalated", "missed", "false_alarms")


def rule_delta(df: DataFrame, base: str, rules: list[str], truth: str) -> DataFrame:
    """What each rule changes against the base: caught anew, new false alarms, missed anew."""
    long = df.select(base, truth, F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.col(r).alias("on")) for r in rules))).alias("x"))
    on, o, t = F.col("x.on"), F.col(base), F.col(truth)
    return long.groupBy("x.rule").agg(F.count_if(on & ~o & t).alias("caught"), F.count_if(on & ~o & ~t).alias("new_false_alarms"), F.count_if(~on & o & t).alias("newly_missed"))


def _signals(s, d):
    return B.gold(s, d).select(F.col("doc_id").alias("item"), (F.col("n_chars") > 2000).alias("long_text"), F.col("text").contains("!!").alias("shouts"))


def _votes(s, d):
    p = B.preds(s, d)
    runs = p.select("item", F.explode(F.array("a", "b", F.lit("en"))).alias("label"))
    return vote_summary(runs, p.select("item", F.col("a").alias("label")), "item", 3, RISKY)


def _policies(s, d):
    base = route(B.route_in(s, d), DEFAULTS).withColumn("runner_up_risky", F.col("wants_human") | (B.uniform("item", 15) % 5 == 0))
    return additive_policies(base, _votes(s, d), "item", "runner_up_risky")


def _judged(s, d):
    return _policies(s, d).join(B.route_in(s, d).select("item", "escalate").hint("merge"), "item")


QUERIES = {
    "route_triggers": lambda s, d: route_triggers(B.route_in(s, d), DEFAULTS, TRIGGERS, _signals(s, d), "item").select("item", "reason", "pred"),
    "route_variants": lambda s, d: route_variants(B.preds(s, d).withColumn("confidence", B.uniform("item", 1) / 4294967295.0), "item", "a", "b", RISKY),
    "vote_summary": _votes,
    "additive_policies": _policies,
    "rule_scores": lambda s, d: rule_scores(_judged(s, d), ["a", "b", "c", "d"], "escalate"),
    "select_rule": lambda s, d: select_rule(rule_scores(_judged(s, d), ["a", "b", "c", "d"], "escalate"), "a"),
    "rule_delta": lambda s, d: rule_delta(_judged(s, d), "a", ["b", "c", "d"], "escalate"),
}
_VOTES = f"{B.SQL_PREDS}, votes AS (SELECT item, len(list_distinct([a, b, 'en'])) AS n_unique, a = b AND b = 'en' AS all_agree, CASE WHEN a = b OR a = 'en' THEN a WHEN b = 'en' THEN b END AS majority, a = 'fr' OR b = 'fr' AS any_risky, true AS complete, round((1 + (b = a)::INT + (a = 'en')::INT) / 3.0::DOUBLE, 6) AS same_share FROM preds)"
_POL = f"{_ROUTED}, {_VOTES}, pol AS (SELECT r.item, escalate, reason <> 'default_auto' AS a, a OR wants_human OR {B.sql_uniform('r.item', 15)} % 5 = 0 AS b, a OR NOT all_agree AS c, a OR any_risky AS d FROM r JOIN votes ON votes.item = r.item)"
_SCORES = "scores AS (" + " UNION ALL ".join(f"SELECT '{r}' AS rule, count(*) FILTER ({r}) AS escalated, count(*) FILTER (NOT {r} AND escalate) AS missed, count(*) FILTER ({r} AND NOT escalate) AS false_alarms FROM pol" for r in "abcd") + ")"
ORACLE_SQL = {
    "route_triggers": f"WITH {_ROUTED}, t AS (SELECT item, CASE WHEN reason NOT LIKE 'default_%' AND reason <> 'unknown_class' THEN reason WHEN n_chars > 2000 THEN 'long_text' WHEN contains(text, '!!') THEN 'shouts' ELSE reason END AS reason FROM r JOIN documents ON doc_id = item) SELECT item, reason, reason <> 'default_auto' AS pred FROM t",
    "route_variants": f"WITH {B.SQL_PREDS}, v AS (SELECT item, a = 'fr' AS base, {B.sql_uniform('item', 1)} / 4294967295.0 < 0.5 AS unsure, a <> b AS differ FROM preds) SELECT item, base AS plain, base OR unsure AS confidence, base OR differ AS disagreement, base OR unsure OR differ AS both FROM v",
    "vote_summary": f"WITH {_VOTES} SELECT * FROM votes",
    "additive_policies": f"WITH {_POL} SELECT item, a, b, c, d FROM pol",
    "rule_scores": f"WITH {_POL}, {_SCORES} SELECT * FROM scores",
    "select_rule": f"WITH {_POL}, {_SCORES}, z AS (SELECT s.*, s.missed < b.missed AND s.false_alarms - b.false_alarms <= 2 * (b.missed - s.missed) AS fits FROM scores s, (SELECT * FROM scores WHERE rule = 'a') b) SELECT rule, escalated, missed, false_alarms FROM z WHERE fits OR rule = 'a' ORDER BY NOT fits, missed, false_alarms, escalated, rule LIMIT 1",
    "rule_delta": f"WITH {_POL} " + " UNION ALL ".join(f"SELECT '{r}' AS rule, count(*) FILTER ({r} AND NOT a AND escalate) AS caught, count(*) FILTER ({r} AND NOT a AND NOT escalate) AS new_false_alarms, count(*) FILTER (NOT {r} AND a AND escalate) AS newly_missed FROM pol" for r in "bcd"),
}
