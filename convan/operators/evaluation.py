"""Profiles, routing policy and evaluation metrics: single-pass aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from convan.functions.scratch import ranked
from convan.functions.tails import mcnemar_p
from convan.plans import bindings as B

# Keyword categories and the routing policy of the test classes.
CATEGORIES = {"licence": "(?i)licen[sc]e", "contact": "[A-Za-z0-9._]+@[A-Za-z0-9.]+", "shout": "!!"}
DEFAULTS = {"en": "auto", "de": "auto", "fr": "escalate"}


def volume(df: DataFrame, key: str, n: int) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(n)


def keyword_prevalence(df: DataFrame, text: str, categories: dict[str, str]) -> DataFrame:
    """Rows that match each category, in one pass; a row may match several."""
    one = df.agg(F.count("*").alias("n_rows"), *(F.count_if(F.col(text).rlike(p)).alias(n) for n, p in categories.items()))
    return one.select("n_rows", F.explode(F.array(*(F.struct(F.lit(n).alias("category"), F.col(n).alias("n")) for n in categories))).alias("c")).select("c.category", "c.n", "n_rows")


# What overrides a class's default, in this order; low confidence comes after the first.
OVERRIDES = {"triage": "triage", "disputes": "disputing_turn", "legal_sensitive": "legal", "wants_human": "human", "churn_risk": "churn", "abusive_content": "abuse"}


def route(df: DataFrame, defaults: dict[str, str], threshold: float = 0.5) -> DataFrame:
    """The action of each row and its reason: a triage flag, low confidence, a disputing turn, legal, human, churn and abuse flags,
    then the class default; unknown classes escalate. Null flags are no flags, nor are those that df has no column for; a null confidence is low."""
    flagged = [(F.col(flag) if flag in df.columns else F.lit(False), why) for flag, why in OVERRIDES.items()]
    flagged.insert(1, (F.col("confidence").isNull() | (F.col("confidence") < threshold), "low_confidence"))
    reason = F
    for condition, why in flagged:
        reason = reason.when(condition, why)
    for name, action in defaults.items():
        reason = reason.when(F.col("intent") == name, f"default_{action}")
    reason = reason.otherwise("unknown_class")
    return df.withColumn("reason", reason).withColumn("pred", F.col("reason") != "default_auto")


MISSING = "__missing__"


def assemble(gold: DataFrame, preds: DataFrame, versions: list[str]) -> DataFrame:
    """One row per row of gold (item, gold, escalate), with each version's class, whether it is right, and its action.

    preds: (item, version, intent, pred), one row per item and version. What a version lacks is MISSING: wrong, and escalated."""
    wide = preds.groupBy("item").pivot("version", versions).agg(F.first("intent").alias("intent"), F.first("pred").alias("pred"))
    out = gold.join(wide.hint("merge"), "item", "left")
    said = lambda v: F.coalesce(f"{v}_intent", F.lit(MISSING))
    return out.select("item", "gold", "escalate", *(x for v in versions for x in (said(v).alias(f"{v}_intent"), said(v).eqNullSafe(F.col("gold")).alias(f"{v}_right"), F.coalesce(f"{v}_pred", F.lit(True)).alias(f"{v}_pred"))))


def wilson(hits, n):
    """The bounds of the 95 % Wilson interval."""
    z, p = 1.96, hits / n
    mid, half = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return F.round((mid - half) / (1 + z * z / n), 6), F.round((mid + half) / (1 + z * z / n), 6)


def accuracy(df: DataFrame, gold: str, pred: str, by: str) -> DataFrame:
    out = df.groupBy(by).agg(F.count("*").alias("n"), F.count_if(F.col(gold) == F.col(pred)).alias("hits"))
    low, high = wilson(F.col("hits").cast("double"), F.col("n").cast("double"))
    return out.withColumn("accuracy", F.round(F.col("hits") / F.col("n"), 6)).withColumn("low", low).withColumn("high", high)


def confusion(df: DataFrame, gold: str, pred: str) -> DataFrame:
    return df.groupBy(F.col(gold).alias("gold"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))


def confusion_matrix(df: DataFrame, gold: str, pred: str, classes: list[str]) -> DataFrame:
    """A row per class of gold that occurs and a column per class in the given order, and one for missing predictions; others are not counted."""
    said = df.select(F.col(gold).alias("gold"), F.coalesce(pred, F.lit(MISSING)).alias("said"))
    return said.groupBy("gold").pivot("said", [*classes, MISSING]).count().na.fill(0)


def report_averages(report: DataFrame, least: int = 0) -> DataFrame:
    """The macro average over classes of at least that support, and the average weighted by support."""
    macro = lambda c: F.avg(F.when(F.col("support") >= least, F.col(c)))
    weighted = lambda c: F.sum(F.col(c) * F.col("support")) / F.sum("support")
    one = report.agg(*(F.round(f(c), 6).alias(f"{n}_{c}") for n, f in (("macro", macro), ("weighted", weighted)) for c in ("precision", "recall", "f1")), F.sum("support").alias("support"))
    rows = [F.struct(F.lit(n).alias("cls"), "support", *(F.col(f"{n}_{c}").alias(c) for c in ("precision", "recall", "f1"))) for n in ("macro", "weighted")]
    return one.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def class_report(df: DataFrame, gold: str, pred: str) -> DataFrame:
    """Precision, recall, F1 and support of each class, from the confusion counts."""
    c = confusion(df, gold, pred)
    long = c.select(F.explode(F.array(F.struct(F.col("gold").alias("cls"), F.col("n").alias("support"), F.lit(0).cast("long").alias("said"), F.when(F.col("gold") == F.col("pred"), F.col("n")).otherwise(0).alias("hit")), F.struct(F.col("pred").alias("cls"), F.lit(0).cast("long").alias("support"), F.col("n").alias("said"), F.lit(0).cast("long").alias("hit")))).alias("x")).select("x.*")
    s = long.groupBy("cls").agg(*(F.sum(x).alias(x) for x in ("support", "said", "hit")))
    share = lambda a, b: F.round(F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0)), 6)
    return s.select("cls", "support", share("hit", "said").alias("precision"), share("hit", "support").alias("recall"), F.round(F.coalesce(2 * F.col("hit") / F.nullif(F.col("said") + F.col("support"), F.lit(0)), F.lit(0.0)), 6).alias("f1"))


def bidirectional(df: DataFrame, gold: str, pred: str) -> DataFrame:
    """Confusions of two classes in both directions."""
    wrong = confusion(df, gold, pred).where("gold <> pred").select(F.least("gold", "pred").alias("x"), F.greatest("gold", "pred").alias("y"), (F.col("gold") < F.col("pred")).alias("forth"), "n")
    return wrong.groupBy("x", "y").agg(F.sum(F.when(F.col("forth"), F.col("n")).otherwise(0)).alias("n_xy"), F.sum(F.when(~F.col("forth"), F.col("n")).otherwise(0)).alias("n_yx"))


def routing_metrics(df: DataFrame, pred: str, truth: str) -> DataFrame:
    """Counts and rates of an escalation policy in one row; a rate of nothing is null."""
    p, t = F.col(pred), F.col(truth)
    one = df.agg(F.count("*").alias("n"), F.count_if(p == t).alias("right"), F.count_if(p).alias("escalated"), F.count_if(t).alias("due"), F.count_if(~p & t).alias("missed"), F.count_if(p & ~t).alias("over"))
    rate = lambda a, b: F.round(a / F.nullif(b, F.lit(0)), 6)
    n, right, escalated, due, missed, over = (F.col(c) for c in ("n", "right", "escalated", "due", "missed", "over"))
    return one.select("*", rate(right, n).alias("accuracy"), rate(escalated, n).alias("escalated_rate"), rate(escalated - over, escalated).alias("precision"), rate(due - missed, due).alias("recall"), rate(missed, due).alias("miss_rate"), rate(over, n - due).alias("false_alarm_rate"))


def calibration(df: DataFrame, score: str, hit: str, bins: int) -> DataFrame:
    b = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).alias("bin")
    return df.groupBy(b).agg(F.count("*").alias("n"), F.round(F.avg(score), 6).alias("confidence"), F.round(F.avg(F.col(hit).cast("double")), 6).alias("accuracy"))


def calibration_gap(df: DataFrame, score: str, hit: str, cut: float = 0.5, least: int = 20) -> DataFrame:
    """Rows and accuracy below and from the cut, and the gap between them; null where a side has fewer than `least` rows. Null scores count on neither side."""
    high = F.col(score) >= cut
    share = lambda side: F.round(F.avg(F.when(side, F.col(hit).cast("double"))), 6)
    one = df.agg(F.count_if(~high).alias("n_low"), F.count_if(high).alias("n_high"), share(~high).alias("low"), share(high).alias("high"))
    return one.withColumn("gap", F.when((F.col("n_low") >= least) & (F.col("n_high") >= least), F.round(F.col("high") - F.col("low"), 6)))


def fixes_breaks(df: DataFrame, key: str, gold: str, a: str, b: str, text: str, most: int = 120) -> DataFrame:
    """Rows that b gets right and a wrong (fixed) or the other way round (broken), with the text on one line and cut to so many letters."""
    x, y = F.col(a).eqNullSafe(F.col(gold)), F.col(b).eqNullSafe(F.col(gold))
    line = F.left(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "[ \\t\\r\\n]+", " ")), F.lit(most))
    return df.where(x != y).select(key, F.when(y, "fixed").otherwise("broken").alias("kind"), line.alias("text"))


def majority_baseline(train: DataFrame, test: DataFrame, key: str, cls: str, reply: str) -> DataFrame:
    """What the simplest baseline says of each test row: the class that most training rows have (of several the last by name), one
    fixed reply, and always escalate. Without training rows the class is null."""
    top = train.groupBy(cls).agg(F.count("*").alias("n")).agg(F.max_by(cls, F.struct("n", cls)).alias("pred"))  # one row
    return test.select(key, F.col(cls).alias("gold")).crossJoin(F.broadcast(top)).withColumn("reply", F.lit(reply)).withColumn("escalate", F.lit(True))


def paired_table(df: DataFrame, gold: str, a: str, b: str) -> DataFrame:
    x, y = F.col(a) == F.col(gold), F.col(b) == F.col(gold)
    return df.agg(F.count_if(x & y).alias("both"), F.count_if(x & ~y).alias("only_a"), F.count_if(~x & y).alias("only_b"), F.count_if(~x & ~y).alias("neither"), F.count_if(F.col(a) == F.col(b)).alias("agree"), F.count_if(~x & (F.col(a) == F.col(b))).alias("same_wrong"))


def mcnemar(df: DataFrame) -> DataFrame:
    """The exact two-sided p value of a paired table."""
    return df.select("only_a", "only_b", F.round(mcnemar_p("only_a", "only_b"), 6).alias("p"))


def recall_delta(df: DataFrame, gold: str, a: str, b: str) -> DataFrame:
    """Recall of a and b for each class with the difference, and their means over the classes as class "macro"."""
    share = lambda c: F.avg((F.col(c) == F.col(gold)).cast("double"))
    per = df.groupBy(F.col(gold).alias("cls")).agg(F.count("*").alias("n"), share(a).alias("ra"), share(b).alias("rb"))
    mean = per.agg(F.lit("macro").alias("cls"), F.sum("n").alias("n"), F.avg("ra").alias("ra"), F.avg("rb").alias("rb"))
    return per.unionByName(mean).select("cls", "n", F.round("ra", 6).alias("recall_a"), F.round("rb", 6).alias("recall_b"), F.round(F.col("rb") - F.col("ra"), 6).alias("delta"))


def majority(df: DataFrame, cls: str) -> DataFrame:
    c = df.groupBy(cls).agg(F.count("*").alias("n"))
    return c.agg(F.max_by(cls, F.struct("n", cls)).alias("majority"), F.round(F.max("n") / F.sum("n"), 6).alias("share"), F.round(F.sum(F.pow(F.col("n"), F.lit(2.0))) / F.pow(F.sum("n"), F.lit(2.0)), 6).alias("chance"))


def fingerprint(df: DataFrame, cols: list[str], order: list[str] | None = None) -> DataFrame:
    """Rows, and a hash of 64 bits of the rows' contents, with sums of its halves; line ends of \\r\\n count as \\n.

    Without an order the rows' order doesn't count. With one, which must be total, each row's number is hashed with it."""
    if order is not None:
        df = ranked(df.select(*dict.fromkeys([*cols, *order])), [F.col(c) for c in order], name="_rank")
        cols = ["_rank", *cols]
    hexed = F.md5(F.concat_ws("|", *(F.coalesce(F.replace(F.col(c).cast("string"), F.lit("\r\n"), F.lit("\n")), F.lit("~")) for c in cols)))
    half = lambda at: F.conv(F.substring(hexed, at, 8), 16, 10).cast("long")
    one = df.select(half(1).alias("h"), half(9).alias("l")).agg(F.count("*").alias("n_rows"), F.bit_xor("h").alias("_h"), F.bit_xor("l").alias("_l"), F.sum("h").alias("total"), F.sum("l").alias("total_low"))
    digits = lambda c: F.lpad(F.lower(F.hex(F.coalesce(c, F.lit(0)))), 8, "0")
    return one.select("n_rows", F.concat(digits("_h"), digits("_l")).alias("xor"), "total", "total_low")


def over_quota(df: DataFrame, key: str, ts: str, seconds: int, cap: int) -> DataFrame:
    """Rows at which a key has more than cap rows within the seconds up to then.

    Time is cut into spans of that length, and a row is seen from its own span and, without its columns, from the next: so a key
    with many rows is dealt by spans. Rows without a time count among themselves."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    length = seconds * 1_000_000
    span = F.floor(at / length)
    row, seen = F.struct(*df.columns), lambda s, r: F.struct(s.alias("s"), r.alias("r"))
    spans = F.when(at.isNull(), F.array(seen(span, row))).otherwise(F.array(seen(span, row), seen(span + 1, F.lit(None))))
    dealt = df.select(F.col(key).alias("_key"), at.alias("_at"), F.explode(spans).alias("_x"))
    w = Window.partitionBy("_key", "_x.s").orderBy("_at").rangeBetween(-length, 0)
    return dealt.withColumn("_calls", F.count("*").over(w)).where("_x.r is not null").select("_x.r.*", F.col("_calls").alias("calls")).where(F.col("calls") > cap)


def _docs(spark, d):
    return B.table(spark, d, "documents")


def _assembled(spark, d):
    """Gold with an action of each document, and two versions of predictions, of which the second lacks some."""
    docs = B.preds(spark, d)
    due = F.col("item") % 5 == 0
    said = docs.select("item", F.explode(F.array(*(F.struct(F.lit(v).alias("version"), F.col(v).alias("intent"), (F.col("item") % k == 0).alias("pred")) for v, k in (("a", 4), ("b", 6))))).alias("x")).select("item", "x.*")
    return docs.select("item", "gold", due.alias("escalate")), said.where("version = 'a' or item % 7 <> 0")


QUERIES = {
    "volume": lambda s, d: volume(B.table(s, d, "events"), "event_type", 10),
    "keyword_prevalence": lambda s, d: keyword_prevalence(_docs(s, d), "text", CATEGORIES),
    "mid_thread_share": lambda s, d: B.msgs(s, d).groupBy("author").agg(F.count("*").alias("n"), F.round(F.avg(F.col("reply_to").isNotNull().cast("double")), 6).alias("share")),
    "assemble": lambda s, d: assemble(*_assembled(s, d), ["a", "b"]),
    "confusion_matrix": lambda s, d: confusion_matrix(assemble(*_assembled(s, d), ["a", "b"]), "gold", "b_intent", ["en", "de", "fr", "es"]),
    "report_averages": lambda s, d: report_averages(class_report(B.preds(s, d), "gold", "a"), 20),
    "route": lambda s, d: route(B.route_in(s, d), DEFAULTS).select("item", "reason", "pred"),
    "routing_metrics": lambda s, d: routing_metrics(route(B.route_in(s, d), DEFAULTS), "pred", "escalate"),
    "accuracy": lambda s, d: accuracy(B.preds(s, d), "gold", "a", "gold").withColumnRenamed("gold", "cls"),
    "confusion": lambda s, d: confusion(B.preds(s, d), "gold", "a"),
    "confused_pairs": lambda s, d: confusion(B.preds(s, d), "gold", "a").where("gold <> pred").orderBy(F.desc("n"), "gold", "pred").limit(5),
    "class_report": lambda s, d: class_report(B.preds(s, d), "gold", "a"),
    "bidirectional": lambda s, d: bidirectional(B.preds(s, d), "gold", "b"),
    "calibration": lambda s, d: calibration(B.route_in(s, d), "confidence", "escalate", 5),
    "paired_table": lambda s, d: paired_table(B.preds(s, d), "gold", "a", "b"),
    "mcnemar": lambda s, d: mcnemar(paired_table(B.preds(s, d), "gold", "a", "b")),
    "recall_delta": lambda s, d: recall_delta(B.preds(s, d), "gold", "a", "b"),
    "majority": lambda s, d: majority(B.gold(s, d), "lang"),
    "fixes_breaks": lambda s, d: fixes_breaks(B.preds(s, d).join(_docs(s, d).select(F.col("doc_id").alias("item"), "text").hint("merge"), "item"), "item", "gold", "a", "b", "text"),
    "calibration_gap": lambda s, d: calibration_gap(B.route_in(s, d), "confidence", "escalate"),
    "majority_baseline": lambda s, d: majority_baseline(B.gold(s, d).where("doc_id % 3 > 0"), B.gold(s, d).where("doc_id % 3 = 0"), "doc_id", "lang", "We will look into it."),
    "fingerprint": lambda s, d: fingerprint(_docs(s, d), ["doc_id", "lang", "source", "n_chars", "text"]),
    "fingerprint_ordered": lambda s, d: fingerprint(_docs(s, d), ["lang", "text"], ["n_chars", "doc_id"]),
    "over_quota": lambda s, d: over_quota(B.table(s, d, "events"), "user_id", "ts", 86400, 3).select("event_id", "calls"),
}
_W = "hits / n::DOUBLE"
_ASSEMBLED = f"assembled AS (SELECT item, gold, item % 5 = 0 AS escalate, a AS a_intent, a = gold AS a_right, item % 4 = 0 AS a_pred, CASE WHEN item % 7 = 0 THEN '{MISSING}' ELSE b END AS b_intent, item % 7 <> 0 AND b = gold AS b_right, item % 7 = 0 OR item % 6 = 0 AS b_pred FROM preds)"
_AVERAGES = ", ".join(f"round({{f}}{c}{{g}}, 6) AS {c}" for c in ("precision", "recall", "f1"))


def _hashed(source: str, cols: list[str]) -> str:
    row = "md5(concat_ws('|', " + ", ".join(f"coalesce(replace({c}, chr(13) || chr(10), chr(10)), '~')" for c in cols) + "))"
    half = lambda at: f"CAST('0x' || substr(m, {at}, 8) AS BIGINT)"
    return f"WITH m AS (SELECT {row} AS m FROM {source}), h AS (SELECT {half(1)} AS h, {half(9)} AS l FROM m) SELECT count(*) AS n_rows, format('{{:08x}}{{:08x}}', coalesce(bit_xor(h), 0), coalesce(bit_xor(l), 0)) AS xor, CAST(sum(h) AS BIGINT) AS total, CAST(sum(l) AS BIGINT) AS total_low FROM h"


ORACLE_SQL = {
    "volume": "SELECT event_type, count(*) AS n FROM events GROUP BY event_type ORDER BY n DESC, event_type LIMIT 10",
    "keyword_prevalence": " UNION ALL ".join(f"SELECT '{n}' AS category, count(*) FILTER (regexp_matches(text, '{p}')) AS n, count(*) AS n_rows FROM documents" for n, p in CATEGORIES.items()),
    "mid_thread_share": f"WITH {B.SQL_MSGS} SELECT author, count(*) AS n, round(avg(CASE WHEN reply_to IS NULL THEN 0.0 ELSE 1.0 END), 6) AS share FROM msgs GROUP BY author",
    "confusion": f"WITH {B.SQL_PREDS} SELECT gold, a AS pred, count(*) AS n FROM preds GROUP BY ALL",
    "confused_pairs": f"WITH {B.SQL_PREDS} SELECT gold, a AS pred, count(*) AS n FROM preds WHERE gold <> a GROUP BY ALL ORDER BY n DESC, gold, pred LIMIT 5",
    "paired_table": f"WITH {B.SQL_PREDS} SELECT count(*) FILTER (a = gold AND b = gold) AS both, count(*) FILTER (a = gold AND b <> gold) AS only_a, count(*) FILTER (a <> gold AND b = gold) AS only_b, count(*) FILTER (a <> gold AND b <> gold) AS neither, count(*) FILTER (a = b) AS agree, count(*) FILTER (a = b AND a <> gold) AS same_wrong FROM preds",
    "recall_delta": f"WITH {B.SQL_PREDS}, per AS (SELECT gold AS cls, count(*) AS n, avg((a = gold)::INT) AS ra, avg((b = gold)::INT) AS rb FROM preds GROUP BY gold), r AS (SELECT * FROM per UNION ALL SELECT 'macro', CAST(sum(n) AS BIGINT), avg(ra), avg(rb) FROM per) SELECT cls, n, round(ra, 6) AS recall_a, round(rb, 6) AS recall_b, round(rb - ra, 6) AS delta FROM r",
    "assemble": f"WITH {B.SQL_PREDS}, {_ASSEMBLED} SELECT * FROM assembled",
    "confusion_matrix": f"WITH {B.SQL_PREDS}, {_ASSEMBLED} SELECT gold, " + ", ".join(f"count(*) FILTER (b_intent = '{c}') AS {c}" for c in ("en", "de", "fr", "es", MISSING)) + " FROM assembled GROUP BY gold",
    "majority": f"WITH {B.SQL_GOLD}, c AS (SELECT lang, count(*) AS n FROM gold GROUP BY lang) SELECT arg_max(lang, (n, lang)) AS majority, round(max(n) / sum(n)::DOUBLE, 6) AS share, round(sum(pow(n, 2)) / pow(sum(n), 2), 6) AS chance FROM c",
    "fixes_breaks": f"WITH {B.SQL_PREDS} SELECT item, CASE WHEN b = gold THEN 'fixed' ELSE 'broken' END AS kind, left(trim(regexp_replace(coalesce(text, ''), '[ \\t\\r\\n]+', ' ', 'g')), 120) AS text FROM preds JOIN documents ON item = doc_id WHERE (a = gold) <> (b = gold)",
    "calibration_gap": f"WITH {B.SQL_ROUTE}, c AS (SELECT count(*) FILTER (confidence < 0.5) AS n_low, count(*) FILTER (confidence >= 0.5) AS n_high, round(avg(escalate::INT) FILTER (confidence < 0.5), 6) AS low, round(avg(escalate::INT) FILTER (confidence >= 0.5), 6) AS high FROM route_in) SELECT *, CASE WHEN n_low >= 20 AND n_high >= 20 THEN round(high - low, 6) END AS gap FROM c",
    "majority_baseline": f"WITH {B.SQL_GOLD}, t AS (SELECT lang, count(*) AS n FROM gold WHERE doc_id % 3 > 0 GROUP BY lang) SELECT doc_id, lang AS gold, (SELECT arg_max(lang, (n, lang)) FROM t) AS pred, 'We will look into it.' AS reply, true AS escalate FROM gold WHERE doc_id % 3 = 0",
    "accuracy": f"WITH {B.SQL_PREDS}, c AS (SELECT gold AS cls, count(*) AS n, count(*) FILTER (a = gold) AS hits FROM preds GROUP BY gold) SELECT cls, n, hits, round({_W}, 6) AS accuracy, " + ", ".join(f"round(({_W} + 1.96 * 1.96 / (2 * n) {op} 1.96 * sqrt({_W} * (1 - {_W}) / n + 1.96 * 1.96 / (4.0 * n * n))) / (1 + 1.96 * 1.96 / n), 6) AS {name}" for op, name in (("-", "low"), ("+", "high"))) + " FROM c",
    "class_report": f"WITH {B.SQL_PREDS}, s AS (SELECT c AS cls, count(*) FILTER (gold = c) AS support, count(*) FILTER (a = c) AS said, count(*) FILTER (gold = c AND a = c) AS hit FROM preds, (SELECT gold AS c FROM preds UNION SELECT a FROM preds) GROUP BY c) SELECT cls, support, round(coalesce(hit / nullif(said, 0)::DOUBLE, 0), 6) AS precision, round(coalesce(hit / nullif(support, 0)::DOUBLE, 0), 6) AS recall, round(coalesce(2 * hit / nullif(said + support, 0)::DOUBLE, 0), 6) AS f1 FROM s",
    "bidirectional": f"WITH {B.SQL_PREDS} SELECT least(gold, b) AS x, greatest(gold, b) AS y, count(*) FILTER (gold < b) AS n_xy, count(*) FILTER (gold > b) AS n_yx FROM preds WHERE gold <> b GROUP BY ALL",
    "calibration": f"WITH {B.SQL_ROUTE} SELECT CAST(least(floor(confidence * 5), 4) AS BIGINT) AS bin, count(*) AS n, round(avg(confidence), 6) AS confidence, round(avg(escalate::INT), 6) AS accuracy FROM route_in GROUP BY ALL",
    "over_quota": "SELECT event_id, calls FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 86400 SECONDS PRECEDING AND CURRENT ROW) AS calls FROM events) WHERE calls > 3",
    "fingerprint": _hashed("documents", ["doc_id::VARCHAR", "lang", "source", "n_chars::VARCHAR", "text"]),
    "fingerprint_ordered": _hashed("(SELECT *, row_number() OVER (ORDER BY n_chars, doc_id) AS k FROM documents)", ["k::VARCHAR", "lang", "text"]),
}
_overrides = [f"WHEN {flag} THEN '{why}'" for flag, why in OVERRIDES.items()]
_overrides.insert(1, "WHEN confidence IS NULL OR confidence < 0.5 THEN 'low_confidence'")
_ROUTED = f"{B.SQL_ROUTE}, r AS (SELECT *, CASE {' '.join(_overrides)} " + " ".join(f"WHEN intent = '{n}' THEN 'default_{a}'" for n, a in DEFAULTS.items()) + " ELSE 'unknown_class' END AS reason FROM route_in)"
_rates = ", ".join(f"round({a} / nullif({b}, 0)::DOUBLE, 6) AS {n}" for a, b, n in (('"right"', "n", "accuracy"), ("escalated", "n", "escalated_rate"), ("(escalated - over)", "escalated", "precision"), ("(due - missed)", "due", "recall"), ("missed", "due", "miss_rate"), ("over", "(n - due)", "false_alarm_rate")))
ORACLE_SQL |= {
    "route": f"WITH {_ROUTED} SELECT item, reason, reason <> 'default_auto' AS pred FROM r",
    "routing_metrics": f"WITH {_ROUTED}, p AS (SELECT escalate AS t, reason <> 'default_auto' AS p FROM r), m AS (SELECT count(*) AS n, count(*) FILTER (p = t) AS \"right\", count(*) FILTER (p) AS escalated, count(*) FILTER (t) AS due, count(*) FILTER (NOT p AND t) AS missed, count(*) FILTER (p AND NOT t) AS over FROM p) SELECT *, {_rates} FROM m",
    "report_averages": f"WITH c AS ({ORACLE_SQL['class_report']}) SELECT 'macro' AS cls, CAST(sum(support) AS BIGINT) AS support, {_AVERAGES.format(f='avg(CASE WHEN support >= 20 THEN ', g=' END)')} FROM c UNION ALL SELECT 'weighted', CAST(sum(support) AS BIGINT), {_AVERAGES.format(f='sum(support * ', g=') / sum(support)')} FROM c",
    "mcnemar": f"WITH {B.SQL_PREDS}, t AS (SELECT count(*) FILTER (a = gold AND b <> gold) AS only_a, count(*) FILTER (a <> gold AND b = gold) AS only_b FROM preds) SELECT only_a, only_b, round(CASE WHEN only_a + only_b = 0 THEN 1.0 ELSE least(1.0, 2 * (SELECT sum(exp(lgamma(only_a + only_b + 1) - lgamma(i + 1) - lgamma(only_a + only_b - i + 1) - (only_a + only_b) * ln(2.0))) FROM range(0, 100000) g(i) WHERE i <= least(only_a, only_b))) END, 6) AS p FROM t",
}
