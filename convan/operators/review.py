"""Profiles, label versions, agreement and signals: aggregates over one pass, and joins on item ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convan.functions.scratch import running_sum
from convan.operators.evaluation import DEFAULTS, _ROUTED, route, wilson
from convan.plans import bindings as B

# Words of a bare greeting, the words allowed beside them, and the new names of old event types.
GREETINGS, FILLERS = ("hi", "hello", "hey"), ("there", "all", "team", "please", "thanks")
MIGRATION = {"click": "engage", "view": "engage", "purchase": "order"}
DISSOLVED = {"error": [("value > 80", "incident"), ("value > 20", "fault")]}
TOPICS = {"licence": "(?i)licen[sc]e", "contact": "[A-Za-z0-9._]+@[A-Za-z0-9.]+"}
SHOUT = "!!"


def profile(df: DataFrame) -> DataFrame:
    """Type, nulls and rows of each column, in one pass. An empty table has a row per column too."""
    one = df.agg(F.count("*").alias("_n"), *(F.count_if(F.col(f"`{c}`").isNull()).alias(f"_{i}") for i, c in enumerate(df.columns)))
    return one.select(F.col("_n").alias("n_rows"), F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.lit(t).alias("type"), F.col(f"_{i}").alias("nulls")) for i, (c, t) in enumerate(df.dtypes)))).alias("c")).select("c.name", "c.type", "c.nulls", "n_rows")


def shortlist_volume(messages: DataFrame, keys: list[str]) -> DataFrame:
    """Per author of the shortlist: own replies, distinct messages replied to, and distinct messages of either kind."""
    own = messages.where(F.col("author").isin(keys) & F.col("reply_to").isNotNull())
    ids = own.select("author", F.explode(F.array("msg_id", "reply_to")).alias("id"))
    counts = own.groupBy("author").agg(F.count("*").alias("replies"), F.countDistinct("reply_to").alias("answered"))
    return counts.join(ids.groupBy("author").agg(F.countDistinct("id").alias("touched")).hint("merge"), "author")


def category_overlap(df: DataFrame, text: str, x: str, topics: dict[str, str]) -> DataFrame:
    """Of the rows that match x: how many match each topic as well. One pass."""
    hit = df.where(F.col(text).rlike(x))
    one = hit.agg(F.count("*").alias("n_x"), *(F.count_if(F.col(text).rlike(p)).alias(f"_{i}") for i, p in enumerate(topics.values())))
    return one.select("n_x", F.explode(F.array(*(F.struct(F.lit(t).alias("topic"), F.col(f"_{i}").alias("n_both")) for i, t in enumerate(topics)))).alias("t")).select("t.topic", "t.n_both", "n_x")


def with_context(messages: DataFrame, brand: str) -> DataFrame:
    """Every message with a line that says whom it answers, and with what text; those without a known parent keep an empty line. A null text counts as empty."""
    parent = messages.select(F.col("msg_id").alias("_p"), F.col("author").alias("_a"), F.coalesce("text", F.lit("")).alias("_t"))
    who = F.when(F.col("_a") == brand, "Brand").when(F.col("_a") == F.col("author"), "Same author").otherwise("Other")
    line = F.when(F.col("_p").isNull(), "").otherwise(F.concat(who, F.lit(": "), "_t"))
    return messages.join(parent.hint("merge"), F.col("reply_to") == F.col("_p"), "left").select("msg_id", line.alias("context"))


def version_audit(df: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """Rows whose label differs between two versions; null is a value of its own."""
    return df.where(~F.col(a).eqNullSafe(F.col(b))).select(key, F.col(a).alias("old"), F.col(b).alias("new"))


def migrate_categories(df: DataFrame, key: str, col: str, mapping: dict[str, str], dissolved: dict[str, list[tuple[str, str]]]) -> DataFrame:
    """The new category of each row; categories without an entry stay. A dissolved category has (condition, category) rules, of
    which the first that holds counts; its rows that no rule takes have none."""
    new = F.col(col)
    for old, rules in dissolved.items():
        to = F.lit(None).cast("string")
        for condition, category in reversed(rules):
            to = F.when(F.expr(condition), category).otherwise(to)
        new = F.when(F.col(col) == old, to).otherwise(new)
    for old, to in mapping.items():
        new = F.when(F.col(col) == old, to).otherwise(new)
    return df.select(key, new.alias("category"))


def strip_leading_handles(text: Column) -> Column:
    return F.regexp_replace(text, r"^([ \t\r\n]*@[A-Za-z0-9_]+)+[ \t\r\n]*", "")


def is_bare_greeting(text: Column, most: int = 4) -> Column:
    """At most a few words, one greeting among them and nothing else but fillers. Null and empty texts are none."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z']+"), 0)
    return (F.size(words) <= most) & F.exists(words, lambda w: w.isin(*GREETINGS)) & F.forall(words, lambda w: w.isin(*GREETINGS, *FILLERS))


def flags_to_string(df: DataFrame, flags: list[str]) -> Column:
    """The names of the flags that are set, in order, joined by semicolons; none: empty."""
    return F.array_join(F.array_compact(F.array(*(F.when(F.col(f), F.lit(f)) for f in flags))), ";")


def flags_from_string(text: Column) -> Column:
    """The names in a flag string, split at ; or , and trimmed; null and empty strings have none."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "[;,]"), lambda x: F.trim(x)), lambda x: x != "")


def has_flag(text: Column, flag: str) -> Column:
    return F.array_contains(flags_from_string(text), flag)


def separation(df: DataFrame, gold: str, pred: str, other: str) -> DataFrame:
    """Accuracy of pred where another signal agrees with it, and where not."""
    return df.groupBy(F.col(pred).eqNullSafe(F.col(other)).alias("agrees")).agg(F.count("*").alias("n"), F.round(F.avg((F.col(gold) == F.col(pred)).cast("double")), 6).alias("accuracy"))


def separation_difference(parts: DataFrame) -> DataFrame:
    """The accuracy of a separation where the signals agree less that where they don't; null without rows on either side."""
    of = lambda yes: F.max(F.when(F.col("agrees") == yes, F.col("accuracy")))
    return parts.agg(of(True).alias("agreeing"), of(False).alias("disagreeing"), F.round(of(True) - of(False), 6).alias("difference"))


def thin_classes(df: DataFrame, cls: str, least: int) -> DataFrame:
    return df.groupBy(cls).agg(F.count("*").alias("n")).where(F.col("n") < least)


def minority_rows(df: DataFrame, key: str, cls: str, flag: str, smallest: int = 4) -> DataFrame:
    """Rows whose flag is the rare one in their class: at most 2 rows or a quarter. Classes are counted before the join."""
    c = df.groupBy(cls).agg(F.count("*").alias("_n"), F.count_if(F.col(flag)).alias("_t")).where(F.col("_n") >= smallest)
    rows = df.select(key, cls, flag).join(c.hint("merge"), cls)
    same = F.when(F.col(flag), F.col("_t")).otherwise(F.col("_n") - F.col("_t"))
    return rows.where((same <= F.greatest(F.lit(2.0), F.col("_n") * 0.25)) & (same * 2 < F.col("_n"))).select(key, cls, flag)


def risk_metrics(df: DataFrame, pred: str, truth: str) -> DataFrame:
    """Risky rows, those caught with the 95 % interval of their share, and how the rows left to the machine fare."""
    p, t = F.col(pred), F.col(truth)
    one = df.agg(F.count_if(t).alias("n_risky"), F.count_if(t & p).alias("caught"), F.count_if(~p).alias("n_auto"), F.round(F.count_if(~p & ~t) / F.nullif(F.count_if(~p), F.lit(0)), 6).alias("auto_accuracy"))
    low, high = wilson(F.col("caught").cast("double"), F.nullif("n_risky", F.lit(0)).cast("double"))
    return one.select("*", F.round(F.col("caught") / F.nullif("n_risky", F.lit(0)), 6).alias("recall"), low.alias("low"), high.alias("high"))


def policy_mismatch(df: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """Labels that the policy contradicts; labels are certain, so their confidence is 1."""
    return route(df.withColumn("confidence", F.lit(1.0)), defaults).select("item", "pred", "escalate").where("pred <> escalate")


def mismatch_rate(df: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """Labelled rows, those that the policy contradicts, and their share; null without rows."""
    one = route(df.withColumn("confidence", F.lit(1.0)), defaults).agg(F.count("*").alias("n"), F.count_if(F.expr("pred <> escalate")).alias("n_mismatch"))
    return one.withColumn("rate", F.round(F.col("n_mismatch") / F.nullif("n", F.lit(0)), 6))


def trigger_table(df: DataFrame, signals: list[str], base: str, truth: str) -> DataFrame:
    """Per signal: fires, fires on rows to escalate, and fires on those of them that the base rule misses."""
    s = F.explode(F.array(*(F.struct(F.lit(n).alias("signal"), F.col(n).alias("on")) for n in signals)))
    return df.select(base, truth, s.alias("s")).groupBy("s.signal").agg(F.count_if("s.on").alias("fires"), F.count_if(F.col("s.on") & F.col(truth)).alias("on_escalated"), F.count_if(F.col("s.on") & F.col(truth) & ~F.col(base)).alias("on_missed"))


def rank_correlation(df: DataFrame, a: str, b: str, by: str) -> DataFrame:
    """Spearman's correlation of two raters per group, with average ranks for ties; null where a rater never differs.

    Rows are counted by (group, a, b) first, so the windows run over the distinct pairs of ratings."""
    c = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(by, a, b).agg(F.count("*").alias("n"))
    for x in (a, b):
        upto, same = F.sum("n").over(Window.partitionBy(by).orderBy(x).rangeBetween(Window.unboundedPreceding, Window.currentRow)), F.sum("n").over(Window.partitionBy(by, x))
        c = c.withColumn(f"_r{x}", upto - (same - 1) / 2)
    x, y, n = F.col(f"_r{a}"), F.col(f"_r{b}"), F.col("n")
    s = c.groupBy(by).agg(F.sum("n").alias("n"), *(F.sum(n * v).alias(k) for k, v in (("x", x), ("y", y), ("xx", x * x), ("yy", y * y), ("xy", x * y))))
    spread = lambda q, m: F.col("n") * F.col(q) - F.col(m) * F.col(m)
    return s.select(by, F.round((n * F.col("xy") - F.col("x") * F.col("y")) / F.nullif(F.sqrt(spread("xx", "x") * spread("yy", "y")), F.lit(0.0)), 6).alias("spearman"))


def group_agreement(df: DataFrame, a: str, b: str, flag_a: str, flag_b: str, by: str) -> DataFrame:
    """Per group: rows, exact agreement, equal flags, and Spearman's correlation."""
    plain = df.groupBy(by).agg(F.count("*").alias("n"), F.round(F.avg((F.col(a) == F.col(b)).cast("double")), 6).alias("exact"), F.round(F.avg(F.col(flag_a).eqNullSafe(F.col(flag_b)).cast("double")), 6).alias("same_flag"))
    return plain.join(rank_correlation(df, a, b, by).hint("merge"), by, "left")


def rater_agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """Exact and within-1 agreement, bias, and Cohen's kappa of two raters' acceptance (4 or more). One pass."""
    x, y = F.col(a) >= 4, F.col(b) >= 4
    s = df.agg(F.count("*").alias("n"), F.count_if(F.col(a) == F.col(b)).alias("_e"), F.count_if(F.abs(F.col(a) - F.col(b)) <= 1).alias("_w"), F.avg(F.col(a) - F.col(b)).alias("_d"), F.count_if(x == y).alias("_s"), F.count_if(x).alias("_x"), F.count_if(y).alias("_y"))
    chance = (F.col("_x") * F.col("_y") + (F.col("n") - F.col("_x")) * (F.col("n") - F.col("_y"))) / (F.col("n") * F.col("n"))
    return s.select("n", F.round(F.col("_e") / F.col("n"), 6).alias("exact"), F.round(F.col("_w") / F.col("n"), 6).alias("within_1"), F.round("_d", 6).alias("bias"), F.round((F.col("_s") / F.col("n") - chance) / F.nullif(1 - chance, F.lit(0.0)), 6).alias("kappa"))


def drift(pins: DataFrame, now: DataFrame, key: str, value: str) -> DataFrame:
    """Per key of either table: ok, changed, missing (only pinned) or new."""
    p, n = pins.select(key, F.col(value).alias("_p"), F.lit(True).alias("_in")), now.select(key, F.col(value).alias("_n"), F.lit(True).alias("_is"))
    state = F.when(F.col("_is").isNull(), "missing").when(F.col("_in").isNull(), "new").when(F.col("_p").eqNullSafe(F.col("_n")), "ok").otherwise("changed")
    return p.join(n.hint("merge"), key, "full").select(key, state.alias("state"))


def auroc(df: DataFrame, truth: str, score: str) -> DataFrame:
    """Area under the ROC curve by average ranks over distinct scores; null with one class only.

    Scores are counted by value first; the counts below each are summed up by ranges of scores, many tasks at a time."""
    c = df.where(F.col(truth).isNotNull() & F.col(score).isNotNull()).groupBy(score).agg(F.count_if(F.col(truth)).alias("p"), F.count_if(~F.col(truth)).alias("q"))
    c = running_sum(c, [F.col(score)], "q", "upto")
    s = c.select("p", "q", (F.col("upto") - F.col("q")).alias("below")).agg(F.sum("p").alias("p"), F.sum("q").alias("q"), F.sum(F.col("p") * (F.col("below") + F.col("q") / 2)).alias("u"))
    return s.select(F.col("p").alias("positives"), F.col("q").alias("negatives"), F.round(F.col("u") / F.nullif(F.col("p") * F.col("q"), F.lit(0)), 6).alias("auroc"))


def _ratings(spark, d):
    stars = lambda c: F.least(F.lit(5), 1 + F.floor(c)).cast("int")
    spaces = F.length(F.regexp_replace("text", "[^ ]", ""))
    return B.table(spark, d, "documents").select("doc_id", "lang", (F.col("n_chars") < 60).alias("f"), (spaces < 10).alias("g"), stars(F.col("n_chars") / 400).alias("a"), stars(spaces / 60).alias("b"))


def _docs(spark, d):
    return B.table(spark, d, "documents")


_SIGNALS = ["legal_sensitive", "abusive_content", "wants_human"]
QUERIES = {
    "profile": lambda s, d: profile(B.table(s, d, "pages")),
    "shortlist_volume": lambda s, d: shortlist_volume(B.msgs(s, d), ["assistant", "user"]),
    "category_overlap": lambda s, d: category_overlap(_docs(s, d), "text", SHOUT, TOPICS),
    "with_context": lambda s, d: with_context(B.msgs(s, d), "assistant"),
    "version_audit": lambda s, d: version_audit(B.preds(s, d), "item", "a", "b"),
    "migrate_categories": lambda s, d: migrate_categories(B.table(s, d, "events"), "event_id", "event_type", MIGRATION, DISSOLVED),
    "strip_leading_handles": lambda s, d: B.msgs(s, d).select("msg_id", strip_leading_handles(F.concat(F.lit("@"), "author", F.lit(" @x "), "text")).alias("text")),
    "is_bare_greeting": lambda s, d: B.msgs(s, d).select("msg_id", is_bare_greeting(F.col("text")).alias("greeting")),
    "flags_to_string": lambda s, d: (lambda r: r.select("item", flags_to_string(r, _SIGNALS).alias("flags")))(B.route_in(s, d)),
    "flags_from_string": lambda s, d: B.route_in(s, d).select("item", F.concat(F.lit(" "), F.when(F.col("triage"), "triage").otherwise(""), F.lit(";; "), F.when(F.col("disputes"), "disputes").otherwise("x"), F.lit(" ,y")).alias("t")).select("item", F.array_join(flags_from_string(F.col("t")), "|").alias("flags"), has_flag(F.col("t"), "triage").alias("triage")),
    "separation": lambda s, d: separation(B.preds(s, d), "gold", "a", "b"),
    "separation_difference": lambda s, d: separation_difference(separation(B.preds(s, d), "gold", "a", "b")),
    "thin_classes": lambda s, d: thin_classes(B.gold(s, d), "source", 100),
    "minority_rows": lambda s, d: minority_rows(B.route_in(s, d), "item", "intent", "escalate"),
    "risk_metrics": lambda s, d: risk_metrics(route(B.route_in(s, d), DEFAULTS), "pred", "escalate"),
    "policy_mismatch": lambda s, d: policy_mismatch(B.route_in(s, d), DEFAULTS),
    "mismatch_rate": lambda s, d: mismatch_rate(B.route_in(s, d), DEFAULTS),
    "trigger_table": lambda s, d: trigger_table(route(B.route_in(s, d), DEFAULTS), _SIGNALS, "pred", "escalate"),
    "group_agreement": lambda s, d: group_agreement(_ratings(s, d), "a", "b", "f", "g", "lang"),
    "rater_agreement": lambda s, d: rater_agreement(_ratings(s, d), "a", "b"),
    "drift": lambda s, d: drift(B.preds(s, d).where("a <> 'fr'"), B.preds(s, d).where("b <> 'es'").withColumn("a", F.col("b")), "item", "a"),
    "auroc": lambda s, d: auroc(B.route_in(s, d), "escalate", "confidence"),
}
_list = lambda names: "(" + ", ".join(f"'{n}'" for n in names) + ")"
_P = f"{_ROUTED}, p AS (SELECT item, escalate, reason <> 'default_auto' AS pred, {', '.join(_SIGNALS)} FROM r)"
_CERTAIN = _P.replace(f'{B.sql_uniform("doc_id", 1)} / 4294967295.0 AS confidence', "1.0 AS confidence")
_RATED = """r AS (SELECT lang, n_chars < 60 AS f, length(regexp_replace(text, '[^ ]', '', 'g')) < 10 AS g, least(5, 1 + floor(n_chars / 400)) AS a, least(5, 1 + floor(length(regexp_replace(text, '[^ ]', '', 'g')) / 60)) AS b FROM documents)"""
ORACLE_SQL = {
    "profile": " UNION ALL ".join(f"SELECT '{c}' AS name, '{t}' AS type, count(*) - count({c}) AS nulls, count(*) AS n_rows FROM pages" for c, t in (("page_id", "bigint"), ("url", "string"), ("html", "string"))),
    "shortlist_volume": f"WITH {B.SQL_MSGS}, o AS (SELECT * FROM msgs WHERE author IN ('assistant', 'user') AND reply_to IS NOT NULL), t AS (SELECT author, msg_id AS id FROM o UNION SELECT author, reply_to FROM o), n AS (SELECT author, count(*) AS touched FROM t GROUP BY author) SELECT author, count(*) AS replies, count(DISTINCT reply_to) AS answered, any_value(touched) AS touched FROM o JOIN n USING (author) GROUP BY author",
    "category_overlap": " UNION ALL ".join(f"SELECT '{t}' AS topic, count(*) FILTER (regexp_matches(text, '{p}')) AS n_both, count(*) AS n_x FROM documents WHERE contains(text, '{SHOUT}')" for t, p in TOPICS.items()),
    "with_context": f"WITH {B.SQL_MSGS} SELECT m.msg_id, CASE WHEN p.msg_id IS NULL THEN '' ELSE CASE WHEN p.author = 'assistant' THEN 'Brand' WHEN p.author = m.author THEN 'Same author' ELSE 'Other' END || ': ' || coalesce(p.text, '') END AS context FROM msgs m LEFT JOIN msgs p ON m.reply_to = p.msg_id",
    "version_audit": f"WITH {B.SQL_PREDS} SELECT item, a AS old, b AS new FROM preds WHERE a IS DISTINCT FROM b",
    "migrate_categories": "SELECT event_id, CASE " + " ".join(f"WHEN event_type = '{a}' THEN '{b}'" for a, b in MIGRATION.items()) + "".join(f" WHEN event_type = '{a}' THEN CASE " + " ".join(f"WHEN {c} THEN '{b}'" for c, b in rules) + " END" for a, rules in DISSOLVED.items()) + " ELSE event_type END AS category FROM events",
    "strip_leading_handles": f"WITH {B.SQL_MSGS} SELECT msg_id, regexp_replace('@' || author || ' @x ' || text, '^([ \\t\\r\\n]*@[A-Za-z0-9_]+)+[ \\t\\r\\n]*', '') AS text FROM msgs",
    "is_bare_greeting": f"WITH {B.SQL_MSGS}, w AS (SELECT msg_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z'']+') AS w FROM msgs) SELECT msg_id, len(w) <= 4 AND len(list_filter(w, lambda x: x IN {_list(GREETINGS)})) > 0 AND len(list_filter(w, lambda x: x NOT IN {_list(GREETINGS + FILLERS)})) = 0 AS greeting FROM w",
    "flags_to_string": f"WITH {B.SQL_ROUTE} SELECT item, concat_ws(';', {', '.join(f"CASE WHEN {f} THEN '{f}' END" for f in _SIGNALS)}) AS flags FROM route_in",
    "flags_from_string": f"WITH {B.SQL_ROUTE} SELECT item, concat_ws('|', CASE WHEN triage THEN 'triage' END, CASE WHEN disputes THEN 'disputes' ELSE 'x' END, 'y') AS flags, triage FROM route_in",
    "separation_difference": f"WITH {B.SQL_PREDS}, s AS (SELECT round(avg((a = gold)::INT) FILTER (a = b), 6) AS agreeing, round(avg((a = gold)::INT) FILTER (a <> b), 6) AS disagreeing FROM preds) SELECT *, round(agreeing - disagreeing, 6) AS difference FROM s",
    "separation": f"WITH {B.SQL_PREDS} SELECT a = b AS agrees, count(*) AS n, round(avg((a = gold)::INT), 6) AS accuracy FROM preds GROUP BY ALL",
    "thin_classes": f"WITH {B.SQL_GOLD} SELECT source, count(*) AS n FROM gold GROUP BY source HAVING count(*) < 100",
    "minority_rows": f"WITH {B.SQL_ROUTE}, c AS (SELECT item, intent, escalate, count(*) OVER (PARTITION BY intent) AS n, count(*) OVER (PARTITION BY intent, escalate) AS same FROM route_in) SELECT item, intent, escalate FROM c WHERE n >= 4 AND same <= greatest(2.0, n * 0.25) AND same * 2 < n",
    "risk_metrics": f"WITH {_P}, c AS (SELECT count(*) FILTER (escalate) AS n_risky, count(*) FILTER (escalate AND pred) AS caught, count(*) FILTER (NOT pred) AS n_auto, round(count(*) FILTER (NOT pred AND NOT escalate) / nullif(count(*) FILTER (NOT pred), 0)::DOUBLE, 6) AS auto_accuracy FROM p), q AS (SELECT *, nullif(n_risky, 0)::DOUBLE AS n, caught / nullif(n_risky, 0)::DOUBLE AS r FROM c) SELECT n_risky, caught, n_auto, auto_accuracy, round(r, 6) AS recall, " + ", ".join(f"round((r + 3.8416 / (2 * n) {op} 1.96 * sqrt(r * (1 - r) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 6) AS {name}" for op, name in (("-", "low"), ("+", "high"))) + " FROM q",
    "policy_mismatch": f"WITH {_CERTAIN} SELECT item, pred, escalate FROM p WHERE pred <> escalate",
    "mismatch_rate": f"WITH {_CERTAIN} SELECT count(*) AS n, count(*) FILTER (pred <> escalate) AS n_mismatch, round(count(*) FILTER (pred <> escalate) / nullif(count(*), 0)::DOUBLE, 6) AS rate FROM p",
    "trigger_table": f"WITH {_P} " + " UNION ALL ".join(f"SELECT '{n}' AS signal, count(*) FILTER ({n}) AS fires, count(*) FILTER ({n} AND escalate) AS on_escalated, count(*) FILTER ({n} AND escalate AND NOT pred) AS on_missed FROM p" for n in _SIGNALS),
    "group_agreement": f"WITH {_RATED}, k AS (SELECT *, rank() OVER (PARTITION BY lang ORDER BY a) + (count(*) OVER (PARTITION BY lang, a) - 1) / 2.0::DOUBLE AS x, rank() OVER (PARTITION BY lang ORDER BY b) + (count(*) OVER (PARTITION BY lang, b) - 1) / 2.0::DOUBLE AS y FROM r) SELECT lang, count(*) AS n, round(avg((a = b)::INT), 6) AS exact, round(avg((f = g)::INT), 6) AS same_flag, CASE WHEN stddev_pop(x) * stddev_pop(y) > 0 THEN round(corr(x, y), 6) END AS spearman FROM k GROUP BY lang",
    "rater_agreement": """WITH r AS (SELECT least(5, 1 + floor(n_chars / 400)) AS a, least(5, 1 + floor(length(regexp_replace(text, '[^ ]', '', 'g')) / 60)) AS b FROM documents),
        s AS (SELECT count(*) AS n, avg((a = b)::INT) AS e, avg((abs(a - b) <= 1)::INT) AS w, avg(a - b) AS d, avg(((a >= 4) = (b >= 4))::INT) AS s, avg((a >= 4)::INT) AS x, avg((b >= 4)::INT) AS y FROM r)
        SELECT n, round(e, 6) AS exact, round(w, 6) AS within_1, round(d, 6) AS bias, round((s - (x * y + (1 - x) * (1 - y))) / (1 - (x * y + (1 - x) * (1 - y))), 6) AS kappa FROM s""",
    "drift": f"WITH {B.SQL_PREDS}, p AS (SELECT item, a FROM preds WHERE a <> 'fr'), n AS (SELECT item, b FROM preds WHERE b <> 'es') SELECT item, CASE WHEN b IS NULL THEN 'missing' WHEN a IS NULL THEN 'new' WHEN a = b THEN 'ok' ELSE 'changed' END AS state FROM p FULL JOIN n USING (item)",
    "auroc": f"WITH {B.SQL_ROUTE}, r AS (SELECT escalate, confidence AS s FROM route_in), k AS (SELECT escalate, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS k FROM r), t AS (SELECT count(*) FILTER (escalate) AS p, count(*) FILTER (NOT escalate) AS q, sum(k) FILTER (escalate) AS u FROM k) SELECT p AS positives, q AS negatives, round((u - p * (p + 1) / 2.0) / nullif(p * q, 0), 6) AS auroc FROM t",
}
