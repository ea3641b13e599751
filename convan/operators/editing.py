"""Label edits, versions of labels, batches to label and the evaluation set: joins on ids, and distributed ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convan.functions.scratch import ranked, saved
from convan.operators.text import contaminated, normalize_text
from convan.plans import bindings as B

# Hints that a text belongs to a class.
HINTS = {"de": "(?i) und ", "fr": "(?i) les "}


def middle_of_ranking(df: DataFrame, key: str, k: int) -> DataFrame:
    """The k keys before the middle of the ranking by rows, and the k from there on. Ties go by key."""
    counts = df.groupBy(key).agg(F.count("*").alias("n"))
    places = ranked(counts, [F.desc("n"), F.asc(key)])
    half = places.agg(F.floor(F.max("rank") / 2).alias("_half"))  # one row
    return places.crossJoin(F.broadcast(half)).where((F.col("rank") > F.col("_half") - k) & (F.col("rank") <= F.col("_half") + k)).select(key, "n", "rank")


def default_usage(df: DataFrame, cols: list[str]) -> DataFrame:
    """Per column: its commonest value (ties: the smallest), that value's share, and whether it looks never set (0.95 or more)."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("value")) for c in cols))).alias("x")).groupBy("x.field", "x.value").agg(F.count("*").alias("n"))
    top = long.groupBy("field").agg(F.min_by("value", F.struct((-F.col("n")).alias("n"), "value")).alias("value"), (F.max("n") / F.sum("n")).alias("share"))
    return top.select("field", "value", F.round("share", 6).alias("share"), (F.col("share") >= 0.95).alias("defaulted"))


def usage_shares(df: DataFrame, uses: dict[str, Column], rare: float = 0.05) -> DataFrame:
    """Per use of a field (flags set, a second value given): rows with it, all rows, their share, and whether that is near none. A null is no use."""
    counts = df.agg(F.count("*").alias("n_rows"), *(F.count_if(c).alias(f"_{i}") for i, c in enumerate(uses.values())))
    long = counts.select("n_rows", F.inline(F.array(*(F.struct(F.lit(n).alias("use"), F.col(f"_{i}").alias("n")) for i, n in enumerate(uses)))))
    share = F.col("n") / F.nullif(F.col("n_rows"), F.lit(0))
    return long.select("use", "n", "n_rows", F.round(share, 6).alias("share"), (share < rare).alias("near_none"))


def progress(items: DataFrame, done: dict[str, DataFrame], key: str) -> DataFrame:
    """Per version: distinct items of the set that have a result, and the size of the set."""
    total = items.agg(F.countDistinct(key).alias("n_items"))  # one row
    hits = None
    for name, df in done.items():
        part = df.select(key).distinct().join(items.select(key).distinct().hint("merge"), key, "left_semi").agg(F.count("*").alias("n_done")).withColumn("version", F.lit(name))
        hits = part if hits is None else hits.unionByName(part)
    return hits.crossJoin(F.broadcast(total)).select("version", "n_done", "n_items")


def scorable(df: DataFrame, split: DataFrame, key: str, side: str, status: str, excluded: list[str]) -> DataFrame:
    """Rows on one side of a split whose status lets them be scored; a null status can be scored."""
    ok = df.where(~F.coalesce(F.col(status).isin(excluded), F.lit(False)))
    return ok.join(split.where(F.col("split") == side).select(key).hint("merge"), key, "left_semi")


def orphan_edits(base: DataFrame, edits: DataFrame, key: str) -> DataFrame:
    """Edits of unknown items, and edits that decide nothing."""
    known = base.select(key).distinct().withColumn("_known", F.lit(True))
    problem = F.when(F.col("_known").isNull(), "unknown").when(F.coalesce(F.trim("label"), F.lit("")) == "", "undecided")
    return edits.join(known.hint("merge"), key, "left").select(key, problem.alias("problem")).where("problem is not null")


def apply_edits(base: DataFrame, edits: DataFrame, key: str, label: str) -> DataFrame:
    """The next version of a label: the edit's where it gives one, else the one before. Edits have one row per item.

    status is edited, confirmed (the edit gives the label that was there), or kept; confidence and source are those of an
    edit that gives a label, if edits have these columns, else null."""
    e = edits.select(key, F.nullif(F.trim("label"), F.lit("")).alias("_e"), "rule", *((F.col(c) if c in edits.columns else F.lit(None).cast(t)).alias(c) for c, t in (("confidence", "double"), ("source", "string"))))
    out = base.select(key, label).join(e.hint("merge"), key, "left")
    new, given = F.coalesce("_e", label), F.col("_e").isNotNull()
    changed = ~new.eqNullSafe(F.col(label))
    status = F.when(changed, "edited").when(given, "confirmed").otherwise("kept")
    return out.select(key, F.col(label).alias("before"), new.alias("label"), *(F.when(given, F.col(c)).alias(c) for c in ("rule", "confidence", "source")), status.alias("status"), changed.alias("changed"))


def merge_reviews(first: DataFrame, changes: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Two passes of verdicts in one table: the first with its recheck's changes, then the second."""
    c = changes.select(key, F.col("verdict").alias("_v"))
    a = first.select(key, "verdict").join(c.hint("merge"), key, "left").select(key, F.lit(1).alias("side"), F.coalesce("_v", "verdict").alias("verdict"), F.coalesce(F.col("_v") != F.col("verdict"), F.lit(False)).alias("changed"))
    return a.unionByName(second.select(key, F.lit(2).alias("side"), "verdict", F.lit(False).alias("changed")))


def backfill_namespace(log: DataFrame, old: str, new: str, key: str) -> DataFrame:
    """The log, and the old namespace's rows under the new one where it lacks the key. A second call adds nothing."""
    add = log.where(F.col("namespace") == old).join(log.where(F.col("namespace") == new).select(key).distinct().hint("merge"), key, "left_anti")
    return log.unionByName(add.withColumn("namespace", F.lit(new)))


def topup_batch(df: DataFrame, id_col: str, text: str, have: DataFrame, cls: str, minimum: int, hints: dict[str, str], size: int, seed: int) -> DataFrame:
    """A batch to label: first rows that match the hint of a class with fewer than `minimum` rows in `have`, then any, at random."""
    short = have.agg(*((F.count_if(F.col(cls) == c) < minimum).alias(f"_short{i}") for i, c in enumerate(hints)))  # one row
    hinted = F.lit(False)
    for i, p in enumerate(hints.values()):
        hinted |= F.col(f"_short{i}") & F.coalesce(F.col(text).rlike(p), F.lit(False))
    return df.crossJoin(F.broadcast(short)).select(id_col, hinted.alias("hinted"), B.uniform(id_col, seed).alias("u")).orderBy(F.desc("hinted"), "u", id_col).limit(size)


def priority_order(df: DataFrame, id_col: str, cls: str, have: DataFrame, floor: int, seed: int) -> DataFrame:
    """An order to label in: one row of each class in turn, the neediest class first, rows beyond the need last."""
    turn = ranked(df.select(id_col, cls).withColumn("_u", B.uniform(id_col, seed)), [F.col("_u"), F.col(id_col)], (cls,), "turn")
    got = have.groupBy(cls).agg(F.count("*").alias("_h"))
    need = turn.join(got.hint("merge"), cls, "left").withColumn("need", F.greatest(floor - F.coalesce("_h", F.lit(0)), F.lit(0)))
    beyond = need.withColumn("beyond", F.col("turn") > F.col("need"))
    return ranked(beyond, [F.asc("beyond"), F.asc("turn"), F.desc("need"), F.asc(cls), F.asc(id_col)], name="position").select(id_col, cls, "need", "turn", "beyond", "position")


def build_eval_set(df: DataFrame, used: DataFrame, refs: DataFrame, n: int, seed: int) -> DataFrame:
    """n rows at random, numbered: not used before by id or by normalised text, sharing no window with a reference text, texts once."""
    norm = saved(df.select("doc_id", F.md5(normalize_text(F.col("text"))).alias("_norm")), "norms")
    seen = norm.join(used.select("doc_id").hint("merge"), "doc_id", "left_semi").select("_norm").distinct()
    fresh = norm.join(used.select("doc_id").hint("merge"), "doc_id", "left_anti").join(seen.hint("merge"), "_norm", "left_anti")
    clean = fresh.join(contaminated(df, refs, "doc_id", "item_id", "text").hint("merge"), "doc_id", "left_anti")
    once = clean.groupBy("_norm").agg(F.min("doc_id").alias("doc_id"))
    drawn = once.select("doc_id", B.uniform("doc_id", seed).alias("u")).orderBy("u", "doc_id").limit(n)
    return ranked(drawn, [F.asc("u"), F.asc("doc_id")], name="eval_index").select("doc_id", "eval_index")


def _docs(spark, d):
    return B.table(spark, d, "documents")


def _edits(s, d):
    """Edits of labelled documents: a new language, a blank for every third, and ids beyond the table for every fifth."""
    u = B.uniform("doc_id", 5)
    return B.gold(s, d).where(u % 2 == 0).select(F.when(u % 5 == 0, F.col("doc_id") + 10_000_000_000).otherwise(F.col("doc_id")).alias("doc_id"), F.when(u % 3 == 0, " ").otherwise("fr").alias("label"), F.concat(F.lit("r"), (u % 7).cast("string")).alias("rule"), ((u % 101) / 100.0).alias("confidence"), F.when(u % 11 < 4, "review").otherwise("import").alias("source"))


def _log(s, d):
    u = B.uniform("item", 6)
    p = B.preds(s, d)
    return p.select(F.lit("v1").alias("namespace"), "item", F.col("a").alias("label")).unionByName(p.where(u % 2 == 0).select(F.lit("v2").alias("namespace"), "item", F.col("b").alias("label")))


_verdicts = lambda s, d, c: B.preds(s, d).select("item", F.when(F.col(c) == F.col("gold"), "gold").otherwise("model").alias("verdict"))
QUERIES = {
    "middle_of_ranking": lambda s, d: middle_of_ranking(B.table(s, d, "events"), "user_id", 5),
    "default_usage": lambda s, d: default_usage(B.route_in(s, d), ["intent", "legal_sensitive", "abusive_content", "wants_human"]),
    "usage_shares": lambda s, d: usage_shares(B.route_in(s, d), {"flags": F.col("legal_sensitive") | F.col("abusive_content") | F.col("wants_human"), "second": F.col("triage") & F.col("churn_risk"), "escalated": F.col("escalate")}),
    "progress": lambda s, d: progress(_docs(s, d), {"labels": B.table(s, d, "labels"), "preds": B.preds(s, d).where("a <> 'en'").withColumnRenamed("item", "doc_id")}, "doc_id"),
    "scorable": lambda s, d: scorable(B.gold(s, d).select("doc_id", "lang", "source"), B.gold(s, d).select("doc_id", F.when(B.uniform("doc_id", 7) % 10 < 6, "dev").otherwise("holdout").alias("split")), "doc_id", "dev", "source", ["web"]),
    "orphan_edits": lambda s, d: orphan_edits(B.gold(s, d), _edits(s, d), "doc_id"),
    "apply_edits": lambda s, d: apply_edits(B.gold(s, d), _edits(s, d), "doc_id", "lang"),
    "merge_reviews": lambda s, d: merge_reviews(_verdicts(s, d, "a"), _verdicts(s, d, "b").where("item % 3 = 0"), _verdicts(s, d, "b"), "item"),
    "backfill_namespace": lambda s, d: backfill_namespace(_log(s, d), "v1", "v2", "item"),
    "topup_batch": lambda s, d: topup_batch(_docs(s, d).join(B.table(s, d, "labels"), "doc_id", "left_anti"), "doc_id", "text", B.gold(s, d), "lang", 100, HINTS, 40, 9),
    "priority_order": lambda s, d: priority_order(_docs(s, d), "doc_id", "lang", B.gold(s, d), 100, 8),
    "build_eval_set": lambda s, d: build_eval_set(_docs(s, d), B.table(s, d, "labels"), B.table(s, d, "benchmark"), 100, 11),
    "prefix": lambda s, d: build_eval_set(_docs(s, d), B.table(s, d, "labels"), B.table(s, d, "benchmark"), 100, 11).where("eval_index <= 25"),
}
_u = lambda seed, c="doc_id": B.sql_uniform(c, seed)
_EDITS = f"{B.SQL_GOLD}, edits AS (SELECT CASE WHEN {_u(5)} % 5 = 0 THEN doc_id + 10000000000 ELSE doc_id END AS doc_id, CASE WHEN {_u(5)} % 3 = 0 THEN ' ' ELSE 'fr' END AS label, 'r' || ({_u(5)} % 7) AS rule, ({_u(5)} % 101) / 100.0 AS confidence, CASE WHEN {_u(5)} % 11 < 4 THEN 'review' ELSE 'import' END AS source FROM gold WHERE {_u(5)} % 2 = 0)"
_NORM_SQL = "trim(regexp_replace(replace(regexp_replace(regexp_replace(lower(text), 'https?://[^ \\t\\r\\n]+', ' ', 'g'), '@[A-Za-z0-9_]+', ' ', 'g'), '&amp;', '&'), '[^a-z0-9]+', ' ', 'g'))"
_WIN = "SELECT DISTINCT id, w FROM (SELECT id, unnest(list_transform(range(1, greatest(length(norm) - 39, 1) + 1), lambda i: substr(norm, i, 40))) AS w FROM {t}) WHERE w <> ''"
_EVAL = f"""n AS (SELECT doc_id AS id, {_NORM_SQL} AS norm FROM documents), b AS (SELECT item_id AS id, {_NORM_SQL} AS norm FROM benchmark),
    bad AS (SELECT DISTINCT id FROM ({_WIN.format(t="n")}) WHERE w IN (SELECT w FROM ({_WIN.format(t="b")}))),
    once AS (SELECT min(id) AS doc_id FROM n WHERE id NOT IN (SELECT doc_id FROM labels) AND norm NOT IN (SELECT norm FROM n JOIN labels ON id = doc_id) AND id NOT IN (SELECT id FROM bad) GROUP BY norm),
    e AS (SELECT doc_id, row_number() OVER (ORDER BY {_u(11)}, doc_id) AS eval_index FROM once QUALIFY eval_index <= 100)"""
_VERDICT = "SELECT item, CASE WHEN {c} = gold THEN 'gold' ELSE 'model' END AS verdict FROM preds"
ORACLE_SQL = {
    "middle_of_ranking": "WITH c AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, user_id) AS rank, count(*) OVER () // 2 AS half FROM c) SELECT user_id, n, rank FROM r WHERE rank > half - 5 AND rank <= half + 5",
    "default_usage": f"WITH {B.SQL_ROUTE}, l AS (" + " UNION ALL ".join(f"SELECT '{c}' AS field, coalesce({c}::VARCHAR, '') AS value FROM route_in" for c in ("intent", "legal_sensitive", "abusive_content", "wants_human")) + "), c AS (SELECT field, value, count(*) AS n, sum(count(*)) OVER (PARTITION BY field) AS t FROM l GROUP BY field, value) SELECT field, value, round(n / t, 6) AS share, n / t >= 0.95 AS defaulted FROM c QUALIFY row_number() OVER (PARTITION BY field ORDER BY n DESC, value) = 1",
    "usage_shares": f"WITH {B.SQL_ROUTE}, c AS (SELECT 'flags' AS use, count(*) FILTER (legal_sensitive OR abusive_content OR wants_human) AS n, count(*) AS n_rows FROM route_in UNION ALL SELECT 'second', count(*) FILTER (triage AND churn_risk), count(*) FROM route_in UNION ALL SELECT 'escalated', count(*) FILTER (escalate), count(*) FROM route_in) SELECT *, round(n / nullif(n_rows, 0)::DOUBLE, 6) AS share, n / nullif(n_rows, 0)::DOUBLE < 0.05 AS near_none FROM c",
    "progress": f"WITH {B.SQL_PREDS} SELECT 'labels' AS version, (SELECT count(DISTINCT doc_id) FROM labels WHERE doc_id IN (SELECT doc_id FROM documents)) AS n_done, count(DISTINCT doc_id) AS n_items FROM documents UNION ALL SELECT 'preds', (SELECT count(DISTINCT item) FROM preds WHERE a <> 'en'), count(DISTINCT doc_id) FROM documents",
    "scorable": f"WITH {B.SQL_GOLD} SELECT doc_id, lang, source FROM gold WHERE {_u(7)} % 10 < 6 AND source IS DISTINCT FROM 'web'",
    "orphan_edits": f"WITH {_EDITS}, p AS (SELECT e.doc_id, CASE WHEN g.doc_id IS NULL THEN 'unknown' WHEN trim(e.label) = '' THEN 'undecided' END AS problem FROM edits e LEFT JOIN gold g ON e.doc_id = g.doc_id) SELECT * FROM p WHERE problem IS NOT NULL",
    "apply_edits": f"WITH {_EDITS}, j AS (SELECT g.doc_id, g.lang, nullif(trim(e.label), '') AS e, e.rule, e.confidence, e.source FROM gold g LEFT JOIN edits e ON e.doc_id = g.doc_id) SELECT doc_id, lang AS before, coalesce(e, lang) AS label, CASE WHEN e IS NOT NULL THEN rule END AS rule, CASE WHEN e IS NOT NULL THEN confidence END AS confidence, CASE WHEN e IS NOT NULL THEN source END AS source, CASE WHEN coalesce(e, lang) IS DISTINCT FROM lang THEN 'edited' WHEN e IS NOT NULL THEN 'confirmed' ELSE 'kept' END AS status, coalesce(e, lang) IS DISTINCT FROM lang AS changed FROM j",
    "merge_reviews": f"WITH {B.SQL_PREDS}, x AS ({_VERDICT.format(c='a')}), y AS ({_VERDICT.format(c='b')}) SELECT x.item, 1 AS side, coalesce(y.verdict, x.verdict) AS verdict, coalesce(y.verdict <> x.verdict, false) AS changed FROM x LEFT JOIN y ON x.item = y.item AND y.item % 3 = 0 UNION ALL SELECT item, 2, verdict, false FROM y",
    "backfill_namespace": f"WITH {B.SQL_PREDS} SELECT 'v1' AS namespace, item, a AS label FROM preds UNION ALL SELECT 'v2', item, CASE WHEN {_u(6, 'item')} % 2 = 0 THEN b ELSE a END FROM preds",
    "topup_batch": f"WITH {B.SQL_GOLD}, s AS (SELECT count(*) FILTER (lang = 'de') < 100 AS de, count(*) FILTER (lang = 'fr') < 100 AS fr FROM gold) SELECT doc_id, (de AND regexp_matches(text, '(?i) und ')) OR (fr AND regexp_matches(text, '(?i) les ')) AS hinted, {_u(9)} AS u FROM documents, s WHERE doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY hinted DESC, u, doc_id LIMIT 40",
    "priority_order": f"WITH {B.SQL_GOLD}, h AS (SELECT lang, count(*) AS h FROM gold GROUP BY lang), t AS (SELECT doc_id, d.lang, greatest(100 - coalesce(h, 0), 0) AS need, row_number() OVER (PARTITION BY d.lang ORDER BY {_u(8)}, doc_id) AS turn FROM documents d LEFT JOIN h ON h.lang = d.lang) SELECT doc_id, lang, need, turn, turn > need AS beyond, row_number() OVER (ORDER BY turn > need, turn, need DESC, lang, doc_id) AS position FROM t",
    "build_eval_set": f"WITH {_EVAL} SELECT * FROM e",
    "prefix": f"WITH {_EVAL} SELECT * FROM e WHERE eval_index <= 25",
}
