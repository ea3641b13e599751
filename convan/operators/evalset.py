"""Evaluation sets: drawing with counts of what was left out and why, pins of tables, and all problems of a frozen set as rows."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convan.functions.scratch import ranked, saved
from convan.operators.editing import _EVAL, _NORM_SQL, _WIN, build_eval_set
from convan.operators.evaluation import _hashed, fingerprint
from convan.operators.text import contaminated, normalize_text
from convan.plans import bindings as B


def sifted(pool: DataFrame, used: DataFrame, refs: DataFrame, key: str, ref_key: str, text: str) -> DataFrame:
    """key, norm (a hash of the normalised text) and why a row of the pool may not be drawn, the first that holds: id (it is in
    use), text (blank, or that of a row in use), window (it shares one with a reference text); null if it may. The pool's key is unique, null texts are blank."""
    norm = saved(pool.select(key, normalize_text(F.coalesce(text, F.lit(""))).alias("_t")).select(key, F.md5("_t").alias("norm"), (F.col("_t") == "").alias("_blank")), "norms")
    mark = lambda df, c, name: df.select(c).distinct().withColumn(name, F.lit(True)).hint("merge")
    known = norm.join(mark(used, key, "_used"), key, "left")
    seen = mark(known.where("_used"), "norm", "_seen")
    hits = mark(contaminated(pool.select(key, text), refs, key, ref_key, text), key, "_hit")
    why = F.when(F.col("_used"), "id").when(F.col("_blank") | F.col("_seen"), "text").when(F.col("_hit"), "window")
    return known.join(seen, "norm", "left").join(hits, key, "left").select(key, "norm", why.alias("why"))


def draw_eval_set(pool: DataFrame, used: DataFrame, refs: DataFrame, key: str, ref_key: str, text: str, n: int, seed: int, parents: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """n numbered rows at random of those that sifted() leaves, each text once (the smallest key), with the columns of `parents`
    (key and what it says of the message before); and one row of counts: pool, lost to id, text, window and repeats, eligible, drawn.

    Reasons are written once; set and counts are read from there, so the counts are those of the set, also after a task was lost and run again."""
    rows = saved(sifted(pool, used, refs, key, ref_key, text), "sifted")
    once = rows.where("why is null").groupBy("norm").agg(F.min(key).alias(key))
    drawn = saved(once.select(key, B.uniform(key, seed).alias("u")).orderBy("u", key).limit(n), "drawn")
    out = ranked(drawn, [F.asc("u"), F.asc(key)], name="eval_index").select(key, "eval_index")
    if parents is not None:
        out = out.join(parents.hint("merge"), key, "left")
    lost = [F.count_if(F.col("why") == w).alias(f"lost_to_{w}") for w in ("id", "text", "window")]
    left = F.count_if(F.col("why").isNull())
    kinds = once.agg(F.count("*").alias("eligible"))  # one row
    counts = rows.agg(F.count("*").alias("pool"), *lost, left.alias("_left")).crossJoin(F.broadcast(kinds)).crossJoin(F.broadcast(drawn.agg(F.count("*").alias("drawn"))))
    return out, counts.select("pool", *(f"lost_to_{w}" for w in ("id", "text", "window")), (F.col("_left") - F.col("eligible")).alias("lost_to_repeats"), "eligible", "drawn")


def table_pins(tables: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """name, n_rows and the sums and hashes of fingerprint() for each table and its columns."""
    return functools.reduce(DataFrame.unionByName, (fingerprint(df, cols).select(F.lit(name).alias("name"), "*") for name, (df, cols) in tables.items()))


def table_drift(pins: DataFrame, now: DataFrame) -> DataFrame:
    """name and state of every table of either side: ok, changed, missing (only pinned) or new. Both as table_pins() gives them."""
    values = [c for c in pins.columns if c != "name"]
    side = lambda df, c: df.select("name", F.struct(*values).alias(c))
    state = F.when(F.col("_n").isNull(), "missing").when(F.col("_p").isNull(), "new").when(F.col("_p") == F.col("_n"), "ok").otherwise("changed")
    return side(pins, "_p").join(side(now, "_n").hint("merge"), "name", "full").select("name", state.alias("state"))


def eval_set_problems(items: DataFrame, texts: DataFrame, used: DataFrame, refs: DataFrame, labels: DataFrame, drift: DataFrame, pinned: DataFrame, key: str, ref_key: str, text: str) -> DataFrame:
    """problem and item (a key or table as text, or null) of all that is wrong with a frozen set of (key, eval_index); none is a clean set.

    drift: a table that table_drift() doesn't find ok. set_changed: the set's fingerprint isn't the pinned one. leak: an item in
    use elsewhere. quoted: a text that shares a window with a reference. repeated_id, repeated_text: each id, or each item whose
    normalised text another has. index_gap: numbers aren't 1 to n. label_outside: a label of no item. An empty set has no gap."""
    tag = lambda df, name, c=key: df.select(F.lit(name).alias("problem"), F.col(c).cast("string").alias("item"))
    ids = items.select(key).distinct().hint("merge")
    own = saved(texts.select(key, text).join(ids, key, "left_semi"), "items")
    norm = own.select(key, F.md5(normalize_text(F.coalesce(text, F.lit("")))).alias("_norm"))
    shared = norm.groupBy("_norm").agg(F.count("*").alias("_k")).where("_k > 1")
    one = items.agg(F.count("*").alias("n"), F.min("eval_index").alias("low"), F.max("eval_index").alias("high"), F.countDistinct("eval_index").alias("k"))
    # Two tables of one row each; a set without a pin has changed.
    same = table_drift(pinned, table_pins({"set": (items, [key, "eval_index"])})).where("name = 'set' and state <> 'ok'")
    found = [
        tag(drift.where("state <> 'ok'"), "drift", "name"),
        same.select(F.lit("set_changed").alias("problem"), F.lit(None).cast("string").alias("item")),
        tag(ids.join(used.select(key).hint("merge"), key, "left_semi"), "leak"),
        tag(contaminated(own, refs, key, ref_key, text), "quoted"),
        tag(items.groupBy(key).agg(F.count("*").alias("_k")).where("_k > 1"), "repeated_id"),
        tag(norm.join(shared.hint("merge"), "_norm", "left_semi"), "repeated_text"),
        one.where("n > 0 and (low <> 1 or high <> n or k <> n)").select(F.lit("index_gap").alias("problem"), F.lit(None).cast("string").alias("item")),
        tag(labels.select(key).distinct().join(ids, key, "left_anti"), "label_outside"),
    ]
    return functools.reduce(DataFrame.unionByName, found)


def _counts(s, d):
    return draw_eval_set(B.table(s, d, "documents"), B.table(s, d, "labels"), B.table(s, d, "benchmark"), "doc_id", "item_id", "text", 100, 11)[1]


def _messages(s, d):
    """User messages, a quarter of them in use, with the message before."""
    m = B.msgs(s, d)
    pool = m.where("author = 'user'")
    before = m.select(F.col("msg_id").alias("parent_id"), F.col("author").alias("parent_author"), F.col("text").alias("parent_text"))
    parents = pool.select("msg_id", F.col("reply_to").alias("parent_id")).join(before.hint("merge"), "parent_id").select("msg_id", "parent_author", "parent_text")
    return draw_eval_set(pool, pool.where(B.uniform("msg_id", 31) % 4 == 0), B.table(s, d, "benchmark"), "msg_id", "item_id", "text", 25, 32, parents)[0]


def _tables(s, d, pinned: bool):
    t = {n: (B.table(s, d, n), cols) for n, cols in (("documents", ["doc_id", "text"]), ("labels", ["doc_id", "quality", "toxic"]), ("benchmark", ["item_id", "text"]), ("pages", ["page_id", "url"]))}
    t["labels"] = (t["labels"][0].where("quality = 1"), t["labels"][1]) if pinned else t["labels"]
    t.pop("pages" if pinned else "benchmark")
    return table_pins(t)


def _drift(s, d):
    return table_drift(_tables(s, d, True), _tables(s, d, False))


def _problems(s, d):
    """The evaluation set of documents with rows added that should not be there: some in use, quoted, repeated, beyond the last number."""
    docs, labels, refs = B.table(s, d, "documents"), B.table(s, d, "labels"), B.table(s, d, "benchmark")
    clean = build_eval_set(docs, labels, refs, 100, 11)
    spoilt = saved(clean.unionByName(clean.where("eval_index % 9 = 0")).unionByName(docs.where("doc_id % 23 = 0").select("doc_id", (F.col("doc_id") + 1000).cast("int").alias("eval_index"))), "spoilt")
    return eval_set_problems(spoilt, docs, labels, refs, labels.where("toxic = 1"), _drift(s, d), table_pins({"set": (clean, ["doc_id", "eval_index"])}), "doc_id", "item_id", "text")


QUERIES = {"eval_set_counts": _counts, "eval_set_of_messages": _messages, "table_drift": _drift, "eval_set_problems": _problems}
_u = B.sql_uniform
_PINS = f"""d AS ({_hashed("documents", ["doc_id::VARCHAR", "text"])}), a AS ({_hashed("(SELECT * FROM labels WHERE quality = 1)", ["doc_id::VARCHAR", "quality::VARCHAR", "toxic::VARCHAR"])}), z AS ({_hashed("labels", ["doc_id::VARCHAR", "quality::VARCHAR", "toxic::VARCHAR"])}),
    state AS (SELECT 'documents' AS name, 'ok' AS state FROM d UNION ALL SELECT 'labels', CASE WHEN a = z THEN 'ok' ELSE 'changed' END FROM a, z UNION ALL SELECT 'benchmark', 'missing' UNION ALL SELECT 'pages', 'new')"""
_WHY = """CASE WHEN used THEN 'id' WHEN norm = '' OR norm IN (SELECT norm FROM p WHERE used) THEN 'text' WHEN id IN (SELECT id FROM bad) THEN 'window' END AS why"""
_BAD = f"b AS (SELECT item_id AS id, {_NORM_SQL} AS norm FROM benchmark), bad AS (SELECT DISTINCT id FROM ({_WIN.format(t='p')}) WHERE w IN (SELECT w FROM ({_WIN.format(t='b')})))"
ORACLE_SQL = {
    "eval_set_counts": f"""WITH p AS (SELECT doc_id AS id, coalesce({_NORM_SQL}, '') AS norm, doc_id IN (SELECT doc_id FROM labels) AS used FROM documents), {_BAD}, r AS (SELECT *, {_WHY} FROM p), c AS (SELECT count(*) AS pool, count(*) FILTER (why = 'id') AS lost_to_id, count(*) FILTER (why = 'text') AS lost_to_text, count(*) FILTER (why = 'window') AS lost_to_window, count(*) FILTER (why IS NULL) AS k, count(DISTINCT norm) FILTER (why IS NULL) AS eligible FROM r)
        SELECT pool, lost_to_id, lost_to_text, lost_to_window, k - eligible AS lost_to_repeats, eligible, least(eligible, 100) AS drawn FROM c""",
    "eval_set_of_messages": f"""WITH {B.SQL_MSGS}, p AS (SELECT msg_id AS id, reply_to, coalesce({_NORM_SQL}, '') AS norm, {_u("msg_id", 31)} % 4 = 0 AS used FROM msgs WHERE author = 'user'), {_BAD}, r AS (SELECT *, {_WHY} FROM p), o AS (SELECT min(id) AS id FROM r WHERE why IS NULL GROUP BY norm),
        e AS (SELECT id, row_number() OVER (ORDER BY {_u("id", 32)}, id) AS eval_index FROM o QUALIFY eval_index <= 25)
        SELECT e.id AS msg_id, eval_index, m.author AS parent_author, m.text AS parent_text FROM e JOIN p USING (id) LEFT JOIN msgs m ON m.msg_id = p.reply_to""",
    "table_drift": f"WITH {_PINS} SELECT * FROM state",
    "eval_set_problems": f"""WITH {_EVAL}, {_PINS}, items AS (SELECT doc_id, eval_index FROM e UNION ALL SELECT doc_id, eval_index FROM e WHERE eval_index % 9 = 0 UNION ALL SELECT doc_id, doc_id + 1000 FROM documents WHERE doc_id % 23 = 0), own AS (SELECT id, norm FROM n WHERE id IN (SELECT doc_id FROM items))
        SELECT 'drift' AS problem, name AS item FROM state WHERE state <> 'ok' UNION ALL SELECT 'set_changed', NULL UNION ALL SELECT 'leak', doc_id::VARCHAR FROM (SELECT DISTINCT doc_id FROM items) WHERE doc_id IN (SELECT doc_id FROM labels)
        UNION ALL SELECT 'quoted', id::VARCHAR FROM own WHERE id IN (SELECT id FROM bad) UNION ALL SELECT 'repeated_id', doc_id::VARCHAR FROM items GROUP BY doc_id HAVING count(*) > 1
        UNION ALL SELECT 'repeated_text', id::VARCHAR FROM own WHERE norm IN (SELECT norm FROM own GROUP BY norm HAVING count(*) > 1) UNION ALL SELECT 'index_gap', NULL UNION ALL SELECT 'label_outside', doc_id::VARCHAR FROM labels WHERE toxic = 1 AND doc_id NOT IN (SELECT doc_id FROM items)""",
}
