"""Taxonomies: small JSON lists of named classes, checked when they are read, and looked up as a broadcast dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convan.functions.scratch import new_path
from convan.plans import bindings as B

MOST = 10_000  # classes of a list that may be sent to all tasks


class TaxonomyError(ValueError):
    """What is wrong with a taxonomy: `problems` has (entry from 1 or None, field or None, problem)."""

    def __init__(self, path: str, problems: list[tuple[int | None, str | None, str]]):
        self.problems = problems
        told = "; ".join(" ".join(str(x) for x in ("entry" if i else None, i, f, p) if x is not None) for i, f, p in problems)
        super().__init__(f"{path}: {told}")


def read_taxonomy(spark: SparkSession, path: str, fields: tuple[str, ...] = ("name", "description"), key: str = "name", most: int = MOST) -> DataFrame:
    """place (from 1) and the fields of each class of a JSON list of objects, in the order of the list.

    Raises TaxonomyError that names every problem: no JSON list; an entry that is no object; a field that is missing, unknown, no
    string or blank; a key that another entry has; no entry; more than `most`. A file is one list."""
    lists = spark.read.text(path, wholetext=True).select(F.from_json("value", "array<string>").alias("l"), F.expr("schema_of_variant(try_parse_json(value)) like 'ARRAY%'").alias("is_list"))
    heads = lists.select("is_list", F.size("l").alias("n")).limit(2).collect()
    if len(heads) != 1 or not heads[0]["is_list"]:
        raise TaxonomyError(path, [(None, None, "is no JSON list")])
    if not 0 < heads[0]["n"] <= most:
        raise TaxonomyError(path, [(None, None, f"has {heads[0]['n']} entries, 1 to {most} are allowed")])
    entries = lists.select(F.posexplode("l").alias("k", "e")).select((F.col("k") + 1).alias("place"), F.expr("try_parse_json(e)").alias("v"), F.expr("coalesce(map_keys(from_json(e, 'map<string,string>')), array())").alias("has"))
    kind = lambda f: F.expr(f"schema_of_variant(try_variant_get(v, '$.{f}', 'variant'))")
    value = lambda f: F.expr(f"try_variant_get(v, '$.{f}', 'string')")
    is_object = F.coalesce(F.expr("schema_of_variant(v)").startswith("OBJECT"), F.lit(False))
    one = lambda field, problem, when: F.when(when, F.struct(F.lit(field).cast("string").alias("field"), problem.alias("problem")))
    checks = [one(None, F.lit("is no object"), ~is_object)]
    for f in fields:
        missing = is_object & ~F.coalesce(F.array_contains("has", f), F.lit(False))
        checks += [
            one(f, F.lit("is missing"), missing),
            one(f, F.concat(F.lit("is "), F.lower(F.coalesce(kind(f), F.lit("null"))), F.lit(", no string")), is_object & ~missing & (F.coalesce(kind(f), F.lit("")) != "STRING")),
            one(f, F.lit("is blank"), is_object & (F.coalesce(kind(f), F.lit("")) == "STRING") & (F.trim(value(f)) == "")),
        ]
    unknown = F.transform(F.filter("has", lambda x: ~x.isin(*fields)), lambda x: F.struct(x.alias("field"), F.lit("is unknown").alias("problem")))
    bad = entries.select("place", F.explode(F.concat(F.array_compact(F.array(*checks)), unknown)).alias("p")).select("place", "p.*")
    out = entries.select("place", *(value(f).alias(f) for f in fields))
    twice = out.groupBy(key).agg(F.array_sort(F.collect_list("place")).alias("at")).where(f"size(at) > 1 and {key} is not null").select(F.element_at("at", 2).alias("place"), F.lit(key).alias("field"), F.concat(F.lit("repeats that of entry "), F.element_at("at", 1).cast("string")).alias("problem"))
    found = sorted((r["place"], r["field"] or "", r["problem"]) for r in bad.unionByName(twice).collect())  # at most a few rows for each of `most` entries
    if found:
        raise TaxonomyError(path, [(i, f or None, p) for i, f, p in found])
    return out


def with_class(df: DataFrame, taxonomy: DataFrame, col: str, key: str = "name") -> DataFrame:
    """df with known (is its class in the taxonomy?) and the taxonomy's other fields, as class_<field>; null for other classes and null ones.

    The taxonomy is sent to all tasks: read_taxonomy() bounds it."""
    fields = [c for c in taxonomy.columns if c != key]
    dim = taxonomy.select(F.col(key).alias("_class"), *(F.col(c).alias(f"class_{c}") for c in fields))
    return df.join(F.broadcast(dim), F.col(col) == F.col("_class"), "left").withColumn("known", F.col("_class").isNotNull()).drop("_class")


def list_text(taxonomy: DataFrame, name: str = "name", description: str = "description") -> DataFrame:
    """One row: the classes as a list of lines, as a prompt shows them."""
    lines = taxonomy.agg(F.array_sort(F.collect_list(F.struct("place", F.concat(F.lit("- "), name, F.lit(": "), description).alias("line")))).alias("x"))  # as many rows as classes
    return lines.select(F.array_join(F.col("x.line"), "\n").alias("text"))


def _taxonomy(s, d):
    """A list of the languages that documents have in numbers, written as JSON and read again."""
    path = new_path(s, "taxonomy")
    classes = B.table(s, d, "documents").where("lang <> 'es'").groupBy("lang").agg(F.count("*").alias("n"))
    entry = F.struct(F.col("lang").alias("name"), F.concat(F.lit('"'), F.col("n").cast("string"), F.lit(" texts\"")).alias("description"))
    classes.agg(F.to_json(F.array_sort(F.collect_list(entry))).alias("value")).coalesce(1).write.text(path)
    return read_taxonomy(s, path)


QUERIES = {
    "read_taxonomy": _taxonomy,
    "with_class": lambda s, d: with_class(B.preds(s, d).select("item", "a"), _taxonomy(s, d), "a").groupBy("a", "known", "class_place", "class_description").agg(F.count("*").alias("n")).select("a", "known", F.coalesce("class_place", F.lit(0)).alias("class_place"), "class_description", "n"),
    "list_text": lambda s, d: list_text(_taxonomy(s, d)),
}
_TAX = "t AS (SELECT lang AS name, '\"' || count(*) || ' texts\"' AS description, CAST(row_number() OVER (ORDER BY lang) AS INT) AS place FROM documents WHERE lang <> 'es' GROUP BY lang)"
ORACLE_SQL = {
    "read_taxonomy": f"WITH {_TAX} SELECT place, name, description FROM t",
    "with_class": f"WITH {_TAX}, {B.SQL_PREDS} SELECT a, name IS NOT NULL AS known, coalesce(place, 0) AS class_place, description AS class_description, count(*) AS n FROM preds LEFT JOIN t ON a = name GROUP BY ALL",
    "list_text": f"WITH {_TAX} SELECT string_agg('- ' || name || ': ' || description, chr(10) ORDER BY place) AS text FROM t",
}
