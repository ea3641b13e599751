"""Exact dedup: a tree merge of sorted digest runs, with DataFrame functions only.

Each row is reduced to an entry once: SHA-256, byte length and a second 64-bit hash of its text, written as a table. Every
row belongs to one of 2 ** `bits` runs by its id. Level 0 reduces each run to its distinct entries, each with the id
that stays and its number of rows; map-side aggregation collapses copies before anything is shuffled. Runs are dealt by
ranges of (run, digest) and sorted, so a run lies in as many partitions as it needs. A round takes `ways` bits of the run
number at once, as that many rounds of a binomial tree would one after the other: of each 2 ** `ways` runs, all go to the
one whose number lacks those bits, and are merged there in one multiway merge. Neighbours that match in all three parts
become one entry, and what is left is again a sorted run, written before the next round. A digest never has more than
2 ** `ways` rows in a merge, so a text that a third of all rows share costs no task more than its fair part; texts that
only share a digest stay apart at every level.

The way back goes through the runs too: the last run joins the entries of level 0, those join the rows by run and
digest, so hot texts are spread over 2 ** `bits` keys.

Defined cases: null texts count as empty, and so equal each other; rows with the same id and the same text are one
document and all carry kept = true if theirs is the id that stays; null ids never stay unless all ids of a group are
null; an empty table gives an empty table. Only the id and the text are read, so other columns can have any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from convan.llm.common import saved

BITS, WAYS = 6, 3
_ENTRY = ("_digest", "_bytes", "_check")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", bits: int = BITS, ways: int = WAYS) -> DataFrame:
    """One row per row of docs: id_col, keep_id, group_size, kept, text_sha256. keep: "min" or "max", the id that stays."""
    best = {"min": F.min, "max": F.max}[keep]
    text = F.coalesce(F.col(text_col), F.lit(""))
    run = F.pmod(F.xxhash64(id_col), F.lit(1 << bits)).cast("int")
    rows = saved(docs.select(F.col(id_col), run.alias("_run"), F.unhex(F.sha2(text, 256)).alias("_digest"), F.octet_length(text).alias("_bytes"), F.xxhash64(text).alias("_check")), "digests")
    leaves = saved(rows.groupBy("_run", *_ENTRY).agg(best(id_col).alias("_keep"), F.count("*").alias("_size")), "leaves")
    same = Window.partitionBy("_run", *_ENTRY)
    merged = leaves
    for r in range(0, bits, ways):
        meet = ((1 << min(ways, bits - r)) - 1) << r
        met = merged.withColumn("_run", F.col("_run").bitwiseAND(F.lit(~meet))).repartitionByRange("_run", "_digest")
        one = met.select("_run", *_ENTRY, F.row_number().over(same.orderBy("_run")).alias("_k"), best("_keep").over(same).alias("_keep"), F.sum("_size").over(same).alias("_size"))
        merged = saved(one.where("_k = 1").drop("_k"), f"bits-{r}")
    root = merged.select(*_ENTRY, F.col("_keep").alias("keep_id"), F.col("_size").alias("group_size"))
    known = leaves.select("_run", *_ENTRY).join(root.hint("merge"), list(_ENTRY))
    out = rows.join(known.hint("merge"), ["_run", *_ENTRY])
    return out.select(F.col(id_col), "keep_id", "group_size", F.col(id_col).eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("_digest")).alias("text_sha256"))
