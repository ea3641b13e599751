"""Sharding by vector bin packing: bytes, tokens and rows balanced jointly.

Rows with equal texts form a group, of which (bytes, tokens, rows) is the vector; a group that fills a shard by itself
(beyond WHOLE of its bytes) is dealt with in PARTS parts, any other stays together. A unit goes to the shard where the dot product of its vector with the shard's residual
capacity is highest. Large units are placed first, over the whole table: by their size there are at most
shards * LARGE of them, whatever the table holds. The rest is dealt into cells of about CELL_ROWS units; every cell
packs its units into its part of what is left of each shard, largest first, so cells run in parallel. Then the shards of
a cell are matched to the shards of a node over FAN cells, most loaded to least loaded, cell after cell, so what one cell
has left over doesn't add up; nodes are matched to the nodes above in the same way, up to a root, whose shards are the
global ones. A task matches FAN x shards rows; the driver sees none of them.

Slots number the rows of a shard without gaps: rows are counted in chunks of a shard, the chunks' offsets are summed up,
and rows are numbered within their chunk, so that no task gets a whole shard.

Defined cases: a null text has no bytes, tokens or crc of its own (it counts as empty); rows that repeat an id are rows of
their own; an empty table gives an empty table. Only id and text are read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from convan.llm.common import saved

SHARDS, ROW_BYTES = 24, 8
LARGE = 200  # a unit of over 1 / LARGE of a shard, in any dimension, is placed before the cells
WHOLE, PARTS = 0.9, 64  # a group beyond that share of a shard's bytes is dealt with in so many parts
CELL_ROWS, CHUNK_ROWS = 20_000, 20_000
FAN = 32  # cells, or nodes, that are matched in one task
_DIMS = ("bytes", "tokens", "rows")


def place(units: np.ndarray, residual: np.ndarray) -> np.ndarray:
    """The shard of each unit, taken largest first; residual (shards x dims) is what is left of each, and is lowered.

    Dimensions are scaled by the capacity they have, bytes weigh most; ties go to the shard with most bytes left."""
    scale = np.maximum(residual.sum(0), 1e-9)
    weight = np.array([1.0, 0.25, 0.25]) / scale
    order = np.argsort(-(units * weight).sum(1), kind="stable")
    out = np.zeros(len(units), np.int32)
    left = residual * weight
    for i in order:
        u = units[i] * weight
        best = int(np.argmax(left @ np.maximum(u, 1e-12)))
        out[i] = best
        left[best] -= u
    residual[:] = left / weight
    return out


def matched(loads: DataFrame, cells: int, aim: np.ndarray) -> DataFrame:
    """(cell, local, shard): the shard that each cell's local shard becomes, from loads (node, local, bytes); aim is the share of each shard."""
    shards = len(aim)

    def step(children: pd.DataFrame) -> pd.DataFrame:
        over, out = np.zeros(shards), []
        for node, own in children.sort_values("node").groupby("node"):
            load = np.zeros(shards)
            load[own["local"]] = own["bytes"]
            part = aim * load.sum()
            swap = np.empty(shards, int)
            swap[np.argsort(-(load - part), kind="stable")] = np.argsort(over, kind="stable")
            ways = []
            for to in (np.arange(shards), swap):
                after = over - part
                after[to] += load
                ways.append((np.ptp(after), to, after))
            _, to, over = min(ways, key=lambda w: w[0])
            out.append(pd.DataFrame({"node": np.int32(node), "local": np.arange(shards, dtype=np.int32), "to": to.astype(np.int32), "bytes": load.astype(np.int64)}))
        return pd.concat(out)

    above, match = (F.col("node") / FAN).cast("int"), None
    while match is None or cells > 1:
        level = saved(loads.groupBy(above.alias("_above")).applyInPandas(step, "node int, local int, to int, bytes long"), "match")
        if match is None:
            match = level.select(F.col("node").alias("cell"), "local", above.alias("_node"), F.col("to").alias("shard"))
        else:
            up = level.select(F.col("node").alias("_node"), F.col("local").alias("shard"), above.alias("_up"), "to")
            match = match.join(up.hint("merge"), ["_node", "shard"]).select("cell", "local", F.col("_up").alias("_node"), F.col("to").alias("shard"))
        loads = level.groupBy(above.alias("node"), F.col("to").alias("local")).agg(F.sum("bytes").alias("bytes"))
        cells = -(-cells // FAN)
    return match.drop("_node")


def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, size, text_crc32, shard, slot."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    spark = docs.sparkSession
    rows = docs.select(
        F.col(id_col).alias("id"), (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.size(F.split(text, r"\s+")).cast("long").alias("tokens"), F.crc32(text.cast("binary")).alias("crc"),
        F.unhex(F.sha2(text, 256)).alias("digest"), F.pmod(F.xxhash64(F.col(id_col)), F.lit(PARTS)).cast("int").alias("part"),
    )
    rows = saved(rows, "rows")
    parts = rows.groupBy("digest", "part").agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows"))
    total = parts.agg(*(F.sum(d).alias(d) for d in _DIMS), F.count("*").alias("n")).first()
    full = np.array([max(total[d] or 0, 1) for d in _DIMS], float)
    groups = parts.groupBy("digest").agg(F.sum("bytes").alias("all"))
    too_large = F.col("all") > float(WHOLE * full[0] / shards)
    units = parts.join(groups.select("digest", too_large.alias("split")).hint("merge"), "digest").groupBy("digest", F.when(F.col("split"), F.col("part")).otherwise(-1).alias("unit"), "split").agg(*(F.sum(d).alias(d) for d in _DIMS))
    cells = max(1, round((total["n"] or 0) / CELL_ROWS))
    large = F.greatest(*(F.col(d) / float(s) for d, s in zip(_DIMS, full / shards / LARGE, strict=True))) > 1
    units = saved(units.withColumn("cell", F.when(large, -1).otherwise(F.pmod(F.xxhash64("digest", "unit"), F.lit(cells)).cast("int"))), "units")
    first = units.where("cell = -1").select("digest", "unit", *_DIMS).orderBy("digest", "unit").toPandas()  # at most 3 * shards * LARGE rows, since their shares add up to at most 3
    residual = np.tile(full / shards, (shards, 1))
    at = place(first[list(_DIMS)].to_numpy(float), residual) if len(first) else np.zeros(0, np.int32)
    heavy = spark.createDataFrame(pd.DataFrame({"digest": [bytes(x) for x in first["digest"]], "unit": first["unit"].astype("int32"), "shard": at}), "digest binary, unit int, shard int")
    sent = spark.sparkContext.broadcast(residual)

    def pack(cell: pd.DataFrame) -> pd.DataFrame:
        cell = cell.sort_values(["digest", "unit"])
        vectors = cell[list(_DIMS)].to_numpy(float)
        left = np.maximum(sent.value, 0)
        left = left / np.maximum(left.sum(0), 1e-9) * vectors.sum(0)
        return cell[["digest", "unit", "cell", *_DIMS]].assign(local=place(vectors, left))

    packed = saved(units.where("cell >= 0").groupBy("cell").applyInPandas(pack, "digest binary, unit int, cell int, bytes long, tokens long, rows long, local int"), "packed")
    aim = np.maximum(residual[:, 0], 0)
    match = matched(packed.groupBy(F.col("cell").alias("node"), "local").agg(F.sum("bytes").alias("bytes")), cells, aim / max(aim.sum(), 1e-9))
    light = packed.join(F.broadcast(match) if cells * shards <= 100_000 else match.hint("merge"), ["cell", "local"]).select("digest", "unit", "shard")
    placed = light.unionByName(heavy)
    keyed = placed.where("unit = -1").select("digest", "shard")
    split = placed.where("unit >= 0").select("digest", F.col("unit").alias("part"), "shard")
    # Whole groups join by (digest, part) too: their entries in `parts` have one row per part that occurs.
    known = parts.select("digest", "part").join(keyed.hint("merge"), "digest").unionByName(split.select("digest", "part", "shard"))
    found = rows.join(known.hint("merge"), ["digest", "part"]).select("id", "size", "crc", "shard")
    chunks = max(1, round((total["rows"] or 0) / shards / CHUNK_ROWS))
    found = found.withColumn("chunk", F.pmod(F.xxhash64("id"), F.lit(max(chunks, 16))).cast("int"))
    counts = found.groupBy("shard", "chunk").agg(F.count("*").alias("n"))
    offsets = counts.withColumn("before", F.sum("n").over(Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))).select("shard", "chunk", F.coalesce("before", F.lit(0)).alias("before"))
    numbered = found.withColumn("k", F.row_number().over(Window.partitionBy("shard", "chunk").orderBy("id", "crc", "size")))
    out = numbered.join(offsets.hint("merge"), ["shard", "chunk"])
    return out.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("before") + F.col("k") - 1).alias("slot"))
