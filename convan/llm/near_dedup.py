"""MinHash near-dedup with odd sketches.

1. Every text becomes its set of distinct word shingles (64-bit hashes), 128 MinHash values in 32 bands of 4, and two odd
   sketches. In the first each MinHash value flips one of 512 bits, so the XOR of two sketches has about
   256 (1 - exp(J - 1)) bits that are set, whatever the sets' sizes. In the second each shingle flips one of 1,024 bits:
   for sets that are not much larger than that, XOR counts their differences nearly exactly.
   Texts with equal sets are one class; only its smallest id goes on.
2. Classes that share a band key are candidates. Each is held against the smallest id of its buckets (one row for each
   member, never all pairs of a bucket); the XOR counts and the sizes drop pairs that are surely below the threshold; of
   what is left the best pair of each class is confirmed on the full sets.
3. Following these links gives every class a label that it is connected with. In buckets that still hold several labels,
   classes without the bucket's most frequent label meet three members that have it; then again in narrower buckets (keys of
   two neighbouring bands), whose members are nearer. Hits merge labels.
4. Who is still apart meets all members of its buckets with other labels, behind the sizes and the XOR counts; a bucket of
   many members is dealt over several keys. Of the pairs that pass, the best of each class is confirmed, then all those
   whose labels still differ. So no pair of one bucket that could join two components is left out. This step compares
   (classes left) x (members of the bucket) sketches. Components of all confirmed links are the result.

A pair at the threshold of 0.75 shares no band with probability (1 - 0.75^4)^32 = 5e-6; the XOR cuts lie 5 standard
deviations below the threshold; for sets that together have up to about 1,500 shingles that on whole sets is the exact bound on their
differences.

Defined cases: null texts and texts without words have no shingles and stay alone; shorter texts than k words have one
shingle, the whole; equal rows are one class; where an id repeats with different texts, each text is searched, and where such an
id is the smallest of both texts' classes these are joined through it; null ids are their own component (null). Only id and text are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convan.llm.common import mixed, saved, span_hashes, spread
from convan.llm.components import components

WORDS, BANDS, ROWS, BITS, SET_BITS = 5, 32, 4, 512, 1024
STEP, SUMS = 16, 256  # the cuts by the sum of two sets' sizes; beyond the last the cut lets everything pass
WIDTHS = (1, 2)  # bands in a bucket key, round by round
SALTS, SPLIT = 16, 4_000  # keys that a hot id is spread over; members of a bucket that one key holds
_rng = np.random.default_rng(3)
_A = _rng.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64)[:, None] * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)[:, None]
_MIX = _rng.integers(1, 2**63, (5, 64), dtype=np.uint64) | np.uint64(1)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def shingle_set(text: str | None, k: int = WORDS) -> np.ndarray:
    """Distinct 64-bit hashes of the text's k-word shingles, A-Z taken as a-z; of the whole text if it has fewer words."""
    data = np.frombuffer((text or "").encode("utf-8", "replace") + b" ", np.uint8)
    edge = np.flatnonzero(np.diff(_BLANK[data], prepend=True))
    begin, end = edge[::2], edge[1::2]
    n = len(begin)
    if not n:
        return np.zeros(0, np.uint64)
    words = span_hashes(data, begin, end)
    if n < k:
        return mixed(np.array([(words * _MIX[1, :n]).sum() + np.uint64(n)], np.uint64))
    h = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        h += mixed(words[j : n - k + 1 + j] * _MIX[2, j])
    return np.unique(mixed(h))


def min_hashes(shingles: np.ndarray) -> np.ndarray:
    out = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for i in range(0, len(shingles), 1024):
        np.minimum(out, (_A * shingles[i : i + 1024] + _B).min(axis=1), out=out)
    return out


def odd_sketch(hashes: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The parity bitmap, as 64-bit words."""
    place = mixed(hashes * _A[:, 0] + np.arange(len(hashes), dtype=np.uint64)) % np.uint64(bits)
    odd = np.bincount(place.astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def set_sketch(shingles: np.ndarray, bits: int = SET_BITS) -> np.ndarray:
    """The parity bitmap of the whole set, as 64-bit words."""
    odd = np.bincount((mixed(shingles + _MIX[4, 0]) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def most_bits(threshold: float, bits: int = BITS, samples: int = BANDS * ROWS, deviations: float = 5) -> int:
    """The XOR count beyond which the similarity lies below the threshold by that many standard deviations."""
    low = threshold - deviations * math.sqrt(threshold * (1 - threshold) / samples + 0.02**2)
    return math.ceil(bits / 2 * (1 - math.exp(-4 * samples * (1 - max(low, 0)) / bits)))


def _most_set_bits(both: int, threshold: float) -> int:
    """The XOR count of whole-set sketches of sets with so many elements together: at most their differences at the threshold,
    and at most the expectation for these + 5 deviations."""
    if both >= STEP * SUMS:
        return SET_BITS
    x = both * (1 - threshold) / (1 + threshold) / SET_BITS  # differences at the threshold, per bit
    spread_ = math.sqrt(max(SET_BITS / 4 * (1 - math.exp(-4 * x)) - SET_BITS * x * math.exp(-4 * x), 0))
    return min(math.floor(x * SET_BITS + 1e-9), math.ceil(SET_BITS / 2 * (1 - math.exp(-2 * x)) + 5 * spread_ + 2))


def _close(a: str, b: str, threshold: float) -> Column:
    """Whether sizes and sketches of the structs a and b allow the threshold, by expectation + 5 deviations of XOR counts."""
    sizes = F.least(f"{a}.n", f"{b}.n") >= threshold * F.greatest(f"{a}.n", f"{b}.n") - 1e-6
    return sizes & (_apart(f"{a}.bits", f"{b}.bits", BITS) <= most_bits(threshold)) & (_apart(f"{a}.set_bits", f"{b}.set_bits", SET_BITS) <= _cut(a, b, threshold))


def _cut(a: str, b: str, threshold: float) -> Column:
    cuts = [_most_set_bits(STEP * (i + 1), threshold) for i in range(SUMS)]
    both = F.col(f"{a}.n") + F.col(f"{b}.n")
    return F.get(F.array(*map(F.lit, cuts)), F.least(F.ceil(both / STEP).cast("int") - 1, F.lit(SUMS - 1)))


def _one_sketch() -> Column:
    """The sketch that fits a set's size, for joins: of the whole set, or of its MinHash values for large sets."""
    zeros = F.array(*[F.lit(0).cast("long")] * ((SET_BITS - BITS) // 64))
    return F.struct("s.n", F.when(F.col("s.n") <= 2 * SET_BITS, F.col("s.set_bits")).otherwise(F.concat("s.bits", zeros)).alias("q"), (F.col("s.n") > 2 * SET_BITS).alias("large"))


def _close_by_one(a: str, b: str, threshold: float) -> Column:
    """_close by one sketch: few enough operations for Spark to compile the join condition."""
    sizes = F.least(f"{a}.n", f"{b}.n") >= threshold * F.greatest(f"{a}.n", f"{b}.n") - 1e-6
    cut = F.when(F.col(f"{a}.large") != F.col(f"{b}.large"), F.lit(SET_BITS)).when(F.col(f"{a}.large"), F.lit(most_bits(threshold))).otherwise(_cut(a, b, threshold))
    return sizes & (_apart(f"{a}.q", f"{b}.q", SET_BITS) <= cut)


def _sketches(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, text, h in batch.itertuples(index=False):
                s = shingle_set(text, k)
                if not len(s):
                    rows.append((i, h, 0, 0, 0, None, None, None))
                    continue
                m = min_hashes(s)
                bands = mixed((m.reshape(BANDS, ROWS) * _MIX[0, :ROWS]).sum(1) + np.arange(BANDS, dtype=np.uint64))
                rows.append((i, h, len(s), int(s.sum().view(np.int64)), int(np.bitwise_xor.reduce(mixed(s + _MIX[3, 0])).view(np.int64)), bands.view(np.int64), odd_sketch(m).view(np.int64), set_sketch(s).view(np.int64)))
            yield pd.DataFrame(rows, columns=["id", "h", "n", "s1", "s2", "bands", "bits", "set_bits"]).astype({"id": "Int64"})

    return run


def _apart(a: str, b: str, bits: int) -> Column:
    """The number of bits in which two sketches differ."""
    return F.expr(" + ".join(f"bit_count({a}[{i}] ^ {b}[{i}])" for i in range(bits // 64)))


def _distance() -> Column:
    """Smaller for more similar sets, from the sketches of sa and sb: by their differences, or by MinHash for large sets."""
    both = F.col("sa.n") + F.col("sb.n")
    return F.when(both <= 3 * SET_BITS, _apart("sa.set_bits", "sb.set_bits", SET_BITS) / both).otherwise(_apart("sa.bits", "sb.bits", BITS) / (2.0 * BITS))


def _lookup(pairs: DataFrame, of: DataFrame, key: str, by: str) -> DataFrame:
    """pairs with the columns of `of`, a table by `key`. A key of very many pairs is spread over SALTS keys by the column `by`;
    no more rows of `of` are copied than there are pairs."""
    salted = pairs.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)))
    wanted = salted.select(key, "_salt").distinct().join(of.hint("merge"), key)
    return salted.join(wanted.hint("merge"), [key, "_salt"]).drop("_salt")


def _confirm(pairs: DataFrame, texts: DataFrame, threshold: float, k: int) -> DataFrame:
    """Of pairs (a, b) of ids, those whose full sets are similar enough. Each row carries both texts; no group is gathered."""
    part, whole = round(threshold * 100), 100

    @F.pandas_udf("boolean")
    def linked(left: pd.Series, right: pd.Series) -> pd.Series:
        out, last, kept = [], None, None
        for x, y in zip(left, right, strict=True):
            if last is None or y != last:
                kept, last = shingle_set(y, k), y
            s = shingle_set(x, k)
            both = len(np.intersect1d(s, kept, assume_unique=True))
            out.append(whole * both >= part * (len(s) + len(kept) - both) and both > 0)
        return pd.Series(out, dtype="bool")

    t = lambda i: texts.select(F.col("id").alias(i), F.col("text").alias(f"t{i}"))
    rows = _lookup(pairs.select("a", "b").join(t("a").hint("merge"), "a"), t("b"), "b", "a")
    return rows.where(linked("ta", "tb")).select("a", "b").distinct()


def _merged(label: DataFrame, edges: DataFrame) -> DataFrame:
    """The labels (id, c; of ids that aren't their own label) after linking the labels of edges (a, b), each to the smallest that it
    has a link with, and on from there. Ids of one label are connected; not all that are connected get one label."""
    hook = saved(edges.select(F.greatest("a", "b").alias("c"), F.least("a", "b").alias("to")).groupBy("c").agg(F.min("to").alias("to")), "hooks")
    for _ in range(2):
        hook = hook.join(hook.select(F.col("c").alias("to"), F.col("to").alias("next")).hint("merge"), "to", "left").select("c", F.coalesce("next", "to").alias("to"))
    moved = label.join(hook.hint("merge"), "c", "left").select("id", F.coalesce("to", "c").alias("c"))
    return saved(moved.unionByName(hook.select(F.col("c").alias("id"), F.col("to").alias("c"))), "labels")


def _labelled(rows: DataFrame, label: DataFrame) -> DataFrame:
    return rows.join(label.hint("merge"), "id", "left").withColumn("c", F.coalesce("c", "id"))


def _open(named: DataFrame) -> DataFrame:
    """The rows of those buckets that hold several labels, with the bucket's size and whether a row has its most frequent label."""
    sizes = named.groupBy("band", "c").agg(F.count("*").alias("size"))
    parts = sizes.groupBy("band").agg(F.max_by("c", F.struct("size", "c")).alias("main"), F.sum("size").alias("size"), F.count("*").alias("labels")).where("labels > 1").drop("labels")
    return named.join(parts.hint("merge"), "band").withColumn("of_main", F.col("c") == F.col("main")).drop("main")


def _keys(width: int) -> Column:
    """Bucket keys of so many neighbouring bands each: the wider, the nearer are those that share one."""
    return F.expr(f"transform(sequence(0, {BANDS - 1}), i -> xxhash64(i, {', '.join(f'bands[(i + {j}) % {BANDS}]' for j in range(width))}))")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.75, k: int = WORDS) -> DataFrame:
    """One row per row of docs: id_col, n_shingles, component_id (smallest id reachable), kept."""
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).withColumn("h", F.xxhash64("text"))
    sketched = saved(spread(source, "id").mapInPandas(_sketches(k), "id long, h long, n long, s1 long, s2 long, bands array<long>, bits array<long>, set_bits array<long>"), "sketches")
    key = ["n", "s1", "s2"]
    classes = saved(sketched.where("n > 0 and id is not null").groupBy(*key).agg(F.min(F.struct("id", "h")).alias("rep")).select(*key, "rep.id", "rep.h"), "classes")
    rep = sketched.select("id", "h", "n", "bands", F.struct("n", "bits", "set_bits").alias("s")).join(classes.select("id", "h").hint("merge"), ["id", "h"], "left_semi").dropDuplicates(["id", "h"])
    rows = saved(rep, "reps").select("id", "h", "n", "bands", "s")
    # Buckets of more than one class, and the classes in them: nothing else is looked at from here on.
    keyed = rows.select("id", F.posexplode("bands").alias("i", "band"))
    buckets = keyed.groupBy("band").agg(F.min("id").alias("b"), F.count("*").alias("size")).where("size > 1").select("band", "b")
    shared = saved(keyed.join(buckets.hint("merge"), "band"), "buckets")
    rep = saved(rows.join(shared.select("id").distinct().hint("merge"), "id", "left_semi"), "shared")
    texts = saved(source.join(rep.select("id", "h").distinct().hint("merge"), ["id", "h"], "left_semi").select("id", "h", "text").dropDuplicates(["id", "h"]), "texts")
    sketch = lambda i: rep.select(F.col("id").alias(i), F.col("s").alias(f"s{i}"))

    def best(pairs: DataFrame) -> DataFrame:
        """For each a the b that looks most similar, of those that may be similar enough."""
        both = _lookup(pairs.join(sketch("a").hint("merge"), "a"), sketch("b"), "b", "a").where(_close("sa", "sb", threshold))
        return both.groupBy("a").agg(F.min_by("b", F.struct(_distance(), F.col("b"))).alias("b"))

    tested = saved(best(shared.where("id <> b").select(F.col("id").alias("a"), "b").distinct()), "first")
    none = rep.select("id", F.col("id").alias("c")).limit(0)
    links = saved(_confirm(tested, texts, threshold, k), "links")
    label = _merged(none, links)
    # Who is not of its bucket's main label meets three of its members, in ever narrower buckets.
    open_ = saved(_open(_labelled(shared.select("band", "i", "id"), label)), "open")
    for width in WIDTHS:
        if width > 1:
            left = rep.join(open_.select("id").distinct().hint("merge"), "id", "left_semi").select("id", F.explode(_keys(width)).alias("band"))
            narrow = saved(_open(_labelled(left, label)), "narrow")
        else:
            narrow = open_
        picks = [F.min_by(F.struct("id", "c"), F.xxhash64("id", F.lit(i))) for i in range(3)]
        centres = narrow.where("of_main").groupBy("band").agg(F.array_distinct(F.array(*picks)).alias("m")).select("band", F.explode("m").alias("m")).select("band", F.col("m.id").alias("b"), F.col("m.c").alias("cb"))
        met = saved(narrow.where("not of_main").select("band", F.col("id").alias("a"), F.col("c").alias("ca")).join(centres.hint("merge"), "band").drop("band").distinct(), "met")
        now = saved(best(met.select("a", "b").join(tested.hint("merge"), ["a", "b"], "left_anti")), "best")
        linked = saved(_confirm(now, texts, threshold, k), "linked")
        label = _merged(label, linked.join(met.hint("merge"), ["a", "b"]).select(F.col("ca").alias("a"), F.col("cb").alias("b")))
        links, tested = links.unionByName(linked), tested.unionByName(now)
    # What is left: each member without its bucket's main label, against all members with other labels that may be similar enough.
    open_ = _open(_labelled(open_.select("band", "i", "id"), label)).join(rep.select("id", "s", "bands").hint("merge"), "id")
    open_ = saved(open_.select("band", "id", "c", _one_sketch().alias("s"), F.slice("bands", 1, F.col("i")).alias("earlier"), "of_main", F.ceil(F.col("size") / SPLIT).cast("int").alias("salts")), "open")
    few = open_.where("not of_main").select("band", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("id").alias("a"), F.col("c").alias("ca"), F.col("s").alias("sa"), F.col("earlier").alias("ea"))
    all_ = open_.select(F.col("band").alias("band_b"), F.pmod(F.xxhash64("id"), "salts").cast("int").alias("salt_b"), F.col("id").alias("b"), F.col("c").alias("cb"), F.col("s").alias("sb"), F.col("earlier").alias("eb"), "of_main")
    # A pair is taken in the first of the bands that it shares, and nowhere else.
    meet = (F.col("ca") != F.col("cb")) & (F.col("of_main") | (F.col("a") < F.col("b"))) & _close_by_one("sa", "sb", threshold) & ~F.arrays_overlap("ea", "eb")
    pairs = few.join(all_.hint("merge"), (F.col("band") == F.col("band_b")) & (F.col("salt") == F.col("salt_b")) & meet).select("a", "b", "ca", "cb").distinct()
    pairs = saved(pairs.join(tested.hint("merge"), ["a", "b"], "left_anti"), "pairs")
    # The most similar of each goes first: what that links needs no other test.
    for last in (False, True):
        now = pairs if last else saved(best(pairs.select("a", "b")), "best")
        linked = saved(_confirm(now, texts, threshold, k), "linked")
        links = links.unionByName(linked)
        if not last:
            label = _merged(label, linked.join(pairs.hint("merge"), ["a", "b"]).select(F.col("ca").alias("a"), F.col("cb").alias("b")))
            pairs = pairs.join(now.hint("merge"), ["a", "b"], "left_anti").drop("ca", "cb")
            for x in ("a", "b"):
                pairs = pairs.join(label.select(F.col("id").alias(x), F.col("c").alias(f"c{x}")).hint("merge"), x, "left").withColumn(f"c{x}", F.coalesce(f"c{x}", x))
            pairs = saved(pairs.where("ca <> cb"), "pairs")
    label = saved(components(links), "components").select(F.col("node").alias("id"), F.col("component").alias("c"))
    named = _labelled(classes, label).select(*key, "c")
    found = sketched.select("id", *key).where("n > 0").join(named.hint("merge"), key, "left").select("id", "n", F.coalesce("c", "id").alias("c"))
    out = found.unionByName(sketched.where("n = 0").select("id", "n", F.col("id").alias("c")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("c").alias("component_id"), F.col("id").eqNullSafe(F.col("c")).alias("kept"))
