"""The stages of the pipeline that drop copies, and packing after them, against brute force: null ids, repeated ids, repeated rows."""

from collections import Counter

import corpus_pipeline as P
import pytest
from convan.llm import near_dedup
from convan.llm.common import saved

BASE = " ".join(f"w{i}" for i in range(60))
NEAR = [BASE.replace("w30", x) for x in ("one", "two", "three")]
OTHER = [" ".join(f"{x}{i}" for i in range(20)) for x in "abcdefg"]
A, B, C, D, E, F_, G = OTHER
ROWS = [
    (5, A), (5, B), (9, A), (9, A), (9, A), (None, A),  # an id with two texts; repeated rows; a null id among others
    (None, C), (None, C), (None, D), (7, None), (8, ""), (None, "  "),
    (1, BASE), (2, NEAR[0]), (None, NEAR[1]), (3, E), (3, NEAR[2]), (3, F_), (4, G), (4, E),
]


def columns(rows):
    return [(i, t, "en", "x", len(t or "")) for i, t in rows]


def of(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def low(i):
    return (i is None, i or 0)


def exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append((i, t))
    return [max(g, key=lambda r: (r[0] is not None, r[0] or 0)) for g in groups.values()]


def near(rows):
    sets, group = [set(near_dedup.shingle_set(t).tolist()) for _, t in rows], list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] & sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                group = [group[b] if g == group[a] else g for g in group]
    return [min((r for r, g in zip(rows, group, strict=True) if g == x), key=lambda r: low(r[0])) for x in set(group)]


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.createDataFrame(columns(ROWS), "doc_id long, text string, lang string, source string, n_chars long"), {}
    for name, stage in P.STAGES[2:]:
        docs = out[name] = saved(stage(spark, docs, ""), name.replace(" ", "-"))
    return out


def test_no_copies(stages):
    want = Counter(exact(ROWS))
    assert of(stages["exact dedup"]) == want and want[(5, A)] == 0 and want[(None, C)] == want[(5, B)] == want[(9, A)] == 1
    assert stages["exact dedup"].columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_no_near_copies(stages):
    want = Counter(near(exact(ROWS)))
    assert of(stages["near dedup"]) == want and want[(3, F_)] == want[(None, D)] == want[(1, BASE)] == 1 and want[(3, NEAR[2])] == 0


def test_packed(stages):
    got = Counter(r.doc_id for r in stages["packing"].where("piece = 0").collect())
    assert got == Counter(i for i, _ in near(exact(ROWS)))


def test_columns_of_any_name(spark, tmp_path):
    """Columns named like the stages' own come back as they were, through the fitted stages too; these act on labels of documents alone."""
    good = "the quick brown words are of a text that reads well and goes on for some more words"
    rows = [(i, f"{good} {i}" if i % 2 else "BUY NOW !!! $$$ idiot scum " * 3, "en", "x", 1, f"r{i}", f"q{i}", f"t{i}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _row string, _quality string, _toxicity string")
    spark.createDataFrame([(i, i % 2, 1 - i % 2) for i in range(50)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for stage in (P.good_quality, P.not_toxic):
        got = stage(spark, docs, str(tmp_path))
        assert got.columns == docs.columns and {r.doc_id for r in got.collect()} == set(range(1, 60, 2))
    got = P.no_near_copies(spark, docs, "")
    assert got.columns == docs.columns and all((r._row, r._quality, r._toxicity) == (f"r{r.doc_id}", f"q{r.doc_id}", f"t{r.doc_id}") for r in got.collect())
    for stage in (P.good_quality, P.not_toxic, P.no_copies, P.no_near_copies, P.packed):
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
