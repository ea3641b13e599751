"""Taxonomies: what is read, and every problem by its name."""

import json

import pytest

from convan.sources.taxonomy import TaxonomyError, list_text, read_taxonomy, with_class

GOOD = [{"name": "billing", "description": "about\nmoney"}, {"description": 'of "parcels"', "name": "delivery"}]


def written(tmp_path, value):
    path = tmp_path / "classes.json"
    path.write_text(value if isinstance(value, str) else json.dumps(value, indent=1))
    return f"file://{path}"


def test_read_and_look_up(spark, tmp_path):
    t = read_taxonomy(spark, written(tmp_path, GOOD))
    assert sorted(map(tuple, t.collect())) == [(1, "billing", "about\nmoney"), (2, "delivery", 'of "parcels"')]
    assert list_text(t).first().text == '- billing: about\nmoney\n- delivery: of "parcels"'
    df = spark.createDataFrame([(1, "delivery", "x"), (2, "other", "y"), (3, None, "z")], "k long, label string, place string")
    assert sorted((r.k, r.known, r.class_place, r.place) for r in with_class(df, t, "label").collect()) == [(1, True, 2, "x"), (2, False, None, "y"), (3, False, None, "z")]
    assert with_class(df.limit(0), t, "label").count() == 0


@pytest.mark.parametrize(
    "value, want",
    [
        ("{not json", [(None, None, "is no JSON list")]),
        ({"name": "a", "description": "b"}, [(None, None, "is no JSON list")]),
        ("", [(None, None, "is no JSON list")]),
        ([], [(None, None, "has 0 entries, 1 to 10000 are allowed")]),
        ([*GOOD, "text"], [(3, None, "is no object")]),
        ([{"name": "a"}], [(1, "description", "is missing")]),
        ([{"name": 5, "description": None}], [(1, "description", "is void, no string"), (1, "name", "is bigint, no string")]),
        ([{"name": " ", "description": "b"}], [(1, "name", "is blank")]),
        ([{"name": "a", "description": "b", "colour": "red"}], [(1, "colour", "is unknown")]),
        ([*GOOD, {"name": "billing", "description": "again"}], [(3, "name", "repeats that of entry 1")]),
    ],
)
def test_problems_are_named(spark, tmp_path, value, want):
    with pytest.raises(TaxonomyError) as e:
        read_taxonomy(spark, written(tmp_path, value))
    assert e.value.problems == want and want[0][2] in str(e.value)


def test_a_list_too_long_to_send(spark, tmp_path):
    with pytest.raises(TaxonomyError, match="has 2 entries, 1 to 1 are allowed"):
        read_taxonomy(spark, written(tmp_path, GOOD), most=1)
