"""Twins under other codes, containment by rarest words, and entries of several records: by hand and by brute force."""

import json
import random

import pytest
from pyspark.sql import functions as F

from foliant.operators import fanout, identity


@pytest.mark.parametrize("seed", range(2))
def test_twins_are_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice([1, 2, None]), i, rng.choice(["S1", "S2", "S3", None]), rng.choice("abcd "), rng.choice([1, 2, 3, None])) for i in range(120)]
    rows += [(3, 1000 + i, "S1", "z", None) for i in range(40)] + [(3, 2000, "S2", "z", 7)]
    want = {}
    for p, i, c, k, n in rows:
        met = [j for q, j, b, m, o in rows if p is not None and p == q and c and b and c != b for same in (k == m, n is not None and n == o) if same]
        if met:
            want[(p, i)] = (min(met), len(met))
    frame = spark.createDataFrame(rows, "person int, record_id long, code string, name string, number int")
    out = identity.code_twins(frame, [F.col("name"), F.col("number")]).collect()
    assert {(r.person, r.record_id): (r.twin, r.shared) for r in out} == want and len(out) == len(want)
    assert want[(3, 2000)] == (1000, 40)
    assert identity.code_twins(frame.filter("false"), [F.col("name")]).collect() == []


@pytest.mark.parametrize("seed", range(2))
def test_containment_is_brute_force(spark, seed):
    rng = random.Random(seed)
    sets = lambda n, k: [(rng.randint(1, 3), 1000 * k + i, [rng.choice("abcdefgh") for _ in range(rng.randint(0, 4 * k))]) for i in range(n)]
    some, held = sets(60, 1) + [(1, 1900, None), (1, 1901, ["never"])], sets(60, 2) + [(None, 2900, ["a"]), (1, 2901, None)]
    want = {i: min(js) for p, i, w in some if w and (js := [j for q, j, v in held if p == q and v and set(w) <= set(v)])}
    frame = lambda x: spark.createDataFrame(x, "person int, record_id long, words array<string>")
    out = identity.inside_dated(frame(some), frame(held)).collect()
    assert {r.record_id: r.inside for r in out} == want and len(out) == len(want) > 10
    assert identity.inside_dated(frame(some), frame(held).filter("false")).collect() == []


def test_fan_out_and_its_guards(spark):
    schemas = spark.createDataFrame([("H", ["title", "year", "place"])], "code string, keys array<string>")
    two = [{"title": "One", "year": "1999"}, {"title": "Two"}]
    cases = {
        1: ("One 1999, two at the Here", {"place": "Here", "year": "1950", "awards": two}),
        2: ("one two", {"group": {"items": two, "label": "x"}}),
        3: ("one three", {"awards": two}),
        4: ("one", {"awards": two, "more": two}),
        5: ("one", {"awards": [*two, {"title": "x", "minutes": "3"}]}),
        6: ("one", {"awards": two, "formatted_citation": "One and Two."}),
        7: ("one", {"awards": [*two, {"title": " ", "year": ""}]}),
        8: ("one", {"title": "One", "awards": ["a", "b"], "empty": []}),
        9: (None, {"awards": [{"title": "Alone [and \"so\"] {on}"}]}),
        10: ("one", {"year": json.dumps(two), "title": "t"}),
        11: ("one", None),
        12: ("one", {"awards": two}),
    }
    rows = [(i, "unknown" if i == 12 else "H", t, json.dumps(f) if f is not None else None, "extra") for i, (t, f) in cases.items()] + [(13, None, "", "no json", "extra"), (14, "H", "", "[1]", "extra")]
    out = fanout.fan_out(spark.createDataFrame(rows, "entry_id long, code string, text string, fields string, values string"), schemas).collect()
    got = {(r.entry_id, r.ord): (r.from_key, r["values"], r.reason) for r in out}
    assert len(got) == len(out)
    assert got[(1, 0)] == ("awards", {"place": "Here", "title": "One", "year": "1999"}, None) and got[(1, 1)] == ("awards", {"place": "Here", "title": "Two", "year": "1950"}, None)
    assert got[(2, 1)] == ("group.items", {"title": "Two"}, None)
    assert got[(9, 0)][1] == {"title": 'Alone [and "so"] {on}'}
    reasons = {i: r for (i, o), (_, _, r) in got.items() if o is None}
    assert reasons == {3: "uncovered", 4: "several", 5: "foreign_key", 6: "formatted", 7: "blank_record", 8: "single", 10: "single", 11: "single", 12: "foreign_key", 13: "single", 14: "single"}
    assert len(out) == 5 + len(reasons)
