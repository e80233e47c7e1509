"""Spans of days and lines of forms: edge cases by hand, and brute force on random rows."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from foliant.operators import spans, templates

CASES = {
    "2001-2003": [("2001-01-01", "2004-01-01", "year")],
    "2001-03": [("2001-03-01", "2001-04-01", "month")],
    "1998-14": [("1998-01-01", "2015-01-01", "year")],
    "1998-97": [],
    "Grant, 1999 - Present": [("1999-01-01", "2010-06-01", "year")],
    "Feb. 2001 to March 2002": [("2001-02-01", "2002-04-01", "month")],
    "2/28/99": [("1999-02-28", "1999-03-01", "day")],
    "2/29/99": [],
    "05/98- 07/01": [("1998-05-01", "2001-08-01", "month")],
    "1998-03-2001-05": [("1998-03-01", "2001-06-01", "month")],
    "1998-03-14 – 1998-04-02": [("1998-03-14", "1998-04-03", "day")],
    "2001, 2002 and 2005": [("2001-01-01", "2002-01-01", "year"), ("2002-01-01", "2003-01-01", "year"), ("2005-01-01", "2006-01-01", "year")],
    "2005-2001": [],
    "13/98, 12001, room 2001b": [],
    "": [],
    None: [],
}


def test_written_days(spark):
    rows = [(k, t, "kept") for k, t in enumerate(CASES)]
    out = spans.day_spans(spark.createDataFrame(rows, "id long, text string, lo string"), F.col("text"), "2010-06-01")
    assert out.columns == ["id", "text", "place", "lo", "hi", "unit"]
    got = {}
    for r in sorted(out.collect(), key=lambda r: (r.id, r.place)):
        got.setdefault(r.id, []).append((str(r.lo), str(r.hi), r.unit))
    assert {t: got.get(k, []) for k, t in enumerate(CASES)} == CASES


@pytest.mark.parametrize("seed", range(2))
def test_overlaps_and_counts_are_brute_force(spark, seed):
    rng, rows = random.Random(seed), []
    for i in range(150):
        lo = date(1990, 1, 1) + timedelta(days=rng.randint(0, 4000))
        rows.append((rng.choice("ab"), i // 2, i % 2, lo, lo + timedelta(days=rng.choice([1, 30, 366, 5000]))))
    frame = spark.createDataFrame(rows, "g string, id long, place int, lo date, hi date")
    meet = lambda a, b: a[3] < b[4] and b[3] < a[4]
    n = {(r.id, r.place): r.n for r in spans.concurrent(frame, ["g"]).collect()}
    assert n == {(a[1], a[2]): sum(a[0] == b[0] and meet(a, b) for b in rows) - 1 for a in rows}
    want = {}
    for a in rows:
        for b in rows:
            if a[1] % 10 == 0 and a[0] == b[0] and a[1] != b[1] and meet(a, b):
                want[(a[1], b[1])] = want.get((a[1], b[1]), 0) + (min(a[4], b[4]) - max(a[3], b[3])).days
    out = spans.overlapping(frame.filter("id % 10 = 0"), frame, ["g"]).collect()
    assert {(r.id, r.other): r.days for r in out} == want and len(out) == len(want)
    assert spans.concurrent(frame.filter("false"), ["g"]).collect() == [] == spans.overlapping(frame, frame.filter("false"), ["g"]).collect()


def test_a_month_agrees_with_its_year_and_what_is_undated_with_all(spark):
    texts = {1: "2001", 2: "March 2001", 3: "April 2001", 4: "none", 5: "2001, 2009"}
    at = spans.day_spans(spark.createDataFrame(list(texts.items()), "id long, text string"), F.col("text"), "2010-01-01")
    pairs = spark.createDataFrame([(2, 1), (2, 3), (4, 1), (1, 4), (5, 1), (1, 5)], "dropped long, kept long")
    assert {(r.dropped, r.kept): r.agree for r in spans.agree(pairs, at).collect()} == {(2, 1): True, (2, 3): False, (4, 1): True, (1, 4): False, (5, 1): False, (1, 5): True}


def test_shapes_of_forms(spark):
    yes = [
        "C. Academic Appointments (include institution, title and dates)", "1. Leave: N/A", "video media): n/a.", "(Please list all): N/A", "(include dates)", "NOTE: This  section should name what you did", "ii) Talk(s) given (specify place",
        "12) Awards (give year): not applicable",
    ]
    no = [
        "Attending Physician (provide inpatient care)", "C. Papers (list available upon request)", "b. National:", "2. Conflicts: None", "C. Posts (include title), 2001", "Note: this table is for reference", "1. Leave | N/A", "Leave: N/A",
        "C. Posts (include (all) titles)", "(list on request)", "", "   ", None, "A. " + "word " * 90 + "(include all)", "N/A", "1. 2001: N/A",
    ]
    out = spark.createDataFrame([(x,) for x in yes + no], "line string").select("line", templates.is_scaffold(F.col("line")).alias("s")).collect()
    assert [r.line for r in out if r.s] == yes and len(out) == len(yes + no)


def test_templates_belong_to_sources(spark):
    rows = [(i, "a", "Name of 1. board") for i in range(5)] + [(i, "b", "Years, held") for i in range(10, 14)] + [(10, "b", "name of BOARD"), (11, "b", "my own line"), (11, "b", "my own line"), (20, None, "Years: held"), (21, "a", ""), (21, "a", None), (22, "c", "12")]
    lines = spark.createDataFrame(rows, "doc_id long, source string, line string").select("doc_id", "source", templates.line_key(F.col("line")).alias("key"))
    out = {(r.doc_id, r.key): (r.n, r.own, r.foreign, r.home) for r in templates.by_origin(lines, 0.5, 2).collect()}
    assert out[(0, "name of board")] == (1, True, False, "a") and out[(10, "name of board")] == (1, False, True, "a")
    assert out[(11, "my own line")] == (2, False, False, None) and out[(20, "years held")] == (1, False, True, "b") and out[(12, "years held")][1]
    assert len(out) == 12
    assert templates.by_origin(lines.filter("false"), 0.5, 2).collect() == []


def test_what_overlaps_is_not_shuffled(spark):
    """Pairs of ids that stand in one group come out of the join as they are; they were grouped, so shuffled, all of them."""
    day = lambda k: date(1990, 1, 1) + timedelta(days=k)
    rows = [("a", i, day(400 * j + i), day(400 * j + i + 300)) for i in range(60) for j in range(1 + i % 3)]
    frame = spark.createDataFrame(rows, "g string, id long, lo date, hi date")
    out = spans.overlapping(frame.filter("id < 20"), frame, ["g"])
    want = {}
    for a in rows:
        for b in rows:
            if a[1] < 20 and a[1] != b[1] and (n := (min(a[3], b[3]) - max(a[2], b[2])).days) > 0:
                want[(a[1], b[1])] = want.get((a[1], b[1]), 0) + n
    assert {(r.id, r.other): r.days for r in out.collect()} == want
    plan = out._jdf.queryExecution().optimizedPlan()
    assert plan.nodeName() == "Union" and "Aggregate [id_q" not in plan.apply(0).toString() and plan.children().head().nodeName() == "Project"
