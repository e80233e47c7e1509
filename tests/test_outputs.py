"""Checks on source and output together, against counters."""

import random
import re
from collections import Counter

from foliant.operators import paired


def brute(source, output):
    words = lambda t: Counter(re.findall(r"[^\W_]+", (t or "").lower()))
    lines = lambda t: Counter(k for x in (t or "").lower().split("\n") if (k := re.sub(r"[\W_]", "", x)))
    a, b, la, lb = words(source), words(output), lines(source), lines(output)
    years = lambda x, y: sum(bool(re.fullmatch(r"(19|20)\d\d", k)) and k not in y for k in x)
    return (a.total(), b.total(), (a - b).total(), (b - a).total(), years(a, b), years(b, a), sum(k not in lb for k in la), sum(n for k, n in (lb - la).items() if k in la))


def test_differences_are_counters(spark):
    rng = random.Random(3)
    line = lambda: " ".join(rng.choice(["grant", "Grant", "1999", "2004", "of", "élan", "_", "1899"]) for _ in range(rng.randint(0, 4)))
    text = lambda: "\n".join(line() for _ in range(rng.randint(0, 6)))
    sources = {i: text() for i in range(60)} | {100: None, 101: "", 102: "only here 1999", 103: "x\n" * 5_000, 104: "null output"}
    outputs = {i: text() for i in range(55)} | {100: "out of nothing", 101: "", 103: "x\n" * 6_000, 104: None, 999: "unknown"}
    frame = lambda d: spark.createDataFrame([(i, t, "clash", 1) for i, t in d.items()], "doc_id long, text string, kind string, s int")
    out = paired.differences(frame(sources), frame(outputs)).collect()
    assert {r.doc_id: r.there for r in out} == {i: outputs.get(i) is not None for i in sources} and len(out) == len(sources)
    for r in out:
        assert (r.words, r.out_words, r.lost_words, r.new_words, r.lost_years, r.new_years, r.lost_lines, r.twice) == brute(sources[r.doc_id], outputs.get(r.doc_id)), r.doc_id
    found = {(r.doc_id, r.lint): r.n for r in paired.findings(frame(sources), frame(outputs)).collect()}
    assert found[(103, "lines_twice")] == 1_000 and not any(i in (102, 104, 999) for i, _ in found) and (100, "words_new") in found
    status = {(r.lint, r.status): r.docs for r in paired.status(frame(sources), frame(outputs)).collect()}
    assert status[("lines_lost", "skipped: no output")] == 7 and status[("lines_lost", "ran")] == 58


def test_rows_of_one_document_count_together_and_nothing_gives_nothing(spark):
    one = spark.createDataFrame([(1, "a b"), (1, "c"), (None, "z")], "doc_id long, text string")
    two = spark.createDataFrame([(1, "a b\nc")], "doc_id long, text string")
    r = paired.differences(one, two).collect()
    assert len(r) == 1 and (r[0].words, r[0].lost_words, r[0].new_words, r[0].lost_lines) == (3, 0, 0, 0)
    assert paired.findings(one.filter("false"), two).collect() == [] == paired.status(one.filter("false"), two).collect()
