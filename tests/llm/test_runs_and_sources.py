"""Periodic runs and the source divergence audit against brute force and their SQL."""

import glob
import os
import random
from collections import Counter

import duckdb
import numpy as np
import pytest

from foliant.llm import divergence, entries, periodic

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, term string, rank string"


def docs(spark, rows):
    """rows: (doc_id, text, lang, source); further columns clash with the operators' own names."""
    return spark.createDataFrame([(*r, None, "x", "y") for r in rows], SCHEMA)


def runs_by_hand(w, repeats=4, least=6):
    n, out = len(w), []
    for q in range(1, n // repeats + 1):
        i = q
        while i < n:
            j = i
            while j < n and w[j] == w[j - q]:
                j += 1
            s, size = i - q, j - i + q
            if j > i and size >= max(least, repeats * q) and not any(s2 <= s and s2 + n2 >= s + size for s2, n2, _ in out):
                out.append((s, size, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def some_words(rng):
    k = rng.randint(1, 4)
    w = [b"%d" % rng.randrange(k) for _ in range(rng.randint(0, 60))]
    if rng.random() < 0.6:
        at, block = rng.randint(0, len(w)), [b"%d" % rng.randrange(k + 3) for _ in range(rng.randint(1, 12))]
        w[at:at] = (block * 60)[: rng.randint(1, 60)]
    return w


@pytest.mark.parametrize("repeats", [4, 5])
def test_runs_are_those_by_hand(repeats):
    rng, cfg = random.Random(repeats), periodic.Runs(repeats=repeats)
    for _ in range(600):
        texts = [some_words(rng) for _ in range(rng.randint(1, 6))]
        got = [list(zip(*(x.tolist() for x in r))) for r in periodic.of_texts(texts, cfg)]
        assert got == [runs_by_hand(t, repeats) for t in texts]


def test_nested_runs_and_ties():
    inner = [b"a", b"a", b"a", b"a", b"a", b"a", b"b"] * 5
    assert list(zip(*(x.tolist() for x in next(periodic.of_texts([inner], periodic.Runs()))))) == [(0, 6, 1), (0, 35, 7), (7, 6, 1), (14, 6, 1), (21, 6, 1), (28, 6, 1)]
    assert periodic.best_of(np.array([0, 9, 20]), np.array([8, 12, 6]), np.array([2, 2, 1])) == 1
    with pytest.raises(ValueError):
        periodic.Runs(repeats=3)


def test_classes_are_those_of_equal_factors():
    """The partition after every step, against factors as they stand, of the classes that are large enough."""
    rng = random.Random(4)
    for _ in range(200):
        w = [rng.randrange(3) for _ in range(rng.randint(1, 50))]
        part, size = periodic.Partition(np.array([*w, -1])), 1
        while len(part.small):
            many = Counter(tuple(w[i : i + size]) for i in range(len(w) - size + 1))
            want = {}
            for i in range(len(w) - size + 1):
                if many[f := tuple(w[i : i + size])] >= periodic.LEAST_CLASS:
                    want.setdefault(f, []).append(i)
            got = {}
            for i in np.flatnonzero(part.cls >= 0).tolist():
                got.setdefault(int(part.cls[i]), []).append(i)
            assert sorted(got.values()) == sorted(want.values())
            for members in got.values():
                assert part.next[members].tolist() == [*members[1:], -1] and part.prev[members].tolist() == [-1, *members[:-1]]
            part.refine()
            size += 1


def test_run_rows(spark):
    rows = [(1, None, None, None), (2, "", "", ""), (3, " \n\t", "", ""), (4, "a b " * 3, "", ""), (5, "x" + " go\n" * 9 + "y", "", ""), (5, "x" + " go\n" * 9 + "y", "", ""), (None, "a b " * 9, "", ""), (6, "z" * 40_000, "", ""), (7, "ä b " * 20_000, "", "")]
    out = periodic.detect(docs(spark, rows)).collect()
    assert len(out) == len(rows)
    got = {r.doc_id: r[1:6] for r in out}
    assert got == {1: (0, None, None, None, None), 2: (0, None, None, None, None), 3: (0, None, None, None, None), 4: (0, None, None, None, None), 5: (1, 1, 9, 1, 9000), None: (1, 0, 18, 2, 9000), 6: (0, None, None, None, None), 7: (1, 0, 40_000, 2, 20_000_000)}
    texts = {r.doc_id: (r.text, len(r.runs)) for r in periodic.collapse(docs(spark, rows)).collect()}
    assert texts[5] == ("x go y", 1) and texts[7] == ("ä b", 1) and texts[1] == (None, 0) and texts[4] == ("a b " * 3, 0)
    assert periodic.detect(docs(spark, [])).collect() == []


def duck(name, sf_dir=None, **tables):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    for table, frame in tables.items():
        con.register(table, frame)
    rel = con.sql(entries.ORACLE[name])
    return sorted(rel.columns), sorted((tuple(r[rel.columns.index(c)] for c in sorted(rel.columns)) for r in rel.fetchall()), key=repr)


@pytest.mark.parametrize("name", ["op11_periodic_runs", "op12_source_divergence"])
def test_query_equals_its_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    out = entries.QUERIES[name](spark, sf)
    columns, want = duck(name, sf)
    assert columns == sorted(out.columns)
    assert sorted((tuple(r[c] for c in columns) for r in out.collect()), key=repr) == want


def some_sources(rng, n):
    words = [f"w{chr(97 + i)}" for i in range(26)] + ["ÉTÉ", "été", "Tree", "tree"]
    rows = [(i, " ".join(rng.choices(words, [1 / (k + 1) for k in range(30)], k=rng.randint(0, 40))), rng.choice(["en", "de", None, ""]), rng.choice(["a", "b", "ä", None, "hot", "hot"])) for i in range(n)]
    return [*rows, (None, None, "xx", "alone"), (1, "one two", "yy", "p"), (1, "one two", "yy", "q"), (2, "x" * 9_000 + " 1 2", "zz", "r"), *[(9, "same text", "vv", "s")] * 12]


@pytest.mark.parametrize("settings", [{}, {"held": 50}, {"cells_a_doc": 1, "most_cells": 1 << 16, "rows": 1}])
def test_audit_equals_its_sql(spark, settings):
    """Repeated rows, nulls, single sources and languages without kept terms; parts of a few pairs; a sketch of one row."""
    rows = some_sources(random.Random(3), 300)
    frame = docs(spark, rows)
    out = divergence.audit(frame.repartition(3), divergence.Audit(**settings))
    columns, want = duck("op12_source_divergence", documents=frame.toPandas())
    assert sorted((tuple(r[c] for c in columns) for r in out.collect()), key=repr) == want
    assert divergence.audit(docs(spark, [])).collect() == []


def test_the_sketch_rules_out_and_never_underestimates(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(f"t{rng.choice('abcdefgh')}{'x' * rng.randrange(9)} rare{chr(97 + i % 26)}{chr(97 + i // 26)}" for _ in range(5)), "en", "s") for i in range(400)]
    frame = docs(spark, rows).select("lang", "source", "text").repartition(5)
    docs_of = Counter(t for _, text, _, _ in rows for t in set(divergence.terms_of(text.encode())))
    for bits, fewer in ((20, True), (6, False)):
        cfg = divergence.Audit()
        maps = divergence.bitmaps(divergence.sketch(frame, cfg, bits), cfg, bits)
        terms = sorted(docs_of)
        part = divergence.Part([("en", "s")], terms, np.zeros(len(terms), np.int32), np.arange(len(terms)), None, None)
        ok = divergence.possible(maps, part.hashes(), bits)
        assert all(ok[k] for k, t in enumerate(terms) if docs_of[t] >= cfg.least_docs)
        if fewer:
            assert not any(ok[k] for k, t in enumerate(terms) if docs_of[t] < cfg.least_docs)


def test_shares_are_exact_beyond_64_bit_products(spark):
    count, total = 20_000_000_000, 4_000_000_000_000
    row = spark.createDataFrame([(count, total, 10**9)], "n long, t long, v long").select(divergence.share(*(divergence.F.col(c) for c in "ntv"), divergence.Audit()).alias("p")).first()
    assert row.p == 1 + 10**9 * (count + 2) // (total + 2 * 10**9)
