"""Order-dependent resolution in rounds, against the loop that it stands for."""

import random

import pytest
from pyspark.sql import functions as F

from foliant.operators import dedup, rounds


def loop(pairs):
    gone, out = set(), {}
    for g, a, b, drops_b in sorted(pairs):
        if (g, a) not in gone and (g, b) not in gone:
            d, k = (b, a) if drops_b else (a, b)
            gone.add((g, d))
            out[(g, d)] = k
    return out


@pytest.mark.parametrize("seed", range(4))
def test_first_come_is_the_loop(spark, seed):
    rng = random.Random(seed)
    pairs = {}
    for g in range(30):
        n = rng.randint(1, 12)
        for _ in range(rng.randint(0, 25)):
            a, b = sorted(rng.sample(range(n + 1), 2))
            pairs[(g, a, b)] = rng.random() < (0.5, 0.9)[seed % 2]
    rows = [(*k, d) for k, d in pairs.items()]
    out = rounds.first_come(spark.createDataFrame(rows * 2, "g int, a long, b long, drops_b boolean"), ["g"]).collect()
    assert {(r.g, r.dropped): r.kept for r in out} == loop(rows) and len(out) == len(loop(rows))


def test_chains_stars_and_nothing(spark):
    schema = "g int, a long, b long, drops_b boolean"
    star = [(0, 1, b, True) for b in range(2, 300)]
    chain = [(1, a, a + 1, True) for a in range(1, 14)]
    late = [(2, 1, 5, False), (2, 1, 6, True), (2, 5, 6, True), (2, None, 6, True), (2, 7, 8, None)]
    out = rounds.first_come(spark.createDataFrame([*star, *chain, *late], schema), ["g"]).collect()
    assert {(r.g, r.dropped): r.kept for r in out} == loop([*star, *chain, *late[:3], (2, 7, 8, False)])
    assert rounds.first_come(spark.createDataFrame([], schema), ["g"]).collect() == []


@pytest.mark.parametrize("seed", range(3))
def test_first_of_keys_is_the_loop(spark, seed):
    rng, rows = random.Random(seed), []
    for person in range(25):
        for i in range(rng.randint(0, 14)):
            rows.append((person, 100 * person + i, [rng.choice(["a", "b", "c", "d", "e", "f", None]) for _ in range(rng.randint(0, 3))]))
    want = {}
    for person in range(25):
        held = {}
        for p, i, ks in rows:
            if p == person:
                ks = {k for k in ks if k}
                at = min((held[k] for k in ks if k in held), default=None)
                if at is None:
                    held.update((k, i) for k in ks if k not in held)
                else:
                    want[(p, i)] = at
    frame = spark.createDataFrame(rows, "person int, id long, ks array<string>")
    assert {(r.person, r.id): r.holder for r in rounds.first_of_keys(frame, ["person"], "id", F.col("ks")).collect()} == want
    assert rounds.first_of_keys(frame.filter("false"), ["person"], "id", F.col("ks")).collect() == []


def test_a_long_chain_is_no_round_a_link(spark, monkeypatch):
    """Each link waits for the one before; in rounds of joins, every second one was a round of its own."""
    kept, keep = [], rounds.Tables.keep
    monkeypatch.setattr(rounds.Tables, "keep", lambda self, rows: kept.append(1) or keep(self, rows))
    schema = "g string, a long, b long, drops_b boolean"
    chain = [(None, a, a + 1, True) for a in range(1, 30)] + [("x", a, a + 1, a % 3 > 0) for a in range(1, 20)]
    out = rounds.first_come(spark.createDataFrame(chain, schema), ["g"]).collect()
    want = {(None if g == "" else g, d): k for (g, d), k in loop([(g or "", *p) for g, *p in chain]).items()}
    assert {(r.g, r.dropped): r.kept for r in out} == want
    assert len(kept) < 5


@pytest.mark.parametrize("most", (0, 6))
def test_rounds_and_order_agree(spark, most):
    """Groups above the bound take rounds until they are below it."""
    rng = random.Random(most)
    pairs = {(g, *sorted(rng.sample(range(9), 2))): rng.random() < 0.7 for g in range(8) for _ in range(14)}
    rows = [(*k, d) for k, d in pairs.items()]
    out = rounds.first_come(spark.createDataFrame(rows, "g int, a long, b long, drops_b boolean"), ["g"], most).collect()
    assert {(r.g, r.dropped): r.kept for r in out} == loop(rows)


def near_by_hand(rows):
    """(g, a, b) of all pairs of (id, g, text) in a group."""
    words = {i: set(w for w in t.split() if len(w) > 1) for i, _, t in rows}
    out = set()
    for a, g, _ in rows:
        for b, h, _ in rows:
            k = len(words[a] & words[b])
            if g == h and a < b and k and (k / len(words[a] | words[b]) >= 0.6 or k / min(len(words[a]), len(words[b])) >= 0.75):
                out.add((g, a, b))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_near_rows_and_what_goes_of_them(spark, seed, monkeypatch):
    """Copies by the dozen, near sets, longer and shorter texts; lists of two ids, and groups by rows or by pairs."""
    rng, vocabulary = random.Random(seed), [f"w{k}" for k in range(7)]
    rows = [(i, rng.choice("xyz"), " ".join(rng.choices(vocabulary[: 4 + seed], k=rng.randint(1, 5))) + " a" * rng.randint(0, 2)) for i in rng.sample(range(500), 150)]
    frame = spark.createDataFrame([*rows, (900, "x", None), (901, "x", ""), (None, "x", "w1 w2"), (902, None, "w1 w2")], "id long, g string, t string")
    monkeypatch.setattr(dedup, "ROWS_A_LIST", 2)
    got = [(r.g, r.a, r.b) for r in dedup.near_pairs(frame, "id", "g", "t").collect()]
    want = near_by_hand(rows)
    assert set(got) == want and len(got) == len(want)
    long = {i: len(t) for i, _, t in rows}
    gone = set(loop([(g, a, b, long[b] <= long[a]) for g, a, b in want]))
    for most in (0, 10**6):
        out = [(r.g, r.dropped) for r in dedup.greedy_near(frame, "id", "g", "t", rows_a_task=most).collect()]
        assert set(out) == gone and len(out) == len(gone)


def test_no_pair_of_copies_is_shuffled(spark):
    """Two thousand copies are two million pairs: they were shuffled twice."""
    frame = spark.range(2000).select("id", F.lit("g").alias("g"), F.lit("large ring").alias("t"))
    out = dedup.near_pairs(frame, "id", "g", "t")
    assert out.count() == 2000 * 1999 // 2
    plan = out._jdf.queryExecution().executedPlan().toString()
    final = plan.split("Initial Plan")[0]
    assert final.index("Exchange") > final.index("Generate explode(ids_a")
