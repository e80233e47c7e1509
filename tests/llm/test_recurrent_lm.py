"""The recurrent language model: gradients, likelihoods word by word, counts and base scores by hand, held-out gain."""

import math
import zlib
from collections import Counter
from dataclasses import replace

import numpy as np
import pytest

from foliant.llm import entries, recurrent_lm as lm
from foliant.llm.common import Scratch

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, row string, word string"
SMALL = lm.Recurrent(classes=4, of_class=8, inputs=5, hidden=6, head=60, rounds=2, share=2, tasks=3, steps=7, lanes=4, at_once=300, piece=30)


def docs(spark, rows):
    """Further columns clash with the operator's own names."""
    return spark.createDataFrame([(i, t, None, None, None, 0.5, "x", "y") for i, t in rows], SCHEMA)


def held_out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 10 == 0


def by_hand(rows):
    """The contract's base: doc_id, held_out, n_tokens, n_known, train_tokens, base_score."""
    tokens = lambda t: [*(t or "").encode().lower().split(), None]
    c = Counter(w for i, t in rows if i is not None and not held_out(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    return [(i, held_out(i), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t))) for i, t in rows]


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(2)
    words = [f"w{k}" for k in range(150)] + ["Über", "x" * 90]
    p = 1 / np.arange(1, len(words) + 1)
    some = [(i, " ".join(rng.choice(words, rng.integers(0, 60), p=p / p.sum()))) for i in range(200)]
    return [*some, (300, None), (301, ""), (302, " \n\t"), (None, "w1 w2 never"), (303, "A\xa0b　C"), (303, "other text of it"), (304, "same"), (304, "same"), (305, "w3 " * 3_000 + "once"), (306, "unseen" * 3 + " W1")]


def test_gradients_are_right():
    cfg = lm.Recurrent(classes=3, of_class=4, inputs=3, hidden=4)
    net, rng = lm.Net(cfg, np.arange(12) + 1.0), np.random.default_rng(0)
    net.p = {k: x.astype(float) + rng.standard_normal(x.shape) * 0.3 for k, x in net.p.items()}
    x, y = rng.integers(0, 12, (5, 3)), rng.integers(0, 12, (5, 3))
    first, use, state = rng.random((5, 3)) < 0.3, rng.random((5, 3)) < 0.8, rng.standard_normal((3, 4)) * 0.5
    loss = lambda: net.gradients(x, y, first, use, state)[0]
    for k, g in net.gradients(x, y, first, use, state)[1].items():
        if isinstance(g, tuple):
            g, (at, part) = np.zeros_like(net.p[k]), g
            g[at] = part
        for i in [tuple(rng.integers(0, s) for s in g.shape) for _ in range(8)]:
            was, eps = net.p[k][i], 1e-5
            net.p[k][i] = was + eps
            up = loss()
            net.p[k][i] = was - eps
            down = loss()
            net.p[k][i] = was
            assert abs((up - down) / 2 / eps - g[i]) < 1e-6, k


def one_by_one(net, text):
    """ln P of word numbers that end with the end's, a word at a time."""
    p, h, total, before = net.p, np.zeros(net.cfg.hidden), 0.0, text[-1]
    soft = lambda z: np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    for w in text:
        g, k = p["word"][before] @ p["wx"] + p["b"], net.cfg.hidden
        z, r = (1 / (1 + np.exp(-(g[a : a + k] + h @ p["u"][:, a : a + k]))) for a in (0, k))
        new = np.tanh(g[2 * k :] + (r * h) @ p["u"][:, 2 * k :])
        h = (1 - z) * new + z * h
        c, place = divmod(int(w), net.cfg.of_class)
        total += math.log(soft(h @ p["class"] + p["class_b"])[c]) + math.log(soft(h @ p["out"][c] + p["out_b"][c])[place])
        before = w
    return total


def some_net(cfg=SMALL):
    net, rng = lm.Net(cfg, np.arange(cfg.words) + 1.0), np.random.default_rng(1)
    net.p = {k: (x + rng.standard_normal(x.shape) * 0.5).astype(np.float32) for k, x in net.p.items()}
    return net


def test_likelihoods_are_those_word_by_word():
    net, rng = some_net(), np.random.default_rng(3)
    texts = [np.append(rng.integers(0, SMALL.words, n), 1) for n in (0, 1, 5, 700, 3, 40, 64, 63, 0)]
    table = net.p["word"] @ net.p["wx"] + net.p["b"]
    want = [one_by_one(net, t) for t in texts]
    for width in (1, 3, 256):
        assert np.allclose(lm.log_likelihoods(net, texts, table, width), want, rtol=1e-4)


def test_probabilities_add_up_to_one():
    net = some_net()
    state = np.random.default_rng(4).standard_normal((1, SMALL.hidden)).astype(np.float32)
    assert abs(np.exp(net.log_p(np.repeat(state, SMALL.words, 0), np.arange(SMALL.words))).sum() - 1) < 1e-5


def test_an_untrained_network_is_the_smoothed_unigram():
    counts = np.arange(1, SMALL.words + 1) * 3.0
    net = lm.Net(SMALL, counts)
    got = net.log_p(np.ones((SMALL.words, SMALL.hidden), np.float32), np.arange(SMALL.words))
    assert np.allclose(got, np.log(counts / counts.sum()), atol=1e-5)


def test_lanes_read_every_word_once():
    cfg, rng, seen = replace(SMALL, rate=0.0), np.random.default_rng(5), Counter()
    texts = [np.append(rng.integers(2, cfg.words, n), 1) for n in (0, 100, 3, 31, 29, 30, 7)]

    class Watch(lm.Net):
        def gradients(self, x, y, first, use, state):
            seen.update(zip(x[use].tolist(), y[use].tolist()))
            return super().gradients(x, y, first, use, state)

    assert lm.learn(Watch(cfg, np.ones(cfg.words)), iter(texts)) == sum(map(len, texts))
    assert seen == Counter((int(a), int(b)) for t in texts for a, b in zip(np.append(t[-1], t[:-1]), t))


def lane_by_lane(texts, cfg):
    """windows() a word at a time."""
    texts, lanes = lm.pieces(iter(texts), cfg.piece), [[] for _ in range(cfg.lanes)]
    while True:
        x, y, first, use = (np.zeros((cfg.steps, cfg.lanes), kind) for kind in (int, int, bool, bool))
        for b, lane in enumerate(lanes):
            for t in range(cfg.steps):
                if not lane:
                    if (piece := next(texts, None)) is None:
                        break
                    lane += zip([piece[0], *piece[1][:-1]], piece[1])
                    first[t, b] = True
                x[t, b], y[t, b] = lane.pop(0)
                use[t, b] = True
        if not use.any():
            return
        yield x, y, first, use


@pytest.mark.parametrize("cfg", [SMALL, replace(SMALL, lanes=1), replace(SMALL, steps=30), replace(SMALL, piece=7), replace(SMALL, piece=3), replace(SMALL, steps=1)])
def test_windows_are_those_word_by_word(cfg):
    rng = np.random.default_rng(6)
    texts = [np.append(rng.integers(2, cfg.words, n), 1) for n in (0, 100, 3, 31, 29, 30, 7, 6, 13, 0, 59, 60, 200, 1)]
    got, want = list(lm.windows(iter(texts), cfg)), list(lane_by_lane(texts, cfg))
    assert len(got) == len(want)
    for some, other in zip(got, want):
        assert all(np.array_equal(p, q) for p, q in zip(some, other))


def test_texts_are_split_for_counts_and_once_more(spark, rows, tmp_path, monkeypatch):
    """Training and scoring share one table of word numbers."""
    seen = str(tmp_path / "seen")

    def watch(text):
        with open(seen, "ab") as f:
            f.write(b".")
        return text.lower().split()

    monkeypatch.setattr(lm, "words_of", watch)
    assert lm.fit_and_score(docs(spark, rows), SMALL).count() == len(rows)
    with open(seen, "rb") as f:
        assert len(f.read()) == sum(i is not None and not held_out(i) for i, _ in rows) + len(rows)


def test_numbers_of_a_portion_are_its_rows_own(spark):
    """Texts of several portions, empty ones at their borders: every row has its own words, sums and words beyond the head."""
    some = [(1, ""), (2, "w1 " * 400_000), (3, None), (4, "w2 rare rare w1"), (5, "w1 " * 300_000 + "once"), (6, "")]
    cfg = replace(SMALL, head=3, folds=1_000_000_007)
    got = {r.doc_id: r for r in lm.fit_and_score(docs(spark, some).coalesce(1), cfg).collect()}
    tokens = {i: [*(t or "").split(), None] for i, t in some}
    c = Counter(w for ts in tokens.values() for w in ts)
    n, v = sum(c.values()), len(c)
    for i, ts in tokens.items():
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(ts), len(ts), n)
        assert math.isclose(got[i].base_score, sum(k * math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w, k in Counter(ts).items()), rel_tol=1e-9)


@pytest.mark.parametrize("cfg", [SMALL, replace(SMALL, head=10_000, most_words=20), lm.Recurrent(tasks=2)])
def test_rows_by_hand(spark, rows, cfg):
    frame = docs(spark, rows).repartition(3)
    with Scratch(spark) as scratch:
        model, counts = lm.fit(frame, scratch, cfg)
        got = lm.score(frame, model, counts, scratch).collect()
        c = {r.word.encode(): r.n for r in counts.collect()}
    want = by_hand(rows)
    key = lambda r: (str(r[0]), r[2], round(r[5], 6))
    assert [(*r[:5], round(r[5], 8)) for r in sorted(map(tuple, got), key=key)] == [(*r[:5], round(r[5], 8)) for r in sorted(want, key=key)]
    # the score: the network's own words, then counts inside the unknown one
    net, number = model.net(), {w: k + 1 for k, w in enumerate(model.head[: model.own])}
    assert model.head[0] == lm.END and len(model.head) <= cfg.head and all(len(w) <= cfg.longest for w in model.head)
    own = {}
    for i, t in rows:
        words = [*lm.words_of((t or "").encode()), lm.END]
        lp = one_by_one(net, [number.get(w, 0) for w in words]) / math.log(10) if len(words) < 400 else None
        own[(i, len(words))] = lp and lp + sum(math.log10((c.get(w, 0) + 0.1) / model.rest_total()) for w in words if w not in number)
    assert all(abs(own[(r.doc_id, r.n_tokens)] - r.score) < 1e-3 * max(1, abs(r.score)) for r in got if own[(r.doc_id, r.n_tokens)] is not None)


@pytest.mark.parametrize("cfg", [SMALL, lm.Recurrent(tasks=2)])
def test_every_training_document_is_learned_from(spark, rows, cfg, monkeypatch):
    """By default as well: no part of the training documents is left out, and none is learned from more often than others."""
    seen, average = Counter(), lm.one_round

    def watch(texts, *more):
        seen.update(r.doc_id for r in texts.collect())
        return average(texts, *more)

    monkeypatch.setattr(lm, "one_round", watch)
    with Scratch(spark) as scratch:
        lm.fit(docs(spark, rows), scratch, cfg)
    assert seen == Counter(i for i, _ in rows if i is not None and not held_out(i))


def test_no_setting_leaves_training_documents_out():
    with pytest.raises(ValueError):
        lm.Recurrent(rounds=4, share=32)


def test_softmax_of_far_logits():
    logits = np.array([[-200.0, -201.0], [500.0, 0.0], [1.0, 2.0], [90.0, 90.0]], np.float32)
    at, want = np.array([1, 1, 0, 1]), [-1 - math.log1p(math.exp(-1)), -500, -1 - math.log1p(math.exp(-1)), -math.log(2)]
    assert np.allclose(lm.target_log(logits.copy(), at), want, rtol=1e-5)
    loss, d = lm.surprise(logits.copy(), np.arange(4), at, 4)
    assert abs(loss + sum(want)) < 1e-3 and np.isfinite(d).all() and np.allclose(d.sum(1), 0, atol=1e-6)


def test_odd_tables(spark):
    assert lm.fit_and_score(docs(spark, []), SMALL).collect() == []
    alone = next(i for i in range(100) if held_out(i))
    row = lm.fit_and_score(docs(spark, [(alone, "a b")]), SMALL).first()  # nothing to learn from
    assert tuple(row) == (alone, True, 3, 0, 0, 0.0, 0.0)


def test_held_out_texts_are_likelier_than_by_counts(spark):
    out = entries.op13_lm_scoring(spark, "/root/testdata/sf0.01").filter("held_out").agg({"score": "sum", "base_score": "sum", "n_tokens": "sum"}).first()
    assert out["sum(score)"] / out["sum(n_tokens)"] > out["sum(base_score)"] / out["sum(n_tokens)"] + 0.02
