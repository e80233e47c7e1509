"""Blocks of two versions, against the plain search for the best ratio, and how often that is worked out."""

import random
from difflib import SequenceMatcher

from foliant.operators import alignment


def by_hand(before, after):
    x, y, rows, gone, came = [t for _, t in before], [t for _, t in after], [], [], []
    for op, i1, i2, j1, j2 in SequenceMatcher(None, x, y, autojunk=False).get_opcodes():
        if op == "equal":
            rows += [("equal", before[i][0], after[j][0], x[i]) for i, j in zip(range(i1, i2), range(j1, j2), strict=True)]
        else:
            gone += range(i1, i2)
            came += range(j1, j2)
    for i in gone:
        best = max(((SequenceMatcher(None, x[i], y[j]).ratio(), -j) for j in came), default=(0, 0))
        if best[0] >= alignment.MOVE_RATIO:
            came.remove(-best[1])
            rows.append(("moved", before[i][0], after[-best[1]][0], x[i]))
        else:
            rows.append(("deleted", before[i][0], None, x[i]))
    return rows + [("added", None, after[j][0], y[j]) for j in came]


def versions(rng):
    lines = [" ".join(rng.choices(["one", "two", "three", "four", "fiver"], k=rng.randint(1, 80))) for _ in range(12)]
    slip = lambda t: t if rng.random() < 0.6 else t.replace("one", "One", rng.randint(0, 4)) + "."
    return [(k, t) for k, t in enumerate(lines)], [(k, slip(t)) for k, t in enumerate(rng.sample(lines, 9) + lines[:2])]


def test_changes_are_those_of_the_plain_search(spark):
    rng, pairs, want = random.Random(1), [], set()
    for doc in range(25):
        before, after = versions(rng)
        assert alignment._changes(before, after) == by_hand(before, after)
        want |= {(doc, *r) for r in by_hand(before, after)}
        pairs.append((doc, before, after))
    side = lambda k: spark.createDataFrame([(p[0], *b) for p in pairs for b in p[k]] + ([(99, 0, "alone")] if k == 1 else []), "doc long, idx int, text string")
    assert {tuple(r) for r in alignment.aligned(side(1), side(2)).collect()} == want | {(99, "deleted", 0, None, "alone")}


def test_unlike_blocks_are_ruled_out_first(monkeypatch):
    """Each deleted block met each added one letter by letter."""
    ratios, ratio = [], SequenceMatcher.ratio
    monkeypatch.setattr(SequenceMatcher, "ratio", lambda self: ratios.append(1) or ratio(self))
    before, after = [(k, chr(97 + k) * (5 + k)) for k in range(20)], [(k, chr(75 - k) * 9) for k in range(10)]
    assert {r[0] for r in alignment._changes(before, after)} == {"deleted", "added"} and not ratios
