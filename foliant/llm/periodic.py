"""Periodic runs of words, by Crochemore's partition refinement.

A run is a stretch of words with a smallest period q of which it holds ``repeats`` times or more, that can't be extended on either side with that period.

Positions of equal factors of one length form a class; classes of length l are refined to those of length l + 1. Of the classes that
one class fell into, all but one largest are used: the positions before their members are taken out of their classes (smaller-half strategy, so a position
is taken some log n times). A class keeps its members in one stretch of an array, where those taken out are swapped to the front, and linked in the order of the text.
At length q the neighbours in a class at distance q are squares of period q, none of them of a shorter one; consecutive squares are merged into runs.

All of it is done for the positions of a whole level at once, in numpy, and for many texts side by side. A run of four periods holds each of its factors of length q three times at least, so classes
of fewer than three members are given up; so is a text at lengths over its words / ``repeats``. So ordinary text is done with after a few lengths.

Defined results. Null and empty texts have no words and no run. Repeated rows give a row each; an empty table none. Of runs with the same exponent the first, then the one of the
smaller period is best. Very long texts are taken whole, alone: memory grows with the words of a text, time with n log n of them. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from foliant.llm.common import doc_rows, held, raw_texts

#: Members of a class that still can hold a run's factor. It needs ``repeats`` of four or more.
LEAST_CLASS = 3


@dataclass(frozen=True)
class Runs:
    """repeats: least periods of a run, at least 4. least: words of a run. at_once: words that are refined side by side."""

    repeats: int = 4
    least: int = 6
    at_once: int = 300_000

    def __post_init__(self):
        if self.repeats < 4:
            raise ValueError("classes of fewer than three members are given up, which needs four repeats")


def stretches(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each, together."""
    total = int(sizes.sum())
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(total)


class Partition:
    """Classes of positions by equal factors, for words of several texts with a number of its own after each."""

    def __init__(self, words: np.ndarray):
        """words: numbers; those that stand fewer than LEAST_CLASS times are alone. A position without a class has -1."""
        n = len(words)
        order = np.argsort(words, kind="stable")
        value = words[order]
        starts = np.flatnonzero(np.diff(value, prepend=value[0] - 1)) if n else np.empty(0, np.int64)
        sizes = np.diff(np.append(starts, n))
        live = sizes >= LEAST_CLASS
        self.elems = order  # members of a class stand together
        self.loc = np.empty(n, np.int64)
        self.loc[order] = np.arange(n)
        self.cls = np.empty(n, np.int64)
        self.cls[order] = np.repeat(np.where(live, np.arange(len(starts)), -1), sizes)
        self.first, self.end, self.classes = self._room(starts), self._room(starts + sizes), len(starts)
        self.next, self.prev = np.full(n, -1), np.full(n, -1)
        same = self.cls[order[1:]] == self.cls[order[:-1]]
        same &= self.cls[order[1:]] >= 0
        self.next[order[:-1][same]], self.prev[order[1:][same]] = order[1:][same], order[:-1][same]
        self.mark = np.zeros(n, bool)
        self.small = np.arange(n)  # members of the classes by which the next step splits
        self.changed = np.flatnonzero(self.next >= 0)  # whose next member is another than before

    @staticmethod
    def _room(x: np.ndarray) -> np.ndarray:
        return np.append(x, np.zeros(len(x) + 1024, np.int64))

    def refine(self) -> None:
        """From factors of one length to those of the next."""
        taken = self.small[self.small > 0]
        taken = taken[self.cls[taken - 1] >= 0]
        by = self.cls[taken]
        taken = taken - 1
        if not len(taken):
            self.small = self.changed = taken
            return
        own = self.cls[taken]
        order = np.lexsort((taken, by, own))
        taken, by, own = taken[order], by[order], own[order]
        self._unlink(taken[np.lexsort((taken, own))])
        # where each class's taken members begin, and where each new group's
        a_start = np.flatnonzero(np.diff(own, prepend=-2))
        a, a_size = own[a_start], np.diff(np.append(a_start, len(own)))
        front = self._to_front(taken, a, a_size)
        g_new = np.diff(own, prepend=-2) != 0
        g_new |= np.diff(by, prepend=-2) != 0
        g_start = np.flatnonzero(g_new)
        g_size = np.diff(np.append(g_start, len(own)))
        g_live = (by[g_start] >= 0) & (g_size >= LEAST_CLASS)
        self._name(taken, front, g_start, g_size, g_live)
        rest = self.end[a] - self.first[a]
        lost = rest < LEAST_CLASS  # what remains of a class is too small
        self.cls[self.elems[stretches(self.first[a[lost]], rest[lost])]] = -1
        # all but one largest part of a class split the next length; parts without a class split it, too
        owner = np.repeat(np.arange(len(a)), np.diff(np.append(np.searchsorted(g_start, a_start), len(g_start))))
        size = np.where(g_live, g_size, 0)
        largest = np.zeros(len(a), np.int64)
        np.maximum.at(largest, owner, size)
        beaten = largest > np.where(lost, 0, rest)
        best = beaten[owner] & (size == largest[owner]) & g_live
        best[np.flatnonzero(best)[1:][np.diff(owner[best]) == 0]] = False
        use = np.repeat(~best, g_size)
        others = (beaten | lost) & (rest > 0)
        self.small = np.concatenate([taken[use], self.elems[stretches(self.first[a[others]], rest[others])]])

    def _unlink(self, gone: np.ndarray) -> None:
        """Members by class and place: the member before each chain of them is linked with the one after it."""
        before, after = self.prev[gone], self.next[gone]
        starts, ends = np.ones(len(gone), bool), np.ones(len(gone), bool)
        starts[1:] = before[1:] != gone[:-1]
        ends[:-1] = after[:-1] != gone[1:]
        p, n = before[starts], after[ends]
        has = p >= 0
        self.next[p[has]] = n[has]
        self.prev[n[n >= 0]] = p[n >= 0]
        self.changed = p[has & (n >= 0)]

    def _to_front(self, taken: np.ndarray, a: np.ndarray, a_size: np.ndarray) -> np.ndarray:
        """Puts the taken members at the front of their classes' stretches, in their order, and the stretches begin after them. The places."""
        self.mark[taken] = True
        front = stretches(self.first[a], a_size)
        at_front = self.elems[front]
        holes = front[~self.mark[at_front]]
        behind = self.loc[taken] >= np.repeat(self.first[a] + a_size, a_size)
        places, stay = self.loc[taken[behind]], self.elems[holes]
        self.elems[places], self.loc[stay] = stay, places
        self.elems[front], self.loc[taken] = taken, front
        self.first[a] += a_size
        self.mark[taken] = False
        return front

    def _name(self, taken: np.ndarray, front: np.ndarray, g_start: np.ndarray, g_size: np.ndarray, g_live: np.ndarray) -> None:
        """New classes of the groups that live, linked in the order of the text."""
        many = int(g_live.sum())
        while self.classes + many > len(self.first):
            self.first, self.end = self._room(self.first), self._room(self.end)
        names = np.full(len(g_start), -1)
        names[g_live] = self.classes + np.arange(many)
        self.first[names[g_live]], self.end[names[g_live]] = front[g_start[g_live]], front[g_start[g_live]] + g_size[g_live]
        self.classes += many
        name = np.repeat(names, g_size)
        self.cls[taken], self.next[taken], self.prev[taken] = name, -1, -1
        same = np.flatnonzero((name[1:] == name[:-1]) & (name[1:] >= 0))
        self.next[taken[same]], self.prev[taken[same + 1]] = taken[same + 1], taken[same]
        self.changed = np.concatenate([self.changed, taken[same]])


def find_runs(words: np.ndarray, ends: np.ndarray, cfg: Runs = Runs()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and smallest periods of all runs, by start and period. words: numbers of all texts' words, with a place after each text whose number is found nowhere
    else; ends: those places."""
    found = []
    begins = np.append(0, ends[:-1] + 1)
    longest = int((ends - begins).max(initial=0)) // cfg.repeats
    part = Partition(words)
    q, upto, later, waiting = 1, 0, np.empty(0, np.int64), {}
    while q <= longest:
        if q > upto:  # gaps of the next octave are looked up once; those that come later are kept by gap
            upto = 2 * q - 1
            at = np.flatnonzero((part.next >= 0) & (part.cls >= 0))
            gap = part.next[at] - at
            at = at[(gap >= q) & (gap <= upto)]
            gap = part.next[at] - at
            order = np.argsort(gap, kind="stable")
            later, later_gap, waiting = at[order], gap[order], {}
        else:
            gap = part.next[part.changed] - part.changed
            near = (gap >= q) & (gap <= upto)
            some, gap = part.changed[near], gap[near]
            if len(some):
                order = np.argsort(gap, kind="stable")
                some, gap = some[order], gap[order]
                for x in np.split(some, np.flatnonzero(np.diff(gap)) + 1):
                    waiting.setdefault(int(part.next[x[0]] - x[0]), []).append(x)
        lo, hi = np.searchsorted(later_gap, (q, q + 1))
        squares = np.concatenate([later[lo:hi], *waiting.pop(q, [])])
        if len(squares):
            squares = np.unique(squares)
            squares = squares[(part.cls[squares] >= 0) & (part.next[squares] - squares == q)]
            first = np.flatnonzero(np.diff(squares, prepend=-2) != 1)
            length = np.diff(np.append(first, len(squares))) + 2 * q - 1
            ok = length >= max(cfg.least, cfg.repeats * q)
            found.append((squares[first[ok]], length[ok], np.full(int(ok.sum()), q)))
        part.refine()
        if not len(part.small):
            break
        q += 1
    if not found:
        return (np.empty(0, np.int64),) * 3
    start, length, period = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def of_texts(docs: list[list[bytes]], cfg: Runs) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The runs of each text, with starts in its own words."""
    number: dict[bytes, int] = {}
    sizes = np.array([len(d) for d in docs])
    ends = np.cumsum(sizes + 1) - 1
    flat = np.empty(int(ends[-1]) + 1, np.int64)
    for d, words, end in zip(range(len(docs)), docs, ends):
        flat[end - len(words) : end] = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
        flat[end] = -1 - d
    text = np.repeat(np.arange(len(docs)), sizes + 1)
    # one word in two texts is two
    key = np.where(flat < 0, flat, flat * len(docs) + text)
    start, length, period = find_runs(key, ends, cfg)
    at = np.searchsorted(start, np.append(ends - sizes, ends[-1] + 1))
    for d in range(len(docs)):
        a, b = at[d], at[d + 1]
        yield start[a:b] - (ends[d] - sizes[d]), length[a:b], period[a:b]


def best_of(start: np.ndarray, length: np.ndarray, period: np.ndarray) -> int:
    """Of the runs, by start and period, the first of the greatest length / period, exactly."""
    best = 0
    for k in np.flatnonzero(length / period >= (length / period).max() * (1 - 1e-9)).tolist():
        if int(length[k]) * int(period[best]) > int(length[best]) * int(period[k]):
            best = k
    return best


def row_of(words: list[bytes], runs: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple:
    """n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256."""
    start, length, period = runs
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in zip(start.tolist(), length.tolist(), period.tolist()))
    best = (None,) * 4
    if len(start):
        k = best_of(start, length, period)
        best = (int(start[k]), int(length[k]), int(period[k]), 1000 * int(length[k]) // int(period[k]))
        edge = np.zeros(len(words) + 1, np.int64)
        np.add.at(edge, start + period, 1)
        np.add.at(edge, start + length, -1)
        stay = np.cumsum(edge[:-1]) == 0
        words = [words[i] for i in np.flatnonzero(stay).tolist()]
    return (len(start), *best, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(words)).hexdigest())


COLUMNS = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
TYPES = (*(pa.int64(),) * 5, pa.string(), pa.string())


def detect(docs: DataFrame, cfg: Runs = Runs(), rewrite: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """doc_id, n_runs, the best run (start, length, period, exponent_milli), runs_sha256 (of every run's ``start,length,period`` and a newline), and collapsed_sha256 (of the words
    that are in no run after its first period, joined by one space). ``rewrite`` may change a text's words before they are looked at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held(None)
        ids, texts, size = [], [], 0

        def flush() -> pa.RecordBatch:
            rows = list(zip(*(row_of(words, runs) for words, runs in zip(texts, of_texts(texts, cfg)))))
            return pa.record_batch({"doc_id": pa.array(ids, pa.int64())} | {c: pa.array(v, t) for c, v, t in zip(COLUMNS, rows, TYPES)})

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), raw_texts(batch)):
                words = text.split()
                ids.append(doc_id)
                texts.append(rewrite(doc_id, words) if rewrite else words)
                size += len(words)
                if size >= cfg.at_once:
                    yield flush()
                    ids, texts, size = [], [], 0
        if ids:
            yield flush()

    return doc_rows(docs).mapInArrow(run, SCHEMA)


def collapse(docs: DataFrame, cfg: Runs = Runs()) -> DataFrame:
    """doc_id, runs (start, length, period), text: the words that no run repeats, joined by one space; texts without a run, null ones too, as they are."""
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held(None)
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                words = next(iter(raw_texts(one))).split()
                start, length, period = next(of_texts([words], cfg))
                text = one.column("text")
                if len(start):
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, start + period, 1)
                    np.add.at(edge, start + length, -1)
                    stay = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
                    text = pa.array([b" ".join(words[i] for i in stay.tolist()).decode()], pa.string())
                runs = [{"start": s, "length": n, "period": q} for s, n, q in zip(start.tolist(), length.tolist(), period.tolist())]
                yield pa.record_batch({"doc_id": one.column("doc_id"), "runs": pa.array([runs], pa.list_(run_type)), "text": text})

    return doc_rows(docs).mapInArrow(run, "doc_id long, runs array<struct<start:long,length:long,period:long>>, text string")
