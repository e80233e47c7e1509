"""Benchmark decontamination with a generalised suffix automaton.

The automaton holds the words of all items of a block. Training words are streamed through it; the state and the length
of the longest match that ends at each word are tracked. A match of ``window`` words or more covers its last ``window`` words, and
the state tells the items; items with fewer words count where they occur whole. Words are the lower-cased (A-Z)
runs of ASCII letters, digits and non-ASCII characters. Stretches that can't hold a match, because two neighbouring words are
neighbours in no item, are skipped.

The benchmark is a query set: it is read in blocks of at most ``block_chars`` characters (and one item), one automaton
at a time, against all documents.

Defined results. Null texts have no words. Items without words are ignored; items with a null id mark words but aren't listed; a repeated
item_id is one item. Repeated documents give a row each. Empty tables give no hits, or no rows. Very long texts are scanned whole. Spans that touch are one span, so ties can't be.
Other columns, whatever their names, are ignored by find_leaks and kept by decontaminate.
"""

from __future__ import annotations

import re
import uuid
from array import array
from bisect import bisect_left
from collections.abc import Iterable
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import cut, doc_rows, held, map_rows, raw_texts

WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
#: Bytes to what splitting sees: words in lower case, all else a space.
PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


@dataclass(frozen=True)
class Leaks:
    """window: words. max_coverage: documents of which a larger share of the words is hit are dropped; from others the spans are
    removed, those shorter than min_span words excepted."""

    window: int = 10
    max_coverage: float = 0.5
    min_span: int = 1
    block_chars: int = 1_000_000


def words_of(text: bytes) -> list[bytes]:
    return text.translate(PLAIN).split()


class SuffixAutomaton:
    """Of several word sequences. It is built with a dict of edges for each state, and then held as one sorted array of (state, word) keys with the states that they lead to, arrays of
    links and lengths, and item sets of those states alone that have any."""

    def __init__(self, items: Iterable[tuple[str | None, bytes]], window: int):
        self.window, self.ids, seqs = window, {}, []
        self.edges: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        for name, text in items:
            seq = [self.ids.setdefault(w, len(self.ids)) for w in words_of(text)]
            if seq:
                seqs.append((name, seq))
                self._add(seq)
        n, wide = len(self.len), max(1, len(self.ids))
        self.shortest = min((min(window, len(s)) for _, s in seqs), default=window)
        # keys grow with the state, so only a state's own edges need sorting
        self.keys = array("q", (v * wide + c for v, own in enumerate(self.edges) for c in sorted(own)))
        self.to = array("i", (own[c] for own in self.edges for c in sorted(own)))
        del self.edges
        self.link, self.len = array("i", self.link), array("i", self.len)
        self.windows: dict[int, set] = {}  # items that have the window-long suffix of a state's strings
        self.whole: dict[int, dict[int, set]] = {}  # short items that end a state's strings, by length
        order = sorted(range(1, n), key=self.len.__getitem__)
        #: of a state whose strings reach the window, the state of their window-long suffix: found once, from the links' end
        self.of_window = array("i", bytes(4 * n))
        for v in order:
            if self.len[v] >= window:
                self.of_window[v] = v if self.len[self.link[v]] < window else self.of_window[self.link[v]]
        for name, seq in seqs:
            least, state, length = min(window, len(seq)), 0, 0
            for w in seq:
                state, length = self.step(state, length, w)
                if length >= least:
                    at = self.of_window[state] if least == window else state  # a short item is whole here, so the state is its own
                    (self.windows.setdefault(at, set()) if least == window else self.whole.setdefault(at, {}).setdefault(least, set())).add(name)
        same: dict[frozenset, frozenset] = {}  # an item's windows share one set
        self.windows = {v: same.setdefault(x, x) for v, names in self.windows.items() if (x := frozenset(names))}
        self.next_short = array("i", bytes(4 * n))  # the nearest state on the way to the root, itself included, that ends a short item
        for v in order:
            self.next_short[v] = v if v in self.whole else self.next_short[self.link[v]]
        self.pairs = np.unique(np.array([a * len(self.ids) + b for _, s in seqs for a, b in zip(s, s[1:])], np.int64))

    def _add(self, seq: list[int]) -> None:
        last = 0
        for c in seq:
            if c in self.edges[last]:
                q = self.edges[last][c]
                last = q if self.len[q] == self.len[last] + 1 else self._split(last, q, c)
                continue
            new = self._state(self.len[last] + 1, {})
            p = last
            while p >= 0 and c not in self.edges[p]:
                self.edges[p][c] = new
                p = self.link[p]
            if p >= 0:
                q = self.edges[p][c]
                self.link[new] = q if self.len[q] == self.len[p] + 1 else self._split(p, q, c)
            last = new

    def _state(self, length: int, edges: dict[int, int], link: int = 0) -> int:
        self.len.append(length)
        self.edges.append(edges)
        self.link.append(link)
        return len(self.len) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        copy = self._state(self.len[p] + 1, dict(self.edges[q]), self.link[q])
        while p >= 0 and self.edges[p].get(c) == q:
            self.edges[p][c] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def step(self, state: int, length: int, word: int) -> tuple[int, int]:
        """The longest suffix of what was matched, with the word, that is in an item."""
        keys, wide = self.keys, max(1, len(self.ids))
        while (at := bisect_left(keys, state * wide + word)) == len(keys) or keys[at] != state * wide + word:
            state = self.link[state]
            if state < 0:
                return 0, 0
            length = self.len[state]
        return self.to[at], length + 1

    def candidates(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """Stretches of words that are neighbours in an item, long enough for a match."""
        good = ids >= 0
        if self.shortest > 1:
            pair = good[:-1] & good[1:]
            at = np.flatnonzero(pair)
            key = ids[at] * len(self.ids) + ids[at + 1]
            found = np.searchsorted(self.pairs, key)
            pair[at] = self.pairs[np.minimum(found, len(self.pairs) - 1)] == key if len(self.pairs) else False
            edge = np.diff(np.concatenate([[0], pair.view(np.int8), [0]]))
            starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + 1
        else:
            edge = np.diff(np.concatenate([[0], good.view(np.int8), [0]]))
            starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        long = ends - starts >= self.shortest
        return list(zip(starts[long].tolist(), ends[long].tolist()))

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set, int]:
        """Merged hit spans in words (end exclusive), items, longest match."""
        spans: list[tuple[int, int]] = []
        items: set = set()
        longest = 0
        if len(words) < self.shortest or not self.ids:
            return spans, items, longest
        ids = np.fromiter(map(self.ids.get, words, repeat(-1)), np.int64, len(words))
        for start, end in self.candidates(ids):
            state = length = 0
            for i in range(start, end):
                state, length = self.step(state, length, int(ids[i]))
                longest, most = max(longest, length), 0
                if length >= self.window:
                    found = self.windows.get(self.of_window[state], ())
                    items.update(found)
                    most = self.window if found else 0
                at = self.next_short[state]
                while at:
                    for k, names in self.whole[at].items():
                        if k <= length:
                            items |= names
                            most = max(most, k)
                    at = self.next_short[self.link[at]]
                if most:
                    lo = i + 1 - most
                    while spans and spans[-1][1] >= lo:
                        lo = min(lo, spans.pop()[0])
                    spans.append((lo, i + 1))
        return spans, items, longest


def automaton(shared, window: int) -> SuffixAutomaton:
    """Built once in a worker for each block; only the latest is kept."""
    name, items = shared.value
    return held(("automaton", name, window), lambda: SuffixAutomaton(items, window))


def blocks(benchmark: DataFrame, cfg: Leaks) -> list[list[tuple[str | None, bytes]]]:
    """The items, dealt by hash; each block is read to the driver alone."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-size // cfg.block_chars))
    for k in range(n):
        part = items if n == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield [(r.item_id, r.text.encode()) for r in part.collect()]


def find_leaks(docs: DataFrame, benchmark: DataFrame, cfg: Leaks = Leaks()) -> DataFrame:
    """doc_id, text, n_words, spans (merged, in words), items, longest."""
    schema = "doc_id long, text string, n_words long, spans array<struct<start:int,end:int>>, items array<string>, longest int"
    out = doc_rows(docs)
    for k, block in enumerate(blocks(benchmark, cfg)):
        out = scan_block(cut(out) if k else out, block, cfg, schema, k > 0)
    return out


def scan_block(docs: DataFrame, block: list[tuple[str | None, bytes]], cfg: Leaks, schema: str, again: bool) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, block))

    def start():
        found = automaton(shared, cfg.window)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            n, spans, items, longest = [], [], [], []
            for i, text in enumerate(raw_texts(batch)):
                words = words_of(text)
                s, names, most = found.scan(words)
                names = {x for x in names if x is not None}
                if again:
                    names.update(batch.column("items")[i].as_py())
                    s = merge(s + [(x["start"], x["end"]) for x in batch.column("spans")[i].as_py()])
                    most = max(most, batch.column("longest")[i].as_py())
                n.append(len(words))
                spans.append([{"start": a, "end": b} for a, b in s])
                items.append(sorted(names))
                longest.append(most)
            return pa.record_batch({"doc_id": batch.column("doc_id"), "text": batch.column("text"), "n_words": pa.array(n, pa.int64()), "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), "items": pa.array(items, pa.list_(pa.string())), "longest": pa.array(longest, pa.int32())})

        return step

    return map_rows(docs, start, schema)


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the spans, and what stands between them."""
    at = [m.span() for m in WORD.finditer(text)]
    out, pos = [], 0
    for a, b in spans:
        out.append(text[pos : at[a][0]])
        pos = at[b - 1][1]
    return b"".join([*out, text[pos:]])


def decontaminate(docs: DataFrame, benchmark: DataFrame, cfg: Leaks = Leaks()) -> DataFrame:
    """The documents, in their own columns, without leaked spans; those over the coverage limit are dropped. The limit is on
    the spans of all blocks together, over the words of the document as it came. What a removal brings together is looked at
    again, by all blocks."""
    todo = blocks(benchmark, cfg)
    block = next(todo)
    after = next(todo, None)
    if after is None:
        return one_block(docs, block, cfg)
    # the own columns, and what is known of a row: spans of this round, words as it came, words gone, whether it is to be looked at again
    names = docs.columns
    know = F.struct(F.lit(None).cast("array<struct<start:int,end:int>>").alias("spans"), F.lit(None).cast("long").alias("whole"), F.lit(0).cast("long").alias("gone"), F.lit(True).alias("open"))
    state = "__" + uuid.uuid4().hex
    left, done = docs.withColumn(state, know), None
    while True:
        for part in chain([block, after], todo) if done is None else blocks(benchmark, cfg):
            left = cut(mark(left, part, cfg, state))
        turned = cut(remove_marked(left, cfg, state))
        over = turned.filter(~F.col(f"{state}.open")).select(*names)
        done = over if done is None else done.unionByName(over)
        left = turned.filter(f"{state}.open")
        if left.isEmpty():
            return done


def mark(docs: DataFrame, block: list[tuple[str | None, bytes]], cfg: Leaks, state: str) -> DataFrame:
    """The rows with the block's spans merged into those of this round."""
    shared = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, block))

    def run(batches):
        found = automaton(shared, cfg.window)
        for batch in batches:
            known = batch.column(state).to_pylist()
            for text, row in zip(raw_texts(batch), known, strict=True):
                spans = found.scan(words_of(text))[0]
                row["spans"] = [{"start": a, "end": b} for a, b in merge(spans + [(x["start"], x["end"]) for x in row["spans"] or []])]
            at = batch.schema.get_field_index(state)
            yield batch.set_column(at, batch.schema.field(at), pa.array(known, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


def remove_marked(docs: DataFrame, cfg: Leaks, state: str) -> DataFrame:
    """Ends a round: the rows that stay within the limit, without their spans; those that had any are open."""

    def run(batches):
        for batch in batches:
            keep, new, known = [], [], []
            place, at = batch.schema.get_field_index("text"), batch.schema.get_field_index(state)
            for i, (text, row) in enumerate(zip(raw_texts(batch), batch.column(at).to_pylist(), strict=True)):
                spans = [(x["start"], x["end"]) for x in row["spans"] if x["end"] - x["start"] >= cfg.min_span]
                whole = len(words_of(text)) if row["whole"] is None else row["whole"]
                gone = row["gone"] + sum(b - a for a, b in spans)
                if gone <= cfg.max_coverage * whole:
                    keep.append(i)
                    new.append(without(text, spans).decode() if spans else batch.column(place)[i].as_py())
                    known.append({"spans": None, "whole": whole, "gone": gone, "open": bool(spans)})
            if keep:
                kept = batch.take(pa.array(keep))
                for k, values in ((place, new), (at, known)):
                    kept = kept.set_column(k, kept.schema.field(k), pa.array(values, kept.schema.field(k).type))
                yield kept

    return docs.mapInArrow(run, docs.schema)


def one_block(docs: DataFrame, block: list[tuple[str | None, bytes]], cfg: Leaks) -> DataFrame:
    """All rounds of a row where it stands."""
    names = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, block))

    def run(batches):
        found = automaton(shared, cfg.window)
        for batch in batches:
            at, keep, new = names.index("text"), [], []
            for i, text in enumerate(raw_texts(batch)):
                whole = len(words := words_of(text))
                gone, changed = 0, False
                while spans := [(a, b) for a, b in found.scan(words)[0] if b - a >= cfg.min_span]:
                    gone += sum(b - a for a, b in spans)
                    if gone > cfg.max_coverage * whole:
                        break
                    text, changed = without(text, spans), True
                    words = words_of(text)
                if gone <= cfg.max_coverage * whole:
                    keep.append(i)
                    new.append(text.decode() if changed else batch.column(at)[i].as_py())
            if keep:
                kept = batch.take(pa.array(keep))
                yield kept.set_column(at, kept.schema.field(at), pa.array(new, kept.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)
