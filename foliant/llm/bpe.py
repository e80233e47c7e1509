"""Byte-pair encoding as a bounded-lookahead streaming transducer, and its incremental decoder.

The merge list fixes how far to the right a symbol can matter. Going through the rules in order of rank, M[t] is the reach beyond a
token t of the rules so far that have t on their left, and F[t] the reach beyond t that its own making needs:

    rule (t, c) -> u:   F[u] = max(M[c], F[c]);   M[t] = max(M[t], len(c) + max(M[c], F[c]))

The sufficient lookahead is the largest len(t) + max(M[t], F[t]). The transducer (``Window``) takes symbols and gives out every
token that ends at least that far before the last symbol, and all of them when the word is over; it never holds more than twice the lookahead. ``Transducer``
feeds it from text that comes in portions of any size: it holds what normalisation, the split pattern and the strings of added tokens may still
need, and the symbols of an unfinished word.

Texts are read in portions of ``PORTION`` bytes that end at white space, as no token crosses that. Most words are short and come again and again: what the transducer gives for a word is kept in
a bounded memo, and the new words of a portion go through it side by side (``Merges.side_by_side``: one window each, one merge in each at a time). Stretches without white space that are longer than a
portion are streamed. So memory doesn't grow with the length of a text, but for the ids where the caller asks for them.

The ids are those of the tokenizer's own library: NFC, white space, lower case (character by character), the split
pattern, byte-level symbols, word-end suffix; the strings of added tokens are found first. Decoding joins tokens with a space, as these
vocabularies have no decoder; ``mode="bytes"`` gives the bytes' text instead, character by character as it is complete.

Defined results. Null texts are empty: no ids, empty decoded text. Very long texts, and very long words, are streamed whole. Repeated rows give a row each; an empty table none. Equal ranks can't be: of two
places of one rule the left one is merged first. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from foliant.llm.common import doc_rows, held, portions, raw_texts

#: Unicode white space.
SPACES = "\t\n\x0b\x0c\r \x85\xa0  -     　"
#: Texts of these need no composition.
PLAIN = re.compile("[\x00-˿]*\\Z")
CACHE = 300_000
#: Longer chunks aren't kept in the cache.
LONGEST = 64
#: Words up to so many bytes go through their windows side by side; at most the lookahead.
SHORT = 24
#: Bytes of a text that are read at once.
PORTION = 1 << 18
#: Bytes of texts whose ids a worker holds and hands on together.
TOGETHER = 2 << 20
WHITE = b" \t\n\r\x0b\x0c"
NO_RULE = 1 << 60
SLOTS = 1 << 18


def slot(key: np.ndarray) -> np.ndarray:
    return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(46)).astype(np.int64)


def byte_symbols() -> list[str]:
    """The character for each byte: printable Latin-1 stands for itself, the rest take the code points from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(other)) for b in range(256)]


class Merges:
    """Symbols, merges and the lookahead of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = [""] * (1 + max([*self.vocab.values(), *self.added.values()]))
        for name, i in [*self.vocab.items(), *self.added.items()]:
            self.names[i] = name
        suffix = model["end_of_word_suffix"] or ""
        self.suffix = suffix
        chars = byte_symbols()
        self.inner = [self.vocab[c] for c in chars]
        self.final = [self.vocab[c + suffix] for c in chars]
        self.rules: dict[int, int] = {}  # pair to rank and new id, packed
        size: dict[int, int] = dict.fromkeys([*self.inner, *self.final], 1)
        reach: dict[int, int] = {}
        made: dict[int, int] = {}
        for rank, (left, right) in enumerate(model["merges"]):
            a, b = self.vocab[left], self.vocab[right]
            new = self.vocab[left + right]
            self.rules.setdefault(a << 20 | b, rank << 20 | new)
            size[new] = size[a] + size[b]
            far = max(reach.get(b, 0), made.get(b, 0))
            made[new] = max(made.get(new, 0), far)
            reach[a] = max(reach.get(a, 0), size[b] + far)
        self.lookahead = max(size[t] + max(reach.get(t, 0), made.get(t, 0)) for t in size)
        self.size = size
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        self.split = regex.compile(split.replace(r"[^\s", f"[^{SPACES}"))
        self.lines = regex.compile(self.split.pattern + "|\n")
        self.pieces = Pieces(self)
        self.slots: np.ndarray | None = None
        self.special = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None

    def merge(self, symbols: list[int]) -> list[int]:
        """All merges of a short list, lowest rank first, leftmost of equals."""
        rules = self.rules
        if len(symbols) > 24:
            return self.merge_long(symbols)
        none = 1 << 60
        get = rules.get
        ranks = [get(a << 20 | b, none) for a, b in pairwise(symbols)]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            i, new = ranks.index(best), best & 0xFFFFF
            symbols[i] = new
            del symbols[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(symbols[i - 1] << 20 | new, none)
            if i < len(ranks):
                ranks[i] = get(new << 20 | symbols[i + 1], none)
        return symbols

    def merge_long(self, symbols: list[int]) -> list[int]:
        """The same with a heap."""
        rules, n = self.rules, len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (r := rules.get(symbols[i] << 20 | symbols[i + 1]))]
        heapq.heapify(heap)
        while heap:
            rule, i, a, b = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != a or j >= n or symbols[j] != b:
                continue
            new = rule & 0xFFFFF
            symbols[i], symbols[j] = new, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if r := rules.get(new << 20 | symbols[k]):
                    heapq.heappush(heap, (r, i, new, symbols[k]))
            if (p := before[i]) >= 0 and (r := rules.get(symbols[p] << 20 | new)):
                heapq.heappush(heap, (r, p, symbols[p], new))
        return [s for s in symbols if s >= 0]

    def side_by_side(self, pieces: list[bytes]) -> list[list[int]]:
        """The tokens of many short words, each in a window of its own that its end empties: every round does one merge in every window that has one left."""
        n, sizes = len(pieces), np.fromiter(map(len, pieces), np.int64, len(pieces))
        wide = int(sizes.max())
        row, col = np.repeat(np.arange(n), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        flat = np.frombuffer(b"".join(pieces), np.uint8)
        symbols = np.full((n, wide), -1, np.int64)
        symbols[row, col] = np.array(self.inner)[flat]
        symbols[np.arange(n), sizes - 1] = np.array(self.final)[flat[np.cumsum(sizes) - 1]]
        out, who = symbols.copy(), np.arange(n)
        ranks = self.lookup(symbols[:, :-1], symbols[:, 1:])
        while len(who) and ranks.shape[1]:
            at = ranks.argmin(1)
            best = ranks[np.arange(len(at)), at]
            live = best < NO_RULE
            if not live.all():
                out[who[~live], : symbols.shape[1]] = symbols[~live]
                out[who[~live], symbols.shape[1] :] = -1
                who, symbols, ranks, at, best = who[live], symbols[live], ranks[live], at[live], best[live]
                if not len(who):
                    break
            r, new = np.arange(len(who)), best & 0xFFFFF
            symbols[r, at] = new
            places = np.arange(symbols.shape[1] - 1)
            symbols = np.take_along_axis(symbols, places + (places > at[:, None]), 1)
            places = np.arange(ranks.shape[1] - 1)
            ranks = np.take_along_axis(ranks, places + (places >= at[:, None]), 1)
            left = at > 0
            ranks[r[left], at[left] - 1] = self.lookup(symbols[r[left], at[left] - 1], new[left])
            right = at < ranks.shape[1]
            ranks[r[right], at[right]] = self.lookup(new[right], symbols[r[right], at[right] + 1])
        if len(who):
            out[who, : symbols.shape[1]] = symbols
            out[who, symbols.shape[1] :] = -1
        ends = np.cumsum((out >= 0).sum(1)).tolist()
        ids = out[out >= 0].tolist()
        return [ids[a:b] for a, b in zip([0, *ends], ends)]

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Packed rank and new id of pairs; NO_RULE where there is none. An open-addressing table that numpy probes."""
        if self.slots is None:
            keys, values = np.fromiter(self.rules.keys(), np.int64, len(self.rules)), np.fromiter(self.rules.values(), np.int64, len(self.rules))
            self.slots, self.found = np.full(SLOTS, -1, np.int64), np.full(SLOTS, NO_RULE, np.int64)
            at = slot(keys)
            self.probes = 0
            while len(keys):
                self.probes += 1
                free = self.slots[at] < 0
                self.slots[at[free]] = keys[free]
                mine = self.slots[at] == keys
                self.found[at[mine]] = values[mine]
                keys, values, at = keys[~mine], values[~mine], (at[~mine] + 1) % SLOTS
        key = left << 20 | right
        at = slot(key)
        got = self.slots[at]
        out = np.where(got == key, self.found[at], NO_RULE)
        miss = np.nonzero((got != key) & (got >= 0) & (left >= 0) & (right >= 0))
        for _ in range(1, self.probes):
            if not len(miss[0]):
                break
            at[miss] = (at[miss] + 1) % SLOTS
            got = self.slots[at[miss]]
            hit = got == key[miss]
            out[tuple(m[hit] for m in miss)] = self.found[at[miss]][hit]
            miss = tuple(m[~hit & (got >= 0)] for m in miss)
        return out

    def transduce(self, symbols: Iterable[int]) -> Iterator[int]:
        """Tokens of one word, each given out once no further symbol can change it."""
        window = Window(self)
        yield from window.push(symbols)
        yield from window.end()

    def word(self, piece: bytes) -> Iterator[int]:
        symbols = [self.inner[b] for b in piece]
        symbols[-1] = self.final[piece[-1]]
        return self.transduce(symbols)

    def pieces_of(self, text: str) -> list[str]:
        return self.split.findall(self.normal(text))

    def normal(self, text: str) -> str:
        return text.lower() if PLAIN.match(text) else "".join(c.lower() for c in unicodedata.normalize("NFC", text))


class Window:
    """The symbols of one word that later ones may still change, at most twice the lookahead."""

    def __init__(self, merges: Merges):
        self.merges, self.hold, self.most = merges, [], 2 * merges.lookahead

    def push(self, symbols: Iterable[int]) -> Iterator[int]:
        for s in symbols:
            self.hold.append(s)
            if len(self.hold) >= self.most:
                used = 0
                for token in self.merges.merge(list(self.hold)):
                    if used + self.merges.size[token] + self.merges.lookahead > len(self.hold):
                        break
                    used += self.merges.size[token]
                    yield token
                del self.hold[:used]

    def end(self) -> Iterator[int]:
        """The word is over."""
        out, self.hold = self.merges.merge(self.hold), []
        yield from out


#: An open word goes on with letters, or with what is neither space, letter nor digit.
LETTERS, OTHERS = regex.compile(r"\p{L}+"), regex.compile(rf"[^{SPACES}\p{{L}}\p{{N}}]+")


class Transducer:
    """Text in portions of any size to ids, each as soon as it is settled. Held between portions: raw text that an added token's string or the next
    character's composition may still need, the start of a word of up to ``LONGEST`` characters, and a window of symbols."""

    def __init__(self, merges: Merges):
        self.m, self.raw, self.text, self.window = merges, "", "", Window(merges)
        self.open: regex.Pattern | None = None  # what a long word that has begun goes on with
        self.last: int | None = None  # its last byte so far, which may be its end
        self.keep = max(map(len, merges.added), default=1) - 1

    def held(self) -> int:
        return len(self.raw) + len(self.text) + len(self.window.hold)

    def feed(self, text: str, over: bool = False) -> Iterator[int]:
        self.raw += text
        while self.m.special and (found := self.m.special.search(self.raw)):
            before, self.raw = self.raw[: found.start()], self.raw[found.end() :]
            yield from self._pieces(before, True)
            yield self.m.added[found[0]]
        end = len(self.raw) if over else max(0, len(self.raw) - self.keep)
        while not over and end and not starts_anew(self.raw[end : end + 1]):
            end -= 1
        ready, self.raw = self.raw[:end], self.raw[end:]
        yield from self._pieces(ready, over)

    def finish(self) -> Iterator[int]:
        return self.feed("", True)

    def _pieces(self, ready: str, over: bool) -> Iterator[int]:
        self.text += self.m.normal(ready)
        at = 0
        while at < len(self.text):
            if self.open:
                run = self.open.match(self.text, at)
                if run:
                    yield from self._more(run[0])
                    at = run.end()
                if at == len(self.text):
                    break
                yield from self._end()
            found = self.m.split.search(self.text, at)
            if not found:
                at = len(self.text)
            elif found.end() < len(self.text) or over:
                yield from self._more(found[0])
                yield from self._end()
                at = found.end()
            elif len(found[0]) > LONGEST:
                self.open = LETTERS if LETTERS.match(found[0][-1]) else OTHERS
                yield from self._more(found[0])
                at = found.end()
            else:
                at = found.start()
                break
        self.text = self.text[at:]
        if over and self.last is not None:
            yield from self._end()

    def _more(self, piece: str) -> Iterator[int]:
        data = piece.encode()
        before = [] if self.last is None else [self.m.inner[self.last]]
        self.last = data[-1]
        return self.window.push(before + [self.m.inner[b] for b in data[:-1]])

    def _end(self) -> Iterator[int]:
        yield from self.window.push([self.m.final[self.last]])
        self.open = self.last = None
        yield from self.window.end()


JOINING: set[str] = set()


def starts_anew(c: str) -> bool:
    """Whether no composition takes the character to what stands before it."""
    if c < "\u0300":
        return c != ""
    if not JOINING:
        pairs = (unicodedata.decomposition(chr(i)).split() for i in range(0x110000))
        JOINING.update(chr(int(p[1], 16)) for p in pairs if len(p) == 2 and not p[0].startswith("<"))
        JOINING.update(map(chr, [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)]))
    return not unicodedata.combining(c) and c not in JOINING


class Pieces(dict):
    """Words of up to LONGEST bytes to their ids, as the transducer gave them."""

    def __init__(self, merges: Merges):
        super().__init__()
        self.merges = merges

    def __missing__(self, piece: str) -> Iterable[int]:
        if len(self) >= CACHE:
            self.clear()
        self[piece] = ids = tuple(self.merges.word(piece.encode()))
        return ids


class Encoder(dict):
    """Chunks to their ids as little-endian bytes. Bounded: when full it becomes the old generation; long chunks aren't kept."""

    def __init__(self, merges: Merges):
        super().__init__()
        self.merges = merges
        self.old: dict[bytes, bytes] = {}

    def __missing__(self, chunk: bytes) -> bytes:
        if chunk in self.old:
            return self.old[chunk]
        text, m = chunk.decode(), self.merges
        if len(chunk) > LONGEST or "<|" in text:
            run = Transducer(m)
            return np.fromiter(chain(run.feed(text), run.finish()), "<u4").tobytes()
        ids = np.array([i for p in m.pieces_of(text) for i in m.pieces[p]], "<u4").tobytes()
        if len(self) >= CACHE:
            self.clear()
        self[chunk] = ids
        return ids

    def encode_all(self, texts: Iterable[bytes]) -> Iterator[Iterable[bytes]]:
        """For each text its ids in parts, to be taken before the next text's. The new words of about a megabyte of short texts go through the transducer together."""
        hold, size = [], 0
        for text in texts:
            if len(text) > PORTION or size > 1_000_000:
                yield from ((ids,) for ids in self._together(hold))
                hold, size = [], 0
            if len(text) > PORTION:
                yield self.streamed(text)
            else:
                hold.append(text)
                size += len(text)
        yield from ((ids,) for ids in self._together(hold))

    def streamed(self, text: bytes) -> Iterator[bytes]:
        """A long text's ids, portion by portion."""
        at = 0
        while at < len(text):
            end = len(text) if len(text) - at <= PORTION else max(text.rfind(c, at, at + PORTION) for c in (WHITE[i : i + 1] for i in range(len(WHITE)))) + 1
            if end > at:
                yield from self._together([text[at:end]])
                at = end
                continue
            # no white space in a portion: up to the next through the transducer
            ends = [p for c in (WHITE[i : i + 1] for i in range(len(WHITE))) if (p := text.find(c, at)) >= 0]
            end = min(ends, default=len(text))
            run, utf8 = Transducer(self.merges), codecs.getincrementaldecoder("utf-8")()
            for k in range(at, end, 1 << 14):
                yield np.fromiter(run.feed(utf8.decode(text[k : min(k + (1 << 14), end)])), "<u4").tobytes()
            yield np.fromiter(run.finish(), "<u4").tobytes()
            at = end

    def _together(self, texts: list[bytes]) -> Iterator[bytes]:
        split = [t.split() for t in texts]
        fresh = {c for chunks in split for c in chunks if c not in self and len(c) <= LONGEST}
        merges, pieces = self.merges, self.merges.pieces
        again = fresh & self.old.keys()
        plain = [c for c in fresh - again if b"<|" not in c]
        back = {c: self.old[c] for c in again}
        if len(self) + len(fresh) > CACHE:
            self.old = dict(self)
            self.clear()
        self.update(back)
        found = merges.lines.findall(merges.normal(b"\n".join(plain).decode())) if plain else []
        short = [(w, b) for w in set(found) if w not in pieces and len(b := w.encode()) <= SHORT and w != "\n"]
        if len(pieces) + len(short) > CACHE:
            pieces.clear()
            short = [(w, b) for w in set(found) if len(b := w.encode()) <= SHORT and w != "\n"]
        if short:
            pieces.update(zip([w for w, _ in short], merges.side_by_side([b for _, b in short])))
        flat: list[int] = []
        ends = [0]
        for w in found:
            if w == "\n":
                ends.append(4 * len(flat))
            else:
                flat += pieces[w]
        ends.append(4 * len(flat))
        ids = np.array(flat, "<u4").tobytes()
        self.update(zip(plain, [ids[a:b] for a, b in pairwise(ends)]))
        for chunks in split:
            yield b"".join(map(self.__getitem__, chunks))


class Decoder:
    """Takes ids in any portions and gives text as soon as it is settled."""

    def __init__(self, merges: Merges, mode: str = "joined"):
        self.merges, self.mode, self.begun = merges, mode, False
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")
        self.bytes = {c: b for b, c in enumerate(byte_symbols())}

    def feed(self, ids: list[int]) -> str:
        names = self.merges.names
        if self.mode == "joined":
            out = " ".join([names[i] for i in ids])
            lead = " " if self.begun and ids else ""
            self.begun |= bool(ids)
            return lead + out
        return "".join(map(self._one, ids))

    def _one(self, i: int) -> str:
        name, end = self.merges.names[i], self.merges.suffix
        if i in self.merges.added.values():
            return self.utf8.decode(b"", True) + name
        stop = bool(end) and name.endswith(end)
        text = self.utf8.decode(bytes(self.bytes[c] for c in (name[: -len(end)] if stop else name)))
        return text + " " if stop else text

    def finish(self) -> str:
        return self.utf8.decode(b"", True)


def loaded(path: str) -> Encoder:
    return held(("bpe", path), lambda: Encoder(Merges(path)))


def encode_documents(docs: DataFrame, path: str, ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit, binary; left out on request), ids_sha256, decoded_sha256."""
    schema = "doc_id long, n_tokens long, " + ("ids binary, " if ids else "") + "ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = loaded(path)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            n, raw, a, b = [], [], [], []
            for parts in encoder.encode_all(raw_texts(batch)):
                size, kept, own = 0, [], hashlib.sha256()
                decoder, out = Decoder(encoder.merges), hashlib.sha256()
                for part in parts:
                    size += len(part) // 4
                    own.update(part)
                    for at in range(0, len(part), 1 << 18):
                        out.update(decoder.feed(np.frombuffer(part[at : at + (1 << 18)], "<u4").tolist()).encode())
                    if ids:
                        kept.append(part)
                out.update(decoder.finish().encode())
                n.append(size)
                raw.append(b"".join(kept))
                a.append(own.hexdigest())
                b.append(out.hexdigest())
            columns = {"doc_id": batch.column("doc_id"), "n_tokens": pa.array(n, pa.int64())} | ({"ids": pa.array(raw, pa.binary())} if ids else {})
            return pa.record_batch(columns | {"ids_sha256": pa.array(a, pa.string()), "decoded_sha256": pa.array(b, pa.string())})

        for batch in batches:
            yield from map(step, portions(batch, TOGETHER))

    return doc_rows(docs).mapInArrow(run, schema)
