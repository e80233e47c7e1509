"""Toxicity: a bidirectional gated recurrent network with attention pooling over character and word inputs.

A word's input vector is its word embedding (zero for words in fewer than ``least_docs`` training texts) plus the sum of the embeddings of its hashed byte 3- to
6-grams, its ends counting as bytes, over the root of their number. Two gated recurrent layers read a window of words forward and backward; attention pools their
states to one logit. All windows of ``width`` words, ``stride`` words apart, are scored; a document's score is that of its worst window. Every stretch of
``width - stride + 1`` words stands whole in some window.

Training is in numpy on the driver, on at most ``sample`` labelled texts, half of them of either class at most, read one partition at a time as word numbers. All embeddings and
weights are learned together. First every window has its text's label; then, in rounds, the network itself picks the windows that it finds worst, of toxic and of clean
texts alike, and learns from these.

Defined results. Texts without words score 0. Without labels of both classes all score 0. Null doc_ids aren't held out. Repeated rows give a row each; an empty
table none. Windows that tie are taken in their order. Other columns are ignored. Whole texts are read, very long ones too; memory is bounded by groups of windows and the words of a text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import doc_rows, held, is_held_out, labelled_sample, map_rows, raw, raw_texts
from foliant.llm.decontaminate import words_of

CACHE = 100_000  # words whose gate inputs a worker keeps
AT_ONCE = 512  # windows


@dataclass(frozen=True)
class Recurrent:
    sample: int = 3_000
    width: int = 32
    stride: int = 16
    inputs: int = 12
    hidden: int = 8
    least_docs: int = 5
    char_bits: int = 14
    first_epochs: int = 1
    rounds: int = 3
    epochs: int = 3  # of a round
    least_steps: int = 30  # of the first pass and of a round
    hard: int = 3  # clean windows of a text in a round
    batch: int = 512
    rate: float = 0.01
    decay: float = 1e-5
    drop: float = 0.5  # share of words whose word embedding is left out in training
    seed: int = 7


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def grams(words: list[bytes], cfg: Recurrent) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte 3- to 6-grams of all words, by word, and where each word's start. A word of one byte has one gram."""
    b = np.frombuffer(b"\0" + b"\0".join(words) + b"\0", np.uint8)
    inside = b != 0
    word = np.cumsum(~inside) - 1
    h, whole = b.astype(np.uint64), np.ones(len(b), bool)
    code, owner = [], []
    with np.errstate(over="ignore"):
        for n in range(2, 7):
            if len(h) < 2:
                break
            h = h[:-1] * np.uint64(0x100000001B3) + b[n - 1 :]
            # no end of a word strictly inside the gram
            whole = whole[: len(h)] & (inside[n - 2 : n - 2 + len(h)] if n > 2 else True)
            if n >= 3:
                at = np.flatnonzero(whole)
                code.append((h[at] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - cfg.char_bits)).astype(np.int32))
                owner.append(word[at + 1])
    code, owner = np.concatenate(code), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return code[order], np.searchsorted(owner[order], np.arange(len(words)))


def grams_of(words: list[bytes], cfg: Recurrent, at_once: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """The same for many words, some at a time."""
    parts = [grams(words[k : k + at_once], cfg) for k in range(0, len(words), at_once)]
    before = np.cumsum([0, *(len(char) for char, _ in parts)])
    return np.concatenate([char for char, _ in parts]), np.concatenate([starts + n for (_, starts), n in zip(parts, before)])


def window_starts(n: int, cfg: Recurrent) -> np.ndarray:
    """Windows that cover n words; the last may reach beyond them."""
    return np.arange(0, max(n - cfg.width, 0) + cfg.stride, cfg.stride) if n > cfg.width else np.zeros(1, np.int64)


def sums(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Rows of values added up by place."""
    return np.stack([np.bincount(at, v, n) for v in values.T], 1).astype(values.dtype)


class Net:
    """Parameters, scoring and gradients. The two directions are stacked: the second reads windows from their end."""

    def __init__(self, cfg: Recurrent, words: list[bytes]):
        """words: those that have an embedding of their own; row 0 is for all others and stays zero."""
        self.cfg, self.row = cfg, {w: i + 1 for i, w in enumerate(words)}
        rng, d, h = np.random.default_rng(cfg.seed), cfg.inputs, cfg.hidden
        some = lambda *shape, s=0.3: (rng.standard_normal(shape) * s).astype(np.float32)
        self.p = {"word": np.zeros((len(words) + 1, d), np.float32), "char": some(1 << cfg.char_bits, d, s=0.02), "att": some(2 * h, s=0.5), "out": some(2 * h, s=0.5), "bias": np.zeros(1, np.float32)}
        self.p |= {"wx": some(2, d, 3 * h), "bx": np.zeros((2, 3 * h), np.float32), "u": some(2, h, 3 * h)}

    def vectors(self, char: np.ndarray, starts: np.ndarray, row: np.ndarray | None = None, use: np.ndarray | float = 1.0) -> np.ndarray:
        sizes = np.diff(np.append(starts, len(char)))[:, None]
        return np.add.reduceat(self.p["char"][char], starts) / np.sqrt(sizes, dtype=np.float32) + (0 if row is None else self.p["word"][row] * use)

    def project(self, x: np.ndarray) -> np.ndarray:
        """Words x inputs to words x directions x gates."""
        return (np.matmul(x[None], self.p["wx"]) + self.p["bx"][:, None]).transpose(1, 0, 2)

    def layer(self, gates: np.ndarray, mask: np.ndarray, keep: bool = False):
        """gates: steps x directions x windows x 3 hidden; mask: steps x directions x windows x 1. The states, and on request what training needs."""
        steps, _, n, k = gates.shape
        h, u = k // 3, self.p["u"]
        state, states, saved = np.zeros((2, n, h), gates.dtype), np.empty((steps, 2, n, h), gates.dtype), []
        for i in range(steps):
            zr = sigmoid(gates[i, :, :, : 2 * h] + state @ u[:, :, : 2 * h])
            z, r = zr[..., :h], zr[..., h:]
            new = np.tanh(gates[i, :, :, 2 * h :] + (r * state) @ u[:, :, 2 * h :])
            if keep:
                saved.append((state, z, r, new))
            state = state + mask[i] * (1 - z) * (new - state)
            states[i] = state
        return states, saved

    @staticmethod
    def turned(x: np.ndarray) -> np.ndarray:
        """steps x directions x ...: the second direction from the other end."""
        return np.stack([x[:, 0], x[::-1, 1]], 1)

    def pool(self, states: np.ndarray, mask: np.ndarray):
        """states in reading order: steps x directions x windows x hidden; mask: steps x windows."""
        h = self.cfg.hidden
        both = states.transpose(2, 0, 1, 3).reshape(states.shape[2], states.shape[0], 2 * h)
        m = mask.T
        s = np.where(m > 0, both @ self.p["att"], -1e9)
        e = np.exp(s - s.max(1, keepdims=True)) * (m > 0)
        a = e / np.maximum(e.sum(1, keepdims=True), 1e-9)
        pooled = (a[:, :, None] * both).sum(1)
        return both, a, pooled, pooled @ self.p["out"] + self.p["bias"][0]

    def steps(self, gates: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """windows x words x directions x gates, and mask, as the layers take them."""
        g = np.ascontiguousarray(gates.transpose(1, 2, 0, 3))
        m = np.ascontiguousarray(mask.T)
        return self.turned(g), np.stack([m, m[::-1]], 1)[..., None]

    def logits(self, gates: np.ndarray, mask: np.ndarray) -> np.ndarray:
        states, _ = self.layer(*self.steps(gates, mask))
        return self.pool(self.turned(states), mask.T)[3]

    def gradients(self, vocab, ids: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray, use: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Of the weighted cross-entropy. vocab: word rows, n-grams, where each word's start, and end; ids: windows x words in it; use: by window and word, 0 where the word's embedding is left out."""
        p, d, h = self.p, self.cfg.inputs, self.cfg.hidden
        row, char, starts, ends = vocab
        seen, at = np.unique(ids, return_inverse=True)
        at = at.reshape(ids.shape)
        sizes = ends[seen] - starts[seen]
        first = np.cumsum(sizes) - sizes
        own = char[np.repeat(starts[seen] - first, sizes) + np.arange(sizes.sum())]
        words = p["word"][row[seen]]
        x = self.vectors(own, first)[at] + words[at] * use[:, :, None]
        n, steps = ids.shape
        gates, m = self.steps(self.project(x.reshape(-1, d)).reshape(n, steps, 2, 3 * h), mask)
        states, saved = self.layer(gates, m, True)
        both, a, pooled, logit = self.pool(self.turned(states), mask.T)
        prob = sigmoid(logit)
        dl = ((prob - y) * weight).astype(x.dtype)
        loss = float(-(weight * np.log(np.where(y > 0, prob, 1 - prob) + 1e-9)).sum())
        g = {"bias": np.array([dl.sum()], x.dtype), "out": dl @ pooled}
        dpool = dl[:, None] * p["out"]
        da = np.einsum("nth,nh->nt", both, dpool)
        ds = a * (da - (a * da).sum(1, keepdims=True))
        g["att"] = np.einsum("nt,nth->h", ds, both)
        dboth = a[:, :, None] * dpool[:, None, :] + ds[:, :, None] * p["att"]
        part = self.turned(dboth.reshape(n, steps, 2, h).transpose(1, 2, 0, 3))
        u, du = p["u"], np.zeros_like(p["u"])
        dgates, carry = np.empty_like(gates), np.zeros((2, n, h), x.dtype)
        ut, uz = u[:, :, 2 * h :].transpose(0, 2, 1), u[:, :, : 2 * h].transpose(0, 2, 1)
        for i in range(steps - 1, -1, -1):
            state, z, r, new = saved[i]
            dh = carry + part[i]
            step = dh * m[i]
            dnew = step * (1 - z) * (1 - new * new)
            dz = -step * (new - state) * z * (1 - z)
            drs = dnew @ ut
            dzr = np.concatenate([dz, drs * state * r * (1 - r)], 2)
            dgates[i, :, :, : 2 * h], dgates[i, :, :, 2 * h :] = dzr, dnew
            du[:, :, 2 * h :] += (r * state).transpose(0, 2, 1) @ dnew
            du[:, :, : 2 * h] += state.transpose(0, 2, 1) @ dzr
            carry = dh * (1 - m[i] * (1 - z)) + drs * r + dzr @ uz
        flat = self.turned(dgates).transpose(1, 2, 0, 3).reshape(2, n * steps, 3 * h)  # directions, windows x words
        g |= {"u": du, "bx": flat.sum(1), "wx": x.reshape(-1, d).T[None] @ flat}
        dx = ((flat @ p["wx"].transpose(0, 2, 1)).sum(0).reshape(n, steps, d) * mask[:, :, None]).reshape(-1, d)
        each = sums(at.ravel(), dx, len(seen))
        g["word"] = sums(row[seen], sums(at.ravel(), dx * use.reshape(-1, 1), len(seen)), len(p["word"]))
        g["word"][0] = 0
        g["char"] = sums(own, np.repeat(each / np.sqrt(sizes, dtype=x.dtype)[:, None], sizes, 0), len(p["char"]))
        return loss, g


class Adam:
    def __init__(self, p: dict[str, np.ndarray], cfg: Recurrent):
        self.p, self.rate, self.t, self.decay = p, cfg.rate, 0, cfg.decay
        self.m, self.v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))

    def step(self, g: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, x in g.items():
            x = x + self.decay * self.p[k]
            self.m[k] += 0.1 * (x - self.m[k])
            self.v[k] += 0.01 * (x * x - self.v[k])
            self.p[k] -= self.rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.99**self.t)) + 1e-6)


@dataclass
class Texts:
    """Training texts as word numbers, with the words; a text is held as four bytes a word. Texts without words teach nothing."""

    number: dict[bytes, int] = field(default_factory=dict)
    docs: list[np.ndarray] = field(default_factory=list)
    labels: list[int] = field(default_factory=list)
    names: list[tuple[int, bytes]] = field(default_factory=list)

    def add(self, text: bytes, label: int, doc_id: int | None = None) -> None:
        words = words_of(text)
        if words:
            number = self.number
            self.docs.append(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int32, len(words)))
            self.labels.append(label)
            self.names.append((len(self.docs) if doc_id is None else doc_id, hashlib.sha256(text).digest()))

    def settled(self) -> Texts:
        """In an order of their own, however they came: texts by doc_id and digest, words by bytes."""
        words, order = sorted(self.number), sorted(range(len(self.docs)), key=self.names.__getitem__)
        place = np.empty(len(words), np.int32)
        place[np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))] = np.arange(len(words))
        return Texts({w: i for i, w in enumerate(words)}, [place[self.docs[i]] for i in order], [self.labels[i] for i in order], [self.names[i] for i in order])


def train(texts: Texts, cfg: Recurrent) -> Net | None:
    """None without texts of both classes."""
    texts = texts.settled()
    y = np.array(texts.labels, np.int64)
    if set(y.tolist()) != {0, 1}:
        return None
    rng, docs, words = np.random.default_rng(cfg.seed), texts.docs, list(texts.number)
    in_docs = np.zeros(len(words), np.int32)
    for d in docs:
        in_docs[np.unique(d)] += 1
    net = Net(cfg, [w for w, n in zip(words, in_docs, strict=True) if n >= cfg.least_docs])
    char, starts = grams_of(words, cfg)
    vocab = (np.array([net.row.get(w, 0) for w in words]), char, starts, np.append(starts[1:], len(char)))
    flat, sizes = np.concatenate(docs), np.array([len(d) for d in docs])
    ends = np.cumsum(sizes)
    begins = [window_starts(n, cfg) + end - n for n, end in zip(sizes, ends, strict=True)]
    owner, begin = np.repeat(np.arange(len(docs)), [len(b) for b in begins]), np.concatenate(begins)
    bounds = np.searchsorted(owner, np.arange(len(docs) + 1))

    def read(of: np.ndarray):
        """Words and mask of windows; only those asked for are made."""
        at, end = begin[of][:, None] + np.arange(cfg.width), ends[owner[of]][:, None]
        mask = at < end
        return flat[np.minimum(at, end - 1)], mask.astype(np.float32)

    def learn(chosen: np.ndarray, epochs: int) -> None:
        """Passes over windows in random order, both classes of the same weight; with few windows, smaller batches and more passes."""
        share = y[owner[chosen]].mean()
        many = -(-len(chosen) // min(cfg.batch, max(32, len(chosen) // 8)))
        for part in (part for _ in range(max(epochs, -(-cfg.least_steps // many))) for part in np.array_split(rng.permutation(chosen), many)):
            ids, mask = read(part)
            label = y[owner[part]].astype(np.float32)
            weight = np.where(label > 0, 0.5 / share, 0.5 / (1 - share)).astype(np.float32) / len(part)
            adam.step(net.gradients(vocab, ids, mask, label, weight, (rng.random(ids.shape) >= cfg.drop).astype(np.float32))[1])

    def judged() -> np.ndarray:
        gates = np.concatenate([net.project(net.vectors(char[vocab[2][k] : vocab[3][e - 1]], starts[k:e] - starts[k], vocab[0][k:e])) for k in range(0, len(words), 20_000) if (e := min(k + 20_000, len(words)))])
        out = np.empty(len(begin), np.float32)
        for k in range(0, len(begin), AT_ONCE):
            ids, mask = read(np.arange(k, min(k + AT_ONCE, len(begin))))
            out[k : k + AT_ONCE] = net.logits(gates[ids], mask)
        return out

    adam = Adam(net.p, cfg)
    learn(np.arange(len(begin)), cfg.first_epochs)
    for _ in range(cfg.rounds):
        logit, chosen = judged(), []
        for i in range(len(docs)):
            of = np.arange(bounds[i], bounds[i + 1])
            worst = of[np.argsort(-logit[of], kind="stable")]
            chosen += [worst[:1]] if y[i] else [worst[: cfg.hard], rng.choice(of, 1)]
        learn(np.unique(np.concatenate(chosen)), cfg.epochs)
        adam.rate *= 0.5
    return net


class Scorer:
    """Scores texts; a word's gate inputs are kept, within bounds."""

    def __init__(self, net: Net):
        self.net, self.rows = net, {}
        self.gates = np.zeros((1024, 2, 3 * net.cfg.hidden), np.float32)

    def numbers(self, docs: list[list[bytes]]) -> np.ndarray:
        fresh = list({w for d in docs for w in d if w not in self.rows})
        if len(self.rows) + len(fresh) > CACHE:
            self.rows.clear()
            fresh = list({w for d in docs for w in d})
        if fresh:
            base, net = len(self.rows), self.net
            if base + len(fresh) > len(self.gates):
                more = np.zeros((max(base + len(fresh), 2 * len(self.gates)), *self.gates.shape[1:]), np.float32)
                more[:base] = self.gates[:base]
                self.gates = more
            for k in range(0, len(fresh), 4_000):
                part = fresh[k : k + 4_000]
                row = np.fromiter((net.row.get(w, 0) for w in part), np.int64, len(part))
                self.gates[base + k : base + k + len(part)] = net.project(net.vectors(*grams(part, net.cfg), row))
            self.rows.update(zip(fresh, range(base, base + len(fresh))))
        get = self.rows.__getitem__
        return np.fromiter((get(w) for d in docs for w in d), np.int64, sum(map(len, docs)))

    def group(self, docs: list[list[bytes]]) -> np.ndarray:
        cfg, out = self.net.cfg, np.zeros(len(docs))
        full = [i for i, d in enumerate(docs) if d]
        if not full:
            return out
        flat = self.numbers([docs[i] for i in full])
        at = [window_starts(len(docs[i]), cfg) for i in full]
        sizes = np.array([len(docs[i]) for i in full])
        many = np.array([len(a) for a in at])
        begin = np.repeat(np.cumsum(sizes) - sizes, many) + np.concatenate(at)
        end = np.repeat(np.cumsum(sizes), many)
        logits = np.empty(len(begin), np.float32)
        for k in range(0, len(begin), AT_ONCE):
            place = begin[k : k + AT_ONCE, None] + np.arange(cfg.width)
            mask = place < end[k : k + AT_ONCE, None]
            logits[k : k + AT_ONCE] = self.net.logits(self.gates[flat[np.where(mask, place, 0)]], mask.astype(np.float32))
        out[full] = sigmoid(np.maximum.reduceat(logits, np.cumsum(many) - many).astype(float))
        return out

    def score(self, texts: Iterable[bytes]) -> list[float]:
        out, hold, size = [], [], 0
        for text in texts:
            hold.append(words_of(text))
            size += len(hold[-1])
            if size > 50_000:
                out += self.group(hold).tolist()
                hold, size = [], 0
        return out + (self.group(hold).tolist() if hold else [])


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", cfg: Recurrent = Recurrent()) -> Net | None:
    """Trains on at most cfg.sample whole texts; the driver holds an eighth of them and the others' word numbers."""
    texts = Texts()
    for r in labelled_sample(docs, labels, label, cfg.sample).repartition(8).toLocalIterator():
        texts.add((r.text or "").encode(), int(r.y), r.doc_id)
    return train(texts, cfg)


def scores_of(spark: SparkSession, net: Net | None) -> Callable[[Column], Column]:
    """Texts to scores, as a column: Arrow batches of the text alone go to Python, and one number a row comes back."""
    shared = spark.sparkContext.broadcast(net)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        held(None)
        scorer = Scorer(shared.value) if shared.value else None
        for texts in batches:
            yield pa.array(scorer.score(raw(texts)) if scorer else [0.0] * len(texts), pa.float64())

    return lambda text: score(text.cast("string"))


def score_toxicity(rows: DataFrame, net: Net | None) -> DataFrame:
    """doc_id, score."""
    shared = rows.sparkSession.sparkContext.broadcast(net)

    def start():
        held(None)
        scorer = Scorer(shared.value) if shared.value else None

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = scorer.score(raw_texts(batch)) if scorer else [0.0] * batch.num_rows
            return pa.record_batch({"doc_id": batch.column("doc_id"), "score": pa.array(found, pa.float64())})

        return step

    return map_rows(doc_rows(rows), start, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, label: str = "toxic", limit: float = 0.7, cfg: Recurrent = Recurrent()) -> DataFrame:
    out = score_toxicity(docs, fit(docs, labels, label, cfg))
    return out.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= limit).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, net: Net | None, limit: float = 0.7) -> DataFrame:
    """The documents, in their own columns, that score below the limit."""
    return docs.filter(scores_of(docs.sparkSession, net)(F.col("text")) < limit)
