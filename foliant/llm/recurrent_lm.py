"""Language-model scoring: a gated recurrent network with a class-factored softmax, beside smoothed counts of every word.

**Counts.** Every training document is counted: tasks send their words' counts, which are added up by word. The words of ``head`` highest counts go to the tasks; what a task meets beyond them it returns with its document, and a join finds their
counts. So every token has its true count at every size. Texts are then split once more, into a written table of word numbers that training and scoring share.

**Network.** The ``classes * of_class - 1`` most frequent words, the end of text among them, are the network's; all others are its unknown word, whose probability is shared out by their counts, smoothed like the base score. Words are dealt to
classes by frequency; P(word) = P(class) P(word | class). Before training the output's biases are the logarithms of the counts, so that an untrained network is the smoothed unigram model.

**Training** is by truncated backpropagation in numpy, in Spark tasks, from every training document: they are dealt into ``share`` parts by hash, and each of ``rounds`` rounds, of which there are as many as parts at least,
learns from the whole of one. Long texts are learned from in pieces of ``piece`` words. A task starts from the
round's parameters, runs its documents through ``lanes`` lanes of windows of ``steps`` words, state carried from window to window, and returns how far the parameters
moved, averaged by the tokens behind them, block by block, in Spark.
The driver sees the averages alone. Tasks read their documents in a fixed order, so a lost one is repeated alike; how many there are is the cluster's parallelism, or ``tasks``.

**Scoring** carries the state over the whole document, in windows of many documents side by side.

Defined results. Null and empty texts are the end alone. A null doc_id is not held out and not learned from. Repeated rows count, and give a row each. Without training documents the score is the base score, and every token has probability 1 by its
formula. Ties in frequency are ranked by the word's bytes. Very long texts are scored whole, alone; words of more than ``longest`` bytes are the network's unknown word. Other columns, whatever their names, are ignored. An empty table gives none.
"""

from __future__ import annotations

import heapq
import math
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import Scratch, cut, doc_rows, held, portions, raw, raw_texts

END = b"\n"  # no word holds it
BLOCK = 1_024  # parameters that are averaged together
STRIP = 32  # tokens of one class that go through the softmax together in training


@dataclass(frozen=True)
class Recurrent:
    classes: int = 32
    of_class: int = 32
    inputs: int = 16
    hidden: int = 16
    head: int = 200_000
    longest: int = 64
    smooth: float = 0.1
    folds: int = 10
    rounds: int = 4
    share: int = 4
    tasks: int | None = None
    lanes: int = 64
    steps: int = 20
    piece: int = 200
    rate: float = 0.1
    start: float = 1e-6  # of the squared gradients' sums
    most_words: int = 1_000_000  # that a counting task holds
    at_once: int = 1_000_000  # tokens that are scored side by side
    seed: int = 5

    def __post_init__(self) -> None:
        if self.rounds < self.share:
            raise ValueError("fewer rounds than parts would leave training documents out")

    @property
    def words(self) -> int:
        return self.classes * self.of_class

    @property
    def kind(self) -> str:
        """Of a word's number in tables."""
        return "<u2" if self.words <= 1 << 16 else "<i4"


def by_key(key: np.ndarray, below: int) -> np.ndarray:
    """A stable order of small numbers; those of 16 bits are sorted by their digits."""
    return np.argsort(key.astype(np.uint16) if below <= 1 << 16 else key, kind="stable")


def exponentials(logits: np.ndarray, rows: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The logits at one place of some rows, and all rows' sums of exponentials, which take the logits' place. Where a sum might overflow or vanish, rows are brought down by their largest first."""
    if logits.size and not -60 < logits.min() <= logits.max() < 60:
        logits -= logits.max(1, keepdims=True)
    own = logits[rows, at]
    np.exp(logits, out=logits)
    return own, logits @ np.ones(logits.shape[1], logits.dtype)


def target_log(logits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """log softmax at one place a row; the logits are used up."""
    own, sums = exponentials(logits, np.arange(len(at)), at)
    return own.astype(float) - np.log(sums)


def surprise(logits: np.ndarray, rows: np.ndarray, at: np.ndarray, n: int) -> tuple[float, np.ndarray]:
    """The cross-entropy of the rows that count, summed, and its gradient by all logits, whose place it takes, of n tokens' mean; other rows have none."""
    own, sums = exponentials(logits, rows, at)
    loss = float(np.log(sums[rows]).sum() - own.sum())
    share = np.zeros_like(sums)
    share[rows] = 1 / (n * sums[rows])
    logits *= share[:, None]
    logits[rows, at] -= 1 / n
    return loss, logits


class Net:
    """Parameters by name; 'word' and 'out' by the word's number, which is class * of_class + place."""

    def __init__(self, cfg: Recurrent, counts: np.ndarray):
        """counts: of the network's words, the unknown word's among them; zero for places without a word."""
        self.cfg = cfg
        rng, d, h = np.random.default_rng(cfg.seed), cfg.inputs, cfg.hidden
        some = lambda *shape, s: (rng.standard_normal(shape) * s).astype(np.float32)
        by_class = counts.reshape(cfg.classes, cfg.of_class).astype(float)
        with np.errstate(divide="ignore"):
            of_class = np.maximum(np.log(by_class) - np.log(np.maximum(by_class.sum(1, keepdims=True), 1e-9)), -30)
            classes = np.maximum(np.log(by_class.sum(1)) - np.log(max(by_class.sum(), 1e-9)), -30)
        self.p = {
            "word": some(cfg.words, d, s=0.3), "wx": some(d, 3 * h, s=d**-0.5), "b": np.zeros(3 * h, np.float32), "u": some(h, 3 * h, s=h**-0.5),
            "class": np.zeros((h, cfg.classes), np.float32), "class_b": classes.astype(np.float32),
            "out": np.zeros((cfg.classes, h, cfg.of_class), np.float32), "out_b": of_class.astype(np.float32),
        }

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.p.values()])

    def fill(self, flat: np.ndarray) -> Net:
        at = 0
        for k, x in self.p.items():
            self.p[k] = flat[at : at + x.size].reshape(x.shape).astype(x.dtype)
            at += x.size
        return self

    def states(self, gates: np.ndarray, first: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The states after each word, and the gates that made them: z and r, and what is new. gates: steps x parts x lanes, used up; lanes stand side by side, so that the gates' parts lie together. Where a text starts (first, steps x lanes) the state before (parts x lanes) doesn't count."""
        h, (steps, _, lanes) = self.cfg.hidden, gates.shape
        u = np.ascontiguousarray(self.p["u"].T)
        u_both, u_new, rs = -u[: 2 * h], u[2 * h :], np.empty((h, lanes), gates.dtype)
        both, (news, states) = np.empty((steps, 2 * h, lanes), gates.dtype), (np.empty((steps, h, lanes), gates.dtype) for _ in range(2))
        starts = first.any(1).tolist()
        np.negative(gates[:, : 2 * h], out=gates[:, : 2 * h])
        with np.errstate(over="ignore"):  # a gate of e to such a number is shut
            for gate, zr, z, r, new, after, start, at in zip(gates, both, both[:, :h], both[:, h:], news, states, starts, first):
                if start:
                    state = state * ~at
                np.matmul(u_both, state, out=zr)
                zr += gate[: 2 * h]
                np.exp(zr, out=zr)
                zr += 1
                np.reciprocal(zr, out=zr)
                np.multiply(r, state, out=rs)
                np.matmul(u_new, rs, out=new)
                new += gate[2 * h :]
                np.tanh(new, out=new)
                np.subtract(state, new, out=after)
                after *= z
                after += new
                state = after
        return states, both, news

    def log_p(self, states: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural logarithms. Sums of exponentials alone: of no class or word but the target's a logarithm is taken."""
        which, place = np.divmod(target, self.cfg.of_class)
        p, ones = self.p, np.ones((len(states), 1), states.dtype)
        states = np.concatenate([states, ones], 1)  # the biases as one more row
        out = target_log(states @ np.concatenate([p["class"], p["class_b"][None]]), which)
        order = by_key(which, self.cfg.classes)
        for some in np.split(order, np.flatnonzero(np.diff(which[order])) + 1) if len(order) else ():
            c = which[some[0]]
            out[some] += target_log(states[some] @ np.concatenate([p["out"][c], p["out_b"][c][None]]), place[some])
        return out

    def gradients(self, x: np.ndarray, y: np.ndarray, first: np.ndarray, use: np.ndarray, state: np.ndarray) -> tuple[float, dict[str, np.ndarray], np.ndarray]:
        """Of the mean cross-entropy. x, y, first, use: steps x lanes: word before, word, whether a text starts here, whether there is a word. Also the state at the end. The gradient doesn't go back before the window."""
        p, h = self.p, self.cfg.hidden
        steps, lanes = x.shape
        n = max(1, int(use.sum()))
        inputs = p["word"][x]
        gates = np.matmul(np.ascontiguousarray(p["wx"].T), inputs.transpose(0, 2, 1)) + p["b"][:, None]
        go_on, state = (~first).astype(gates.dtype)[:, None], np.ascontiguousarray(state.T)
        states, both, news = self.states(gates, first, state)
        befores = np.concatenate([state[None], states[:-1]])
        befores *= go_on
        at = np.flatnonzero(use.ravel())
        target = y.ravel()[at]
        which, place = np.divmod(target, self.cfg.of_class)
        order = by_key(which, self.cfg.classes)  # from here on the tokens stand by class
        at, which, place = at[order], which[order], place[order]
        rows, s = np.arange(len(at)), np.ones((len(at), h + 1), gates.dtype)
        s[:, :h] = states.transpose(0, 2, 1).reshape(-1, h)[at]  # the biases are one more row
        loss, d = surprise(s @ np.concatenate([p["class"], p["class_b"][None]]), rows, which, n)
        by_class = s.T @ d
        by_word = np.zeros((self.cfg.classes, h + 1, self.cfg.of_class), gates.dtype)
        ds = d @ p["class"].T
        if len(at):
            # a class's tokens in strips of STRIP, the last one filled up with zeros, so that all classes are gone through at once
            counts = np.bincount(which, minlength=self.cfg.classes)
            strips = -(-counts // STRIP)
            ends = np.cumsum(strips) * STRIP
            of = np.repeat(np.arange(self.cfg.classes), strips)
            slot = rows + np.repeat(ends - strips * STRIP - (np.cumsum(counts) - counts), counts)
            filled = np.zeros((len(of) * STRIP, h + 1), s.dtype)
            filled[slot] = s
            out = np.concatenate([p["out"], p["out_b"][:, None]], 1)[of]
            more, d = surprise((filled.reshape(-1, STRIP, h + 1) @ out).reshape(-1, self.cfg.of_class), slot, place, n)
            loss += more
            for c in np.flatnonzero(strips).tolist():
                some = slice(ends[c] - strips[c] * STRIP, ends[c])
                np.matmul(filled[some].T, d[some], out=by_word[c])
            ds += (d.reshape(-1, STRIP, self.cfg.of_class) @ out[:, :h].transpose(0, 2, 1)).reshape(-1, h)[slot]
        g = {"class": by_class[:h], "class_b": by_class[h], "out": by_word[:, :h], "out_b": by_word[:, h]}
        back = np.zeros((steps * lanes, h), gates.dtype)
        back[at] = ds
        back = np.ascontiguousarray(back.reshape(steps, lanes, h).transpose(0, 2, 1))
        r, shut = both[:, h:], 1 - both
        by_new, by_both = shut[:, :h] * (1 - news * news), np.concatenate([befores - news, befores], 1)
        by_both *= both
        by_both *= shut
        dgates, carry, through = np.empty_like(gates), np.zeros((h, lanes), gates.dtype), np.empty((2 * h, lanes), gates.dtype)
        dh, drs = through[:h], through[h:]
        u_both, u_new = np.ascontiguousarray(p["u"][:, : 2 * h]), np.ascontiguousarray(p["u"][:, 2 * h :])
        starts = first.any(1).tolist()
        for t in range(steps - 1, -1, -1):
            dt = dgates[t]
            np.add(back[t], carry, out=dh)
            dnew = np.multiply(dh, by_new[t], out=dt[2 * h :])
            np.matmul(u_new, dnew, out=drs)
            np.multiply(through, by_both[t], out=dt[: 2 * h])
            np.matmul(u_both, dt[: 2 * h], out=carry)
            through *= both[t]
            carry += dh
            carry += drs
            if starts[t]:
                carry *= go_on[t]
        flat, befores, rs = (np.ascontiguousarray(x.transpose(0, 2, 1)).reshape(steps * lanes, -1) for x in (dgates, befores, r * befores))
        du = np.concatenate([befores.T @ flat[:, : 2 * h], rs.T @ flat[:, 2 * h :]], 1)
        g |= {"u": du, "b": np.ones(len(flat), flat.dtype) @ flat, "wx": inputs.reshape(-1, inputs.shape[-1]).T @ flat}
        dx = flat @ p["wx"].T
        order = by_key(x.ravel(), self.cfg.words)
        seen = x.ravel()[order]
        begins = np.flatnonzero(np.diff(seen, prepend=-1))
        g["word"] = (seen[begins], np.add.reduceat(dx[order], begins, axis=0))
        return float(loss) / n, g, states[-1].T


class Adagrad:
    """Steps by the root of the gradients' squares so far; of the word vectors only those that were met. The net's other parameters become parts of one array, so that a step goes through them at once."""

    def __init__(self, net: Net):
        self.net, self.dense = net, [k for k in net.p if k != "word"]
        self.flat, at = np.concatenate([net.p[k].ravel() for k in self.dense]), 0
        for k in self.dense:
            net.p[k] = self.flat[at : at + net.p[k].size].reshape(net.p[k].shape)
            at += net.p[k].size
        self.sums, self.word_sums = np.full_like(self.flat, net.cfg.start), np.full_like(net.p["word"], net.cfg.start)

    def step(self, g: dict) -> None:
        self.flat -= self.moved(np.concatenate([g[k].ravel() for k in self.dense]), self.sums, slice(None))
        at, x = g["word"]
        self.net.p["word"][at] -= self.moved(x, self.word_sums, at)

    def moved(self, x: np.ndarray, sums: np.ndarray, at: np.ndarray | slice) -> np.ndarray:
        sums[at] += x * x
        x = self.net.cfg.rate * x
        x /= np.sqrt(sums[at])
        return x


def pieces(texts: Iterator[np.ndarray], size: int) -> Iterator[tuple[int, np.ndarray]]:
    """The word before, and at most so many words: a very long text is learned from in many lanes, with a fresh state in each."""
    for text in texts:
        for k in range(0, len(text), size):
            yield int(text[k - 1]), text[k : k + size]  # before the first word stands the end


def windows(texts: Iterator[np.ndarray], cfg: Recurrent) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """x, y, first, use of Net.gradients: the pieces of the texts dealt to lanes, the next one to the lane that is the first to be read to its end. Lanes that fill the window are read together."""
    texts, steps = pieces(texts, cfg.piece), np.arange(cfg.steps)[:, None]
    words = np.zeros((cfg.lanes, cfg.piece + 1 + cfg.steps), np.int32)  # of the lanes' pieces, behind the words before them
    flat, row = words.ravel(), np.arange(cfg.lanes) * words.shape[1]
    at, left = np.zeros(cfg.lanes, np.int64), np.zeros(cfg.lanes, np.int64)
    while True:
        full = left >= cfg.steps
        place = row + np.where(full, at, 0) + steps
        x, y = flat[place], flat[place + 1]
        first, use = np.zeros(x.shape, bool), np.zeros(x.shape, bool)
        use[:, full] = True
        at[full] += cfg.steps
        left[full] -= cfg.steps
        for b in np.flatnonzero(~full).tolist():
            t, k, n = 0, int(at[b]), int(left[b])
            while t < cfg.steps:
                if not n:
                    if (piece := next(texts, None)) is None:
                        break
                    before, text = piece
                    k, n, first[t, b] = 0, len(text), True
                    words[b, 0], words[b, 1 : n + 1] = before, text
                some = min(n, cfg.steps - t)
                x[t : t + some, b], y[t : t + some, b] = words[b, k : k + some], words[b, k + 1 : k + some + 1]
                t, k, n = t + some, k + some, n - some
            at[b], left[b] = k, n
            x[t:, b] = y[t:, b] = 0
            use[:t, b] = True
        if not use.any():
            return
        yield x, y, first, use


def learn(net: Net, texts: Iterator[np.ndarray]) -> int:
    """Runs the texts (word numbers with the end's last) through the lanes once; the tokens learned from."""
    seen, state, best = 0, np.zeros((net.cfg.lanes, net.cfg.hidden), np.float32), Adagrad(net)
    for x, y, first, use in windows(texts, net.cfg):
        _, g, state = net.gradients(x, y, first, use, state)
        best.step(g)
        seen += int(use.sum())
    return seen


def log_likelihoods(net: Net, texts: list[np.ndarray], table: np.ndarray, width: int = 256, at_once: int = 16_384) -> np.ndarray:
    """Natural logarithm of each text's probability, word numbers with the end's last. table: the gates' inputs of every word. Texts are dealt to lanes, the longest first to the shortest lane, and to no more lanes than the longest text leaves full; each lane is read to its end.
    at_once: words that the softmax is taken of together."""
    sizes = np.array([len(t) for t in texts])
    order = np.argsort(-sizes, kind="stable").tolist()
    heap = [(0, b) for b in range(max(1, min(width, -(-int(sizes.sum()) // int(sizes.max())))))]
    lanes: list[list[int]] = [[] for _ in heap]
    for k in order:
        size, b = heapq.heappop(heap)
        lanes[b].append(k)
        heapq.heappush(heap, (size + len(texts[k]), b))
    lanes.sort(key=lambda ks: -sum(len(texts[k]) for k in ks))  # those that are still read are the first ones
    size = np.array([sum(len(texts[k]) for k in ks) for ks in lanes])
    steps = int(size[0])
    y, owner, first = np.zeros((steps, len(lanes)), np.int32), np.zeros((steps, len(lanes)), np.int32), np.zeros((steps, len(lanes)), bool)
    x = np.zeros_like(y)
    for b, ks in enumerate(lanes):
        at = 0
        for k in ks:
            t = texts[k]
            y[at : at + len(t), b], owner[at : at + len(t), b], first[at, b] = t, k, True
            x[at, b], x[at + 1 : at + len(t), b] = t[-1], t[:-1]
            at += len(t)
    out, state = np.zeros(len(texts)), np.zeros((net.cfg.hidden, len(lanes)), np.float32)
    active = np.searchsorted(-size, -np.arange(steps), side="left")  # lanes longer than the step
    window = max(1, at_once // len(lanes))
    for lo in range(0, steps, window):
        n = active[lo]
        x_, y_, owner_, first_ = (part[lo : lo + window, :n] for part in (x, y, owner, first))
        states, _, _ = net.states(np.ascontiguousarray(table[x_].transpose(0, 2, 1)), first_, state[:, :n])
        state, rows = states[-1], states.transpose(0, 2, 1).reshape(-1, net.cfg.hidden)
        use = np.flatnonzero(np.arange(n) < active[lo : lo + window, None])  # lanes that end inside the window are read on to its end, for nothing
        if len(use) < len(rows):
            rows = rows[use]
        out += np.bincount(owner_.ravel()[use], net.log_p(rows, y_.ravel()[use]), len(texts))
    return out


@dataclass
class Model:
    """tokens, distinct: of the training documents. head: words with their counts, the network's first. own, own_tokens: how many of them are the network's, and their tokens."""

    cfg: Recurrent
    tokens: int
    distinct: int
    head: list[bytes]
    counts: np.ndarray
    own: int
    params: np.ndarray | None = None

    @property
    def rest(self) -> tuple[int, int]:
        """Tokens and distinct words that the network doesn't know."""
        return self.tokens - int(self.counts[: self.own].sum()), self.distinct - self.own

    def net(self) -> Net:
        counts = np.zeros(self.cfg.words)
        counts[0] = self.rest[0] + self.cfg.smooth
        counts[1 : self.own + 1] = self.counts[: self.own] + self.cfg.smooth
        net = Net(self.cfg, counts)
        return net if self.params is None else net.fill(self.params)

    def base_total(self) -> float:
        return self.tokens + self.cfg.smooth * (self.distinct + 1)

    def rest_total(self) -> float:
        return self.rest[0] + self.cfg.smooth * (self.rest[1] + 1)


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


def is_held_out(doc_id: Column, folds: int = 10) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def count_words(docs: DataFrame, cfg: Recurrent) -> DataFrame:
    """(word, n), the end of text included."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held(None)
        seen: Counter = Counter()

        def rows() -> Iterator[pa.RecordBatch]:
            words, times = list(seen), list(seen.values())
            for k in range(0, len(words), 50_000):
                yield pa.record_batch({"word": pa.array(words[k : k + 50_000], pa.binary()).cast(pa.string()), "n": pa.array(times[k : k + 50_000], pa.int64())})

        for batch in batches:
            for text in raw_texts(batch):
                seen.update(words_of(text))
                seen[END] += 1
                if len(seen) > cfg.most_words:
                    yield from rows()
                    seen.clear()
        yield from rows()

    return docs.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def head_of(counts: DataFrame, cfg: Recurrent) -> list[tuple[bytes, int]]:
    """The most frequent words, at most cfg.head: those over a limit that is found from the counts' own distribution, so that no task and no sort sees more."""
    able = counts.filter(F.octet_length("word") <= cfg.longest)
    step = F.floor(F.log2("n") * 16).cast("int")
    sizes = sorted(((r.s, r.k) for r in able.groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("k")).collect()), reverse=True)  # sixteen rows a power of two
    many, least = 0, None
    for s, k in sizes:
        if many + k > cfg.head:
            break
        many, least = many + k, s
    if least is None:
        return []
    return sorted(((r.word.encode(), r.n) for r in able.filter(step >= least).collect()), key=lambda x: (-x[1], x[0]))


def learned_from(rows: DataFrame, cfg: Recurrent) -> DataFrame:
    return rows.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % cfg.folds != 0)


def counted(docs: DataFrame, scratch: Scratch, cfg: Recurrent) -> tuple[Model, DataFrame]:
    """A model without a network, and the counts of all words as a written table."""
    counts = scratch.keep(count_words(learned_from(doc_rows(docs), cfg), cfg))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    head = head_of(counts, cfg)
    head.sort(key=lambda x: x[0] != END)  # the end is the network's in any case
    return Model(cfg, total.n, total.v, [w for w, _ in head], np.array([n for _, n in head], np.int64), min(len(head), cfg.words - 1)), counts


def numbered(rows: DataFrame, model: Model, scratch: Scratch) -> DataFrame:
    """Of doc_rows, as a written table, so that texts are split into words once for training and scoring: the network's numbers of a text's words with the end's last, what the head's words add to the sums, and the words beyond the head with their counts.
    o and turn: a text's place in training."""
    cfg, shared = model.cfg, rows.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, model = shared.value
        get, unknown = held(("numbers", name), lambda: {w: i for i, w in enumerate(model.head)}).get, len(model.head)
        counts = model.counts + cfg.smooth
        base, inside = np.log10(counts / model.base_total()), np.log10(counts / model.rest_total())
        inside[: model.own] = 0  # the network's own words
        base, inside = np.append(base, 0), np.append(inside, 0)
        own = np.append(np.arange(1, model.own + 1), np.zeros(unknown + 1 - model.own)).astype(cfg.kind)
        row = uuid.uuid4().int >> 65
        for batch in batches:
            for some in portions(batch, 1 << 20):
                words, ends = [], []
                for text in raw_texts(some):
                    words += words_of(text)
                    words.append(END)
                    ends.append(len(words))
                ids = np.fromiter(map(get, words, repeat(unknown)), np.int64, len(words))
                begins = np.array([0, *ends[:-1]])
                beyond = np.flatnonzero(ids == unknown)
                bounds, rest, times, many = np.searchsorted(beyond, [0, *ends]).tolist(), [], [], [0]
                beyond = [words[k] for k in beyond.tolist()]
                for lo, hi in zip(bounds, bounds[1:]):
                    if lo < hi:
                        found = Counter(beyond[lo:hi])
                        rest += found
                        times += found.values()
                    many.append(len(rest))
                pairs = pa.StructArray.from_arrays([pa.array(rest, pa.binary()).cast(pa.string()), pa.array(times, pa.int64())], ["word", "n"])
                sizes = np.array([0, *ends], np.int32) * np.dtype(cfg.kind).itemsize
                yield pa.record_batch({c: some.column(c) for c in ("doc_id", "tk", "o", "turn")} | {
                    "row": pa.array(np.arange(row, row + len(ends))), "n_tokens": pa.array(np.diff(ends, prepend=0)), "n_known": pa.array(np.add.reduceat(ids != unknown, begins, dtype=np.int64)),
                    "base": pa.array(np.add.reduceat(base[ids], begins)), "inside": pa.array(np.add.reduceat(inside[ids], begins)),
                    "ids": pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(sizes), pa.py_buffer(own[ids])]), "rest": pa.ListArray.from_arrays(pa.array(many, pa.int32()), pairs),
                })
                row += len(ends)

    part = F.pmod(F.xxhash64("doc_id", "text"), F.lit(cfg.share)).cast("int")
    dealt = rows.select("doc_id", "text", F.xxhash64("text").alias("tk"), F.xxhash64("text", "doc_id").alias("o"), part.alias("turn"))
    return scratch.keep(dealt.mapInArrow(run, "doc_id long, tk long, o long, turn int, row long, n_tokens long, n_known long, base double, inside double, ids binary, rest array<struct<word:string,n:long>>"))


def fit(docs: DataFrame, scratch: Scratch, cfg: Recurrent = Recurrent()) -> tuple[Model, DataFrame]:
    """The model, and the counts of all words as a written table."""
    model, counts = counted(docs, scratch, cfg)
    if model.tokens and model.own:
        trained(model, numbered(learned_from(doc_rows(docs), cfg), model, scratch))
    return model, counts


def trained(model: Model, texts: DataFrame) -> None:
    """texts: of the training documents, as numbered() gives them."""
    cfg = model.cfg
    tasks = cfg.tasks or max(1, texts.sparkSession.sparkContext.defaultParallelism)
    for turn in range(cfg.rounds):
        model.params = one_round(texts.filter(F.col("turn") == turn % cfg.share), model, tasks, turn)


def one_round(texts: DataFrame, model: Model, tasks: int, turn: int) -> np.ndarray:
    """Every task trains on its texts; parameters are averaged by tokens, and come to the driver as averages."""
    spark, cfg = texts.sparkSession, model.cfg
    shared = spark.sparkContext.broadcast((model.net().flat(),))

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held(None)
        part = []

        def ids() -> Iterator[np.ndarray]:
            for batch in batches:
                for p, x in zip(batch.column("part"), batch.column("ids")):
                    part or part.append(p.as_py())
                    yield np.frombuffer(x.as_py(), cfg.kind)

        net = Net(cfg, np.ones(cfg.words)).fill(shared.value[0])
        if n := learn(net, ids()):
            moved = (net.flat() - shared.value[0]).astype(np.float16)  # zero, and so small when compressed, where nothing was met
            for k in range(0, len(moved), BLOCK):
                yield pa.record_batch({"block": pa.array([k // BLOCK], pa.int32()), "part": pa.array(part, pa.int32()), "tokens": pa.array([n], pa.int64()), "moved": pa.array([moved[k : k + BLOCK].tobytes()], pa.binary())})

    def average(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("part")
        total, tokens = 0.0, rows.column("tokens").to_numpy()
        for n, x in zip(tokens, rows.column("moved")):
            total = total + np.frombuffer(x.as_py(), np.float16).astype(float) * n
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "moved": pa.array([(total / tokens.sum()).astype(np.float32).tobytes()], pa.binary())})

    dealt = texts.repartition(tasks, "o").sortWithinPartitions("o", "doc_id").select(F.spark_partition_id().alias("part"), "ids")
    found = dealt.mapInArrow(train, "block int, part int, tokens long, moved binary").groupBy("block").applyInArrow(average, "block int, moved binary").collect()
    return shared.value[0] + (np.concatenate([np.frombuffer(r.moved, np.float32) for r in sorted(found, key=lambda r: r.block)]) if found else np.float32(0))


def score(docs: DataFrame, model: Model, counts: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. counts: the model's words, of which its head is read in tasks and the rest is joined."""
    return scored(numbered(doc_rows(docs), model, scratch), model, counts)


def scored(texts: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """score() of what numbered() gives."""
    cfg, shared = model.cfg, texts.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, replace(model, head=[])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, model = shared.value
        net, table = held(("model", name), lambda: opened(model))
        size = cfg.at_once * np.dtype(cfg.kind).itemsize
        for batch in batches:
            for some in portions(batch, size, "ids") if net else [batch]:
                inside = some.column("inside")
                if net:
                    lp = log_likelihoods(net, [np.frombuffer(x, cfg.kind) for x in raw(some.column("ids"))], table)
                    inside = pa.array(inside.to_numpy() + lp / math.log(10))
                yield pa.record_batch({c: some.column(c) for c in ("doc_id", "tk", "row", "n_tokens", "n_known", "base")} | {"model": inside})

    seen = texts.drop("o", "turn", "rest").mapInArrow(run, "doc_id long, tk long, row long, n_tokens long, n_known long, base double, model double")
    n, c, k = F.col("n"), F.coalesce("c", F.lit(0)), F.lit(cfg.smooth)
    rest = texts.select("row", "tk", F.explode("rest").alias("x")).select("row", "tk", "x.word", "x.n").join(counts.select("word", F.col("n").alias("c")), "word", "left")
    adds = rest.groupBy("row", "tk").agg(F.sum(F.when(c > 0, n)).alias("more"), F.sum(n * F.log10((c + k) / model.base_total())).alias("base_more"), F.sum(n * F.log10((c + k) / model.rest_total())).alias("model_more"))
    out = seen.join(adds, ["row", "tk"], "left")
    with_rest = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0))
    score = with_rest("model", "model_more") if model.params is not None else with_rest("base", "base_more")
    return out.select("doc_id", is_held_out(F.col("doc_id"), cfg.folds).alias("held_out"), "n_tokens", with_rest("n_known", "more").alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"), with_rest("base", "base_more").alias("base_score"), score.alias("score"))


def opened(model: Model) -> tuple[Net | None, np.ndarray | None]:
    """What a worker holds: the network, and the gates' inputs of every word."""
    if model.params is None:
        return None, None
    net = model.net()
    return net, net.p["word"] @ net.p["wx"] + net.p["b"]


def fit_and_score(docs: DataFrame, cfg: Recurrent = Recurrent()) -> DataFrame:
    with Scratch(docs.sparkSession) as scratch:
        model, counts = counted(docs, scratch, cfg)
        texts = numbered(doc_rows(docs), model, scratch)
        if model.tokens and model.own:
            trained(model, learned_from(texts, cfg))
        return cut(scored(texts, model, counts))
