"""MinHash near-deduplication with tensored banding.

A document's set holds its distinct word shingles. Two collections of ``m`` groups, each group
of ``k`` minimum hashes, are computed; the m * m table keys combine group i of the first collection
with group j of the second, so 2 m k hash functions serve m^2 tables of 2 k hashes each. Two sets
of similarity s share a key with probability (1 - (1 - s^k)^m)^2.

Candidates are confirmed on full sets (64-bit shingle hashes). Inside a bucket no list of all pairs is
made: members are compared with the bucket's hub, the links found are contracted to components, and what
still spans several components is compared across components only, where sets share one of their rarest shingles (an exact prefix filter)
and sizes and bucket parities leave room for the similarity. So a group of thousands of
near copies costs about one comparison a member, and no candidate is given up.

Keys that many sets share are never gathered: aggregates over them are partial, and what they find is written as a table before it is joined, so that both sides of the
join are plain shuffles, which adaptive execution splits where a key is hot.

Defined results. Equal sets are one class. Null or wordless texts: empty set, linked with nothing,
n_shingles 0. Fewer words than a shingle: the whole sequence is the one shingle. Very long texts are taken whole, one set at a time. Rows with a null
doc_id take no part in links and are kept with a null component. Repeated rows each give a row; a
doc_id with several texts is judged row by row, by its text's hash. Of a group the smallest doc_id stays, and of several texts with one set under it the one with the smallest hash. An empty table gives an empty
result. Other columns, whatever their names, are ignored, and kept by keep_one.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.common import Scratch, cut, doc_rows, held, map_rows, mix64, raw_texts


@dataclass(frozen=True)
class NearDup:
    """words: of a shingle. percent: least similarity. groups and width: m and k above. hub_rounds: comparisons
    with a hub before the rest is compared exactly."""

    words: int = 5
    percent: int = 80
    groups: int = 9
    width: int = 3
    hub_rounds: int = 2
    seed: int = 20_240_101


#: Buckets of the parity, and 64-bit integers that hold them.
BUCKETS = 512
PARTS = BUCKETS // 64
PARITY = [f"p{i}" for i in range(PARTS)]


class Words(dict):
    """64-bit hashes of words; cleared when large, so that memory stays bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_set(text: bytes, words: int, known: Words) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    parts = text.lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, parts), np.uint64, len(parts))
    n = min(words, len(h))
    with np.errstate(over="ignore"):
        out = np.full(len(h) - n + 1, n, np.uint64)
        for i in range(n):
            out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i])
    return np.unique(out)


def digest(values: np.ndarray) -> tuple[int, int]:
    x = xxhash.xxh3_128_digest(values.tobytes())
    return int.from_bytes(x[:8], "little", signed=True), int.from_bytes(x[8:], "little", signed=True)


def sketcher(cfg: NearDup):
    def start():
        held(None)
        known, count = Words(), 2 * cfg.groups * cfg.width
        rng = np.random.default_rng(cfg.seed)
        times = rng.integers(0, 2**64, count, np.uint64) | np.uint64(1)
        plus = rng.integers(0, 2**64, count, np.uint64)
        salt = rng.integers(0, 2**64, 2 * cfg.groups, np.uint64)

        def minima(sets: list[np.ndarray]) -> np.ndarray:
            flat, starts = np.concatenate(sets), np.cumsum([0, *map(len, sets)])[:-1]
            out = np.empty((len(sets), count), np.uint64)
            with np.errstate(over="ignore"):
                for f in range(count):
                    out[:, f] = np.minimum.reduceat((flat ^ plus[f]) * times[f], starts)
            return out

        def keys(sets: list[np.ndarray]) -> np.ndarray:
            with np.errstate(over="ignore"):
                low, m = minima(sets).reshape(len(sets), 2 * cfg.groups, cfg.width), cfg.groups
                part = np.broadcast_to(salt, low.shape[:2])
                for i in range(cfg.width):
                    part = mix64(part + low[:, :, i] * np.uint64(0x9E3779B97F4A7C15))
                return mix64(part[:, :m, None] * np.uint64(3) + part[:, None, m:]).reshape(len(sets), m * m)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            n, d1, d2, tables, wait, size = [], [], [], [], [], 0

            def flush() -> None:
                nonlocal size
                if wait:
                    tables.append(keys(wait))
                    wait.clear()
                    size = 0

            for text in raw_texts(batch):
                s = shingle_set(text, cfg.words, known)
                n.append(len(s))
                a, b = digest(s) if len(s) else (None, None)
                d1.append(a)
                d2.append(b)
                if len(s):
                    wait.append(s)
                    size += len(s)
                    if size > 200_000:
                        flush()
            flush()
            each = cfg.groups**2
            flat = np.concatenate(tables).reshape(-1).view(np.int64) if tables else np.empty(0, np.int64)
            ends = np.cumsum([0, *(each if x else 0 for x in n)]).astype(np.int32)
            return pa.record_batch({"doc_id": batch.column("doc_id"), "text_key": batch.column("text_key"), "n": pa.array(n, pa.int64()), "d1": pa.array(d1, pa.int64()), "d2": pa.array(d2, pa.int64()), "keys": pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))})

        return step

    return start


def set_reader(words: int):
    """(rep, d1, d2, text) to (rep, items, parity); rows whose text isn't of that digest go. Bit i of the parity tells whether an odd
    number of the items falls into bucket i, so that two sets differ in at least as many items as their parities in bits."""

    def start():
        held(None)
        known = Words()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rep, items, parity = [], [], []
            for r, a, b, text in zip(batch.column("rep").to_pylist(), batch.column("d1").to_pylist(), batch.column("d2").to_pylist(), raw_texts(batch), strict=True):
                s = shingle_set(text, words, known)
                if len(s) and digest(s) == (a, b):
                    rep.append(r)
                    items.append(pa.array(s.view(np.int64)))
                    odd = np.bincount((s & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS) & 1
                    parity.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
            ends = np.cumsum([0, *map(len, items)]).astype(np.int32)
            return pa.record_batch({"rep": pa.array(rep, pa.int64()), "items": pa.ListArray.from_arrays(pa.array(ends), pa.concat_arrays(items) if items else pa.array([], pa.int64()))} | {f"p{i}": pa.array([x[i] for x in parity], pa.int64()) for i in range(PARTS)})

        return step

    return start


def alike(a: Column, b: Column, percent: int) -> Column:
    """Sizes that leave room for the similarity."""
    return (a * 100 >= b * percent) & (b * 100 >= a * percent)


def near_parity(prefix: str, sizes: Column, percent: int) -> Column:
    """Whether the sets can differ in few enough items: no pair that is similar enough is left out."""
    differ = sum((F.bit_count(F.col(p).bitwiseXOR(F.col(prefix + p))) for p in PARITY), F.lit(0))
    return differ * (100 + percent) <= sizes * (100 - percent)


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are similar enough on their full sets."""
    with_a = pairs.join(sets.select(F.col("rep").alias("a"), F.col("items").alias("ia")), "a")
    both = with_a.join(sets.select(F.col("rep").alias("b"), F.col("items").alias("ib")), "b")
    common = F.size(F.array_intersect("ia", "ib")).cast("long")
    return both.filter(common * 100 >= (F.size("ia") + F.size("ib") - common) * percent).select("a", "b")


def rarest(sets: DataFrame, percent: int) -> DataFrame:
    """(rep, items) to (key, rep, n, room): the items that come first of each set, rarest of all first, and occur in several sets. Two sets that are
    similar enough share at least ``percent`` of the larger one, so one of the first n - ceil(n * percent / 100) + 1 of either is in both.
    room is how many items the set has from that one on: no pair that has it as its first common item shares more than the smaller room."""
    each = sets.select("rep", F.xxhash64("items").alias("w"), F.size("items").cast("long").alias("n"), F.explode("items").alias("key"))
    often = each.groupBy("key").agg(F.count(F.lit(1)).alias("f")).filter("f > 1")
    of_set = Window.partitionBy("rep", "w")
    found = each.join(often, "key").withColumn("alone", F.col("n") - F.count(F.lit(1)).over(of_set)).withColumn("room", F.col("n") - F.col("alone") - F.row_number().over(of_set.orderBy("f", "key")) + 1)
    return found.filter(F.col("room") >= F.floor((F.col("n") * percent + 99) / 100)).select("key", "rep", "n", "room")


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that can be reached. Minimum labels with pointer jumping; every
    round is a written table."""
    both = scratch.keep(edges.select("a", "b").union(edges.select("b", "a")).toDF("src", "dst").distinct())
    now = scratch.keep(both.groupBy("src").agg(F.min("dst").alias("low")).select(F.col("src").alias("node"), F.least("src", "low").alias("root")))
    while True:
        near = both.join(now.select(F.col("node").alias("dst"), "root"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("root").alias("low"))
        low = now.join(near, "node").select("node", F.col("root").alias("was"), F.least("root", "low").alias("root"))
        jump = now.select(F.col("node").alias("root"), F.col("root").alias("far"))
        step = scratch.keep(low.join(jump, "root", "left").select("node", "was", F.least("root", F.coalesce("far", "root")).alias("root")))
        if step.filter("was <> root").isEmpty():
            return step.select("node", "root")
        now = step.select("node", "root")


def near_duplicates(docs: DataFrame, cfg: NearDup = NearDup()) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept (doc_id = component_id), and of what text and set: text_key, d1, d2."""
    spark, rows = docs.sparkSession, doc_rows(docs).withColumn("text_key", F.xxhash64("text"))
    with Scratch(spark) as scratch:
        sketches = scratch.keep(map_rows(rows, sketcher(cfg), "doc_id long, text_key long, n long, d1 long, d2 long, keys array<long>"))
        classes = sketches.filter("n > 0 and doc_id is not null").groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("keys").alias("keys"))
        # a class is named by its smallest doc_id; the digest tells the texts of a repeated doc_id apart
        post = classes.select("rep", "n", "d1", "d2", F.explode("keys").alias("key"))
        crowd = scratch.keep(post.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("key"))
        shared = scratch.keep(post.join(crowd, "key"))
        wanted = shared.select("rep", "d1", "d2").distinct()
        sets = scratch.keep(map_rows(wanted.join(rows, F.col("rep") == F.col("doc_id")).select("rep", "d1", "d2", "text"), set_reader(cfg.words), "rep long, items array<long>" + "".join(f", {p} long" for p in PARITY)))
        shared = shared.select("key", "rep", "n")
        comp = scratch.keep(sets.select("rep", F.col("rep").alias("comp"), F.size("items").cast("long").alias("n"), *PARITY))
        tested = None
        for turn in range(cfg.hub_rounds + 1):
            if turn:  # only buckets that still span components are looked at again
                spans = shared.join(comp.select("rep", "comp"), "rep").groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("key")
                shared = scratch.keep(shared.join(scratch.keep(spans), "key"))
            at = shared.join(comp.drop("n"), "rep") if turn else shared.withColumn("comp", F.col("rep"))
            last, own = turn == cfg.hub_rounds, PARITY if turn else []
            if not last:
                hub = at.groupBy("key").agg(F.min(F.struct(F.xxhash64("rep", F.lit(turn)).alias("o"), F.col("rep").alias("hub"), F.col("n").alias("hub_n"), F.col("comp").alias("hub_comp"), *(F.col(p).alias("hub_" + p) for p in own))).alias("h"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("key", "h.*")
                pairs = at.join(scratch.keep(hub), "key").filter((F.col("comp") != F.col("hub_comp")) & alike(F.col("n"), F.col("hub_n"), cfg.percent) & (near_parity("hub_", F.col("n") + F.col("hub_n"), cfg.percent) if turn else F.lit(True))).select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b"))
            else:
                # of all sets in buckets that span components, those that share one of their rarest items; of these, all but the largest component that has the item, once for each other component that it meets
                at = rarest(shared.select("rep").distinct().join(sets.select("rep", "items"), "rep"), cfg.percent).join(comp.select("rep", "comp"), "rep")
                at = scratch.keep(at)
                sizes = at.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c"), F.min("n").alias("lo"), F.max("n").alias("hi"), F.max("room").alias("far"))
                main = sizes.groupBy("key").agg(F.max(F.struct("c", "comp")).alias("m"), F.count(F.lit(1)).alias("k")).filter("k > 1").select("key", F.col("m.comp").alias("main"))
                rest = at.join(scratch.keep(main), "key").filter("comp <> main").select("key", F.col("rep").alias("r"), F.col("comp").alias("rc"), "n", "room")
                fits = (F.col("n") * cfg.percent <= F.col("hi") * 100) & (F.col("lo") * cfg.percent <= F.col("n") * 100) & (F.least("room", "far") * (100 + cfg.percent) >= (F.col("n") + F.col("lo")) * cfg.percent)
                meets = rest.join(scratch.keep(sizes.drop("c")), "key").filter((F.col("comp") != F.col("rc")) & fits).select("r", "comp").distinct()
                one = comp.select(F.col("rep").alias("r"), F.col("n").alias("rn"), *(F.col(p).alias("r_" + p) for p in PARITY))
                pairs = meets.join(one, "r").join(comp, "comp").filter(alike(F.col("n"), F.col("rn"), cfg.percent) & near_parity("r_", F.col("n") + F.col("rn"), cfg.percent)).select(F.least("rep", "r").alias("a"), F.greatest("rep", "r").alias("b"))
            pairs = pairs.distinct()
            if tested is not None:
                pairs = pairs.join(tested, ["a", "b"], "left_anti")
            pairs = scratch.keep(pairs)
            links = confirm(pairs, sets, cfg.percent)
            if turn:
                links = links.join(comp.select(F.col("rep").alias("a"), F.col("comp").alias("ca")), "a").join(comp.select(F.col("rep").alias("b"), F.col("comp").alias("cb")), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
            links = scratch.keep(links.distinct())
            tested = pairs if tested is None else tested.union(pairs)
            if not links.isEmpty():
                roots = components(scratch, links)
                comp = scratch.keep(comp.join(roots, comp["comp"] == roots["node"], "left").select("rep", F.coalesce("root", "comp").alias("comp"), "n", *PARITY))
        of_class = classes.select("d1", "d2", "rep").join(comp, "rep", "left").select("d1", "d2", F.coalesce("comp", "rep").alias("component_id"))
        known = sketches.select("doc_id", "text_key", "n", "d1", "d2").join(scratch.keep(of_class), ["d1", "d2"], "left")
        component = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
        out = known.withColumn("component_id", component).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
        return cut(out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", "kept", "text_key", "d1", "d2"))


def keep_one(docs: DataFrame, cfg: NearDup = NearDup()) -> DataFrame:
    """The documents that stay: one of each group, and every one that is linked with nothing. Of repeated rows
    one stays, unless they have no words or no doc_id; different texts under one doc_id that are linked with nothing all stay."""
    worded = near_duplicates(docs, cfg).filter("doc_id is not null and n_shingles > 0")
    each = worded.groupBy("doc_id", "text_key").agg(F.max(~F.col("kept")).alias("gone"), F.count(F.lit(1)).alias("rows"), F.first("d1").alias("d1"), F.first("d2").alias("d2"))
    # of several texts with one set under a doc_id: few rows, of one doc_id
    first = F.min("text_key").over(Window.partitionBy("doc_id", "d1", "d2"))
    each = each.select("doc_id", "text_key", (F.col("gone") | (F.col("text_key") != first)).alias("gone"), "rows").filter("gone or rows > 1")
    i, tk, gone, rows = (f"__{x}_{uuid.uuid4().hex}" for x in ("id", "tk", "gone", "rows"))
    # the same join at every size
    on = (docs["doc_id"] == F.col(i)) & (F.xxhash64(docs["text"].cast("string")) == F.col(tk))
    rest = docs.join(each.toDF(i, tk, gone, rows).hint("merge"), on, "left").filter(~F.coalesce(F.col(gone), F.lit(False)))
    single, many = rest.filter(F.coalesce(F.col(rows), F.lit(1)) <= 1), rest.filter(F.col(rows) > 1).dropDuplicates([i, tk])
    return single.select(*docs.columns).unionByName(many.select(*docs.columns))
