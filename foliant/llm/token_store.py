"""Token ids in binary files with Elias-Fano document boundaries.

A file holds the ids of consecutive documents one after another, and two monotone sequences in Elias-Fano form: the ends of the
documents in the id array, and the doc_ids less the first. An Elias-Fano sequence of n values up to u keeps floor(log2(u / n)) low bits a
value packed, and the high parts in unary: about 2 + log2(u / n) bits a value. The position of every 256th one bit is kept in 32 bits;
select(i) starts there, so an offset is read without a table of 64-bit integers.

Layout, little-endian: magic ``FOLTOK1\\0``, then u64 documents, ids, documents with a null id, first doc_id (signed),
u8 id width in bytes (2 or 4), 7 spare bytes; ids; padding to 8; ends; doc_ids. Each sequence: u64 n, u64 u, u64 low
bits, low words (u64), u64 number of high words, high words (u64), samples (u32, padded to 8).

Documents are dealt into ranges of doc_id; each task sorts its range and writes files of at most ``shard_ids`` ids and one document. File names
depend on the place in the order alone and files are moved into place when complete, so a repeated task writes the same.

Defined results. Null texts are empty: only the end id. Null doc_ids come first. Repeated rows are documents of their own, in the order of their
texts; equal rows in any order. A very long text is one document of one file, however many ids it has. An empty table gives no files and no rows. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark import TaskContext

from foliant.llm.bpe import byte_symbols
from foliant.llm.common import doc_rows, held, texts

MAGIC = b"FOLTOK1\0"
SAMPLE = 256
CACHE = 300_000
#: Texts with other characters than these are encoded whole: the library's character tables may differ from Python's there.
USUAL = re.compile("[\t-\r -~¡-ɏ]*\\Z")


def usual_class(kinds: str) -> str:
    return "".join(re.escape(c) for c in map(chr, range(0x21, 0x250)) if c.isprintable() and unicodedata.category(c)[0] in kinds)


#: The byte-level pre-tokenizer's pieces, for usual texts.
PIECE = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{usual_class('L')}]+| ?[{usual_class('N')}]+| ?[^\s{usual_class('LN')}]+|\s+(?!\S)|\s+")


class EliasFano:
    """A monotone sequence of unsigned integers."""

    def __init__(self, n: int, top: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.top, self.low_bits, self.low, self.high, self.samples = n, top, low_bits, low, high, samples

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.uint64)
        n, top = len(v), int(v[-1]) if len(v) else 0
        bits = max(0, (top // n).bit_length() - 1) if n else 0
        low = pack(v & np.uint64((1 << bits) - 1), bits)
        ones = (v >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        flags = np.zeros(((int(ones[-1]) // 64 + 1) * 64) if n else 0, np.uint8)
        flags[ones] = 1
        high = np.packbits(flags, bitorder="little").view(np.uint64)
        return cls(n, top, bits, low, high, ones[::SAMPLE].astype(np.uint32))

    def select_high(self, i: int) -> int:
        """Position of the i-th one bit."""
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        word = at // 64
        bits = int(self.high[word]) >> (at % 64) << (at % 64)
        while (c := bits.bit_count()) <= left:
            left -= c
            word += 1
            bits = int(self.high[word])
        for _ in range(left):
            bits &= bits - 1
        return word * 64 + (bits & -bits).bit_length() - 1

    def select(self, i: int) -> int:
        """The i-th value."""
        bits, at = self.low_bits, i * self.low_bits
        low = 0
        if bits:
            pair = int(self.low[at // 64]) | (int(self.low[at // 64 + 1]) << 64)
            low = pair >> (at % 64) & ((1 << bits) - 1)
        return (self.select_high(i) - i) << bits | low

    def values(self) -> np.ndarray:
        """All of them at once."""
        ones = np.flatnonzero(np.unpackbits(self.high.view(np.uint8), bitorder="little")).astype(np.uint64)
        return ((ones - np.arange(self.n, dtype=np.uint64)) << np.uint64(self.low_bits)) | unpack(self.low, self.n, self.low_bits)

    def to_bytes(self) -> bytes:
        samples = self.samples.tobytes()
        return b"".join([np.array([self.n, self.top, self.low_bits, len(self.low)], "<u8").tobytes(), self.low.tobytes(), np.array([len(self.high)], "<u8").tobytes(), self.high.tobytes(), samples, bytes(-len(samples) % 8)])

    @classmethod
    def from_bytes(cls, data: bytes, at: int) -> tuple[EliasFano, int]:
        n, top, bits, k = (int(x) for x in np.frombuffer(data, "<u8", 4, at))
        low = np.frombuffer(data, "<u8", k, at := at + 32)
        h = int(np.frombuffer(data, "<u8", 1, at := at + 8 * k)[0])
        high = np.frombuffer(data, "<u8", h, at := at + 8)
        m = -(-n // SAMPLE)
        samples = np.frombuffer(data, "<u4", m, at := at + 8 * h)
        return cls(n, top, bits, low, high, samples), at + 4 * m + -4 * m % 8


def pack(values: np.ndarray, bits: int) -> np.ndarray:
    """Values of so many bits, one after another, and a spare word."""
    out = np.zeros(len(values) * bits // 64 + 2, np.uint64)
    if bits and len(values):
        at = np.arange(len(values), dtype=np.uint64) * np.uint64(bits)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        np.bitwise_or.at(out, word, values << shift)
        over = shift + np.uint64(bits) > 64
        np.bitwise_or.at(out, word[over] + 1, values[over] >> (np.uint64(64) - shift[over]))
    return out


def unpack(words: np.ndarray, n: int, bits: int) -> np.ndarray:
    if not bits or not n:
        return np.zeros(n, np.uint64)
    at = np.arange(n, dtype=np.uint64) * np.uint64(bits)
    word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
    out = words[word] >> shift
    over = shift + np.uint64(bits) > 64
    out[over] |= words[word[over] + 1] << (np.uint64(64) - shift[over])
    return out & np.uint64((1 << bits) - 1)


def file_bytes(doc_ids: list[int | None], ids: list[bytes], width: int) -> bytes:
    """ids: of each document, little-endian unsigned 32-bit."""
    flat = b"".join(ids)
    if width == 2:
        flat = np.frombuffer(flat, "<u4").astype("<u2").tobytes()
    ends = np.cumsum([len(x) // 4 for x in ids])
    known = [x for x in doc_ids if x is not None]
    first = known[0] if known else 0
    gaps = np.array([x - first for x in known], np.uint64)
    head = np.array([len(ids), int(ends[-1]) if len(ids) else 0, len(doc_ids) - len(known)], "<u8").tobytes() + np.array([first], "<i8").tobytes() + bytes([width, *[0] * 7])
    return b"".join([MAGIC, head, flat, bytes(-len(flat) % 8), EliasFano.build(ends).to_bytes(), EliasFano.build(gaps).to_bytes()])


class TokenFile:
    """What a file holds; offsets come from its select structure."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token file")
        self.n, self.total, self.nulls = (int(x) for x in np.frombuffer(data, "<u8", 3, 8))
        self.first = int(np.frombuffer(data, "<i8", 1, 32)[0])
        width = data[40]
        self.ids = np.frombuffer(data, f"<u{width}", self.total, 48)
        size = width * self.total
        self.ends, at = EliasFano.from_bytes(data, 48 + size + -size % 8)
        self.docs, _ = EliasFano.from_bytes(data, at)

    def doc_id(self, i: int) -> int | None:
        return None if i < self.nulls else self.first + self.docs.select(i - self.nulls)

    def bounds(self, i: int) -> tuple[int, int]:
        return self.ends.select(i - 1) if i else 0, self.ends.select(i)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", uri))


def qualified(spark: SparkSession, path: str) -> str:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()


class LibraryEncoder(dict):
    """Ids by the tokenizers library, as little-endian bytes. Its pre-tokenizer's pieces are cut here and each new one is given to
    the library's model; pieces are kept, within bounds. Texts with unusual characters or with the string of an added token go to the library whole."""

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer, self.old = Tokenizer.from_file(path), {}
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.plain = '"ByteLevel"' in self.tokenizer.pre_tokenizer.__getstate__().decode() and self.tokenizer.normalizer is None
        self.added = re.compile("|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()) or r"(?!)")
        self.chars = {b: ord(c) for b, c in enumerate(byte_symbols())}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = np.array([t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(self.chars))], "<u4").tobytes()
        if len(piece) <= 64:
            if len(self) >= CACHE:
                self.old = dict(self)
                self.clear()
            self[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if self.plain and USUAL.match(text) and not self.added.search(text):
            return b"".join(map(self.__getitem__, PIECE.findall(text)))
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def loaded(path: str) -> LibraryEncoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    return held(("tokens", path), lambda: LibraryEncoder(path))


@dataclass(frozen=True)
class TokenStore:
    tokenizer: str
    end_id: int = 0
    shard_ids: int = 4_000_000


def write_tokens(docs: DataFrame, where: str, cfg: TokenStore) -> DataFrame:
    """Writes the files under ``where`` when it is run; part, seq, path, n_docs, n_ids of each file."""
    end = np.array([cfg.end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        encoder, fs, base = loaded(cfg.tokenizer), *filesystem(where)
        width = 2 if max(encoder.tokenizer.get_vocab_size(), cfg.end_id + 1) <= 1 << 16 else 4
        names: list = []
        ids: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal seq, size
            name = f"{base}/tokens-{part:06d}-{seq:06d}.ftk"
            own = f"{base}/_tmp-{part}-{seq}-{TaskContext.get().taskAttemptId()}"
            fs.create_dir(base, recursive=True)
            with fs.open_output_stream(own) as out:
                out.write(file_bytes(names, ids, width))
            fs.move(own, name)
            row = pa.record_batch({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "path": [f"{where}/tokens-{part:06d}-{seq:06d}.ftk"], "n_docs": pa.array([len(ids)], pa.int64()), "n_ids": pa.array([size], pa.int64())})
            names.clear()
            ids.clear()
            seq, size = seq + 1, 0
            return row

        for batch in batches:
            for doc_id, found in zip(batch.column("doc_id").to_pylist(), map(encoder.encode, texts(batch))):
                n = len(found) // 4 + 1
                if ids and size + n > cfg.shard_ids:
                    yield flush()
                names.append(doc_id)
                ids.append(found + end)
                size += n
        if ids:
            yield flush()

    ordered = doc_rows(docs).repartitionByRange(F.asc_nulls_first("doc_id")).sortWithinPartitions(F.asc_nulls_first("doc_id"), "text")
    return ordered.mapInArrow(run, "part int, seq int, path string, n_docs long, n_ids long")


def read_tokens(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files."""
    order = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("path", F.coalesce(F.sum("n_ids").over(order), F.lit(0)).cast("long").alias("base"))
    spread = starts.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist()):
                fs, at = filesystem(path)
                with fs.open_input_stream(at) as f:
                    held = TokenFile(f.read())
                bounds = [held.bounds(i) for i in range(held.n)]
                crc = [zlib.crc32(held.ids[a:b].astype("<u4").tobytes()) for a, b in bounds]
                yield pa.record_batch({"doc_id": pa.array([held.doc_id(i) for i in range(held.n)], pa.int64()), "start": pa.array([base + a for a, _ in bounds], pa.int64()), "n_tokens": pa.array([b - a for a, b in bounds], pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})

    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
