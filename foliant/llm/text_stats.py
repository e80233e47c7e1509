"""Document statistics for the quality operators, with numpy over UTF-8 bytes."""

from __future__ import annotations

import numpy as np

from foliant.llm.near_dedup import Words

SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
#: Lower, upper, digit, space but newline, newline, sentence sign, comma, quote or bracket, symbol, exclamation mark, rest of ASCII, lead byte, continuation byte.
CLASS = np.full(256, 10, np.uint8)
for _kind, _bytes in enumerate((range(97, 123), range(65, 91), range(48, 58), (32, 9, 11, 12, 13), (10,), b".?:;", b",", b"\"'()[]{}", b"#*$%&|<>", b"!")):
    CLASS[list(_bytes)] = _kind
CLASS[192:] = 11
CLASS[128:192] = 12
CLASSES = 13
RULE_WORDS = 8


def word_hashes(words: list[bytes], known: Words) -> np.ndarray:
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def repeated_cover(h: np.ndarray, width: int) -> int:
    """Words in windows that are found twice or more, the first included."""
    if len(h) <= width:
        return 0
    with np.errstate(over="ignore"):
        w = h[: len(h) - width + 1].copy()
        for i in range(1, width):
            w = w * np.uint64(0x9E3779B97F4A7C15) + (h[i : len(h) - width + 1 + i] ^ np.uint64(i))
            w ^= w >> np.uint64(29)
    _, at, n = np.unique(w, return_inverse=True, return_counts=True)
    twice = n[at] > 1
    if not twice.any():
        return 0
    edge = np.zeros(len(h) + 1, np.int32)
    starts = np.flatnonzero(twice)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + width, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def rule_counts(text: bytes, words: list[bytes], h: np.ndarray) -> tuple[int, int, int, int]:
    """word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    b = np.frombuffer(text, np.uint8)
    chars = int((~SPACE[b] & ((b & 0xC0) != 0x80)).sum())
    lines = [x for x in text.split(b"\n") if x.strip()]
    return chars, int(SYMBOL[b].sum()), len(lines) - len(set(lines)), repeated_cover(h, RULE_WORDS)


FEATURES = 26


def features(text: bytes, known: Words) -> np.ndarray:
    """Fixed-length statistics of a whole text; zeros for an empty one."""
    out = np.zeros(FEATURES, np.float32)
    words = text.split()
    if not words:
        return out
    b = np.frombuffer(text, np.uint8)
    kinds = np.bincount(CLASS[b], minlength=CLASSES).astype(np.float64)
    chars = kinds.sum() - kinds[12]
    out[:12] = kinds[:12] / chars
    h = word_hashes(words, known)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    _, counts = np.unique(h, return_counts=True)
    lines = [x for x in text.split(b"\n") if x.strip()]
    with np.errstate(over="ignore"):
        pairs = np.unique(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])
    ends = np.fromiter((x[-1] for x in words), np.uint8, len(words))
    heads = np.fromiter((x[0] for x in words), np.uint8, len(words))
    out[12:26] = (
        np.log1p(len(words)),
        sizes.mean(),
        sizes.std(),
        np.log1p(sizes.max()),
        len(counts) / len(words),
        counts.max() / len(words),
        (counts == 1).sum() / len(counts),
        len(pairs) / max(1, len(words) - 1),
        len(set(lines)) / max(1, len(lines)),
        len(words) / max(1, len(lines)),
        (CLASS[ends] == 8).mean(),
        (CLASS[ends] == 9).mean(),
        (CLASS[heads] == 1).mean(),
        (sizes == 1).mean(),
    )
    return out
