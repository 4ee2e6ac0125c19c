"""Hashed runs of words of many texts at once, in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Multipliers of the splitmix64 finaliser, and of the steps from one value to the next.
_FIRST, _SECOND, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)

# Fixed value: the bytes of words in lower-case text; those of other letters are above 127, so they part words.
_WORD = np.zeros(256, bool)
_WORD[[*b"0123456789abcdefghijklmnopqrstuvwxyz"]] = True

#: Bytes of text that are taken apart at once; a longer text is on its own.
PART_BYTES = 500_000


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _FIRST
    x = (x ^ (x >> np.uint64(27))) * _SECOND
    return x ^ (x >> np.uint64(31))


def parts_of(texts: pa.Array) -> Iterator[pa.Array]:
    """The texts in parts of about ``PART_BYTES``, in order."""
    texts = texts.cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + PART_BYTES, "right")) - 1)
        yield texts.slice(at, to - at)
        at = to


def order_of(doc: np.ndarray, s: np.ndarray, level: np.ndarray | None = None) -> np.ndarray:
    """The order by text, level (a byte) and hash; equal rows in any.

    One number holds the text, the level and the leading bits of the hash, which is far faster to sort;
    where these bits leave the order open, all are compared.
    """
    if len(doc) and int(doc.max()) >> 20:
        return np.lexsort((s, doc) if level is None else (s, level, doc))
    key = doc.astype(np.uint64) << np.uint64(44)
    key |= s >> np.uint64(20) if level is None else level.astype(np.uint64) << np.uint64(36) | s >> np.uint64(28)
    order = np.argsort(key)
    key, found = key[order], s[order]
    if ((key[1:] == key[:-1]) & (found[1:] != found[:-1])).any():
        return np.lexsort((s, doc) if level is None else (s, level, doc))
    return order


def shingle_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The number of a text in ``texts`` and a hash, for each distinct run of ``k`` words over a-z and 0-9; sorted by both.

    ``texts`` are large strings in lower case without nulls.
    """
    none = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    low, high = int(offsets[0]), int(offsets[-1])
    if low == high:
        return none
    data = np.zeros(high - low + 8, np.uint8)
    data[: high - low] = np.frombuffer(texts.buffers()[2], np.uint8)[low:high]
    ends = offsets[1:] - low
    word = _WORD[data[: high - low]]
    border = np.zeros(len(word) + 1, bool)
    border[ends] = border[0] = True
    start = np.flatnonzero(word & (border[:-1] | ~np.concatenate([[False], word[:-1]])))
    length = np.flatnonzero(word & (border[1:] | ~np.concatenate([word[1:], [False]]))) + 1 - start
    if len(start) < k:
        return none
    eights = np.ndarray((len(data) - 7,), np.dtype("<u8"), data, 0, (1,))
    hashed, at, live = length.astype(np.uint64), 0, np.arange(len(start))
    while len(live):
        unused = np.maximum(8 - (length[live] - at), 0).astype(np.uint64)
        hashed[live] = _mixed((hashed[live] + _STEP) * _STEP ^ (eights[start[live] + at] & (np.uint64(2**64 - 1) >> unused * np.uint64(8))))
        at += 8
        live = live[length[live] > at]
    doc = np.searchsorted(ends, start, side="right")
    m = len(start) - k + 1
    s = np.zeros(m, np.uint64)
    for j in range(k):
        s = _mixed(s * _STEP + hashed[j : j + m])
    whole = doc[:m] == doc[k - 1 :]
    doc, s = doc[:m][whole], s[whole]
    order = order_of(doc, s)
    doc, s = doc[order], s[order]
    new = np.ones(len(s), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (s[1:] != s[:-1])
    return doc[new], s[new]
