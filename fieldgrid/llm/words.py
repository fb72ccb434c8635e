"""Words of many texts at once: numpy finds and hashes the words of a whole batch in passes over its bytes.

Word characters are given as a set of bytes. All bytes from 0x80 on are word bytes in both patterns used here, so words
can be cut from the UTF-8 form without decoding it.
"""

from __future__ import annotations

import numpy as np

#: Odd constants of the word hash.
MULTIPLY, FINISH = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: [^\x20\x09-\x0D]
NOT_BLANK = np.ones(256, bool)
NOT_BLANK[[0x20, *range(0x09, 0x0E)]] = False
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F], after lower-casing
ALPHANUMERIC = np.zeros(256, bool)
ALPHANUMERIC[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def cut(texts: list[bytes], kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The lower-cased bytes of all texts, each followed by a blank; first byte and length of each word; words of each text."""
    raw = np.frombuffer(b" ".join([*texts, b" " * 8]), np.uint8)
    data = LOWER[raw]
    inside = kind[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edges = np.concatenate([[0], edges])
    first, last = edges[::2], edges[1::2]
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes + 1)
    counts = np.diff(np.searchsorted(first, np.concatenate([[0], ends])))
    return data, first, last - first, counts


def hashes(data: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, never 0: eight bytes a pass, over the words that are that long."""
    eight = np.ndarray((max(len(data) - 7, 0),), "<u8", buffer=data, strides=(1,))
    out = length.astype(np.uint64) * FINISH
    at, left, to = first, length, None
    while len(at):
        part = eight[at]
        short = left < 8
        part[short] &= (np.uint64(1) << (left[short].astype(np.uint64) * np.uint64(8))) - np.uint64(1)
        mixed = ((out if to is None else out[to]) ^ part) * MULTIPLY
        mixed ^= mixed >> np.uint64(29)
        mixed *= FINISH
        mixed ^= mixed >> np.uint64(32)
        if to is None:
            out = mixed
        else:
            out[to] = mixed
        more = np.flatnonzero(left > 8)
        to = more if to is None else to[more]
        at, left = at[more] + 8, left[more] - 8
    out[out == 0] = 1
    return out
