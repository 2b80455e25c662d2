"""Words and lines of many texts at once, as numpy arrays over their UTF-8 bytes.

Words are maximal runs of other bytes than blank, tab, line feed, vertical tab, form feed, return.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def codes(data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, int]:
    """Numbers of byte strings that lie one after the other (equal numbers: equal strings), and how many differ."""
    if not len(lengths):
        return np.zeros(0, np.int64), 0
    at = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    strings = pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data))])
    found = strings.dictionary_encode()
    return found.indices.to_numpy().astype(np.int64), len(found.dictionary)


def word_places(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words in the buffer, and where each text's words begin among them."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = ~_SPACE[buf]
    filled = offsets[1:] > offsets[:-1]
    before = np.zeros(len(buf), bool)
    before[1:] = word[:-1]
    before[offsets[:-1][filled]] = False
    after = np.zeros(len(buf), bool)
    after[:-1] = word[1:]
    after[offsets[1:][filled] - 1] = False
    start = np.flatnonzero(word & ~before)
    return start, np.flatnonzero(word & ~after) + 1, np.searchsorted(start, offsets)


def word_codes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, int]:
    return codes(buf[~_SPACE[buf]], end - start)


def line_places(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (without the line feed) of all lines, and where each text's lines begin. A text has a line at least."""
    feed = np.flatnonzero(buf == 10)
    at = np.searchsorted(feed, offsets) + np.arange(len(offsets))
    start, end = np.empty(at[-1], np.int64), np.empty(at[-1], np.int64)
    first = np.zeros(at[-1], bool)
    first[at[:-1]] = True
    start[first], start[~first] = offsets[:-1], feed + 1
    last = np.zeros(at[-1], bool)
    last[at[1:] - 1] = True
    end[last], end[~last] = offsets[1:], feed
    return start, end, at
