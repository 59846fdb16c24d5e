"""Unigram pieces over words: the log probability of all segmentations of a word, and expected counts of pieces.

Words of one length are worked on together: one array operation for each start and end of a piece.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np

START = "▁"  # marks the start of a word in the vocabulary
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_FILTER_BITS = 20
# longer words are worked on one by one
_TOGETHER = 48
_ROWS = 20_000


def _hashes(columns: np.ndarray) -> np.ndarray:
    """64-bit hashes of the code points in each row."""
    code = np.zeros(len(columns), np.uint64)
    for k in range(columns.shape[1]):
        code = _step(code, columns[:, k])
    return code


def _step(code: np.ndarray, points: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        code = (code + points.astype(np.uint64) + np.uint64(1)) * _PRIME
        return code ^ (code >> np.uint64(29))


class Pieces:
    """A vocabulary with a log probability for each piece; bytes stand in for characters it does not have."""

    def __init__(self, pieces: Sequence[str], logs: np.ndarray):
        self.logs = np.asarray(logs, float)
        self.number = {piece: i for i, piece in enumerate(pieces)}
        self.bytes = np.array([self.number.get(f"<0x{b:02X}>", -1) for b in range(256)])
        usable = [p for p in pieces if not (p.startswith("<") and p.endswith(">"))]
        self.longest = max(map(len, usable), default=1)
        keys = np.array([
            _hashes(np.array([[ord(c) for c in p]], np.uint32))[0] for p in usable], np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array([self.number[p] for p in usable])[order]
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[self._cell(self.keys)] = True
        # starts of pieces: where none fits, longer pieces need not be tried
        starts = sorted({p[:k] for p in usable for k in range(1, len(p))})
        self.starts = np.zeros(1 << _FILTER_BITS, bool)
        for length in {len(p) for p in starts}:
            own = [p for p in starts if len(p) == length]
            points = np.frombuffer("".join(own).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, length)
            self.starts[self._cell(_hashes(points))] = True

    @staticmethod
    def _cell(keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows that are pieces, and their numbers."""
        rows = np.flatnonzero(self.filter[self._cell(keys)])
        at = np.minimum(np.searchsorted(self.keys, keys[rows]), len(self.keys) - 1)
        same = self.keys[at] == keys[rows]
        return rows[same], self.ids[at[same]]

    def spelled(self, char: str) -> list[int]:
        """The byte pieces of a character."""
        return [self.bytes[b] for b in char.encode("utf-8", "surrogatepass") if self.bytes[b] >= 0]


def _edges(pieces: Pieces, points: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray | None]]:
    """Start, end, rows and pieces of all pieces in words of one length; lists of bytes for unknown characters."""
    n, length = points.shape
    for start in range(length):
        code, open_ = np.zeros(n, np.uint64), np.arange(n)
        for end in range(start + 1, min(start + pieces.longest, length) + 1):
            code = _step(code, points[open_, end - 1])
            found, ids = pieces.find(code)
            rows = open_[found]
            longer = pieces.starts[pieces._cell(code)]
            code, open_ = code[longer], open_[longer]
            if end == start + 1 and len(rows) < n:
                unknown = np.ones(n, bool)
                unknown[rows] = False
                for point in np.unique(points[unknown, start]):
                    own = np.flatnonzero(unknown & (points[:, start] == point))
                    yield start, end, own, None, np.array(pieces.spelled(chr(point)), np.int64)
            if len(rows):
                yield start, end, rows, ids, None
            if not len(open_):
                break


def _weights(pieces: Pieces, ids, spelled) -> np.ndarray | float:
    return pieces.logs[ids] if spelled is None else float(pieces.logs[spelled].sum())


def _forward(pieces: Pieces, points: np.ndarray, keep: list | None = None) -> np.ndarray:
    n, length = points.shape
    forward = np.full((length + 1, n), -np.inf)
    forward[0] = 0.0
    for start, end, rows, ids, spelled in _edges(pieces, points):
        forward[end, rows] = np.logaddexp(forward[end, rows], forward[start, rows] + _weights(pieces, ids, spelled))
        if keep is not None:
            keep.append((start, end, rows, ids, spelled))
    return forward


def _grouped(words: Sequence[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and code points of words of one length."""
    by_length = defaultdict(list)
    for i, word in enumerate(words):
        by_length[len(word) + 1].append(i)
    for length, places in by_length.items():
        step = _ROWS if length <= _TOGETHER else max(1, _ROWS * _TOGETHER // (length * 16))
        for first in range(0, len(places), step):
            part = places[first:first + step]
            text = "".join(START + words[i] for i in part)
            yield np.array(part), np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, length)


def log_probabilities(pieces: Pieces, words: Sequence[str]) -> np.ndarray:
    """Natural logs of the summed probability of all segmentations of each word."""
    out = np.zeros(len(words))
    for places, points in _grouped(words):
        out[places] = _forward(pieces, points)[-1]
    return out


def expected_counts(pieces: Pieces, words: Sequence[str], counts: np.ndarray) -> np.ndarray:
    """How often each piece is expected in words that occur ``counts`` times."""
    out = np.zeros(len(pieces.logs))
    for places, points in _grouped(words):
        edges: list = []
        forward = _forward(pieces, points, edges)
        backward = np.full(forward.shape, -np.inf)
        backward[-1] = 0.0
        for start, end, rows, ids, spelled in reversed(edges):
            through = _weights(pieces, ids, spelled) + backward[end, rows]
            share = np.exp(forward[start, rows] + through - forward[-1, rows]) * counts[places[rows]]
            backward[start, rows] = np.logaddexp(backward[start, rows], through)
            if spelled is None:
                out += np.bincount(ids, share, minlength=len(out))
            else:
                np.add.at(out, spelled, share.sum())
    return out
