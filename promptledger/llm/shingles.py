"""Hashed word shingles of whole texts, many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text hashed at once; a longer text is cut at white space and its words are joined again.
PIECE = 1 << 18
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_FOLD = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _tables() -> tuple[np.ndarray, np.ndarray]:
    value = mix(np.arange(1, 257, dtype=np.uint64) * _MULTIPLIER)
    value[ord("A") : ord("Z") + 1] = value[ord("a") : ord("z") + 1]
    space = np.zeros(256, bool)
    space[[32, *range(9, 14)]] = True
    return value, space


class WordHasher:
    """Hashes of words (A-Z lower-cased) by prefix sums of a polynomial modulo 2 ** 64."""

    def __init__(self) -> None:
        self.value, self.space = _tables()
        self.power = self.inverse = np.ones(1, np.uint64)

    def _grow(self, size: int) -> None:
        if len(self.power) < size:
            base = int(_MULTIPLIER) | 1
            for name, step in (("power", base), ("inverse", pow(base, -1, 1 << 64))):
                made = np.full(size, np.uint64(step), np.uint64)
                made[0] = 1
                setattr(self, name, np.cumprod(made, dtype=np.uint64))

    def words(self, data: np.ndarray, doc_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hash and place of each word in UTF-8 bytes; no word goes beyond a start in ``doc_starts``."""
        n = len(data)
        if not n:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        self._grow(n)
        gap = self.space[data]
        cut = np.zeros(n + 1, bool)
        cut[doc_starts] = True
        cut[n] = True
        first = np.flatnonzero(~gap & (np.r_[True, gap[:-1]] | cut[:-1]))
        end = np.flatnonzero(~gap & (np.r_[gap[1:], True] | cut[1:])) + 1
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(self.value[data] * self.power[:n], out=total[1:])
        h = (total[end] - total[first]) * self.inverse[first]
        return mix(h + (end - first).astype(np.uint64) * _FOLD), first


def _fold(parts: list[np.ndarray]) -> np.ndarray:
    out = mix(parts[0] + np.uint64(len(parts)))
    for part in parts[1:]:
        out = mix(out * _FOLD + part)
    return out


def _cuts(data: np.ndarray, space: np.ndarray) -> Iterator[np.ndarray]:
    """One long text in pieces that end at white space."""
    at = 0
    while at < len(data):
        end = at + PIECE
        while end < len(data) and not (found := np.flatnonzero(space[data[end : end + PIECE]])).size:
            end += PIECE
        end = len(data) if end >= len(data) else end + int(found[0])
        yield data[at:end]
        at = end


def shingle_sets(texts: pa.Array, size: int, hasher: WordHasher) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For stretches of rows: first row, number of rows, and the distinct shingles of all (row in the stretch, hash), sorted by both.

    A text with fewer words than ``size`` has its whole sequence as one shingle; without words, or null, it has none.
    """
    texts = texts.cast(pa.large_binary()) if pa.types.is_binary(texts.type) else texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.empty(0, np.uint8)
    row = 0
    while row < len(texts):
        upto = max(row + 1, int(np.searchsorted(offsets, offsets[row] + PIECE, "right")) - 1)
        upto = min(upto, len(texts))
        part = data[offsets[row] : offsets[upto]]
        if len(part) > PIECE:
            h = np.concatenate([hasher.words(p, np.zeros(1, np.int64))[0] for p in _cuts(part, hasher.space)])
            doc = np.zeros(len(h), np.int64)
        else:
            starts = offsets[row:upto] - offsets[row]
            h, place = hasher.words(part, starts[starts < len(part)])
            doc = np.searchsorted(starts, place, "right") - 1
        rows, words = upto - row, len(h)
        if words >= size:
            whole = np.flatnonzero(doc[: words - size + 1] == doc[size - 1 :])
            tokens, owner = _fold([h[whole + j] for j in range(size)]), doc[whole]
        else:
            tokens, owner = np.empty(0, np.uint64), np.empty(0, np.int64)
        count = np.bincount(doc, minlength=rows)
        short = np.flatnonzero((count > 0) & (count < size))
        if len(short):
            begin = np.searchsorted(doc, short)
            extra = [_fold([h[b + j : b + j + 1] for j in range(count[d])]) for d, b in zip(short, begin, strict=True)]
            tokens, owner = np.concatenate([tokens, *extra]), np.concatenate([owner, short])
        order = np.lexsort((tokens, owner))
        tokens, owner = tokens[order], owner[order]
        new = np.r_[True, (tokens[1:] != tokens[:-1]) | (owner[1:] != owner[:-1])][: len(tokens)]
        yield row, rows, owner[new], tokens[new]
        row = upto
