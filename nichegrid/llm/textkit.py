"""Vectorised text work on Arrow string columns: word borders and polynomial hashes of byte spans.

All hashes are polynomials over bytes modulo 2**64 with random byte values and an odd base, so that the hash of any
span follows from two prefix values. They serve to find equal spans; callers that must be exact compare the spans.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C13  # 3 modulo 4, so that swapped letters lose few bits
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(20240611).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_tables: dict[str, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """base**0 to base**(n-1) modulo 2**64, or those of its inverse."""
    key = "i" if inverse else "p"
    if key not in _tables or len(_tables[key]) < n:
        steps = np.full(max(n, 1 << 16), _INVERSE if inverse else _BASE, np.uint64)
        steps[0] = 1
        _tables[key] = np.cumprod(steps)
    return _tables[key][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit (the finaliser of SplitMix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """p with p[e] - p[s] = base**s times the hash of data[s:e]."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers(len(data)), out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Position-free hashes of the spans; add the lengths where they can differ."""
    return (prefix[ends] - prefix[starts]) * powers(len(prefix), inverse=True)[starts]


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and the offsets of each; a null is an empty text."""
    texts = texts.cast(pa.large_binary()) if not pa.types.is_large_binary(texts.type) else texts
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def pieces(batch: pa.RecordBatch, column: str, most: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """Slices of the batch with about `most` bytes of text each; one longer text is a slice of its own."""
    if not batch.num_rows:
        return
    _, at = buffers(batch.column(column))
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(at, at[start] + most, "right")) - 1)
        yield batch.slice(start, end - start)
        start = end


def stretches(raw: np.ndarray, at: np.ndarray, most: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Borders of consecutive stretches of the bytes of some texts, of about `most` bytes, that cut no word."""
    start, n = 0, len(raw)
    while start < n:
        end = min(n, start + most)
        while end < n and not _SPACE[raw[end - 1]]:
            space = np.flatnonzero(_SPACE[raw[end : end + most]])
            border = at[np.searchsorted(at, end)]  # the last one is n
            end = min(int(border), end + int(space[0]) + 1 if len(space) else min(n, end + most))
            if end == border:
                break
        yield start, end
        start = end


def _word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool) -> np.ndarray:
    """Hashes of the words of a stretch; a stretch longer than usual is mostly one word, which is hashed in parts."""
    size = (ends - starts).astype(np.uint64) * np.uint64(_BASE)
    step = 1 << 19
    if len(raw) <= step:
        return mix(span_hashes(prefix_hashes(_FOLD[raw] if fold else raw), starts, ends) + size)
    out = np.zeros(len(starts), np.uint64)
    for i, (s, e) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
        for a in range(s, e, step):
            part = raw[a : min(e, a + step)]
            out[i] += prefix_hashes(_FOLD[part] if fold else part)[-1] * np.uint64(pow(_BASE, a - s, 1 << 64))
    return mix(out + size)


class Words:
    """Borders and hashes of the words of some texts; words are separated by ASCII white space.

    The bytes are worked off in stretches, so that a very long text takes some bytes a word and not a byte.
    """

    def __init__(self, texts: pa.Array, fold: bool = True, hashes: bool = True):
        """fold: A-Z count as a-z. firsts[i]:firsts[i+1] are the words of text i."""
        self.raw, self.at = buffers(texts)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray | None]] = []
        for a, z in stretches(self.raw, self.at):
            raw = self.raw[a:z]
            inside = ~_SPACE[raw]
            new = np.empty(len(raw) + 1, bool)  # whether a place begins a text or follows white space
            new[0] = new[-1] = True
            np.logical_not(inside[:-1], out=new[1:-1])
            after = np.empty(len(raw) + 1, bool)  # whether a place is white space or begins a text
            np.logical_not(inside, out=after[:-1])
            after[-1] = True
            border = self.at[np.searchsorted(self.at, a) : np.searchsorted(self.at, z, "right")] - a
            new[border] = after[border] = True
            starts = np.flatnonzero(inside & new[:-1])
            ends = np.flatnonzero(inside & after[1:]) + 1
            found.append((starts + a, ends + a, _word_hashes(raw, starts, ends, fold) if hashes else None))
        self.starts, self.ends = (np.concatenate([x[i] for x in found]) if found else np.zeros(0, np.int64) for i in (0, 1))
        if hashes:
            self.hashes = np.concatenate([x[2] for x in found]) if found else np.zeros(0, np.uint64)
        self.firsts = np.searchsorted(self.starts, self.at)

    def shingles(self, text: int, n: int) -> np.ndarray:
        """Sorted distinct hashes of the n-word sequences of one text; of all its words if they are fewer."""
        w = self.hashes[self.firsts[text] : self.firsts[text + 1]]
        return np.unique(sequences(w, min(n, len(w)))) if len(w) else w


def sequences(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words."""
    out = np.full(max(0, len(words) - n + 1), n, np.uint64)
    for i, factor in enumerate(powers(n + 1)[1:]):
        out += words[i : i + len(out)] * factor
    return mix(out)
