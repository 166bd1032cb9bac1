"""URL filter rules as glob patterns, matched for many URLs at once by a bit-parallel automaton."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nichegrid.llm.common import arrow, lower_ascii

#: Stands between host and path in canonical URLs and in patterns; a symbol that no text has.
BORDER = 256
_SYMBOLS = 257


@dataclass(frozen=True)
class Rule:
    """`host` and its subdomains, where the path matches `path` followed by anything.

    In the path, `*` stands for any run of bytes and `?` for one byte if `globbed`; otherwise both stand for
    themselves.
    """

    host: str
    path: str
    verdict: str
    globbed: bool = False

    @property
    def name(self) -> str:
        return self.host + self.path


class ShiftAnd:
    """All patterns in one row of 64-bit words; each text position costs a few operations on the row.

    A pattern is a list of symbols, where -1 is any run of symbols and -2 is any one symbol. Every pattern may be
    followed by anything: its last bit stays set once reached.
    """

    def __init__(self, patterns: Sequence[Sequence[int]]):
        bits: list[int] = []
        first, loops, self.last = [], set(), []
        for p in patterns:
            start = len(bits)
            leading = p[:1] == [-1]
            for s in p:
                if s == -1:
                    if len(bits) > start:
                        loops.add(len(bits) - 1)  # the bit before the star stays set
                else:
                    bits.append(s)
            first.append((start, leading))
            self.last.append(len(bits) - 1)
            loops.add(len(bits) - 1)
        width = max(1, -(-len(bits) // 64))
        self.accept = np.zeros((_SYMBOLS, width), np.uint64)
        self.always, self.once, self.stay = (np.zeros(width, np.uint64) for _ in range(3))
        self.starts = np.zeros(width, np.uint64)
        bit = lambda i: (i // 64, np.uint64(1) << np.uint64(i % 64))
        for i, s in enumerate(bits):
            w, b = bit(i)
            if s == -2:
                self.accept[:BORDER, w] |= b
            else:
                self.accept[s, w] |= b
        for start, leading in first:
            w, b = bit(start)
            self.starts[w] |= b
            (self.always if leading else self.once)[w] |= b
        for i in loops:
            w, b = bit(i)
            self.stay[w] |= b

    def run(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Which patterns match each text symbols[at[i]:at[i+1]]: a matrix of texts by patterns."""
        n = len(at) - 1
        state = np.zeros((n, len(self.starts)), np.uint64)
        lengths = np.diff(at)
        order = np.argsort(-lengths, kind="stable")
        live = np.searchsorted(-lengths[order], -np.arange(lengths.max(initial=0)), "left")
        own = np.zeros_like(state)
        for t, k in enumerate(live):
            if not k:
                break
            s = own[:k]
            moved = s << np.uint64(1)
            moved[:, 1:] |= s[:, :-1] >> np.uint64(63)
            moved &= ~self.starts
            moved |= self.always | (self.once if t == 0 else np.uint64(0))
            own[:k] = (moved & self.accept[symbols[at[order[:k]] + t]]) | (s & self.stay)
        state[order] = own
        return np.stack([(state[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1) for i in self.last], 1).astype(bool) if self.last else np.zeros((n, 0), bool)


def pattern(rule: Rule) -> list[int]:
    """`*.host`, the border, the path: canonical URLs begin with a dot, so that the host itself fits too."""
    wild = {ord("*"): -1, ord("?"): -2} if rule.globbed else {}
    return [-1, *b".", *rule.host.encode(), BORDER, *(wild.get(b, b) for b in rule.path.encode())]


def host_of(url: Column) -> Column:
    """What is between the first :// and the next / ? # or the end, A-Z lower-cased; empty for null or without ://."""
    return F.when(url.contains("://"), lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))).otherwise("")


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end; empty for null or without ://."""
    return F.when(url.contains("://"), F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)).otherwise("")


def judge(pages: DataFrame, rules: Sequence[Rule], default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict) for every row: the longest fitting rule's verdict, else `default`.

    Rows stay as they are, repeated ones too; a null or unparsable URL has an empty host and path, no rule and the
    default verdict. Of equally long rules the earlier one counts. A very long URL takes a step for each of its bytes.
    One pass, no shuffle; other columns aren't read, whatever their names. An empty table gives no rows.
    """
    machine = ShiftAnd([pattern(r) for r in rules])
    best = sorted(range(len(rules)), key=lambda i: (-len(rules[i].name), i))
    names = pa.array([rules[i].name for i in best] + [None], pa.string())
    verdicts = pa.array([rules[i].verdict for i in best] + [default], pa.string())

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            if not b.num_rows:
                continue
            hosts, paths = ([(x or "").encode() for x in b.column(c).to_pylist()] for c in ("host", "path"))
            lengths = np.array([len(h) + len(p) + 2 for h, p in zip(hosts, paths, strict=True)])
            symbols = np.frombuffer(b"".join(b"." + h + b"\0" + p for h, p in zip(hosts, paths, strict=True)), np.uint8).astype(np.int32)
            at = np.concatenate([[0], np.cumsum(lengths)])
            symbols[at[:-1] + 1 + np.array([len(h) for h in hosts])] = BORDER
            fits = machine.run(symbols, at)[:, best]
            won = np.where(fits.any(1), fits.argmax(1), len(best)) if len(best) else np.zeros(len(hosts), int)
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("host"), b.column("path"), names.take(pa.array(won)), verdicts.take(pa.array(won))], ["key", "host", "path", "rule", "verdict"])

    kind = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(F.col(id_col).alias("key"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    return arrow(rows, batches, f"key {kind}, host string, path string, rule string, verdict string").withColumnRenamed("key", id_col)
