"""SentencePiece encoding and decoding by a max-plus scan.

A text is the sequence of its characters after a leading space, with U+2581 for spaces. The encoding is the
segmentation into pieces of the vocabulary with the highest sum of scores. A character without piece costs as much as
the worst piece and 10 more, and is written as its UTF-8 bytes. For a vocabulary of the BPE kind, whose scores are merge
ranks, a piece's score is its log-probability under a Zipf-Mandelbrot law of its rank; merges aren't replayed.

Giant documents are split into chunks. A boundary's state is by how many characters the piece on it reaches into the
next chunk. Each chunk gives a matrix of best scores from state to state; these are combined associatively in the
(max, +) algebra, which fixes the states, and then each chunk is traced back on its own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nichegrid.llm.common import arrow, cut
from nichegrid.llm.textkit import mix, pieces, powers

SPACE = 0x2581
#: Stands for a U+2581 of the text itself, which is not a space; no piece has it.
LITERAL = 0x110000
NEVER = -1e300
#: Ranks are as probable as 1 / (rank + FLAT): flat among the first, Zipf's law among the later ones.
FLAT = 1000
_SPLIT = re.compile(" *[^ ]+| +")


def _hashes(symbols: np.ndarray) -> np.ndarray:
    out = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum(mix(symbols.astype(np.uint64) + np.uint64(1)) * powers(len(symbols)), out=out[1:])
    return out


def log_probabilities(scores: list[float | None]) -> list[float | None]:
    """The scores, or, if they are ranks (different whole numbers down from 0 or less), log-probabilities of the ranks."""
    used = [s for s in scores if s is not None]
    if len(used) < 2 or len(set(used)) < len(used) or any(s > 0 or s != int(s) for s in used):
        return scores
    total = np.log(np.sum(1 / (FLAT - np.array(used))))
    return [None if s is None else float(-np.log(FLAT - s) - total) for s in scores]


@dataclass
class Vocabulary:
    """Pieces with their scores (None: not for encoding), by id."""

    pieces: list[str]
    scores: list[float | None]
    bytes_: dict[int, int] = field(default_factory=dict)  # byte to id
    unknown: int = 0

    @staticmethod
    def load(path: str) -> Vocabulary:
        """From a SentencePiece model file; the driver reads it. Pieces that the model sets aside by a score of -1e8 or
        less are left to decoding."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        texts = [sp.id_to_piece(i) for i in range(n)]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i) for i in range(n)]
        scores = log_probabilities([None if special[i] or sp.get_score(i) <= -1e8 else sp.get_score(i) for i in range(n)])
        return Vocabulary(texts, scores, {int(t[3:5], 16): i for i, t in enumerate(texts) if sp.is_byte(i)}, sp.unk_id())

    @cached_property
    def longest(self) -> int:
        return max((len(p) for p, s in zip(self.pieces, self.scores, strict=True) if s is not None), default=1)

    @cached_property
    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted hashes of all beginnings of pieces, with the piece's id (-1: only a beginning) and score."""
        found: dict[int, tuple[int, float]] = {}
        for i, (p, s) in enumerate(zip(self.pieces, self.scores, strict=True)):
            if s is None or not p:
                continue
            h = _hashes(np.array([ord(c) for c in p], np.uint32))
            for k in range(1, len(p)):
                found.setdefault(int(h[k]), (-1, NEVER))
            found[int(h[len(p)])] = (i, s)
        keys = np.array(sorted(found), np.uint64)
        return keys, np.array([found[k][0] for k in keys.tolist()], np.int64), np.array([found[k][1] for k in keys.tolist()])

    @cached_property
    def slots(self) -> np.ndarray:
        """For the upper 20 bits of a hash, where its keys begin."""
        return np.searchsorted(self.tables[0], np.arange(1 << 20, dtype=np.uint64) << np.uint64(44)).astype(np.int64)

    @cached_property
    def deepest(self) -> int:
        """The most keys in one slot."""
        return int(np.diff(np.append(self.slots, len(self.tables[0]))).max())

    @cached_property
    def word_cuts(self) -> bool:
        """Whether no piece has a space after another character: then pieces never cross into the next word."""
        return not any(s is not None and re.search("[^▁]▁", p) for p, s in zip(self.pieces, self.scores, strict=True))

    @cached_property
    def fallback(self) -> float:
        return min((s for s in self.scores if s is not None), default=0.0) - 10

    @cached_property
    def spelled(self) -> list[bytes]:
        """What each id stands for in a decoded text."""
        out = [p.replace("▁", " ").encode() for p in self.pieces]
        for b, i in self.bytes_.items():
            out[i] = bytes([b])
        return out

    def spell(self, symbol: int) -> list[int]:
        """Ids of a character without piece."""
        return [self.bytes_.get(b, self.unknown) for b in chr({LITERAL: SPACE, SPACE: 32}.get(symbol, symbol)).encode("utf-8", "surrogatepass")]

    def decode(self, ids: np.ndarray) -> bytes:
        """The text's UTF-8 bytes, without the leading space."""
        return b"".join(map(self.spelled.__getitem__, ids.tolist()))[1:]

    def matches(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(score, id) of the piece of each length from 1 at each place; NEVER where there is none."""
        keys, ids, scores = self.tables
        n, width = len(symbols), self.longest
        score, which = np.full((n, width), NEVER), np.full((n, width), -1, np.int32)
        prefix = _hashes(symbols)
        back = powers(n + 1, inverse=True)
        at = np.arange(n)
        for k in range(1, width + 1):
            at = at[at + k <= n]
            h = (prefix[at + k] - prefix[at]) * back[at]
            slot = self.slots[(h >> np.uint64(44)).astype(np.int64)]
            hit = np.full(len(at), -1)
            for _ in range(self.deepest):
                ok = (slot < len(keys)) & (hit < 0)
                some = np.flatnonzero(ok)
                same = keys[slot[some]] == h[some]
                hit[some[same]] = slot[some[same]]
                slot = slot + 1
                if not (keys[np.minimum(slot, len(keys) - 1)] >> np.uint64(44) == h >> np.uint64(44)).any():
                    break
            live = hit >= 0
            at, hit = at[live], hit[live]
            score[at, k - 1], which[at, k - 1] = scores[hit], ids[hit]
        bare = score[:, 0] == NEVER
        score[bare, 0] = self.fallback
        return score, which

    def encode(self, texts: list[np.ndarray]) -> list[np.ndarray]:
        """Ids of each sequence of symbols."""
        if not texts:
            return []
        ids, at = self.encode_flat(np.concatenate(texts), np.array([len(t) for t in texts]))
        return np.split(ids, at[1:-1])

    def encode_flat(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the sequences of these lengths, and where each one's ids begin: Viterbi, all sequences a character
        at a time."""
        at = np.concatenate([[0], np.cumsum(lengths)])
        score, which = self.matches(symbols)
        order = np.argsort(-lengths, kind="stable")
        start, own = at[:-1][order], lengths[order]
        shift = start + order  # place p of sequence i is at start + p + i
        best = np.full(len(symbols) + len(lengths), NEVER)
        best[shift] = 0.0
        step = np.zeros(len(best), np.int32)
        for t in range(1, int(own.max(initial=0)) + 1):
            k = int(np.searchsorted(-own, -t, "right"))
            top, taken = np.full(k, NEVER), np.zeros(k, np.int32)
            for size in range(1, min(t, self.longest) + 1):
                s = score[start[:k] + t - size, size - 1]
                some = np.flatnonzero(s > NEVER)
                new = best[shift[some] + t - size] + s[some]
                up = new > top[some]
                top[some[up]], taken[some[up]] = new[up], size
            best[shift[:k] + t], step[shift[:k] + t] = top, taken
        sizes = np.zeros(len(symbols), np.int32)
        here, base, first = lengths.copy(), at[:-1] + np.arange(len(lengths)), at[:-1]
        live = np.flatnonzero(here)
        while len(live):  # back from every end at once
            k = step[base[live] + here[live]]
            here[live] -= k
            sizes[first[live] + here[live]] = k
            live = live[here[live] > 0]
        begin = np.flatnonzero(sizes)
        ids = which[begin, sizes[begin] - 1]
        bare = np.flatnonzero(ids < 0)
        spelled = [self.spell(int(c)) for c in symbols[begin[bare]]]
        counts = np.ones(len(ids), np.int64)
        counts[bare] = [len(x) for x in spelled]
        out = np.repeat(ids, counts)
        out[out < 0] = [i for x in spelled for i in x]
        return out, np.concatenate([[0], np.cumsum(counts)])[np.searchsorted(begin, at)]

    def best(self, symbols: np.ndarray) -> float:
        """The highest score of a sequence."""
        return float(self.transfer(symbols, len(symbols))[0, 0])

    def transfer(self, symbols: np.ndarray, n: int) -> np.ndarray:
        """Best scores from state to state of a chunk: symbols[:n], with what follows as far as a piece can reach.

        State s before the chunk: its first s characters belong to an earlier piece.
        """
        w = self.longest
        cuts = np.flatnonzero((symbols[1 : n + 1] == SPACE) & (symbols[:-1][: len(symbols[1 : n + 1])] != SPACE)) + 1 if self.word_cuts else []
        if len(cuts) > 2 and cuts[0] < cuts[-1]:  # all segmentations pass through the first and the last border of words
            a, z = int(cuts[0]), int(cuts[-1])
            head = self._between(symbols[:a], a, w)[:, :1]
            tail = self._between(symbols[z:], n - z, 1)
            words = np.split(symbols[a:z], cuts[1:-1] - a)
            return head + self._sum(words) + tail
        return self._between(symbols, n, w)

    def _sum(self, words: list[np.ndarray]) -> float:
        """The sum of the best scores of sequences."""
        ids = self.encode(words)
        total = 0.0
        for i in ids:
            total += self._score(i)
        return total

    @cached_property
    def _of_id(self) -> np.ndarray:
        out = np.array([0.0 if s is None else s for s in self.scores])
        # the bytes of a character share its cost: its first byte bears it
        for b, i in self.bytes_.items():
            out[i] = self.fallback if b < 0x80 or b >= 0xC0 else 0.0
        out[self.unknown] = self.fallback
        return out

    def _score(self, ids: np.ndarray) -> float:
        return float(self._of_id[ids].sum())

    def _between(self, symbols: np.ndarray, n: int, states: int) -> np.ndarray:
        w = self.longest
        score, _ = self.matches(symbols[: n + w - 1])
        best = np.full((states, n + 2 * w), NEVER)
        best[np.arange(states), np.arange(states)] = 0.0
        for p in range(n):
            here = best[:, p : p + 1]
            if here.max() > NEVER / 2:
                part = score[p]
                np.maximum(best[:, p + 1 : p + 1 + w], here + part, out=best[:, p + 1 : p + 1 + w])
        out = best[:, n : n + w].copy()
        out[out < NEVER / 2] = NEVER
        return out


def combined(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The product of two matrices in the (max, +) algebra."""
    out = (x[:, :, None] + y[None, :, :]).max(1)
    out[out < NEVER / 2] = NEVER
    return out


def states(matrices: list[np.ndarray]) -> list[int]:
    """The state at each border, the outer ones included, of the best way through all chunks.

    Products are formed in a balanced tree; from its root down, each product's inner state follows from its outer
    ones.
    """
    n = len(matrices)
    out = [0] * (n + 1)
    tree: dict[tuple[int, int], np.ndarray] = {}

    def build(a: int, z: int) -> np.ndarray:
        m = matrices[a] if z - a == 1 else combined(build(a, (a + z) // 2), build((a + z) // 2, z))
        tree[a, z] = m
        return m

    def settle(a: int, z: int) -> None:
        if z - a > 1:
            mid = (a + z) // 2
            out[mid] = int((tree[a, mid][out[a]] + tree[mid, z][:, out[z]]).argmax())
            settle(a, mid)
            settle(mid, z)

    build(0, n)
    settle(0, n)
    return out


def symbols_of(text: str) -> np.ndarray:
    """The symbols of a text, with the leading space."""
    s = np.frombuffer((" " + text).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    space, literal = s == 32, s == SPACE
    s[space], s[literal] = SPACE, LITERAL
    return s


class Encoder:
    """Encodes whole texts; words seen before are looked up, as pieces don't cross words."""

    def __init__(self, vocabulary: Vocabulary, most: int = 300_000):
        self.v, self.most = vocabulary, most
        self.known: dict[str, bytes] = {}

    def texts(self, texts: list[str]) -> list[np.ndarray]:
        if not self.v.word_cuts:
            return self.v.encode([symbols_of(t) for t in texts])
        split = [(" " + t).split(" ")[1:] if "  " not in t and t[-1:] != " " and t[:1] != " " and t else _SPLIT.findall(" " + t) for t in texts]
        split = [s if not s or s[0][:1] == " " else [" " + w for w in s] for s in split]
        new = list({w for s in split for w in s} - self.known.keys())
        if len(self.known) + len(new) > self.most:
            self.known = {}
            new = list({w for s in split for w in s})
        if new:
            ids, at = self.v.encode_flat(symbols_of("".join(new)[1:]), np.array([len(w) for w in new]))
            raw, at = ids.astype(np.int32).tobytes(), (at * 4).tolist()
            self.known.update(zip(new, map(raw.__getitem__, map(slice, at[:-1], at[1:])), strict=True))
        return [np.frombuffer(b"".join(map(self.known.__getitem__, s)), np.int32) for s in split]


def encode(docs: DataFrame, model: str, giant: int = 1 << 16, chunk: int = 1 << 14, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids, round_trip) for every row of docs: token ids of the whole text, and whether decoding them gives
    the text again.

    model is the path of a SentencePiece model, read by the driver and broadcast (its size is that of a vocabulary
    file). Null is an empty text; an empty text is a lone leading space. Of equally good segmentations either may
    come. Texts of more than `giant` characters are split into chunks of `chunk`, on which tasks work independently;
    repeated rows stay; other columns of docs are not read; an empty table gives no rows.
    """
    v = Vocabulary.load(model)
    if chunk <= v.longest:
        raise ValueError("chunk must be longer than the longest piece")
    shared = docs.sparkSession.sparkContext.broadcast(v)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_tokens long, ids array<int>, round_trip boolean"
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def small(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = Encoder(shared.value)
        for whole in it:
            for b in pieces(whole, "text"):
                texts = b.column("text").to_pylist()
                ids = e.texts(texts)
                at = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                ok = [e.v.decode(x) == t.encode() for x, t in zip(ids, texts, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(np.diff(at).astype(np.int64)), pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(ids))), pa.array(ok, pa.bool_())], ["id", "n_tokens", "ids", "round_trip"])

    short = arrow(base.where(F.length("text") <= giant), small, schema)
    # a part repeats the characters after it that a piece from it can reach
    long = base.where(F.length("text") > giant).withColumn("key", F.xxhash64("id", "text"))

    def chunks(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            for b in pieces(whole, "text"):
                for i, text in enumerate(b.column("text").to_pylist()):
                    n = -(-len(text) // chunk)
                    for a in range(0, n, 64):
                        no = range(a, min(n, a + 64))
                        own = pa.array([i] * len(no), pa.int64())
                        cut_ = [text[x * chunk : x * chunk + chunk + v_longest] for x in no]
                        yield pa.RecordBatch.from_arrays([b.column("id").take(own), b.column("key").take(own), pa.array(no, pa.int32()), pa.array([n] * len(no), pa.int64()), pa.array(cut_, pa.string())], ["id", "key", "no", "parts", "text"])

    v_longest = v.longest
    parts = arrow(long.select("id", "key", "text"), chunks, f"id {kind}, key long, no int, parts long, text string")
    parts = cut(parts.repartition("key", "no"))

    def part(row: dict) -> tuple[np.ndarray, int]:
        s = symbols_of(row["text"])
        s = s if row["no"] == 0 else s[1:]
        last = row["no"] == row["parts"] - 1
        return s, len(s) if last else chunk + (row["no"] == 0)

    def transfers(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            m = [shared.value.transfer(*part(r)).tobytes() for r in b.to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("key"), b.column("no"), pa.array(m, pa.binary())], ["id", "key", "no", "m"])

    gathered = arrow(parts, transfers, f"id {kind}, key long, no int, m binary").groupBy("id", "key").agg(F.array_sort(F.collect_set(F.struct("no", "m"))).alias("ms"))

    def scanned(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            own, rows = [], []
            for i, ms in enumerate(b.column("ms").to_pylist()):
                s = states([np.frombuffer(x["m"]).reshape(v_longest, v_longest) for x in ms])
                rows += [(no, s[no], s[no + 1]) for no in range(len(ms))]
                own += [i] * len(ms)
            at = pa.array(own, pa.int64())
            c = list(zip(*rows, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([b.column("id").take(at), b.column("key").take(at), *(pa.array(x, pa.int32()) for x in c)], ["id", "key", "no", "before", "after"])

    borders = arrow(gathered, scanned, f"id {kind}, key long, no int, before int, after int").select(F.col("id").alias("_id"), F.col("key").alias("_key"), F.col("no").alias("_no"), "before", "after")
    placed = parts.join(borders, (F.col("key") == F.col("_key")) & (F.col("no") == F.col("_no")) & F.col("id").eqNullSafe(F.col("_id"))).drop("_id", "_key", "_no")

    def traced(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for b in it:
            out = []
            for r in b.to_pylist():
                s, n = part(r)
                s = s[r["before"] : n + r["after"]]
                cuts = np.flatnonzero((s[1:] == SPACE) & (s[:-1] != SPACE)) + 1 if v.word_cuts else []
                ids = np.concatenate(v.encode(np.split(s, cuts)))
                whole = np.where(s == SPACE, 32, np.where(s == LITERAL, SPACE, s)).astype(np.uint32).tobytes().decode("utf-32-le").encode()
                out.append((ids, b"".join(map(v.spelled.__getitem__, ids.tolist())) == whole))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("key"), b.column("no"), pa.array([x for x, _ in out], pa.list_(pa.int32())), pa.array([x for _, x in out], pa.bool_())], ["id", "key", "no", "ids", "ok"])

    done = arrow(placed, traced, f"id {kind}, key long, no int, ids array<int>, ok boolean")
    # rows that repeat an id and its text have each part several times over
    whole = done.groupBy("id", "key", "no").agg(F.min("ids").alias("ids"), F.bool_and("ok").alias("ok"), F.count("*").alias("times"))
    whole = whole.groupBy("id", "key").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("no", "ids"))), lambda x: x["ids"])).alias("ids"), F.bool_and("ok").alias("ok"), F.first("times").alias("times"))
    large = whole.select("id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.col("ok").alias("round_trip"), F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).drop("col")
    return short.unionByName(large).withColumnRenamed("id", id_col)
