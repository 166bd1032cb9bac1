"""Ranked lexical search over bit-sliced Bloom signatures.

Each document has a signature, a Bloom filter of its terms; documents of like size are put into a block, whose signatures
are stored by slices: a row of bits for each place of the filter, a bit for each document. The slices of a term, combined
by AND, are a bitmap of the documents that may hold it. A term is also posted under a tier for each of TIERS occurrences
that it has, so that the bitmaps bound how often it occurs. Sums of weights over the bitmaps are upper bounds of scores;
only what they don't exclude is scored by its text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from nichegrid.llm.common import arrow, cut
from nichegrid.llm.textkit import buffers, mix, prefix_hashes, span_hashes

#: A term with this many occurrences or more has an entry for the tier.
TIERS = (1, 2, 3, 5, 9)
#: Places of an entry; a signature has 8 to 16 bits for each entry.
HASHES = 4
#: Documents and bytes of a block, unless one signature is larger.
BLOCK_ROWS, BLOCK_BYTES = 1024, 1 << 20
#: Bits of the sieve of asked terms, and values of the sieve of candidates' keys.
TERM_BITS, KEY_VALUES = 1 << 20, 1 << 18
#: Terms of a block of items, about.
ITEM_TERMS = 1 << 16

_TERM = np.zeros(256, bool)
_TERM[0x80:] = _TERM[0x30:0x3A] = _TERM[0x41:0x5B] = _TERM[0x61:0x7B] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_TIER = mix(np.arange(1, len(TIERS) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def stretches(raw: np.ndarray, at: np.ndarray, most: int = 1 << 22) -> Iterator[tuple[int, int]]:
    """Borders of consecutive stretches of about `most` bytes that cut no term."""
    start, n = 0, len(raw)
    while start < n:
        end = min(n, start + most)
        if end < n:
            free = np.flatnonzero(~_TERM[raw[start:end]])
            border = max(int(at[np.searchsorted(at, end, "right") - 1]), start + int(free[-1]) + 1 if len(free) else 0)
            if border > start:
                end = border
            else:  # one term fills it
                limit = int(at[np.searchsorted(at, start, "right")])
                while end < limit:
                    free = np.flatnonzero(~_TERM[raw[end : min(limit, end + most)]])
                    if len(free):
                        end += int(free[0])
                        break
                    end = min(limit, end + most)
        yield start, end
        start = end


@dataclass
class Counts:
    """How often each text has each of its terms: entries by text, with the place of their term among `terms`."""

    text: np.ndarray
    term: np.ndarray
    tf: np.ndarray
    terms: pa.Array
    sizes: np.ndarray  # terms of each text, with repeats

    @staticmethod
    def of(texts: pa.Array) -> Counts:
        raw, at = buffers(texts)
        found: list[tuple[np.ndarray, pa.Array, np.ndarray]] = []
        for a, z in stretches(raw, at):
            part = _FOLD[raw[a:z]]
            inside = _TERM[part]
            new = np.ones(len(part) + 1, bool)  # whether a text begins here or what is before is in no term
            np.logical_not(inside[:-1], out=new[1:-1])
            new[at[np.searchsorted(at, a) : np.searchsorted(at, z, "right")] - a] = True
            starts = np.flatnonzero(inside & new[:-1])
            bytes_before = np.concatenate([[0], np.cumsum(inside)])
            offsets = np.append(bytes_before[starts], bytes_before[-1])
            words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(part[inside])]).dictionary_encode()
            m = max(1, len(words.dictionary))
            key, tf = np.unique((np.searchsorted(at, starts + a, "right") - 1) * m + words.indices.to_numpy(), return_counts=True)
            found.append((key // m, words.dictionary.take(pa.array(key % m)), tf))
            if len(found) == 1 and z == len(raw):
                text, term, terms = key // m, key % m, words.dictionary
        if len(found) > 1:
            words = pa.concat_arrays([w for _, w, _ in found]).dictionary_encode()
            m, terms = max(1, len(words.dictionary)), words.dictionary
            key, of = np.unique(np.concatenate([t for t, _, _ in found]) * m + words.indices.to_numpy(), return_inverse=True)
            text, term, tf = key // m, key % m, np.bincount(of, np.concatenate([n for _, _, n in found]), len(key)).astype(np.int64)
        if not found:
            text = term = tf = np.zeros(0, np.int64)
            terms = pa.array([], pa.large_binary())
        return Counts(text, term, tf, terms, np.bincount(text, tf, len(at) - 1).astype(np.int64))


def hashes(terms: pa.Array) -> np.ndarray:
    """A hash of each term; of one of over 64 KB by its first bytes and its length."""
    raw, at = buffers(terms)
    out = np.zeros(len(at) - 1, np.uint64)
    start = 0
    while start < len(out):  # about a megabyte at a time
        end = max(start + 1, int(np.searchsorted(at, at[start] + (1 << 20), "right")) - 1)
        sums = prefix_hashes(raw[at[start] : min(at[end], at[start] + (1 << 20))])
        first = at[start:end] - at[start]
        out[start:end] = span_hashes(sums, first, np.minimum(at[start + 1 : end + 1] - at[start], first + (1 << 16)))
        start = end
    return mix(out + np.diff(at).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def places(entries: np.ndarray, bits: int) -> np.ndarray:
    """The HASHES places of each entry in signatures of `bits` bits, a power of 2."""
    low, step = entries & np.uint64(0xFFFFFFFF), (entries >> np.uint64(32)) | np.uint64(1)
    return ((low[..., None] + step[..., None] * np.arange(HASHES, dtype=np.uint64)) & np.uint64(bits - 1)).astype(np.int64)


class Blocks:
    """Signatures that wait for their block, by the size of their filters."""

    def __init__(self) -> None:
        self.waiting: dict[int, list[tuple[int | None, int, int, np.ndarray]]] = {}

    def add(self, doc_id: int | None, key: int, n: int, entries: np.ndarray) -> Iterator[dict]:
        bits = 8 << max(4, (len(entries) - 1).bit_length())
        rows = self.waiting.setdefault(bits, [])
        rows.append((doc_id, key, n, entries))
        if len(rows) >= BLOCK_ROWS or bits * (len(rows) // 8 + 1) >= BLOCK_BYTES:
            yield self.block(bits)

    def block(self, bits: int) -> dict:
        rows = self.waiting.pop(bits)
        slices = np.zeros((bits, (len(rows) + 7) // 8), np.uint8)
        for i, (_, _, _, entries) in enumerate(rows):
            slices[places(entries, bits).ravel(), i >> 3] |= np.uint8(128 >> (i & 7))
        return {"ids": [r[0] for r in rows], "keys": [r[1] for r in rows], "sizes": [r[2] for r in rows], "bits": bits, "slices": slices.tobytes()}

    def rest(self) -> Iterator[dict]:
        for bits in list(self.waiting):
            yield self.block(bits)


def index(docs: DataFrame, sieve: np.ndarray) -> DataFrame:
    """Blocks (ids, keys, sizes, bits, slices) of all docs (doc_id, key, text) with a term; and in rows of their own (terms,
    dfs), how many documents of a task hold each term whose bit is set in `sieve`."""
    schema = pa.schema([("ids", pa.list_(pa.int64())), ("keys", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("bits", pa.int64()), ("slices", pa.binary()), ("terms", pa.list_(pa.string())), ("dfs", pa.list_(pa.int64()))])

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, df = Blocks(), Counter[bytes]()
        for batch in batches:
            c = Counts.of(batch["text"])
            h = hashes(c.terms)
            asked = sieve[(h & np.uint64(TERM_BITS - 1)).astype(np.int64)]
            holders = np.bincount(c.term, minlength=len(h))
            some = np.flatnonzero(asked)
            for term, n in zip(c.terms.take(pa.array(some)).to_pylist(), holders[some].tolist(), strict=True):
                df[term] += n
            level = np.searchsorted(TIERS, c.tf, "right")
            entries = mix(np.repeat(h[c.term], level) + _TIER[np.arange(int(level.sum())) - np.repeat(np.cumsum(level) - level, level)])
            text = np.repeat(c.text, level)
            first = np.searchsorted(text, np.arange(batch.num_rows + 1)).tolist()
            for i, (doc_id, key, n) in enumerate(zip(batch["doc_id"].to_pylist(), batch["key"].to_pylist(), c.sizes.tolist(), strict=True)):
                if n:
                    for block in blocks.add(doc_id, key, n, entries[first[i] : first[i + 1]]):
                        yield pa.RecordBatch.from_pylist([block], schema)
            if len(df) > 1 << 18:
                yield _counts(df, schema)
                df.clear()
        for block in blocks.rest():
            yield pa.RecordBatch.from_pylist([block], schema)
        if df:
            yield _counts(df, schema)

    return arrow(docs, f, "ids array<long>, keys array<long>, sizes array<long>, bits long, slices binary, terms array<string>, dfs array<long>")


def _counts(df: Counter[bytes], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{"terms": [t.decode() for t in df], "dfs": list(df.values())}], schema)


@dataclass
class Items:
    """A block of items: their distinct terms, and for each item the places and weights of its own; numbers of the corpus."""

    ids: list
    terms: list[bytes]
    own: list[np.ndarray]
    weights: list[np.ndarray]
    documents: int
    length: int

    def saturation(self, sizes: np.ndarray) -> np.ndarray:
        """m of documents with so many terms."""
        return 50 + (50 * sizes * self.documents) // self.length

    def bounds(self, sizes: np.ndarray, bits: int, slices: np.ndarray) -> np.ndarray:
        """Upper bounds of the scores of a block's documents: a row for each item."""
        n, m = len(sizes), self.saturation(sizes)
        most = [np.zeros(n, np.int64)]  # of a term of each level, at weight 1
        for upper in (*(t - 1 for t in TIERS[1:]), None):
            tf = sizes if upper is None else np.minimum(sizes, upper)
            most.append((1_000_000_000 * tf) // (1000 * tf + 20 * m))
        worth = np.empty((len(self.terms), n), np.int64)
        table, columns = np.stack(most), np.arange(n)
        for a in range(0, len(self.terms), 512):
            found = np.bitwise_and.reduce(slices[places(self.entries[a : a + 512], bits)], axis=2)
            level = np.unpackbits(np.bitwise_and.accumulate(found, axis=1), axis=2)[..., :n].sum(1)
            worth[a : a + 512] = table[level, columns]
        return np.stack([w @ worth[t] for t, w in zip(self.own, self.weights, strict=True)])

    @property
    def entries(self) -> np.ndarray:
        if not hasattr(self, "_entries"):
            self._entries = mix(hashes(pa.array(self.terms, pa.large_binary()))[:, None] + _TIER)
        return self._entries

    def scores(self, counts: Counts, asked: list[list[int]]) -> Iterator[tuple[int, int, int]]:
        """(text, item, score) for each text and each of its asked items."""
        place = pc.index_in(counts.terms, value_set=pa.array(self.terms, pa.large_binary()))
        place = pc.fill_null(place, -1).to_numpy(zero_copy_only=False)[counts.term]
        m = self.saturation(counts.sizes)
        first = np.searchsorted(counts.text, np.arange(len(asked) + 1))
        for i, items in enumerate(asked):
            own, tf = place[first[i] : first[i + 1]], counts.tf[first[i] : first[i + 1]]
            worth = np.zeros(len(self.terms), np.int64)
            worth[own[own >= 0]] = (1_000_000_000 * tf[own >= 0]) // (1000 * tf[own >= 0] + 20 * m[i])
            for item in items:
                yield i, item, int(self.weights[item] @ worth[self.own[item]])


def _blocks_of(batches: Iterator[pa.RecordBatch], items: Items) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray]]:
    """(ids, keys, bounds) of each block."""
    for batch in batches:
        for r in range(batch.num_rows):
            ids, keys, sizes = (batch[c][r].values for c in ("ids", "keys", "sizes"))
            bits = batch["bits"][r].as_py()
            slices = np.frombuffer(batch["slices"][r].as_buffer(), np.uint8).reshape(bits, -1)
            yield ids, keys, items.bounds(sizes.to_numpy(), bits, slices)


_CANDIDATE = "item int, doc_id long, key long, bound long"


def _candidates(item: np.ndarray, at: np.ndarray, ids: pa.Array, keys: pa.Array, bounds: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), ids.take(pa.array(at)), keys.take(pa.array(at)), pa.array(bounds, pa.int64())], ["item", "doc_id", "key", "bound"])


def most_promising(blocks: DataFrame, items: Items, k: int) -> DataFrame:
    """(item, doc_id, key, bound): for each item the k documents with the highest upper bounds."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for ids, keys, bounds in _blocks_of(batches, items):
            best = np.argpartition(-bounds, min(k, bounds.shape[1]) - 1, axis=1)[:, :k]
            at, item = best.ravel(), np.repeat(np.arange(len(bounds)), best.shape[1])
            value = bounds[item, at]
            new = pa.Table.from_batches([_candidates(item[value > 0], at[value > 0], ids, keys, value[value > 0])])
            held = new if held is None else pa.concat_tables([held, new])
            if held.num_rows > 4 * k * len(bounds):
                held = _first(held, k)
        if held is not None:
            yield from _first(held, k).to_batches()

    found = arrow(blocks, f, _CANDIDATE)
    place = F.row_number().over(W.partitionBy("item").orderBy(F.desc("bound"), "doc_id", "key"))
    return found.withColumn("place", place).where(F.col("place") <= k).drop("place")


def _first(t: pa.Table, k: int) -> pa.Table:
    """The k rows of each item with the highest bounds."""
    item, bound = t["item"].to_numpy(), t["bound"].to_numpy()
    order = np.lexsort((-bound, item))
    begins = np.searchsorted(item[order], item[order])
    return t.take(pa.array(order[np.arange(len(order)) - begins < k])).combine_chunks()


def not_excluded(blocks: DataFrame, items: Items, least: np.ndarray) -> DataFrame:
    """(item, doc_id, key, bound) of every document whose upper bound reaches the item's least score."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, keys, bounds in _blocks_of(batches, items):
            item, at = np.nonzero(bounds >= least[:, None])
            yield _candidates(item, at, ids, keys, bounds[item, at])

    return arrow(blocks, f, _CANDIDATE)


def rescored(docs: DataFrame, candidates: DataFrame, items: Items) -> DataFrame:
    """(item, doc_id, score) of the candidates by their whole texts. Only texts whose key is among a bounded number of values
    go to the join."""
    asked = cut(candidates.groupBy("doc_id", "key").agg(F.collect_set("item").alias("items")))
    value = lambda: F.pmod(F.col("key"), F.lit(KEY_VALUES)).cast("int").alias("value")
    values = asked.select(value()).distinct()  # at most KEY_VALUES rows
    texts = docs.withColumn("value", value()).join(F.broadcast(values), "value", "left_semi").alias("d")
    both = texts.join(asked.alias("c"), F.col("d.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("d.key") == F.col("c.key"))).select("d.doc_id", "d.text", "c.items")

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(items.scores(Counts.of(batch["text"]), batch["items"].to_pylist()))
            at, item, score = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), batch["doc_id"].take(pa.array(at, pa.int64())), pa.array(score, pa.int64())], ["item", "doc_id", "score"])

    return arrow(both, f, "item int, doc_id long, score long")


def terms_of(items: DataFrame) -> DataFrame:
    """(item_id, term, bit) for the distinct terms of each row; bit is its place in the sieve."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = Counts.of(batch["text"])
            bit = (hashes(c.terms) & np.uint64(TERM_BITS - 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch["item_id"].take(pa.array(c.text)), c.terms.take(pa.array(c.term)).cast(pa.string()), pa.array(bit[c.term], pa.int32())], ["item_id", "term", "bit"])

    rows = items.select("item_id", "text")
    return arrow(rows, f, f"item_id {rows.schema['item_id'].dataType.simpleString()}, term string, bit int")


def search(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents with the highest scores above 0 for each item, ties to the smaller
    doc_id, null ids last.

    Terms are the maximal runs of ASCII letters and digits and of other than ASCII characters, A-Z folded. A term weighs
    w = floor(1000 ln((2N + 2) / (2df + 1))); with m = 50 + 50nN div L, a document scores the sum of
    w * (10**9 tf div (1000 tf + 20 m)) over the item's terms. All documents count for N, L and df.

    Null and empty texts, and texts without a term, are no documents and no items' terms; an item without terms has no rows.
    Rows that repeat a doc_id, or a whole row, are documents each; rows that share an item_id are one item with the terms of
    all, those with a null id too. Texts may be of any length; a long one is counted in stretches and has a larger
    signature, stored in smaller blocks. Columns other than doc_id, item_id and text, whatever their names, are not read.
    Empty tables give no rows.

    A first pass over the blocks takes the k highest bounds of each item, whose documents are scored; the k-th of these
    scores excludes what has lower bounds in the second pass, and all else is scored. Items are worked off in blocks of about
    ITEM_TERMS terms, which go to the tasks that read the index.
    """
    spark = docs.sparkSession
    rows = docs.where("text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), "text")
    asked = cut(terms_of(items).distinct())
    sieve = np.zeros(TERM_BITS, bool)
    sieve[asked.select("bit").distinct().toArrow()["bit"].to_numpy()] = True
    stored = cut(index(rows, sieve))
    blocks = stored.where("slices IS NOT NULL").select("ids", "keys", "sizes", "bits", "slices")
    corpus = blocks.select(F.size("ids").alias("n"), F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x).alias("l")).agg(F.sum("n").alias("n"), F.sum("l").alias("l")).first()
    empty = spark.createDataFrame([], f"item_id {asked.schema['item_id'].dataType.simpleString()}, rank int, doc_id long, score long")
    if not corpus["n"]:
        return empty
    df = stored.where("terms IS NOT NULL").select(F.explode(F.arrays_zip("terms", "dfs")).alias("e")).groupBy(F.col("e.terms").alias("term")).agg(F.sum("e.dfs").alias("df"))
    weight = F.floor(F.lit(1000.0) * F.log((F.lit(2.0) * corpus["n"] + 2) / (F.lit(2.0) * F.coalesce("df", F.lit(0)) + 1))).cast("long")
    weighed = cut(asked.join(df, "term", "left").groupBy("item_id").agg(F.collect_list(F.struct("term", weight.alias("w"))).alias("terms")))
    total = weighed.agg(F.sum(F.size("terms")).alias("n")).first()["n"] or 0
    n_blocks = max(1, -(-total // ITEM_TERMS))
    out = empty
    for b in range(n_blocks):
        block = _items(weighed.where(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == b).toArrow(), corpus["n"], corpus["l"])
        if block.ids:
            out = out.unionByName(_ranked(rows, blocks, block, k, weighed.schema["item_id"].dataType.simpleString()))
    return out


def _items(t: pa.Table, documents: int, length: int) -> Items:
    terms: dict[bytes, int] = {}
    own, weights = [], []
    for row in t["terms"].to_pylist():
        own.append(np.array([terms.setdefault(x["term"].encode(), len(terms)) for x in row], np.int64))
        weights.append(np.array([x["w"] for x in row], np.int64))
    return Items(t["item_id"].to_pylist(), list(terms), own, weights, documents, length)


def _ranked(rows: DataFrame, blocks: DataFrame, items: Items, k: int, id_type: str) -> DataFrame:
    first = rescored(rows, most_promising(blocks, items, k), items)
    place = F.row_number().over(W.partitionBy("item").orderBy(F.desc("score")))
    kth = first.withColumn("place", place).where(F.col("place") == k).select("item", "score").toArrow()  # one row an item
    least = np.ones(len(items.ids), np.int64)
    least[kth["item"].to_numpy()] = np.maximum(1, kth["score"].to_numpy())
    found = rescored(rows, not_excluded(blocks, items, least), items).where("score > 0")
    rank = F.row_number().over(W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    best = cut(found.withColumn("rank", rank).where(F.col("rank") <= k))
    names = rows.sparkSession.createDataFrame(list(enumerate(items.ids)), f"item int, item_id {id_type}")
    return best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
