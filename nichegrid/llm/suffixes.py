"""Suffix-array dedup: removal of every byte covered by a long enough string that also starts elsewhere.

Each string (window) of `length` bytes is represented by one anchor inside it: the position of the least hash of
CORE bytes, the leftmost of equals. Equal windows have their anchors at the same offset, so they meet under the hash
of the anchor's core, wherever they start. What an anchor stands for is a run of windows [pos - hi, pos - lo].

1. Anchors with equal contexts (all bytes that their windows cover) are a class; two members stand for it.
2. The contexts of a core's classes are suffix-sorted by prefix hashes (`common`, `sorted_suffixes`), from the anchor to
   the right and to the left; neighbours in the two sorted orders bound what each can share, and the windows within
   the bounds are told equal by hash and compared byte by byte.
3. A core with more than GROUP classes is split by more of the text: its runs of windows are cut into narrower ones, and
   those that agree in the bytes that all their windows cover are a group of their own, again and again, down to single
   windows.
4. What is found for a class holds for all its members.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nichegrid.llm.common import arrow, cut
from nichegrid.llm.textkit import buffers, mix, pieces, powers, prefix_hashes, span_hashes

#: Bytes of an anchor's core, and classes of a core that one task sorts at most.
CORE, GROUP = 64, 2000
_INDEX = np.uint64((1 << 26) - 1)
#: Window starts handled at once; the index must fit beside a hash.
_STRETCH = 1 << 18


def runs(raw: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first, last, core hash) for each run of windows of the bytes that have one anchor.

    A window starts at first..last; borders of texts aren't known here.
    """
    width = length - CORE + 1
    prefix = prefix_hashes(raw)
    at = np.arange(len(raw) - CORE + 1)
    h = mix(span_hashes(prefix, at, at + CORE))
    keys = np.full(-(-len(h) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    keys[: len(h)] = (h & ~_INDEX) | at.astype(np.uint64)
    blocks = keys.reshape(-1, width)
    left = np.minimum.accumulate(blocks, 1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    n = len(raw) - length + 1
    where = (np.minimum(right[:n], left[width - 1 : width - 1 + n]) & _INDEX).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]]))
    last = np.concatenate([first[1:] - 1, [n - 1]])
    return where[first], first, last, h[where[first]]


def anchors(text: memoryview, length: int) -> Iterator[tuple[int, int, int, int, bytes]]:
    """(pos, lo, hi, core hash, hash of all that the windows cover) of one text."""
    for start in range(0, len(text) - length + 1, _STRETCH):
        raw = np.frombuffer(text[start : start + _STRETCH + length - 1], np.uint8)
        for p, a, z, h in zip(*(x.tolist() for x in runs(raw, length)), strict=True):
            yield start + p, p - z, p - a, h, xxhash.xxh3_128_digest(b"%d,%d:" % (p - z, p - a) + text[start + a : start + z + length])


def common(raw: np.ndarray, prefix: np.ndarray, x: np.ndarray, y: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Lengths of the common extensions of the suffixes x and y, at most `most`: binary search over prefix hashes."""
    low, high = np.zeros_like(most), most.copy()
    back = powers(len(prefix), inverse=True)
    ix, iy, px, py = back[x], back[y], prefix[x], prefix[y]
    for _ in range(int(most.max(initial=0)).bit_length()):
        mid = (low + high + 1) // 2
        same = (prefix[x + mid] - px) * ix == (prefix[y + mid] - py) * iy
        low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
    return low


def sorted_suffixes(raw: np.ndarray, starts: np.ndarray, limits: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the suffixes raw[start:start+limit] within each group, and each one's common length with the next.

    group must be sorted. A bottom-up mergesort: at each level all elements search their place in the sibling run at
    once, by comparisons that take a binary search over prefix hashes each. A shorter suffix comes before those that
    it begins; equal ones keep their order. The common length is -1 at the end of a group.
    """
    n = len(starts)
    prefix = prefix_hashes(raw)
    begin = np.searchsorted(group, group, "left")
    end = np.searchsorted(group, group, "right")

    def less(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        most = np.minimum(limits[x], limits[y])
        k = common(raw, prefix, starts[x], starts[y], most)
        cut_ = k == most
        at = np.where(cut_, 0, k)
        return np.where(cut_, limits[x] < limits[y], raw[np.where(cut_, 0, starts[x] + at)] < raw[np.where(cut_, 0, starts[y] + at)])

    order, slot, width = np.arange(n), np.arange(n), 1
    while ((begin // width) != ((end - 1) // width)).any():  # until no group is spread over runs
        run = slot // width
        sibling = np.minimum((run ^ 1) * width, n)
        last = np.minimum(sibling + width, n)
        own_begin, own_end = begin[slot], end[slot]  # a group always holds the same slots
        low, high = np.clip(own_begin, sibling, last), np.clip(own_end, sibling, last)
        right = run % 2 == 1
        live = np.flatnonzero(low < high)
        while len(live):
            mid = (low[live] + high[live]) // 2
            me, other = order[live], order[mid]
            r = right[live]
            # of equals, those of the left run come first
            after = np.where(r, ~less(np.where(r, me, other), np.where(r, other, me)), less(np.where(r, me, other), np.where(r, other, me)))
            low[live] = np.where(after, mid + 1, low[live])
            high[live] = np.where(after, high[live], mid)
            live = live[low[live] < high[live]]
        start = np.minimum(run * width, sibling)
        to = start + (slot - run * width) + (low - sibling)
        out = np.empty_like(order)
        out[to] = order
        order, width = out, width * 2
    lengths = np.full(n, -1, np.int64)
    inner = np.flatnonzero(group[:-1] == group[1:])
    x, y = order[inner], order[inner + 1]
    lengths[inner] = common(raw, prefix, starts[x], starts[y], np.minimum(limits[x], limits[y]))
    return order, lengths


def _nearest(order: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each suffix's longest common length with any other of its group: that of a neighbour in the order."""
    out = np.empty_like(lengths)
    out[order] = np.maximum(lengths, np.concatenate([[-1], lengths[:-1]]))
    return out


def shared_windows(contexts: list[bytes], lo: np.ndarray, hi: np.ndarray, group: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index, first offset, last offset) of runs of windows that occur in another context of the group too.

    A context is text[pos - hi : pos - lo + length]; a window of offset a starts at pos - a. group must be sorted.
    """
    raw = np.frombuffer(b"".join(contexts), np.uint8)
    at = np.concatenate([[0], np.cumsum([len(c) for c in contexts])])
    pos = at[:-1] + hi
    right = _nearest(*sorted_suffixes(raw, pos, length - lo, group))
    left = _nearest(*sorted_suffixes(raw[::-1], len(raw) - pos, hi, group))
    first, last = np.maximum(lo, length - right), np.minimum(hi, left)
    count = np.maximum(0, last - first + 1)
    count[(right < 0) | (left < 0)] = 0
    index = np.repeat(np.arange(len(pos)), count)
    a = np.arange(len(index)) - np.repeat(np.cumsum(count) - count, count) + first[index]
    start = pos[index] - a
    prefix = prefix_hashes(raw)
    key = mix(mix(span_hashes(prefix, start, start + length)) + mix(group[index].astype(np.uint64) * np.uint64(1 << 10) + a.astype(np.uint64)))
    by = np.argsort(key, kind="stable")
    twin = np.flatnonzero(key[by[:-1]] == key[by[1:]])
    found = np.zeros(len(index), bool)
    wrong: list[int] = []
    for i in range(0, len(twin), 4096):  # the bytes decide
        x, y = by[twin[i : i + 4096]], by[twin[i : i + 4096] + 1]
        same = (raw[start[x][:, None] + np.arange(length)] == raw[start[y][:, None] + np.arange(length)]).all(1)
        found[x[same]] = found[y[same]] = True
        wrong += key[x[~same]].tolist()
    for k in set(wrong):  # different windows under one hash: group them by their bytes
        seen: dict[tuple, list[int]] = {}
        for i in np.flatnonzero(key == np.uint64(k)).tolist():
            seen.setdefault((int(group[index[i]]), int(a[i]), raw[start[i] : start[i] + length].tobytes()), []).append(i)
        for some in seen.values():
            found[some] = len(some) > 1
    index, a = index[found], a[found]
    new = np.flatnonzero(np.concatenate([[True], (index[1:] != index[:-1]) | (a[1:] != a[:-1] + 1)])) if len(a) else np.zeros(0, int)
    return index[new], a[new], a[np.append(new[1:] - 1, len(a) - 1)] if len(a) else a


_FOUND = "core long, uni binary, first int, last int"


def _settle(it: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Rows of _FOUND, shared windows of classes by offset, from contexts sorted by core; a core's rows may cross batches."""

    def solved(t: pa.Table) -> pa.RecordBatch:
        t = t.combine_chunks()
        core = t["core"].to_numpy()
        group = np.cumsum(np.concatenate([[0], core[1:] != core[:-1]]))
        i, a, z = shared_windows(t["context"].to_pylist(), t["lo"].to_numpy().astype(np.int64), t["hi"].to_numpy().astype(np.int64), group, length)
        rows = t.select(["core", "uni"]).take(pa.array(i))
        return pa.RecordBatch.from_arrays([rows["core"].combine_chunks(), rows["uni"].combine_chunks(), pa.array(a.astype(np.int32)), pa.array(z.astype(np.int32))], ["core", "uni", "first", "last"])

    rest: pa.Table | None = None
    for b in it:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
        core = t["core"].to_numpy()
        whole = int(np.searchsorted(core, core[-1], "left"))
        rest = t.slice(whole)
        if whole:
            yield solved(t.slice(0, whole))
    if rest is not None and rest.num_rows:
        yield solved(rest)


def _pieces_of(context: bytes, lo: int, hi: int, length: int, width: int) -> Iterator[tuple[int, int, int, bytes, bytes]]:
    """(group, lo, hi, class, context) of the parts of a run of windows, `width` offsets each: a group has the bytes that
    all windows of such a part cover, a class all that they cover."""
    for q in range(lo // width, hi // width + 1):
        a, z = max(lo, q * width), min(hi, q * width + width - 1)
        inner = context[max(0, hi - q * width) : hi + length - (q * width + width - 1)]
        own = context[hi - z : hi - a + length]
        yield xxhash.xxh3_64_intdigest(b"%d,%d:" % (width, q) + inner) - (1 << 63), a, z, xxhash.xxh3_128_digest(b"%d,%d:" % (a, z) + own), own


def _sorted_out(reps: DataFrame, length: int, width: int) -> DataFrame:
    """Rows of _FOUND for all classes (core, uni, lo, hi, kinds, context), of which repeated ones have two rows. kinds is
    how many classes the core has."""
    # the anchor's place in a context follows from hi, so that equal contexts are equal suffixes
    few = arrow(reps.where(F.col("kinds") <= GROUP).repartition("core").sortWithinPartitions("core"), lambda it: _settle(it, length), _FOUND)
    many = reps.where(F.col("kinds") > GROUP)
    if width == 1 or many.isEmpty():
        return few
    narrow = -(-width // 4)

    def parts(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows = [(i, *p) for i, (c, lo, hi) in enumerate(zip(b.column("context").to_pylist(), b.column("lo").to_pylist(), b.column("hi").to_pylist(), strict=True)) for p in _pieces_of(c, lo, hi, length, narrow)]
            i, core, lo, hi, uni, own = zip(*rows, strict=True) if rows else [[]] * 6
            at = pa.array(i, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("core").take(at), b.column("uni").take(at), pa.array(core, pa.int64()), pa.array(uni, pa.binary()), pa.array(lo, pa.int32()), pa.array(hi, pa.int32()), pa.array(own, pa.binary())], ["of_core", "of_uni", "core", "uni", "lo", "hi", "context"])

    split = cut(arrow(many, parts, "of_core long, of_uni binary, core long, uni binary, lo int, hi int, context binary"))
    one = F.struct("context", "of_core", "of_uni")
    classes = cut(split.groupBy("core", "uni").agg(F.count("*").alias("n"), F.first("lo").alias("lo"), F.first("hi").alias("hi"), F.min(one)["context"].alias("one"), F.max(one)["context"].alias("two")))
    found = _sorted_out(_standing(classes, F.col("one"), F.col("two"), "context"), length, narrow)
    mapped = split.select("core", "uni", "of_core", "of_uni").distinct().join(found.hint("merge"), ["core", "uni"])
    return few.union(mapped.select(F.col("of_core").alias("core"), F.col("of_uni").alias("uni"), "first", "last"))


def _standing(classes: DataFrame, one: Column, two: Column, name: str) -> DataFrame:
    """The classes of cores that could share something, with kinds; `name` is one's row and, if the class repeats, two's."""
    # written before the join, so that Spark can split a hot core's rows
    cores = cut(classes.groupBy("core").agg(F.count("*").alias("kinds"), F.sum("n").alias("total")).where("total > 1").select("core", "kinds"))
    both = F.when(F.col("n") > 1, F.array(one, two)).otherwise(F.array(one))
    return classes.join(cores.hint("merge"), "core").select("core", "uni", "lo", "hi", "kinds", F.explode(both).alias(name))


def repeated_spans(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, k, spans): for each text with repeated bytes, the spans covered by strings of `length` bytes that also start
    elsewhere, of any order and overlapping; k is xxhash64 of the text. See repeated_bytes."""
    if length < 2 * CORE:
        raise ValueError(f"length must be {2 * CORE} at least")
    kind = docs.schema[id_col].dataType.simpleString()
    base = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("k"), F.col(text_col).alias("text"))

    def find(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            for b in pieces(whole, "text"):
                raw, at = buffers(b.column("text"))
                view, owner, rows = memoryview(raw), [], []
                for i in np.flatnonzero(np.diff(at) >= length).tolist():
                    own: dict[tuple, tuple[list[int], list[int], list[int]]] = {}  # a class that recurs in a text is one row
                    for p, lo, hi, h, uni in anchors(view[at[i] : at[i + 1]], length):
                        times, firsts, lasts = own.setdefault((h, uni, lo, hi), ([], [], []))
                        if lasts and p - lasts[-1] <= length:  # the spans touch: one stretch of places
                            lasts[-1], times[-1] = p, times[-1] + 1
                        else:
                            for x, value in ((times, 1), (firsts, p), (lasts, p)):
                                x.append(value)
                    rows += [(*c, firsts, None if firsts == lasts else lasts, sum(times)) for c, (times, firsts, lasts) in own.items()]
                    owner += [i] * len(own)
                c = list(zip(*rows, strict=True)) or [[]] * 7
                own = pa.array(owner, pa.int64())
                places = [pa.array(x, pa.list_(pa.int64())) for x in c[4:6]]
                yield pa.RecordBatch.from_arrays([b.column("id").take(own), b.column("k").take(own), pa.array(np.array(c[0], np.uint64).view(np.int64)), pa.array(c[1], pa.binary()), pa.array(c[2], pa.int32()), pa.array(c[3], pa.int32()), *places, pa.array(c[6], pa.int64())], ["id", "k", "core", "uni", "lo", "hi", "places", "ends", "times"])

    # places are the first ones of stretches of a class's places; ends, the last ones, are null where all are single
    found = cut(arrow(base, find, f"id {kind}, k long, core long, uni binary, lo int, hi int, places array<long>, ends array<long>, times long"))
    ends = F.coalesce("ends", "places")
    place = lambda at: F.struct("k", "id", at.alias("pos"))
    classes = cut(found.groupBy("core", "uni").agg(F.sum("times").alias("n"), F.first("lo").alias("lo"), F.first("hi").alias("hi"), F.min(place(F.element_at("places", 1))).alias("one"), F.max(place(F.element_at(ends, -1))).alias("two")))
    reps = _standing(classes, F.col("one"), F.col("two"), "x").select("x.*", "core", "uni", "lo", "hi", "kinds")
    wanted = reps.groupBy("id", "k").agg(F.collect_list(F.struct("pos", "lo", "hi", "core", "uni", "kinds")).alias("own"))

    def contexts(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for all_ in it:
            for b in pieces(all_, "text"):
                own = b.column("own")
                raw, at = buffers(b.column("text"))
                view, parent, each = memoryview(raw), own.value_parent_indices(), own.flatten()
                pos, lo, hi = (each.field(i).to_numpy() for i in range(3))
                start = at[parent.to_numpy()] + pos
                cut_ = [view[s:e] for s, e in zip((start - hi).tolist(), (start - lo + length).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([each.field(3), each.field(4), each.field(1), each.field(2), each.field(5), pa.array(cut_, pa.binary())], ["core", "uni", "lo", "hi", "kinds", "context"])

    same = lambda a, b: (a["k"] == b["k"]) & a["id"].eqNullSafe(b["id"])
    joined = base.join(wanted, same(base, wanted)).select("text", "own")
    near = cut(arrow(joined, contexts, "core long, uni binary, lo int, hi int, kinds long, context binary"))
    shared = cut(_sorted_out(near, length, length - CORE + 1).distinct())
    each = F.arrays_zip(F.col("places").alias("pos"), ends.alias("end"))
    spans = found.join(shared.hint("merge"), ["core", "uni"]).select("id", "k", F.explode(each).alias("x"), "first", "last")
    return spans.groupBy("id", "k").agg(F.collect_set(F.struct((F.col("x.pos") - F.col("last")).alias("start"), (F.col("x.end") - F.col("first") + length).alias("end"))).alias("spans"))


def merged(spans: np.ndarray) -> np.ndarray:
    """Disjoint maximal spans, sorted, from rows of (start, end); spans that touch are one."""
    if not len(spans):
        return spans
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.flatnonzero(np.concatenate([[True], spans[1:, 0] > reach[:-1]]))
    return np.stack([spans[new, 0], reach[np.append(new[1:] - 1, len(spans) - 1)]], 1)


def repeated_bytes(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text", with_bytes: bool = True) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, text[, spans, kept]) for every row of docs.

    Texts are UTF-8 bytes; strings never cross texts. Every byte is removed that is covered by a string of `length`
    bytes which also starts at any other place, in the same text or another row's, judged on the input. Spans are the
    maximal removed runs; `kept` is what is left, `text` the same without the bytes of characters that a removal tore.
    A text may be very long: it is hashed by stretches of 256 KB, and copied once or twice where bytes go; one that
    repeats itself closely gives one span for each stretch of a class's places, not one for each place. Null and empty
    texts, and those shorter than `length`, lose nothing; rows that repeat a text lose all of it, if it is long enough. An empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    base = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("k"), F.col(text_col).alias("text"))
    spans = repeated_spans(docs, length, id_col, text_col)
    rows = base.join(spans, (base["k"] == spans["k"]) & base["id"].eqNullSafe(spans["id"]), "left").select(base["id"], "text", "spans")

    def remove(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            for b in pieces(whole, "text"):
                out = []
                for text, own in zip(b.column("text").cast(pa.large_binary()).to_pylist(), b.column("spans"), strict=True):
                    text = text or b""
                    gone = merged(np.stack([own.values.field(i).to_numpy() for i in (0, 1)], 1)) if own.is_valid else np.zeros((0, 2), np.int64)
                    kept = b"".join(text[s:e] for s, e in zip([0, *gone[:, 1].tolist()], [*gone[:, 0].tolist(), len(text)], strict=True))
                    out.append((len(text), len(text) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), kept.decode(errors="ignore"), [{"start": s, "end": e} for s, e in gone.tolist()] if with_bytes else None, kept if with_bytes else None))
                types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary()][: 7 if with_bytes else 5]
                columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=False)]
                yield pa.RecordBatch.from_arrays([b.column("id"), *columns], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text", "spans", "kept"][: 1 + len(types)])

    schema = f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string" + ", spans array<struct<start: long, end: long>>, kept binary" * with_bytes
    return arrow(rows, remove, schema).withColumnRenamed("id", id_col)
