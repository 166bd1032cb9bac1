"""Token ids packed into matrices of fixed width by best-fit decreasing."""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from nichegrid.llm.common import arrow
from nichegrid.llm.textkit import pieces

#: The split rule of the byte-level BPE vocabularies; a fixed value of theirs.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A text with one of these may have white space beside a space; a lone space between other characters ends a token.
_ODD = ("  ", " \n", "\n ", *"\t\v\f\r\x1c\x1d\x1e\x1f\x85\xa0     　", *map(chr, range(0x2000, 0x200B)))


class Tokens(dict):
    """Token ids of a word after a space, as bytes; words seen before are looked up."""

    def __init__(self, ranks: bytes, kind: str, most: int = 400_000):
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.encoding = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
        self.kind, self.most = kind, most

    def ids(self, text: str) -> bytes:
        return np.array(self.encoding.encode_ordinary(text), self.kind).tobytes()

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        self[word] = out = self.ids(" " + word)
        return out

    def encode(self, text: str) -> bytes:
        """Ids of the whole text: as the tokenizer gives them."""
        if any(c in text for c in _ODD) or text[:1] in (" ", "\n") or text[-1:] == " ":
            return self.ids(text)
        first, *rest = text.split(" ")
        return self.ids(first) + b"".join(map(self.__getitem__, rest))


class Capacities:
    """A segment tree of how many bins have each remaining capacity."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.counts = [0] * (2 * self.size)

    def add(self, capacity: int, n: int) -> None:
        i = capacity + self.size
        while i:
            self.counts[i] += n
            i >>= 1

    def least(self, wanted: int) -> int | None:
        """The least capacity that some bin has and that is `wanted` or more."""
        i = wanted + self.size
        if self.counts[i]:
            return wanted
        while i > 1:
            if not i & 1 and self.counts[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.counts[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return None


def best_fit(lengths: Sequence[int], width: int) -> list[list[int]]:
    """Indices by bin: longest first, each into the fullest bin that has room; of equal lengths the earlier first."""
    free, tree, bins = {}, Capacities(width), []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        room = tree.least(n)
        if room is None:
            b, room = len(bins), width
            bins.append([])
        else:
            tree.add(room, -1)
            b = free[room].pop()
        bins[b].append(i)
        if room > n:
            tree.add(room - n, 1)
            free.setdefault(room - n, []).append(b)
    return bins


def pack(docs: DataFrame, ranks: str, end_id: int | None = 50256, pad_id: int = 50256, width: int = 2048, window_tokens: int = 2_000_000, kind: str = "<u2", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(pack, n_tokens, ids, lengths, positions, doc_ids, parts): one row of the packed matrix each.

    Whole texts become token ids, followed by end_id unless it is None. A document of more than `width` ids is split
    into parts of `width` ids and a rest, so that its parts in order are its ids. Parts are packed by best-fit
    decreasing; ids is a matrix row of `width` little-endian numbers (`kind`), filled up with pad_id; lengths are the
    cumulative segment lengths from 0 to n_tokens, positions the position of each id in its segment (padding counts as
    one more segment), as little-endian 32-bit numbers; doc_ids and parts tell each segment's document and part.

    Packing goes by windows of about `window_tokens` ids of one task's documents, so that no shuffle is needed and
    memory is bounded; a document that is longer fills a window alone. pack is the task's number and a count; a
    repeated task packs alike. Null texts are empty; without end_id, documents without ids take no place. Repeated rows
    are packed each; an empty table gives no rows; other columns of docs are not read. `ranks` is the path of a
    vocabulary file, read by the driver and
    broadcast.
    """
    with open(ranks, "rb") as f:
        table = docs.sparkSession.sparkContext.broadcast(f.read())
    out_kind = docs.schema[id_col].dataType.simpleString()
    names = ["pack", "n_tokens", "ids", "lengths", "positions", "doc_ids", "parts"]
    last = b"" if end_id is None else np.array([end_id], kind).tobytes()
    unit = np.dtype(kind).itemsize

    def rows(window: list[tuple[object, int, bytes]], count: int, id_type: pa.DataType) -> pa.RecordBatch:
        sizes = [len(x) // unit for _, _, x in window]
        bins = best_fit(sizes, width)
        out: list[list] = [[] for _ in names]
        for j, own in enumerate(bins):
            own.sort()
            lengths = np.concatenate([[0], np.cumsum([sizes[i] for i in own])])
            n = int(lengths[-1])
            starts = np.append(lengths[:-1], n)
            positions = np.arange(width) - np.repeat(starts, np.append(np.diff(lengths), width - n))
            packed = b"".join(window[i][2] for i in own) + np.full(width - n, pad_id, kind).tobytes()
            row = ((TaskContext.get().partitionId() << 32) + count + j, n, packed, lengths.tolist(), positions.astype("<i4").tobytes(), [window[i][0] for i in own], [window[i][1] for i in own])
            for column, x in zip(out, row, strict=True):
                column.append(x)
        ints = pa.list_(pa.int32())
        types = [pa.int64(), pa.int64(), pa.binary(), ints, pa.binary(), pa.list_(id_type), ints]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(table.value, kind)
        window: list[tuple[object, int, bytes]] = []
        held = count = 0
        id_type = pa.int64()
        for whole in it:
            for b in pieces(whole, "text"):
                id_type = b.schema.field("id").type
                for key, text in zip(b.column("id").to_pylist(), b.column("text").to_pylist(), strict=True):
                    ids = tokens.encode(text) + last if text else last
                    for k, at in enumerate(range(0, len(ids), width * unit)):
                        window.append((key, k, ids[at : at + width * unit]))
                    held += len(ids) // unit
                    if held >= window_tokens:
                        full = rows(window, count, id_type)
                        count, held, window = count + full.num_rows, 0, []
                        for i in range(0, full.num_rows, 256):
                            yield full.slice(i, 256)
        if window:
            yield rows(window, count, id_type)

    schema = f"pack long, n_tokens long, ids binary, lengths array<int>, positions binary, doc_ids array<{out_kind}>, parts array<int>"
    return arrow(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), batches, schema)


def unpack(packs: DataFrame, kind: str = "<u2", end_id: int | None = 50256) -> DataFrame:
    """(doc_id, ids): every document's token ids in order, without end_id, from the rows that pack gives. Documents whose
    id repeats can't be told apart and aren't for this."""

    def parts(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            out = [(d, p, np.frombuffer(r["ids"], kind)[a:z].astype(np.int32)) for r in b.to_pylist() for d, p, a, z in zip(r["doc_ids"], r["parts"], r["lengths"], r["lengths"][1:], strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], b.schema.field("doc_ids").type.value_type), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.list_(pa.int32()))], ["doc_id", "part", "ids"])

    id_kind = packs.schema["doc_ids"].dataType.elementType.simpleString()
    each = arrow(packs, parts, f"doc_id {id_kind}, part int, ids array<int>")
    joined = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("part", "ids"))), lambda x: x["ids"]))
    ids = F.slice("ids", F.lit(1), F.size("ids") - 1) if end_id is not None else F.col("ids")
    return each.groupBy("doc_id").agg(joined.alias("ids")).select("doc_id", ids.alias("ids"))


def shards(packs: DataFrame, rows: int = 512) -> DataFrame:
    """(shard, n_packs, width, matrix, positions, offsets, lengths, index): binary shards of at most `rows` packs of a task.

    matrix and positions are n_packs raw rows each, one after the other; lengths are the cumulative segment lengths of
    all packs as little-endian 32-bit numbers, of which pack i has those from offsets[i] to offsets[i + 1]; index lists
    the packs. So a reader maps a pack's row without reading others. shard is the task's number and a count.
    """

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        count = 0

        def shard() -> pa.RecordBatch:
            offsets = np.concatenate([[0], np.cumsum([len(r["lengths"]) for r in held])])
            row = ((TaskContext.get().partitionId() << 32) + count, len(held), len(held[0]["positions"]) // 4, b"".join(r["ids"] for r in held), b"".join(r["positions"] for r in held), offsets.tolist(), np.concatenate([r["lengths"] for r in held]).astype("<i4").tobytes(), [r["pack"] for r in held])
            types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], ["shard", "n_packs", "width", "matrix", "positions", "offsets", "lengths", "index"])

        for b in it:
            for r in b.to_pylist():
                held.append(r)
                if len(held) == rows:
                    yield shard()
                    held, count = [], count + 1
        if held:
            yield shard()

    return arrow(packs.select("pack", "ids", "positions", "lengths"), batches, "shard long, n_packs long, width long, matrix binary, positions binary, offsets array<long>, lengths binary, index array<long>")


def write_matrices(packs: DataFrame, path: str, rows: int = 512) -> None:
    """The shards as Parquet, each file with at most a few of them, uncompressed: matrices are ready to be mapped."""
    shards(packs, rows).write.option("compression", "none").parquet(path)


def matrix(shard: Row, kind: str = "<u2") -> np.ndarray:
    """The ids of a shard's packs, a row each, without a copy."""
    return np.frombuffer(shard["matrix"], kind).reshape(shard["n_packs"], shard["width"])
