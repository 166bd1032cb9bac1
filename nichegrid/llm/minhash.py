"""Near-duplicate documents: MinHash signatures as an inverted index, candidates confirmed on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nichegrid.llm.common import arrow, cut, unused
from nichegrid.llm.textkit import Words, pieces

#: Coordinates of a signature, and how many must agree: at a similarity of 0.8, fewer agree once in 110,000 pairs.
COORDINATES, AGREE = 128, 82
#: The first coordinates and how many of them must agree, to tell early which documents can have a partner at all: fewer
#: agree once in 800,000 pairs.
EARLY, EARLY_AGREE = 64, 35
_rng = np.random.default_rng(97)
_XOR = _rng.integers(0, 1 << 63, COORDINATES, dtype=np.uint64)
_TIMES = _rng.integers(0, 1 << 62, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(shingles: np.ndarray) -> np.ndarray:
    """For each coordinate, 32 bits of the hash of the shingle that comes first in its order; shingles must not be empty."""
    best, least = np.zeros(COORDINATES, np.uint64), np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 1024):
        some = shingles[i : i + 1024]
        order = (some[:, None] ^ _XOR) * _TIMES
        at = order.argmin(0)
        value = order[at, np.arange(COORDINATES)]
        less = value < least
        best[less], least[less] = some[at[less]], value[less]
    return (best >> np.uint64(32)).astype(np.uint32)


def signatures(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """(id, n, mark, sig) for every row: the size of its shingle set, a 128-bit hash of the set and its signature."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            for b in pieces(whole, "text"):
                w = Words(b.column("text"))
                sets = [w.shingles(i, words) for i in range(b.num_rows)]
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary())], ["id", "n", "mark", "sig"])

    return arrow(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), batches, f"id {docs.schema[id_col].dataType.simpleString()}, n long, mark binary, sig binary")


def _rows(c: pa.Array) -> np.ndarray:
    """Signatures as a matrix."""
    return np.frombuffer(b"".join(c.to_pylist()), np.uint32).reshape(-1, COORDINATES)


def postings(reps: DataFrame, coordinates: int) -> DataFrame:
    """(rep, token): the first (coordinate, value) pairs of each signature."""

    def tokens(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            sig = _rows(b.column("sig"))[:, :coordinates]
            token = (np.arange(coordinates, dtype=np.int64) << 32) | sig
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column("rep").to_numpy(), coordinates)), pa.array(token.ravel())], ["rep", "token"])

    return arrow(reps.select("rep", "sig"), tokens, "rep long, token long")


def shared_postings(reps: DataFrame, coordinates: int) -> DataFrame:
    """(token, rep, df): the postings in lists of more than one document, with the lists' lengths."""
    tokens = postings(reps, coordinates)
    # aggregates are written before they are joined, so that Spark can split a hot token's rows
    return tokens.join(cut(tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")).hint("merge"), "token")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes of the edges (a, b): the smallest node that links lead to.

    Alternating large-star and small-star steps: every node points its neighbours to the smallest one, until
    nothing changes. Rows are pre-aggregated before each shuffle and each step is written to the shared folder.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    while mark[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        new = cut(small)
        seen = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        now, mark = new, seen
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(nodes.select(F.col("component").alias("node"), "component")).groupBy("node").agg(F.min("component").alias("component"))


def _confirmed(pairs: DataFrame, docs: DataFrame, words: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """Those of the pairs (a, b) of ids whose full sets are similar enough."""
    asked = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(asked.hint("merge"), "id", "left_semi")

    def sets(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            for b in pieces(whole, "text"):
                w = Words(b.column("text"))
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([w.shingles(i, words).tobytes() for i in range(b.num_rows)], pa.binary())], ["id", "set"])

    known = arrow(texts, sets, "id long, set binary").dropDuplicates(["id"])
    known = cut(known)
    rows = pairs.join(known.select(F.col("id").alias("b"), F.col("set").alias("y")).hint("merge"), "b").join(known.select(F.col("id").alias("a"), F.col("set").alias("x")).hint("merge"), "a")

    def compare(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            fits = []
            for x, y in zip(b.column("x"), b.column("y"), strict=True):
                x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
                both = np.sort(np.concatenate([x, y]), kind="stable")
                same = int(np.count_nonzero(both[1:] == both[:-1]))
                fits.append(100 * same >= percent * (len(both) - same))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(fits, pa.bool_()))

    return arrow(rows.select("a", "b", "x", "y"), compare, "a long, b long")


def _across(open_: DataFrame, docs: DataFrame, words: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """Pairs (a, b) of the open documents (id, c) of different components c that can be similar enough.

    A join on the rarest shingles of full sets: two similar sets share one of the n - ceil(percent * n) + 1 rarest of
    each, and from the first that they share on, enough of both must be left. Shingles that no other open document has
    come first; a document of which more than the rest is of that kind has no partner. Nothing similar is lost.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(open_.select("id").hint("merge"), "id", "left_semi")

    def spread(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            for b in pieces(whole, "text"):
                w = Words(b.column("text"))
                sets = [w.shingles(i, words) for i in range(b.num_rows)]
                sizes = np.array([len(x) for x in sets])
                own = pa.array(np.repeat(np.arange(b.num_rows), sizes))
                yield pa.RecordBatch.from_arrays([b.column("id").take(own), pa.array(np.repeat(sizes, sizes)), pa.array(np.concatenate(sets).view(np.int64))], ["id", "n", "shingle"])

    shingles = cut(arrow(texts, spread, "id long, n long, shingle long"))
    often = cut(shingles.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1"))
    own = shingles.join(often.hint("merge"), "shingle").groupBy("id").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("df", "shingle"))).alias("own"))
    alone = F.col("n") - F.size("own")
    last = F.col("n") - F.ceil(F.col("n") * percent / 100) - alone + 1
    first = own.where(last > 0).join(open_, "id").select("id", "c", "n", alone.alias("alone"), F.posexplode(F.slice("own", F.lit(1), last.cast("int"))["shingle"]).alias("at", "shingle"))
    first = cut(first.select("id", "c", "n", "shingle", (F.col("n") - F.col("alone") - F.col("at")).alias("left")))
    a, b = (first.select("shingle", *(F.col(c).alias(f"{c}_{x}") for c in ("id", "c", "n", "left"))) for x in "ab")
    fits = (F.col("c_a") < F.col("c_b")) & (F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
    fits = fits & (F.least("left_a", "left_b") * (100 + percent) >= (F.col("n_a") + F.col("n_b")) * percent)
    return a.join(b, (a["shingle"] == b["shingle"]) & fits).select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row of docs.

    Documents are linked if their sets of `words`-word shingles (A-Z folded) have 100 * intersection >= percent *
    union; a component is what links connect, named after its smallest id, which is kept.

    - Rows with equal sets form a class at once; the work goes on between class representatives.
    - Every representative is posted under its first EARLY (coordinate, value) pairs; those with fewer than EARLY_AGREE
      pairs that others have too are done. The rest are posted under all COORDINATES pairs, and those with fewer than
      AGREE shared pairs are done too.
    - Two signatures that agree in AGREE pairs share one of the COORDINATES - AGREE + 1 rarest of each. Pairs that nobody
      shares are the rarest, so few others are left to merge, and long posting lists are skipped.
    - In each list, every document is first tried with the list's most widely shared document; confirmed links merge
      components; only documents in lists that still hold several components go on, to an exact join on the rarest
      shingles of their full sets.
    - Tried pairs must agree in AGREE coordinates and fit in size, and then pass on their full sets.

    Texts without words, null ones too, have an empty set and link with nothing. A null id has a null component, is
    kept and links nothing. Repeated rows of one id have equal results, if their texts are equal. A very long text is
    hashed in stretches; its set travels as 8 bytes a shingle. Other columns of docs, whatever their names, are not
    read. Empty tables give no rows.
    """
    docs = docs.select(id_col, text_col)
    rows = cut(signatures(docs, words, id_col, text_col))
    fit = (F.col("n") > 0) & F.col("id").isNotNull()
    classes = rows.where(fit).groupBy("mark").agg(F.min("id").alias("rep"))
    reps = rows.where(fit).select(F.col("id").alias("rep"), "mark", "n", "sig").join(classes, ["rep", "mark"], "left_semi").dropDuplicates(["rep", "mark"])
    # an id with several texts is in several classes; its name stands for the first of them
    reps = cut(reps.select(F.col("rep").cast("long").alias("rep"), "n", "sig"))
    able = cut(shared_postings(reps, EARLY).groupBy("rep").agg(F.count("*").alias("k")).where(F.col("k") >= EARLY_AGREE).select("rep"))
    reps = cut(reps.join(able.hint("merge"), "rep", "left_semi"))
    own = shared_postings(reps, COORDINATES).groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("own"), F.sum("df").alias("reach")).where(F.size("own") >= AGREE)
    posted = cut(own.select("rep", "reach", F.explode(F.slice("own", F.lit(1), F.size("own") - AGREE + 1)["token"]).alias("token")))
    hubs = cut(posted.groupBy("token").agg(F.max(F.struct("reach", (-F.col("rep")).alias("x"))).alias("h")).select("token", (-F.col("h.x")).alias("hub")))

    def alike(pairs: DataFrame) -> DataFrame:
        x, y = (reps.select(F.col("rep").alias(c), F.col("n").alias(f"n{c}"), F.col("sig").alias(f"s{c}")) for c in "ab")
        near = pairs.join(y.hint("merge"), "b").join(x.hint("merge"), "a").where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)

        def compare(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in it:
                same = (_rows(b.column("sa")) == _rows(b.column("sb"))).sum(1)
                yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(same.astype(np.int64))], ["a", "b", "same"]).filter(pa.array(same >= AGREE))

        return arrow(near.select("a", "b", "sa", "sb"), compare, "a long, b long, same long")

    stars = posted.join(hubs, "token").where("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()
    tried = alike(stars)
    first = tried.groupBy("b").agg(F.max_by("a", F.struct("same", -F.col("a"))).alias("a")).select("a", "b")
    links = cut(_confirmed(cut(first), docs, words, percent, id_col, text_col))
    found = components(links)
    placed = posted.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("token", "rep", F.coalesce("component", "rep").alias("c"))
    mixed = placed.groupBy("token").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("token")
    open_ = cut(placed.join(mixed.hint("merge"), "token", "left_semi").select(F.col("rep").alias("id"), "c").distinct())
    more = cut(_across(open_, docs, words, percent, id_col, text_col))
    if more.isEmpty():
        whole = found
    else:
        whole = components(links.union(_confirmed(more, docs, words, percent, id_col, text_col)))
    of_class = classes.join(whole.withColumnRenamed("node", "rep"), "rep", "left").select(F.col("mark").alias("_mark"), F.coalesce("component", "rep").alias("_c"))
    out = rows.select("id", "n", "mark").join(of_class, (F.col("mark") == F.col("_mark")) & fit, "left")
    component = F.when(fit, F.col("_c")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def keep_first(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are, without those whose component has a smaller id, one for each id.

    Of rows that share an id, one with the least text stays, a null being the least; rows without id and rows without words
    all stay, as they are linked with nothing. Columns of docs may have any names. Texts of any length are read whole.
    """
    found = cut(near_duplicates(docs, words, percent, id_col, text_col))
    gone, alone, text = unused(docs, "gone"), unused(docs, "alone"), unused(docs, "least")
    dropped = found.where(~F.col("kept")).select(F.col(id_col).alias(gone)).distinct()
    left = docs.join(dropped.hint("merge"), docs[id_col] == F.col(gone), "left_anti")
    if found.where(F.col(id_col).isNotNull()).groupBy(id_col).count().where("count > 1").isEmpty():
        return left
    first = F.min(F.struct(F.col(text_col).isNotNull().alias("is"), F.col(text_col).alias("of")))["of"]  # two values a row, combined before the shuffle
    least = left.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias(gone)).agg(first.alias(text))
    same = left[id_col].isNull() | left[text_col].eqNullSafe(F.col(text))
    left = left.join(least, left[id_col] == F.col(gone), "left").where(same).drop(gone, text)
    each = F.when(F.col(id_col).isNull(), F.monotonically_increasing_id())  # rows without id all stay
    return left.withColumn(alone, each).dropDuplicates([id_col, alone]).drop(alone)
