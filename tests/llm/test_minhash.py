import re

from nichegrid.llm import minhash
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, n):
    w = WORD.findall((text or "").translate(FOLD))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(texts, n, percent):
    sets = {i: shingles(t, n) for i, t in texts.items()}
    name = {i: i for i in sets}

    def find(i):
        while name[i] != i:
            i = name[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                name[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def test_against_brute_force(docs, texts):
    for n in (2, 5):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs, words=n).collect()}
        assert got == brute(texts, n, 80)


def test_keep_first(docs, texts):
    want = {i for i, (_, _, kept) in brute(texts, 5, 80).items() if kept}
    got = minhash.keep_first(docs)
    assert got.columns == docs.columns and sorted(r["doc_id"] for r in got.collect()) == sorted(want)


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(50, 40), (60, 50), (7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in minhash.components(edges).collect()}
    assert got == {i: 0 for i in range(31)} | {40: 40, 50: 40, 60: 40}
    assert minhash.components(edges.limit(0)).collect() == []


def test_edge_cases(odd, empty):
    got = sorted(minhash.near_duplicates(odd, words=2).collect(), key=str)
    by = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got}
    assert len(got) == 5 and by == {None: (6, None, True), 1: (6, 1, True), 2: (0, 2, True), 3: (6, 1, False)}
    assert sorted(str(r["doc_id"]) for r in minhash.keep_first(odd).collect()) == ["1", "2", "None"]
    assert minhash.near_duplicates(empty).collect() == [] and minhash.keep_first(empty).collect() == []


def test_keep_first_with_names_of_its_own_and_repeated_ids(spark):
    twin = " ".join(f"w{i}" for i in range(30))
    rows = [(1, twin, 1, "a"), (2, twin + " more", 2, "b"), (3, "b text", 3, "c"), (3, "a text", 4, "d"), (3, "a text", 5, "e"), (4, None, 6, "f"), (4, "x", 7, "g"), (None, "n", 8, "h"), (None, "n", 9, "i")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, gone long, alone string").withColumns({"least": F.lit(1), "_gone": F.lit(2)})
    got = minhash.keep_first(docs)
    assert got.columns == docs.columns
    kept = [(r["doc_id"], r["text"]) for r in got.collect()]
    assert sorted(kept, key=str) == sorted([(1, twin), (3, "a text"), (4, None), (None, "n"), (None, "n")], key=str)
