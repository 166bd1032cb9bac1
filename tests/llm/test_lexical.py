import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from nichegrid.llm import lexical

UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(str.maketrans(UP, LOW)))


def brute(docs, items, k):
    """docs and items are lists of (id, text)."""
    counts = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n_docs, length = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(w for _, c in counts for w in c)
    own = {}
    for i, t in items:
        own.setdefault(i, set()).update(terms(t))
    out = set()
    for item, words in own.items():
        scores = []
        for i, c in counts:
            m = 50 + (50 * sum(c.values()) * n_docs) // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 20 * m)) for w in words if w in c)
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out |= {(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scores)[:k], 1)}
    return out


def rows(df):
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("k", [1, 5, 50])
def test_against_brute_force(spark, docs, texts, k):
    rng = random.Random(1)
    items = [(i, " ".join(rng.sample((texts[i] or "x").split() + (texts[i + 40] or "x").split(), 8))) for i in range(0, 40, 3)] + [(1000, "word, WORD; a b"), (1001, "é€😀 x" + "x" * 398), (1002, "none of this-is found_here"), (1003, None), (1004, "...")]
    got = rows(lexical.search(docs, spark.createDataFrame(items, "item_id long, text string"), k))
    assert got == brute(list(texts.items()), items, k)


def test_blocks_and_item_blocks(spark, docs, texts, monkeypatch):
    monkeypatch.setattr(lexical, "ITEM_TERMS", 10)
    items = [(i, texts[i]) for i in range(12)]
    got = rows(lexical.search(docs, spark.createDataFrame(items, "item_id long, text string"), 3))
    assert got == brute(list(texts.items()), items, 3)


def test_bounds_hold_and_exclude(texts):
    rng = random.Random(7)
    vocabulary = [f"{a}{b}" for a in LOW for b in LOW[:20]]
    docs = [" ".join(vocabulary[min(int(rng.expovariate(0.02)), 519)] for _ in range(rng.randint(3, 400))) for _ in range(3000)]
    counts = lexical.Counts.of(pa.array(docs))
    h = lexical.hashes(counts.terms)
    df = np.bincount(counts.term)
    words = [t.decode() for t in counts.terms.to_pylist()]
    own = [np.array(rng.sample(range(len(words)), 12)) for _ in range(20)]
    weights = [np.floor(1000 * np.log((2 * 3000 + 2) / (2 * df[o] + 1))).astype(np.int64) for o in own]
    items = lexical.Items(list(range(20)), [w.encode() for w in words], own, weights, 3000, int(counts.sizes.sum()))
    exact = np.zeros((20, 3000), np.int64)
    for i, item, score in items.scores(counts, [list(range(20))] * 3000):
        exact[item, i] = score
    level = np.searchsorted(lexical.TIERS, counts.tf, "right")
    entries = lexical.mix(np.repeat(h[counts.term], level) + lexical._TIER[np.concatenate([np.arange(x) for x in level])])
    text = np.repeat(counts.text, level)
    store = lexical.Blocks()
    blocks = [b for i in range(3000) for b in store.add(i, 0, int(counts.sizes[i]), entries[text == i])] + list(store.rest())
    assert sorted(i for b in blocks for i in b["ids"]) == list(range(3000))
    reached = 0
    for b in blocks:
        bound = items.bounds(np.array(b["sizes"]), b["bits"], np.frombuffer(b["slices"], np.uint8).reshape(b["bits"], -1))
        assert (bound >= exact[:, b["ids"]]).all()
        reached += (bound >= np.sort(exact, 1)[:, -10][:, None]).sum()
    assert reached < 20 * 100  # of 20 * 3,000; 10 for each item are its best


def test_stretches_cut_no_term():
    rng = random.Random(3)
    texts = ["".join(rng.choice("aé ,B") for _ in range(rng.randint(0, 60))) for _ in range(50)] + ["", "x" * 5000, "y" * 700 + " z"]
    raw, at = lexical.buffers(pa.array(texts))
    for most in (7, 64, 1 << 20):
        cuts = list(lexical.stretches(raw, at, most))
        assert [a for a, _ in cuts] == [0] + [z for _, z in cuts[:-1]] and cuts[-1][1] == len(raw)
        got = Counter(t for a, z in cuts for text_start, text_end in zip(at, at[1:]) for t in terms(raw[max(a, text_start) : max(a, text_start, min(z, text_end))].tobytes().decode()))
        assert got == Counter(t for x in texts for t in terms(x))


def test_long_texts_are_counted_in_stretches(monkeypatch):
    texts = pa.array(["one two, One", None, "", "two " * 200 + "three" * 50, "t"])
    whole = lexical.Counts.of(texts)
    real = lexical.stretches
    monkeypatch.setattr(lexical, "stretches", lambda raw, at: real(raw, at, 40))
    parts = lexical.Counts.of(texts)
    as_dict = lambda c: {(int(t), c.terms[int(w)].as_py()): int(n) for t, w, n in zip(c.text, c.term, c.tf)}
    assert as_dict(whole) == as_dict(parts) and whole.sizes.tolist() == parts.sizes.tolist() == [3, 0, 0, 201, 1]


def test_edge_cases(spark, odd, empty):
    items = spark.createDataFrame([(1, "one", "a"), (1, "two", "b"), (None, "words", "c"), (None, "id", "c"), (2, None, None)], "item_id long, text string, doc_id string")
    got = sorted((str(r[0]), *r[1:3]) for r in lexical.search(odd, items).collect())
    assert got == [("1", 1, 1), ("1", 2, 1), ("1", 3, 3), ("None", 1, None)]
    assert lexical.search(empty, items).collect() == [] and lexical.search(odd, items.limit(0)).collect() == []
    assert lexical.search(odd, items).columns == ["item_id", "rank", "doc_id", "score"]


def test_very_long_texts(spark):
    df = spark.range(3).selectExpr("id as doc_id", "case id when 0 then repeat('word other, ', 500000) when 1 then repeat('x', 6000000) else 'word' end as text")
    got = rows(lexical.search(df, spark.createDataFrame([(1, "word"), (2, "x" * 6_000_000)], "item_id long, text string")))
    assert {r[:3] for r in got} == {(1, 1, 0), (1, 2, 2), (2, 1, 1)}
