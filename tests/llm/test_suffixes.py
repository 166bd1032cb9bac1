import collections
import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from nichegrid.llm import suffixes


def brute(texts, length):
    raw = [(i, (t or "").encode()) for i, t in texts]
    seen = collections.Counter(t[s : s + length] for _, t in raw for s in range(len(t) - length + 1))
    out = []
    for i, t in raw:
        gone, spans, end = bytearray(len(t)), 0, -1
        for p in range(len(t)):
            if p + length <= len(t) and seen[t[p : p + length]] > 1:
                end = p + length
            gone[p] = p < end
        spans = sum(1 for p in range(len(t)) if gone[p] and (p == 0 or not gone[p - 1]))
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(t, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=str)


@pytest.mark.parametrize("group", [2000, 2])
def test_against_brute_force(docs, texts, group, monkeypatch):
    """Also with cores that are split down to single windows."""
    monkeypatch.setattr(suffixes, "GROUP", group)
    assert result(suffixes.repeated_bytes(docs, 400)) == brute(texts.items(), 400)
    assert result(suffixes.repeated_bytes(docs, 150)) == brute(texts.items(), 150)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.text("ab", min_size=1, max_size=12)), min_size=1, max_size=12))
def test_suffix_order(rows):
    rows = sorted(rows, key=lambda r: r[0])
    raw = np.frombuffer("".join(t for _, t in rows).encode(), np.uint8)
    starts = np.cumsum([0, *(len(t) for _, t in rows)])[:-1]
    limits, group = np.array([len(t) for _, t in rows]), np.array([g for g, _ in rows])
    order, lengths = suffixes.sorted_suffixes(raw, starts, limits, group)
    assert [rows[i] for i in order] == sorted(rows)
    for a, b, n in zip(order, order[1:], lengths):
        same = next((k for k, (x, y) in enumerate(zip(rows[a][1], rows[b][1])) if x != y), min(len(rows[a][1]), len(rows[b][1])))
        assert n == (same if rows[a][0] == rows[b][0] else -1)


def test_spans_and_bytes(spark):
    x = "".join(chr(97 + i * 7919 % 26) + str(i) for i in range(300))
    df = spark.createDataFrame([(1, x + "left"), (2, "other " + x)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in suffixes.repeated_bytes(df, 200).collect()}
    assert got[1]["kept"] == b"left" and got[2]["kept"] == b"other " and [(s["start"], s["end"]) for s in got[2]["spans"]] == [(6, 6 + len(x))]


def test_periodic_texts(spark):
    """Places that follow closely are kept as stretches; what goes is what brute force tells."""
    x = "".join(chr(97 + i * 7919 % 26) + str(i * i) for i in range(400))
    texts = [(1, "a" * 3000), (2, "xyz" * 700 + x), (3, x[:900] + "q" * 401 + x[900:1500]), (4, (x[:450] + "\n") * 4), (5, "a" * 400 + "b"), (6, "é" * 900 + "z"), (7, "m" * 400 + x[:300] + "m" * 399)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert result(suffixes.repeated_bytes(df, 400)) == brute(texts, 400)
    assert result(suffixes.repeated_bytes(df, 150)) == brute(texts, 150)


def test_a_long_periodic_text(spark):
    texts = [(1, "a" * 4_000_000), (2, "abcdefg" * 300_000 + "end")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    spans = {r["id"]: len(r["spans"]) for r in suffixes.repeated_spans(df).collect()}
    assert spans.keys() == {1, 2} and max(spans.values()) < 1000  # a few for each stretch of hashing, none for each place
    got = {r["doc_id"]: r for r in suffixes.repeated_bytes(df, with_bytes=False).collect()}
    assert (got[1]["n_removed"], got[1]["n_spans"]) == (4_000_000, 1)
    assert (got[2]["n_removed"], got[2]["n_spans"], got[2]["text"]) == (2_100_000, 1, "end")


def test_edge_cases(odd, empty):
    assert len(suffixes.repeated_bytes(odd).collect()) == 5
    assert suffixes.repeated_bytes(empty).collect() == []
    with pytest.raises(ValueError):
        suffixes.repeated_bytes(empty, 100)
