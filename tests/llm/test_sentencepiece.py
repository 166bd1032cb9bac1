import random

import numpy as np
import pytest
from nichegrid.llm import sentencepiece_scan as sp
from nichegrid.llm.queries import SENTENCEPIECE_MODEL

from .conftest import prose


@pytest.fixture(scope="module")
def vocabulary():
    return sp.Vocabulary.load(SENTENCEPIECE_MODEL)


def brute(v, symbols):
    scores = {p: s for p, s in zip(v.pieces, v.scores) if s is not None}
    text = "".join("\0" if c == sp.LITERAL else chr(c) for c in symbols)
    best = [0.0]
    for end in range(1, len(text) + 1):
        options = [best[end - k] + scores[text[end - k : end]] for k in range(1, min(end, v.longest) + 1) if text[end - k : end] in scores]
        if text[end - 1] not in scores:
            options.append(best[end - 1] + v.fallback)
        best.append(max(options))
    return best[-1]


def test_scores_against_brute_force(vocabulary, texts):
    e = sp.Encoder(vocabulary)
    for t in texts.values():
        t = t or ""
        (ids,) = e.texts([t])
        assert vocabulary.decode(ids) == t.encode()
        assert vocabulary._score(ids) == pytest.approx(brute(vocabulary, sp.symbols_of(t)))


@pytest.mark.parametrize("size", [17, 40, 300])
def test_chunks_give_the_same_score(vocabulary, size):
    rng = random.Random(size)
    for t in [prose(rng, 80), "x" * 500, "".join(rng.choice("aeinrst ") for _ in range(600)), "é€😀▁" * 60]:
        s = sp.symbols_of(t)
        cuts = range(0, len(s), size)
        matrices = [vocabulary.transfer(s[c : c + size + vocabulary.longest], min(size, len(s) - c)) for c in cuts]
        borders = sp.states(matrices)
        assert borders[0] == borders[-1] == 0
        total = sum(m[a, b] for m, a, b in zip(matrices, borders, borders[1:]))
        assert total == pytest.approx(brute(vocabulary, s))
        ids = np.concatenate([vocabulary.encode([s[c + borders[i] : min(c + size, len(s)) + borders[i + 1]]])[0] for i, c in enumerate(cuts)])
        assert vocabulary.decode(ids) == t.encode() and vocabulary._score(ids) == pytest.approx(total)


def test_combination_is_associative():
    rng = np.random.default_rng(0)
    a, b, c = rng.normal(size=(3, 6, 6))
    assert np.allclose(sp.combined(sp.combined(a, b), c), sp.combined(a, sp.combined(b, c)))


def test_documents_with_giants(docs, texts, vocabulary):
    got = {r["doc_id"]: r for r in sp.encode(docs, SENTENCEPIECE_MODEL, giant=700, chunk=100).collect()}
    assert set(got) == set(texts)
    for i, t in texts.items():
        ids = np.array(got[i]["ids"])
        assert got[i]["round_trip"] and got[i]["n_tokens"] == len(ids) and vocabulary.decode(ids) == (t or "").encode()
        assert vocabulary._score(ids) == pytest.approx(brute(vocabulary, sp.symbols_of(t or "")))


def test_chunk_borders_of_giants(spark, vocabulary):
    """Texts whose lengths meet the borders of chunks, of characters that are one or two units long elsewhere."""
    rng = random.Random(5)
    made = [prose(rng, 120)[:n] for n in (100, 101, 199, 200, 201, 400)] + ["é€😀▁ " * 60, "😀" * 101, " " * 150, "x" * 300]
    df = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in sp.encode(df, SENTENCEPIECE_MODEL, giant=99, chunk=100).collect()}
    assert set(got) == set(range(len(made)))
    for i, t in enumerate(made):
        ids = np.array(got[i]["ids"])
        assert got[i]["round_trip"] and vocabulary.decode(ids) == t.encode()
        assert vocabulary._score(ids) == pytest.approx(brute(vocabulary, sp.symbols_of(t)))


def test_a_very_long_text(spark):
    """Chunks are cut in one pass over the text."""
    text = "some words of a text that goes on 0123 " * 60_000
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    (row,) = sp.encode(df, SENTENCEPIECE_MODEL).selectExpr("n_tokens", "size(ids) n", "round_trip").collect()
    assert row["round_trip"] and row["n_tokens"] == row["n"] > 500_000


def test_edge_cases(odd, empty, spark):
    assert len(sp.encode(odd, SENTENCEPIECE_MODEL).collect()) == 5
    assert sp.encode(empty, SENTENCEPIECE_MODEL).collect() == []
    twice = spark.createDataFrame([(1, "ab " * 200), (1, "ab " * 200), (None, "ab " * 200)], "doc_id long, text string")
    assert sorted(str(r["doc_id"]) for r in sp.encode(twice, SENTENCEPIECE_MODEL, giant=100, chunk=50).collect()) == ["1", "1", "None"]


def test_ids_against_the_models_own_encoder(vocabulary):
    """No more ids than replayed merges give, and mostly the same words."""
    import sentencepiece
    from pyarrow import parquet

    own = sentencepiece.SentencePieceProcessor(model_file=SENTENCEPIECE_MODEL)
    texts = [t for t in parquet.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist() if t]
    words = sorted({w for t in texts for w in t.split()})
    got, want = sp.Encoder(vocabulary).texts(words), [own.encode(w, num_threads=1) for w in words]
    assert sum(map(len, got)) <= sum(map(len, want))
    assert sum(a.tolist() == b for a, b in zip(got, want)) > 0.6 * len(words)


def test_log_probabilities():
    assert sp.log_probabilities([None, -0.5, -2.0]) == [None, -0.5, -2.0]
    got = sp.log_probabilities([None, 0.0, -1.0, -2.0])
    assert got[0] is None and got[1] > got[2] > got[3] and np.exp(got[1:]).sum() == pytest.approx(1)
