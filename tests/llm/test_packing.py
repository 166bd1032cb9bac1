import base64
import random

import numpy as np
import pytest
from nichegrid.llm import packing
from nichegrid.llm.queries import BPE_RANKS


@pytest.fixture(scope="module")
def encoding():
    import tiktoken

    with open(BPE_RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("test", pat_str=packing.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_round_trip_and_shape(docs, texts, encoding):
    packs = packing.pack(docs, BPE_RANKS, width=64, window_tokens=3000).cache()
    got = {r["doc_id"]: r["ids"] for r in packing.unpack(packs).collect()}
    assert got == {i: encoding.encode_ordinary(t or "") for i, t in texts.items()}
    rows = packs.collect()
    assert len({r["pack"] for r in rows}) == len(rows)
    for r in rows:
        ids, positions = np.frombuffer(r["ids"], "<u2"), np.frombuffer(r["positions"], "<i4")
        assert len(ids) == len(positions) == 64 and r["lengths"][0] == 0 and r["lengths"][-1] == r["n_tokens"] <= 64
        want = [p for a, z in zip(r["lengths"], r["lengths"][1:] + [64]) for p in range(z - a)] if r["n_tokens"] == 64 else [p for a, z in zip(r["lengths"], r["lengths"][1:]) for p in range(z - a)] + list(range(64 - r["n_tokens"]))
        assert positions.tolist() == want[:64] and (ids[r["n_tokens"] :] == 50256).all()
    assert sum(r["n_tokens"] for r in rows) == sum(len(x) + 1 for x in got.values())


def test_best_fit_against_a_plain_search():
    rng = random.Random(3)
    for _ in range(30):
        width = rng.randint(5, 50)
        sizes = [rng.randint(1, width) for _ in range(rng.randint(0, 60))]
        bins = []
        for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
            fits = [b for b in bins if b[0] >= sizes[i]]
            if fits:
                b = min(fits, key=lambda b: b[0])
            else:
                bins.append(b := [width])
            b[0] -= sizes[i]
            b.append(i)
        got = packing.best_fit(sizes, width)
        assert sorted(width - sum(sizes[i] for i in b) for b in got) == sorted(b[0] for b in bins)
        assert sorted(i for b in got for i in b) == list(range(len(sizes)))


def test_words_give_the_tokenizers_ids(encoding):
    with open(BPE_RANKS, "rb") as f:
        tokens = packing.Tokens(f.read(), "<u2")
    for t in ["a b", " a", "a ", "a  b", "a\n b", "a \nb", "it's 't x's", "a\tb c", "x\u2003y z", "é€😀 b c", "don 't", "1 2 3a", "\n", "a\u00a0 b"]:
        assert np.frombuffer(tokens.encode(t), "<u2").tolist() == encoding.encode_ordinary(t), t


def test_edge_cases(odd, empty):
    rows = packing.pack(odd, BPE_RANKS, width=16).collect()
    assert sorted(str(d) for r in rows for d in r["doc_ids"]) == ["1", "1", "2", "3", "None"]
    assert packing.pack(empty, BPE_RANKS).collect() == []
    bare = packing.pack(odd, BPE_RANKS, end_id=None, width=16).collect()
    assert "2" not in {str(d) for r in bare for d in r["doc_ids"]}


def test_shards_hold_the_packs(docs, spark, tmp_path):
    packs = packing.pack(docs, BPE_RANKS, width=64, window_tokens=2000)
    want = {r["pack"]: r for r in packs.collect()}
    packing.write_matrices(packs, str(tmp_path / "m"), rows=7)
    seen = {}
    for s in spark.read.parquet(str(tmp_path / "m")).collect():
        ids, lengths = packing.matrix(s), np.frombuffer(s["lengths"], "<i4")
        assert ids.shape == (s["n_packs"], 64) and s["n_packs"] <= 7
        for i, pack in enumerate(s["index"]):
            seen[pack] = (ids[i].tobytes(), lengths[s["offsets"][i] : s["offsets"][i + 1]].tolist(), s["positions"][i * 256 : (i + 1) * 256])
    assert seen == {p: (r["ids"], r["lengths"], r["positions"]) for p, r in want.items()}
