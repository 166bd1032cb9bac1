import collections
import re

import pytest
from nichegrid.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(sizes, shares=(5, 2, 1), total=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: shares[i % len(shares)] for i, s in enumerate(names)}
    left, open_, target = total * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] >= most * sizes[s]}
        if not full:
            return target | {s: level * weight[s] for s in open_}
        target |= {s: most * sizes[s] for s in full}
        left -= sum(target[s] for s in full)
        open_ -= full
    return target


def test_targets_and_taken(docs, texts):
    got = mixing.mix(docs).collect()
    source = {r["doc_id"]: r["source"] for r in got}
    size = {i: len(WORD.findall(t or "")) for i, t in texts.items()}
    total = collections.Counter()
    for i, n in size.items():
        total[source[i]] += n
    want = brute_targets(dict(total))
    taken = collections.Counter()
    for r in got:
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == total[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]]) and 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(taken[s] == int(want[s] + 1e-9) for s in want)
    again = {r["doc_id"]: r["taken"] for r in mixing.mix(docs.repartition(7)).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in got}


def test_whole_epochs_come_first(docs):
    for r in mixing.mix(docs).collect():
        epochs = int(r["target"] // r["source_size"]) if r["source_size"] else 0
        assert epochs * r["size"] <= r["taken"] <= (epochs + 1) * r["size"]


def test_any_ranges_give_the_same_mix(docs):
    want = sorted(map(str, mixing.mix(docs).collect()))
    assert sorted(map(str, mixing.mix(docs, bucket_rows=3).collect())) == want


def test_weights_decide_inclusion(spark):
    rows = [(i, ("good words here " * 10) if i % 2 else ("$$$ *** @@@ " * 10), "a") for i in range(2000)]
    docs = spark.createDataFrame([*rows, *((10_000 + i, "w " * 30, "b") for i in range(6000))], "doc_id long, text string, source string")
    taken = collections.Counter()
    for r in mixing.mix(docs, shares=(1, 7), total=0.5, most=1.0).collect():
        if r["source"] == "a" and r["taken"]:
            taken[r["doc_id"] % 2] += 1
    assert taken[1] > 2.5 * taken[0] > 0


def test_edge_cases(odd, empty, spark):
    assert len(mixing.mix(odd).collect()) == 5
    assert mixing.mix(empty).collect() == []
    nothing = spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id long, text string, source string")
    assert {(r["taken"], r["target"]) for r in mixing.mix(nothing).collect()} == {(0, 0.0)}
