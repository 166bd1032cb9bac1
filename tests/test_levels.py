import numpy as np
import pytest

from nichegrid.operators import ordering
from nichegrid.plans import levels
from nichegrid.sources.tissue import tissue

LABELS = sorted(f"pheno_{i}" for i in range(12))


def test_records(spark, tmp_path):
    df = spark.range(5)
    a = {"x": levels.exact(df), "y": levels.floats([1.0, float("nan"), 3.0])}
    levels.save(a, str(tmp_path / "r.json"))
    assert levels.differences(a, levels.load(str(tmp_path / "r.json"))) == []
    b = {"x": levels.exact(df.where("id > 0")), "y": levels.floats([1.0, 2.0, 3.0 + 1e-12]), "z": levels.floats([])}
    found = levels.differences(a, b)
    assert [f.split(":")[0].split(" ")[0] for f in found] == ["z", "x", "y[1]"]
    assert levels.exact(df)["digest"] == levels.exact(df.repartition(3))["digest"]


def test_golden_record_is_reproducible(spark):
    nodes = tissue(spark, 2, 400)
    record = levels.golden(nodes, LABELS)
    assert record["edges"]["count"] > 800 and len(record["feature_means"]["values"]) == 24 and len(record["assortativity"]["values"]) == 2
    assert levels.reproducible(nodes, LABELS) == []


def test_recovery(spark):
    got = levels.recovery(spark, 1200, settings={"epochs": 200, "order": 2})
    assert got["ari"] > 0.4 and got["nmi"] > 0.4 and 0 < got["overlap"] < 1


def brute_ward(x):
    """Merges by the increase of the sum of squares, from scratch at each step."""
    groups = {i: [i] for i in range(len(x))}
    spread = lambda g: ((x[g] - x[g].mean(0)) ** 2).sum()
    out = []
    while len(groups) > 1:
        cost = {(a, b): spread(groups[a] + groups[b]) - spread(groups[a]) - spread(groups[b]) for a in groups for b in groups if a < b}
        a, b = min(cost, key=cost.get)
        out.append((a, b, np.sqrt(2 * cost[a, b]), len(groups[a]) + len(groups[b])))
        groups[len(x) + len(out) - 1] = groups.pop(a) + groups.pop(b)
    return out


def test_ward_against_sums_of_squares():
    x = np.random.default_rng(4).normal(size=(12, 3))
    got, want = ordering.ward(x), brute_ward(x)
    assert [(a, b, n) for a, b, _, n in got] == [(a, b, n) for a, b, _, n in want]
    assert np.allclose([m[2] for m in got], [m[2] for m in want])
    assert sorted(ordering.leaves(got, 12)) == list(range(12)) and len(ordering.segments(got, 12)) == 33
    assert ordering.ward(x[:1]) == [] and ordering.leaves([], 1) == [0]


def test_ordered_heatmap(spark):
    rows = [(a, b, 1.0 if (a in "pq") == (b in "pq") else 0.0) for a in "apbq" for b in "apbq" if (a, b) != ("a", "b")]
    got = ordering.ordered(spark.createDataFrame(rows, "a string, b string, value double"), diagonal=False).collect()
    place = {r["a"]: r["a_place"] for r in got}
    assert abs(place["p"] - place["q"]) == 1 and len(got) == 16 and sum(np.isnan(r["value"]) for r in got) == 5
    with pytest.raises(ValueError):
        ordering.ordered(spark.range(600).selectExpr("id as a", "id as b", "1.0D as value"))
