import json
import os
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from nichegrid.functions.clock import clock
from nichegrid.operators import clustering, delaunay, graph, vectors
from nichegrid.plans import benchmark, config, runs, steps
from nichegrid.sources import sinks
from nichegrid.sources.tissue import tissue

OWN = {"reduce": False, "clusterer": "leiden", "resolution": 0.3, "per_sample": True}


@pytest.fixture(scope="module")
def nodes(spark):
    """Three samples of other sizes, one of which has a sample id, and one of a single node."""
    t = tissue(spark, 4, 120).drop("true_niche")
    size = F.when(F.col("patient") == "4", 1).when(F.col("patient") == "3", 60).otherwise(120)
    return t.where(F.col("node_id") < size).withColumn("sample", F.when(F.col("patient") == "2", "a")).cache()


@pytest.fixture(scope="module")
def edges(nodes):
    return steps.networks(nodes, config.NetworkConfig()).cache()


def test_nearest_by_column(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(60, 3)), 1)
    x[40:44] = x[0]  # repeated vectors within and across
    by = [int(b) for b in rng.integers(0, 3, 60)]
    df = spark.createDataFrame([(b, i, v.tolist()) for i, (b, v) in enumerate(zip(by, x))], "g int, id long, vector array<double>")
    got = {(r["source"], r["rank"]): r["target"] for r in vectors.nearest(df, 4, by="g", block=8).collect()}
    want = {}
    for i in range(60):
        others = sorted((j for j in range(60) if j != i and by[j] == by[i]), key=lambda j: (np.sqrt(((x[j] - x[i]) ** 2).sum()), j))
        want |= {(i, r + 1): j for r, j in enumerate(others[:4])}
    assert got == want
    with pytest.raises(ValueError):
        vectors.nearest(df, 4, search="descent", by="g")


def test_communities_apart_are_those_of_each_graph(spark):
    """Two cliques with a bridge in one graph; in a heavier graph, the same with weights of 50; a graph without weight."""
    clique = lambda at: [(at + i, at + j) for i in range(5) for j in range(i)]
    rows = [(g, a + at, b + at, w) for g, at, w in ((0, 0, 1.0), (7, 100, 50.0)) for a, b in [*clique(0), *clique(5), (0, 5)]] + [(9, 200, 201, 0.0)]
    links = spark.createDataFrame(rows, "by long, a long, b long, weight double")
    ids = spark.createDataFrame([(0, i) for i in range(10)] + [(7, 100 + i) for i in range(10)] + [(9, 200), (9, 201)], "by long, node long")
    got = {(r["by"], r["node"]): r["niche"] for r in clustering.communities_apart(links, ids).collect()}
    assert got == {(0, i): i // 5 for i in range(10)} | {(7, 100 + i): i // 5 for i in range(10)} | {(9, 200): 0, (9, 201): 1}
    assert clustering.communities_apart(links.limit(0), ids).count() == 22


def test_modularity_of_samples_found_together(spark, nodes, edges):
    c = config.NicheConfig.of(OWN)
    table = steps.feature_stage(nodes, edges, c)
    together = steps.labels_of_samples(table, c).cache()
    assert together.count() == nodes.count()
    for r in steps.starts(table).collect():
        alone = steps.labels_of_sample(table, r["start"], r["n"], c)
        mine = together.where(F.col("row_id").between(r["start"], r["start"] + r["n"] - 1))
        assert sorted({x["niche"] for x in mine.collect()}) == list(range(mine.select("niche").distinct().count()))
        if r["n"] == 1:
            continue
        names = [x for x in table.columns if x not in (*graph.SAMPLE, "node_id", "row_id")]
        rows = table.where(F.col("row_id").between(r["start"], r["start"] + r["n"] - 1)).select(F.col("row_id").alias("id"), F.array(*(F.col(f"`{x}`") for x in names)).alias("vector"))
        near = clustering.neighbour_graph(vectors.nearest(rows, c.k_cluster)).cache()
        q = [clustering.modularity(near, x.select(F.col("row_id").alias("node"), "niche"), c.resolution).first()[0] for x in (mine, alone)]
        assert q[0] > 0.98 * q[1]


def jobs(spark, name, work):
    spark.sparkContext.setJobGroup(name, name)
    try:
        work()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_jobs_do_not_grow_with_samples(spark):
    c, counts = config.NicheConfig.of(OWN), []
    for samples in (2, 12):
        t = tissue(spark, samples, 40)
        table = steps.feature_stage(t, steps.networks(t, config.NetworkConfig()), c)
        counts.append(jobs(spark, f"samples {samples}", lambda: steps.labels_of_samples(table, c).collect()))  # noqa: B023
    assert counts[1] < 2 * counts[0]


def test_numbers_of_runs(spark, nodes, edges, tmp_path, monkeypatch):
    folder, register = str(tmp_path), runs.Register(str(tmp_path / "runs.json"))
    c = config.NicheConfig.of(OWN)
    number, labels = runs.run(nodes, edges, c, folder, register)
    assert number == "ps-1" and labels.count() == nodes.count()
    about = register.runs_per_sample()["ps-1"]
    assert about["status"] == "done" and set(about["samples"]) == {"1", "2_a", "3", "4"} and about["samples"]["4"] == 1
    assert runs.order("ps-2") < runs.order("ps-10") and runs.order("9-9-9") < runs.order("ps-1")

    made = []
    monkeypatch.setattr(steps, "labels_of_samples", lambda *a: made.append(1))
    assert runs.run(nodes, edges, c, folder, register)[0] == "ps-1" and not made  # taken from the store
    monkeypatch.undo()
    other = config.NicheConfig.of(OWN | {"resolution": 0.6})
    assert runs.sweep(nodes, edges, [other], folder, register)[0]["run"] == "ps-2"
    assert list(register.runs()) == ["ps-1", "ps-2"]

    os.remove(tmp_path / "runs.json")  # a register that is lost doesn't hand out numbers whose labels are others'
    assert runs.run(nodes, edges, config.NicheConfig.of(OWN | {"k_cluster": 5}), folder, register)[0] == "ps-3"
    assert runs.run(nodes, edges, other, folder, register)[0] == "ps-4"


def test_a_run_goes_on_where_it_failed(spark, nodes, edges, tmp_path, monkeypatch):
    folder, register = str(tmp_path), runs.Register(str(tmp_path / "runs.json"))
    c = config.NicheConfig.of({"reduce": False, "clusterer": "gmm", "n_clusters": 3, "per_sample": True})
    whole, seen = steps.labels_of_sample, []

    def broken(table, start, n, settings):
        seen.append(start)
        if len(seen) == 3:
            raise RuntimeError("lost")
        return whole(table, start, n, settings)

    monkeypatch.setattr(steps, "labels_of_sample", broken)
    with pytest.raises(RuntimeError):
        runs.run(nodes, edges, c, folder, register)
    about = register.runs_per_sample()["ps-1"]
    assert about["status"] == "failed" and set(about["samples"]) == {"1", "2_a"}
    number, labels = runs.run(nodes, edges, c, folder, register)
    assert number == "ps-1" and seen == [0, 120, 240, 240, 300] and labels.count() == nodes.count()
    about = json.load(open(tmp_path / "runs.json"))["per_sample"]["ps-1"]
    assert about["status"] == "done" and about["samples"]["4"] == 1
    assert [r["n"] for r in labels.groupBy("patient").agg(F.min("niche").alias("n")).collect()] == [0] * 4
    shutil.rmtree(tmp_path / "samples")
    assert runs.run(nodes, edges, c, folder, register)[1].count() == nodes.count()  # the labels are whole


def test_clock_by_sample(spark, nodes):
    with clock(spark) as spent:
        found = delaunay.network(nodes)
    n = found.count()
    assert set(spent.by_sample()) == {("1", None), ("2", "a"), ("3", None), ("4", None)}
    assert all(s > 0 for s in spent.by_sample().values()) and abs(sum(spent.by_sample().values()) - spent.seconds()) < 1e-9
    before = spent.seconds()
    assert delaunay.network(nodes).count() == n and spent.seconds() == before  # built outside
    with clock(spark) as tiles:
        delaunay.delaunay(nodes, tile=50).count()
    assert {("1", None), ("2", "a"), ("3", None)} <= set(tiles.by_sample())


def test_table_of_costs(spark, nodes, edges, tmp_path):
    path = f"{tmp_path}/edges"
    found, costs = benchmark.networks(nodes, config.NetworkConfig(), path)
    rows = costs.collect()
    size = {(r["patient"], r["sample"]): r["n"] for r in edges.groupBy("patient", "sample").agg(F.count("*").alias("n")).collect()}
    assert [(r["patient"], r["nodes"]) for r in rows] == [("1", 120), ("2", 120), ("3", 60), ("4", 1)]
    assert found.count() == edges.count() and all(r["edges"] == size.get((r["patient"], r["sample"]), 0) and r["seconds"] > 0 for r in rows)
    again = benchmark.networks(nodes, config.NetworkConfig(), path)[1]
    assert [r["seconds"] for r in again.collect()] == [None] * 4  # nothing was computed
    sinks.write_csv(again, f"{tmp_path}/csv")
    text = spark.read.text(f"{tmp_path}/csv").collect()
    assert text[0][0] == "patient,sample,nodes,edges,seconds" and text[4][0] == "4,,1,0,"
    assert benchmark.networks(nodes, config.NetworkConfig(n_edges=5), path)[1].first()["seconds"] > 0  # other settings
    assert benchmark.networks(nodes.limit(0), config.NetworkConfig())[1].count() == 0


def test_samples_of_measurements():
    s = benchmark.Samples([3.0, 1.0, 2.0, 10.0])
    assert s.median() == 2.5 and s.mad() == 1.0 and s.best() == 1.0
    taken = []
    assert len(benchmark.measure(3, lambda: taken.append(1)).seconds) == 3 and len(taken) == 4


def test_communities_of_labels(spark):
    from nichegrid.plans.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    got = QUERIES["communities_by_label"](spark, sf).collect()
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", F.col("label").cast("long")).collect()
    assert sorted((r["node"], r["label"]) for r in got) == sorted(map(tuple, rows))
    own = {}
    for r in got:
        own.setdefault(r["label"], set()).add(r["niche"])
    assert all(x == set(range(len(x))) for x in own.values())
