import json
import os

import numpy as np
import pytest

from nichegrid.operators import agreement, features, layout, mixing
from nichegrid.plans import config, runs, steps
from nichegrid.sources import cohorts, networks, sinks
from nichegrid.sources import tissue as tissue_of
from nichegrid.streaming import arrivals

NODES = "patient string, sample string, node_id long, x double, y double, phenotype string"


def tissue(seed: int, n: int = 90):
    """Nodes around three niche centres, each with its own mix of phenotypes."""
    rng = np.random.default_rng(seed)
    niche = rng.integers(0, 3, n)
    xy = np.clip(np.array([[20, 20], [80, 20], [50, 80]])[niche] + rng.normal(0, 9, (n, 2)), 0, 100)
    kind = [int(rng.choice(3, p=np.where(np.arange(3) == k, 0.8, 0.1))) for k in niche]
    return [(i, float(x), float(y), f"type {k}") for i, ((x, y), k) in enumerate(zip(xy, kind))]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    out = tmp_path_factory.mktemp("cohort")
    for p in (1, 2):
        with open(out / f"nodes_patient-{p}.csv", "w") as f:
            f.write("id,X,Y,phenotype\n")
            f.writelines(f"{i},{x},{y},{k if i else 'NA'}\n" for i, x, y, k in tissue(p))
    (out / "notes.csv").write_text("a,b\n1,2\n")
    return out


@pytest.fixture(scope="module")
def cohort(spark, folder):
    c = config.Config.of({"cohort": {"folder": str(folder), "kind": ".csv", "patient": "patient", "x": "X", "y": "Y", "phenotype": "phenotype"}})
    return steps.nodes_of(spark, c).cache()


@pytest.fixture(scope="module")
def edges(cohort):
    return steps.networks(cohort, config.NetworkConfig()).cache()


def test_reading(cohort):
    rows = cohort.where("patient = '2'").orderBy("node_id").collect()
    assert cohort.count() == 180 and [(r["node_id"], r["x"], r["phenotype"]) for r in rows[:2]] == [(0, tissue(2)[0][1], None), (1, tissue(2)[1][1], tissue(2)[1][3])]
    assert {r["n_nodes"] for r in cohorts.sample_index(cohort).collect()} == {90}


def test_two_levels_of_ids(spark, tmp_path):
    for name in ("nodes_patient-a_sample-1.tsv", "nodes_patient-a_sample-x-2.tsv"):
        (tmp_path / name).write_text("X\tY\tn\n1\t2\t5\n3\tNA\t6\n")
    got = cohorts.read_cohort(spark, str(tmp_path), "patient", "sample", "tsv", "X", "Y")
    assert {(r["patient"], r["sample"]) for r in got.collect()} == {("a", "1"), ("a", "x-2")}
    assert sum(np.isnan(r["y"]) for r in got.collect()) == 2


def test_inference(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b,c,d\n1,1.5,x,\n2,NA,1,null\n")
    got = cohorts.read_table(spark, str(tmp_path / "t.csv"), "csv")
    assert dict(got.dtypes) == {"a": "bigint", "b": "double", "c": "string", "d": "bigint"} and got.where("b is null").count() == 1
    with pytest.raises(ValueError):
        cohorts.read_table(spark, str(tmp_path / "t.csv"), "csv", ["missing"])
    with pytest.raises(ValueError):
        cohorts.extension("xlsx")


def test_statistics(cohort, edges):
    wide = steps.statistics(cohort, edges, config.AssortativityConfig(n_shuffle=10)).toPandas().set_index("id")
    assert (wide["# total"] == 90).all() and (wide["assort"] > 0.3).all() and (wide["assort Z"] > 3).all()
    assert list(wide.columns[:5]) == ["# total", "% type 0", "% type 1", "% type 2", "assort"]
    assert (wide[[c for c in wide if c.startswith("% ")]].sum(1) < 1).all()  # the unlabelled node counts below the line
    none = steps.statistics(cohort, edges, config.AssortativityConfig(n_shuffle=0)).toPandas()
    assert none["assort MEAN"].isna().all() and (none["type 1 - type 0 MEAN"] == 0).all()


def test_random_labellings_by_sample_and_by_joins(cohort, edges):
    """Both keep the labels' numbers and have about the same mean and deviation of the coefficient."""
    found = []
    for tile in (1000, 10):
        random = mixing.permutations(edges, cohort, 60, tile=tile).cache()
        assert all(r["s"] == pytest.approx(1) for r in random.groupBy("patient", "rep").agg({"value": "sum"}).withColumnRenamed("sum(value)", "s").collect())
        a = [r["assortativity"] for r in mixing.coefficient(random.selectExpr("struct(patient, rep) as patient", "null as sample", "a", "b", "value")).collect()]
        assert len(a) == 120
        found.append((np.mean(a), np.std(a)))
    assert found[0][0] == pytest.approx(found[1][0], abs=0.03) and found[0][1] == pytest.approx(found[1][1], rel=0.35)


def test_mixing_is_symmetric(cohort, edges):
    m = {(r["patient"], r["a"], r["b"]): r["value"] for r in mixing.mixing_matrix(edges, cohort, normalized=True).collect()}
    assert all(m[p, b, a] == pytest.approx(v) for (p, a, b), v in m.items())
    assert sum(m.values()) == pytest.approx(2.0)


def test_niches_and_runs(cohort, edges, tmp_path):
    c = config.NicheConfig.of({"reduce": False, "clusterer": "gmm", "n_clusters": 3, "normalize": "all"})
    found = steps.niches(cohort, edges, c)
    assert found.labels.count() == 180 and set(found.composition) == {"total", "obs", "niche", "niche&obs", "clr"}
    assert sorted(r["row_id"] for r in found.labels.collect()) == list(range(180))
    sinks.check_labels(cohort, found.labels)
    assert "niches_1-1-1" in sinks.with_labels(cohort, found.labels, "1-1-1").columns
    with pytest.raises(ValueError):
        sinks.check_labels(cohort, found.labels.where("row_id > 0"))

    register = runs.Register(str(tmp_path / "runs.json"))
    records = runs.sweep(cohort, edges, runs.grid(c, {"n_clusters": [2, 3], "order": [1]}), str(tmp_path), register)
    assert [r["run"] for r in records] == ["1-1-1", "1-1-2"] and all(r["error"] is None for r in records)
    assert runs.sweep(cohort, edges, runs.grid(c, {"n_clusters": [3]}), str(tmp_path), register)[0]["run"] == "1-1-2"
    spark = cohort.sparkSession
    labels = {r: spark.read.parquet(f"{tmp_path}/labels/{r}") for r in register.runs()}
    pairs, stable = runs.compared(labels)
    assert pairs.count() == 1 and all(0 < r["stability"] <= 1 for r in stable.collect())
    (both,) = runs.consecutive(labels).collect()
    assert (both["run_a"], both["run_b"]) == ("1-1-1", "1-1-2") and both["ami"] <= 1
    assert runs.sensitivity(runs.grid(c, {"n_clusters": [2, 3]}), records)[0] == ["run", "n_clusters", "niches", "error"]
    assert json.load(open(tmp_path / "runs.json"))["stages"][0]["settings"]["order"] == 1


def test_stages_are_computed_once(cohort, edges, tmp_path, monkeypatch):
    taken = []
    whole = layout.umap
    monkeypatch.setattr(layout, "umap", lambda *a, **b: taken.append(1) or whole(*a, **b))
    made = steps.feature_stage
    monkeypatch.setattr(steps, "feature_stage", lambda *a: taken.append(0) or made(*a))
    c = config.NicheConfig.of({"epochs": 3, "clusterer": "gmm"})
    register = runs.Register(str(tmp_path / "runs.json"))
    records = runs.sweep(cohort, edges, runs.grid(c, {"n_clusters": [2, 3, 4]}), str(tmp_path), register)
    assert [r["run"] for r in records] == ["1-1-1", "1-1-2", "1-1-3"] and sorted(taken) == [0, 1]
    again = runs.run(cohort, edges, runs.grid(c, {"n_clusters": [3]})[0], str(tmp_path), register)
    assert again[0] == "1-1-2" and sorted(taken) == [0, 1]


def test_plans():
    axes = {"order": [1, 2], "reduce": [True, False], "metric": ["euclidean"]}
    assert runs.parsed_plan(runs.plan_text(axes)) == axes
    assert runs.parsed_plan("n_clusters: 2..8 x 4  # comment\nresolution: 0.01..1.0 x 3 log") == {"n_clusters": [2, 4, 6, 8], "resolution": [0.01, 0.1, 1.0]}
    for bad in ("order 1", "unknown: 1", "metric: cosine"):
        with pytest.raises(ValueError):
            runs.parsed_plan(bad)


def test_networks_as_files(spark, cohort, edges, tmp_path):
    folder = str(tmp_path / "net")
    networks.write_network(cohort, edges, folder)
    nodes, found = networks.read_network(spark, folder)
    assert nodes.count() == 180 and found.count() == edges.count() and set(found.columns) == {"patient", "sample", "source", "target"}
    labels = cohort.select("patient", "sample", "node_id", (cohort["node_id"] % 3).alias("niche"))
    for run in ("1-1-10", "1-1-2"):
        networks.merge_labels(spark, folder, labels, run)
    nodes, _ = networks.read_network(spark, folder)
    assert networks.label_runs(nodes) == ["1-1-2", "1-1-10"] and nodes.count() == 180
    got = networks.read_labels(nodes.selectExpr("*", "if(node_id = 5, null, 1) as niches_9"))
    assert list(got) == ["1-1-2", "1-1-10"]  # run 9 lacks a label
    assert got["1-1-2"].where("niche = 2").count() == 60
    with pytest.raises(ValueError):
        networks.merge_labels(spark, folder, labels.where("node_id > 0"), "x")
    with pytest.raises(ValueError):
        networks.merge_labels(spark, folder, labels, "x", kind="csv")
    networks.save_embedding(spark.createDataFrame([(0, [1.0, 2.0])], "id long, vector array<double>"), spark.createDataFrame([(0, "1", None, 7)], "row_id long, patient string, sample string, node_id long"), f"{folder}/embedding")
    assert spark.read.parquet(f"{folder}/embedding").columns == ["patient", "sample", "node_id", "dim_1", "dim_2"]
    (tmp_path / "net/temp").mkdir()
    assert networks.clear_temporary(spark, folder) and not networks.clear_temporary(spark, folder)


def test_conversion(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for p in ("01", "2"):
        (tmp_path / f"in/nodes_patient-{p}.csv").write_text("X,Y,n\n1,2,5\n3.5,4,NA\n")
        (tmp_path / f"in/edges_patient-{p}.csv").write_text("source,target\n0,1\n")
    out = str(tmp_path / "out")
    assert networks.convert(spark, str(tmp_path / "in"), out, "patient", None, "csv") == 4
    nodes, found = networks.read_network(spark, out)
    assert {r["patient"] for r in nodes.collect()} == {"01", "2"} and dict(nodes.dtypes)["n"] == "bigint" and dict(nodes.dtypes)["X"] == "double"
    assert networks.checked_edges(found).count() == 2
    assert networks.read_edges(spark, str(tmp_path / "in"), "patient", None, "csv").count() == 2
    with pytest.raises(ValueError):
        networks.checked_edges(nodes)
    assert networks.file_name("edges", "patient", "7", "sample", "2") == "edges_patient-7_sample-2.parquet"
    with pytest.raises(ValueError):
        networks.file_name("edges", "patient", "7_1")


def test_planted_niches_are_found(spark):
    nodes = tissue_of.tissue(spark, 1, 1500).cache()
    assert nodes.count() == 1500 and nodes.where("x between 0 and 1000 and y between 0 and 1000").count() == 1500
    found = steps.niches(nodes, steps.networks(nodes, config.NetworkConfig()), config.NicheConfig.of({"clusterer": "gmm", "n_clusters": 5, "epochs": 200, "order": 2}))
    rows = found.labels.join(nodes.select("node_id", "true_niche"), "node_id").selectExpr("true_niche as a", "niche as b")
    assert agreement.rand_index(rows).first()["ari"] > 0.4
    means = {r["column"]: r["mean"] for r in features.column_means(found.features, ["pheno_0 mean", "pheno_1 mean"]).collect()}
    assert all(0 <= m <= 1 for m in means.values())


def test_sweep_reports_failures(cohort, edges, tmp_path):
    bad = config.NicheConfig.of({"columns": ["x", "y"], "reduce": False, "clusterer": "gmm"})
    broken = cohort.withColumn("x", cohort["x"] * float("nan"))
    (r,) = runs.sweep(broken, edges, [bad], str(tmp_path), runs.Register(str(tmp_path / "r.json")))
    assert r["run"] is None and "finite" in r["error"]


def test_axes():
    assert runs.axis(1, 100, 3, "log") == [1, 10, 100] and runs.axis(0, 1, 5) == [0, 0.25, 0.5, 0.75, 1]
    assert runs.axis(1, 3, 9, whole=True) == [1, 2, 3] and sorted(["1-10-1", "1-2-1"], key=runs.order) == ["1-2-1", "1-10-1"]
    base = config.NicheConfig()
    assert runs.recomputed(runs.grid(base, {"order": [1, 2], "resolution": [0.1, 0.2, 0.3]})) == {"features": 2, "reduction": 2, "clustering": 6}


def test_configuration(tmp_path):
    path = tmp_path / "c.yaml"
    path.write_text("cohort: {folder: data, kind: csv, patient: patient, x: X, y: Y}\nnetwork: {adaptive: 'no', longest: 40}\nniches: {order: '2', clusterer: unknown}\n")
    c = config.Config.read(str(path))
    assert c.cohort.folder == str(tmp_path / "data") and not c.network.adaptive and c.network.longest == 40
    assert c.niches.order == 2 and c.niches.clusterer == "leiden"
    for bad in ({}, {"cohort": {"folder": "a"}}, {"cohort": {"folder": "a", "kind": "x", "patient": "p", "x": "x", "y": "y"}}, {"cohort": {"folder": "a", "kind": "csv", "patient": "p_q", "x": "x", "y": "y"}}):
        with pytest.raises(config.ConfigError):
            config.Config.of(bad)
    for bad in ({"statistics": "median"}, {"clusterer": "hdbscan"}, {"order": "x"}, {"order": -1}):
        with pytest.raises(config.ConfigError):
            config.NicheConfig.of(bad)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan"), "a"), (2, float("-inf"), "b")], "n long, x double, s string")
    sinks.write_parquet(df, str(tmp_path / "p"), about={"source": "here"})
    assert sinks.read_about(spark.read.parquet(str(tmp_path / "p"))) == {"source": "here"}
    sinks.write_csv(df, str(tmp_path / "c"))
    (part,) = [f for f in os.listdir(tmp_path / "c") if f.endswith(".csv")]
    assert (tmp_path / "c" / part).read_text() == "n,x,s\n1,,a\n2,-inf,b\n"


def test_arrivals(spark, tmp_path):
    for p in (1, 2):
        spark.createDataFrame([(str(p), None, *row) for row in tissue(p, 40)], NODES).coalesce(1).write.parquet(str(tmp_path / "in"), mode="append")
        q = arrivals.follow(arrivals.arriving(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check"))
        q.awaitTermination()
        assert q.exception() is None
    got = spark.read.parquet(str(tmp_path / "out/assortativity"))
    assert {r["patient"] for r in got.collect()} == {"1", "2"} and got.count() == 2


def test_a_stopped_writer_loses_nothing(spark, tmp_path, monkeypatch):
    from nichegrid.sources import sinks

    path = f"{tmp_path}/table"
    rows = lambda: sorted(r["id"] for r in spark.read.parquet(path).collect())
    networks.write_whole(spark.range(3), path, about={"source": "a"})
    assert rows() == [0, 1, 2] and sinks.read_about(spark.read.parquet(path)) == {"source": "a"}
    networks.write_whole(spark.read.parquet(path).where("id > 0"), path)  # of what it reads
    assert rows() == [1, 2]
    files, moves = networks._files, []

    class Stopped(Exception):
        pass

    class Fs:
        def __init__(self, real):
            self.real = real

        def rename(self, a, b):
            moves.append(1)
            if len(moves) == 2:
                raise Stopped
            return self.real.rename(a, b)

        def __getattr__(self, name):
            return getattr(self.real, name)

    monkeypatch.setattr(networks, "_files", lambda s, p: (Fs(files(s, p)[0]), files(s, p)[1]))
    with pytest.raises(Stopped):
        networks.write_whole(spark.range(9), path)
    monkeypatch.undo()
    networks.settle(spark, path)
    spark.catalog.refreshByPath(path)
    assert rows() == [1, 2]
    networks.write_whole(spark.range(4), path)
    assert rows() == [0, 1, 2, 3]


def test_a_stage_of_another_source_is_made_anew(spark, tmp_path):
    path, made = f"{tmp_path}/stage", []
    make = lambda: made.append(1) or spark.range(5)
    for source in ("cohort a", "cohort a", "cohort b"):
        assert runs.stored(spark, path, source, 5, make).count() == 5
    assert len(made) == 2
