"""Numbered runs of the niche step, their register, and sweeps over parameter grids.

A run's number is features-reduction-clustering: runs that share a stage's settings share its number. Results are
Parquet folders named after the numbers, so that a sweep computes each stage once. A run of all samples on their own is
ps-1, ps-2 and so on.
"""

from __future__ import annotations

import fcntl
import itertools
import json
import os
import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import replace
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nichegrid.operators import agreement
from nichegrid.operators.graph import SAMPLE
from nichegrid.plans import steps
from nichegrid.plans.config import NicheConfig
from nichegrid.sources.networks import settle, write_whole
from nichegrid.sources.sinks import read_about


class Register:
    """The runs that were made, in a JSON file that one process changes at a time."""

    def __init__(self, path: str):
        self.path = path

    @contextmanager
    def _open(self) -> Iterator[dict[str, Any]]:
        os.makedirs(os.path.dirname(os.path.abspath(self.path)), exist_ok=True)
        with open(f"{self.path}.lock", "w") as lock:
            fcntl.flock(lock, fcntl.LOCK_EX)
            found = json.load(open(self.path)) if os.path.exists(self.path) else {"stages": [], "runs": {}}
            yield found
            with open(f"{self.path}.new", "w") as f:
                json.dump(found, f, indent=1)
            os.replace(f"{self.path}.new", self.path)

    def number(self, config: NicheConfig, cohort: str) -> str:
        """The run's number such as 1-2-1; settings and cohorts seen before keep theirs."""
        with self._open() as found:
            level, out = found["stages"], []
            for name, settings in config.stages().items():
                own = {"settings": settings} | ({"cohort": cohort} if name == "features" else {})
                at = next((i for i, s in enumerate(level) if {k: s[k] for k in own if k in s} == own), None)
                if at is None:
                    at = len(level)
                    level.append(own | {"next": []})
                out.append(str(at + 1))
                level = level[at]["next"]
            return "-".join(out)

    def per_sample(self, config: NicheConfig, cohort: str, free: Callable[[str], bool] = lambda run: True) -> str:
        """The number ps-N of a run of single samples, which is running from now on. Settings and cohorts seen before keep
        theirs; a number whose results are another run's, as `free` says of it, is passed over."""
        own = {"settings": config.stages(), "cohort": cohort}
        with self._open() as found:
            known = found.setdefault("per_sample", {})
            run = next((r for r, about in known.items() if {k: about[k] for k in own} == own), None)
            if run is not None and not free(run):
                del known[run]
                run = None
            if run is None:
                last = max((order(r)[1] for r in known), default=0)
                run = next(r for r in (f"ps-{int(last) + i}" for i in itertools.count(1)) if free(r))
                known[run] = own | {"samples": {}}
            known[run]["status"] = "running"
            return run

    def mark_sample(self, run: str, sizes: dict[str, int]) -> None:
        """Notes samples of a run that are done, with their numbers of niches."""
        with self._open() as found:
            found["per_sample"][run]["samples"].update(sizes)

    def mark_per_sample(self, run: str, status: str) -> None:
        """Notes how a run of single samples ended; one that the register has lost is left so."""
        with self._open() as found:
            if run in found.get("per_sample", {}):
                found["per_sample"][run]["status"] = status

    def runs_per_sample(self) -> dict[str, dict[str, Any]]:
        with self._open() as found:
            return dict(sorted(found.get("per_sample", {}).items(), key=lambda x: order(x[0])))

    def mark(self, run: str, about: dict[str, Any]) -> None:
        with self._open() as found:
            found["runs"][run] = about

    def runs(self) -> dict[str, dict[str, Any]]:
        """The marked runs in the order of their numbers."""
        with self._open() as found:
            return dict(sorted(found["runs"].items(), key=lambda x: order(x[0])))


def order(run: str) -> list[float]:
    """Runs sort by their numbers, not by their digits; those of single samples come last."""
    return [float("inf") if x == "ps" else int(x) for x in run.split("-")]


def digest(df: DataFrame) -> str:
    """A sum of row hashes and the number of rows, whatever their order."""
    return "/".join(str(x) for x in df.agg(F.sum(F.xxhash64(*(F.col(f"`{c}`") for c in sorted(df.columns))).cast("decimal(38,0)")), F.count("*")).first())


def fingerprint(nodes: DataFrame, edges: DataFrame) -> str:
    """What a cohort's results depend on: digests of nodes and edges."""
    return f"{digest(nodes)}/{digest(edges)}"


def grid(base: NicheConfig, axes: dict[str, list[Any]]) -> list[NicheConfig]:
    """All combinations of the axes' values; axes of early stages vary slowest, so that stages are reused."""
    early = ("columns", "order", "statistics", "reduce", "metric", "n_neighbors", "dimensions", "epochs", "min_dist")
    names = sorted(axes, key=lambda a: (early.index(a) if a in early else len(early), a))
    return [replace(base, **dict(zip(names, values, strict=True))) for values in itertools.product(*(axes[n] for n in names))]


def axis(start: float, stop: float, count: int, scale: str = "linear", whole: bool = False) -> list[float]:
    """An axis of `count` values from start to stop, evenly or by equal factors; whole values come once each."""
    if count < 2:
        out = [start]
    elif scale == "log":
        if start <= 0 or stop <= 0:
            raise ValueError("a logarithmic axis needs positive ends")
        out = [start * (stop / start) ** (i / (count - 1)) for i in range(count)]
    else:
        out = [start + (stop - start) * i / (count - 1) for i in range(count)]
    return list(dict.fromkeys(round(x) for x in out)) if whole else [round(x, 6) for x in out]


def recomputed(configs: list[NicheConfig]) -> dict[str, int]:
    """How many times a sweep computes each stage, results being reused."""
    seen: dict[str, set] = {"features": set(), "reduction": set(), "clustering": set()}
    for c in configs:
        key = ""
        for name, settings in c.stages().items():
            key += json.dumps(settings, sort_keys=True)
            seen[name].add(key)
    return {name: len(x) for name, x in seen.items()}


def _source(spark: SparkSession, path: str) -> str | None:
    """What a stored table says that it comes from, "" if it doesn't say; None if there is no table."""
    settle(spark, path)
    try:
        return read_about(spark.read.parquet(path)).get("source", "")
    except AnalysisException:  # nothing there
        return None


def stored(spark: SparkSession, path: str, source: str, rows: int | None, make: Callable[[], DataFrame]) -> DataFrame:
    """What is stored at path, if it says that it comes from this source and has as many rows as expected (None: any number);
    else it is made anew, and takes the old one's place when it is whole."""
    if _source(spark, path) == source:
        found = spark.read.parquet(path)
        if rows is None or found.count() == rows:
            return found
    write_whole(make(), path, about={"source": source})
    return spark.read.parquet(path)


def run(nodes: DataFrame, edges: DataFrame, config: NicheConfig, folder: str, register: Register) -> tuple[str, DataFrame]:
    """(number, labels) of a run. Features and layout are stored by the stage's number, so that runs which share them
    compute them once; labels are stored by the run's. A stored stage of another cohort, of other settings or of another
    number of rows is computed again. Settings for single samples make a run ps-N, see run_per_sample."""
    if config.per_sample:
        return run_per_sample(nodes, edges, config, folder, register)
    spark = nodes.sparkSession
    cohort = fingerprint(nodes, edges)
    number = register.number(config, cohort)
    first, second = number.split("-")[0], "-".join(number.split("-")[:2])
    n = nodes.count()
    source, so_far = {}, cohort
    for name, settings in config.stages().items():
        so_far += json.dumps({name: settings}, sort_keys=True)
        source[name] = so_far

    def features() -> DataFrame:
        return stored(spark, f"{folder}/features/{first}", source["features"], n, lambda: steps.feature_stage(nodes, edges, config))

    def reduced() -> DataFrame:
        return stored(spark, f"{folder}/reduction/{second}", source["reduction"], n, lambda: steps.reduction_stage(features(), config))

    known = number in register.runs()
    labels = stored(spark, f"{folder}/labels/{number}", source["clustering"], n, lambda: steps.cluster_stage(features(), reduced(), config))
    if not known:
        sizes = {str(r["niche"]): r["n"] for r in labels.groupBy("niche").agg(F.count("*").alias("n")).orderBy("niche").collect()}
        register.mark(number, {"niches": len(sizes), "sizes": sizes, "stages": config.stages()})
    return number, labels


def run_per_sample(nodes: DataFrame, edges: DataFrame, config: NicheConfig, folder: str, register: Register) -> tuple[str, DataFrame]:
    """(ps-N, labels) of niches that each sample has on its own, numbered from 0 in each.

    Features are made for all samples at once, with one vocabulary: a label that a sample lacks is a constant feature there.
    Communities without a layout before them are found for all samples at once too; other configurations go sample by sample,
    each of which is stored when it is done, so that a run that failed goes on where it stopped. Labels that say they come
    from another run aren't overwritten: this run takes the next number.
    """
    spark = nodes.sparkSession
    cohort = fingerprint(nodes, edges)
    source = cohort + json.dumps({"per_sample": config.stages()}, sort_keys=True)
    number = register.per_sample(config, cohort, lambda run: _source(spark, f"{folder}/labels/{run}") in (None, source))
    n = nodes.count()
    try:
        table = stored(spark, f"{folder}/features/{number}", source, n, lambda: steps.feature_stage(nodes, edges, config))
        if steps.in_one_pass(config):
            labels = stored(spark, f"{folder}/labels/{number}", source, n, lambda: steps.labels_of_samples(table, config))
        else:
            labels = stored(spark, f"{folder}/labels/{number}", source, n, lambda: _sample_by_sample(table, config, f"{folder}/samples/{number}", source, number, register))
        rows = labels.groupBy(*SAMPLE).agg(F.countDistinct("niche").alias("n")).collect()  # a row for each sample
        sizes = {_name(r["patient"], r["sample"]): r["n"] for r in rows}
        register.mark_sample(number, sizes)
        register.mark(number, {"niches": sum(sizes.values()), "sizes": sizes, "stages": config.stages()})
    except BaseException:
        register.mark_per_sample(number, "failed")
        raise
    register.mark_per_sample(number, "done")
    return number, labels


def _name(patient: str, sample: str | None) -> str:
    return patient if sample is None else f"{patient}_{sample}"


def _sample_by_sample(table: DataFrame, config: NicheConfig, folder: str, source: str, number: str, register: Register) -> DataFrame:
    """The labels of all samples, each stored on its own and noted in the register as soon as it is done."""
    spark, paths = table.sparkSession, []
    for r in steps.starts(table).orderBy("start").collect():  # a row for each sample
        path, own = f"{folder}/{r['start']}", f"{source}/{r['start']}"
        labels = stored(spark, path, own, r["n"], lambda: steps.labels_of_sample(table, r["start"], r["n"], config))  # noqa: B023
        register.mark_sample(number, {_name(r["patient"], r["sample"]): labels.select("niche").distinct().count()})
        paths.append(path)
    if not paths:
        return table.select(*SAMPLE, "node_id", "row_id", F.lit(None).cast("long").alias("niche"))
    return spark.read.parquet(*paths)


def sweep(nodes: DataFrame, edges: DataFrame, configs: list[NicheConfig], folder: str, register: Register) -> list[dict[str, Any]]:
    """One record for each run; a run that fails says why, and the others go on."""
    out = []
    for c in configs:
        try:
            number, _ = run(nodes, edges, c, folder, register)
            out.append({"run": number, "niches": register.runs()[number]["niches"], "error": None})
        except Exception as e:  # noqa: BLE001  a sweep reports failures
            out.append({"run": None, "niches": None, "error": f"{type(e).__name__}: {e}"[:500]})
    return out


def sensitivity(configs: list[NicheConfig], records: list[dict[str, Any]]) -> list[list[str]]:
    """The rows of a sweep's table: a header, then a run each with every setting that varies, its niches and its error."""
    flat = [{k: v for part in c.stages().values() for k, v in part.items()} for c in configs]
    names = [k for k in dict.fromkeys(k for f in flat for k in f) if len({json.dumps(f.get(k)) for f in flat}) > 1]
    show = lambda v: "" if v is None else ";".join(map(str, v)) if isinstance(v, list) else str(v)
    return [["run", *names, "niches", "error"], *([show(r["run"]), *(show(f.get(k)) for k in names), show(r["niches"]), show(r["error"])] for f, r in zip(flat, records, strict=True))]


def plan_text(axes: dict[str, list[Any]]) -> str:
    """A grid's axes as lines "name: value, value", which parsed_plan reads back."""
    return "".join(f"{name}: {', '.join(json.dumps(v) for v in values)}\n" for name, values in axes.items())


def parsed_plan(text: str) -> dict[str, list[Any]]:
    """Axes from lines "name: value, value"; a value "from..to x count [log]" is an axis of its own."""
    out: dict[str, list[Any]] = {}
    for line in filter(None, (x.split("#")[0].strip() for x in text.splitlines())):
        name, colon, values = line.partition(":")
        if not colon or name.strip() not in NicheConfig.__dataclass_fields__:
            raise ValueError(f"not an axis: {line!r}")
        span = re.fullmatch(r"\s*(\S+?)\.\.(\S+)\s*x\s*(\d+)(\s+log)?\s*", values)
        if span:
            whole = not re.search(r"[.e]", span[1] + span[2])
            out[name.strip()] = axis(float(span[1]), float(span[2]), int(span[3]), "log" if span[4] else "linear", whole)
        else:
            try:
                out[name.strip()] = json.loads(f"[{values}]")
            except ValueError:
                raise ValueError(f"values must be numbers, true, false or quoted: {line!r}") from None
    return out


def compared(labels: dict[str, DataFrame], reference: str | None = None) -> tuple[DataFrame, DataFrame]:
    """((run_a, run_b, ari), (run, niche, stability)): agreement of all pairs of runs, and how well each other run keeps
    the niches of the reference, the first run unless one is named."""
    names = sorted(labels, key=order)
    reference = reference or names[0]
    long = None
    for n in names:
        part = _key(labels[n]).withColumn("run", F.lit(n))
        long = part if long is None else long.unionByName(part)
    stable = None
    for n in names:
        if n == reference:
            continue
        rows = _joined(labels[reference], labels[n])
        part = agreement.jaccard_stability(rows).select(F.lit(n).alias("run"), "niche", "stability")
        stable = part if stable is None else stable.unionByName(part)
    return agreement.paired_rand(long), stable


def _key(labels: DataFrame) -> DataFrame:
    return labels.select(F.concat_ws("\x1f", *SAMPLE, "node_id").alias("row_id"), "niche")


def _joined(a: DataFrame, b: DataFrame) -> DataFrame:
    return _key(a).withColumnRenamed("niche", "a").join(_key(b).withColumnRenamed("niche", "b"), "row_id").select("a", "b")


def consecutive(labels: dict[str, DataFrame]) -> DataFrame:
    """(run_a, run_b, ari, ami) of each run and the next, in the order of their numbers."""
    names, out = sorted(labels, key=order), None
    for x, y in zip(names, names[1:], strict=False):
        rows = _joined(labels[x], labels[y])
        part = agreement.rand_index(rows).crossJoin(agreement.adjusted_information(rows)).select(F.lit(x).alias("run_a"), F.lit(y).alias("run_b"), "ari", "ami")
        out = part if out is None else out.unionByName(part)
    return out
