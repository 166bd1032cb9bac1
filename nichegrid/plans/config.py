"""Configuration of the three steps: a YAML file of three sections, checked and typed."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field
from typing import Any

import yaml

from nichegrid.sources.cohorts import extension

STATISTICS = {"np.mean": ("mean",), "np.mean,np.std": ("mean", "std")}
CLUSTERERS, METRICS, SEARCHES = ("leiden", "gmm", "spectral"), ("euclidean", "manhattan", "cosine"), ("exact", "descent")


class ConfigError(ValueError):
    """What is wrong in a configuration file, by section and key."""


def truth(value: Any) -> bool:
    """A yes or no, however it is written."""
    if isinstance(value, bool):
        return value
    text = str(value).strip().lower()
    if text in ("true", "yes", "on", "1"):
        return True
    if text in ("false", "no", "off", "0", ""):
        return False
    raise ConfigError(f"{value!r} is neither yes nor no")


def load(path: str) -> dict[str, Any]:
    """The file's sections in their order; relative paths in it start at the file's folder."""
    with open(path) as f:
        found = yaml.safe_load(f) or {}
    if not isinstance(found, dict):
        raise ConfigError("a configuration is a mapping of sections")
    base = os.path.dirname(os.path.abspath(path))

    def resolve(x: Any) -> Any:
        if isinstance(x, dict):
            return {k: os.path.normpath(os.path.join(base, v)) if isinstance(v, str) and re.search(r"director|folder|path", str(k), re.I) and "://" not in v and not os.path.isabs(v) and v.lower() != "default" else resolve(v) for k, v in x.items()}
        return x

    return resolve(found)


def save(config: dict[str, Any], path: str) -> None:
    with open(path, "w") as f:
        yaml.safe_dump(config, f, sort_keys=False, allow_unicode=True)


def _number(value: Any, name: str, least: float | None = None, whole: bool = False) -> Any:
    try:
        out = int(str(value)) if whole else float(value)
    except (TypeError, ValueError):
        raise ConfigError(f"{name} must be a {'whole ' if whole else ''}number, not {value!r}") from None
    if least is not None and out < least:
        raise ConfigError(f"{name} must be {least} at least, not {out}")
    return out


@dataclass(frozen=True)
class CohortConfig:
    """Where a cohort's files are and what their columns mean."""

    folder: str
    kind: str
    patient: str
    x: str
    y: str
    sample: str | None = None
    phenotype: str | None = None
    id_col: str | None = None

    @staticmethod
    def of(d: dict[str, Any]) -> CohortConfig:
        for key in ("folder", "kind", "patient", "x", "y"):
            if not d.get(key):
                raise ConfigError(f"cohort: {key} is missing")
        for key in ("patient", "sample"):
            if d.get(key) and "_" in str(d[key]):
                raise ConfigError(f"cohort: {key} must not hold an underscore, as file names use it as separator")
        try:
            kind = extension(str(d["kind"]))
        except ValueError as e:
            raise ConfigError(f"cohort: {e}") from None
        return CohortConfig(str(d["folder"]), kind, str(d["patient"]), str(d["x"]), str(d["y"]), *(str(d[k]) if d.get(k) else None for k in ("sample", "phenotype", "id_col")))


@dataclass(frozen=True)
class NetworkConfig:
    adaptive: bool = True
    n_edges: int = 3
    ratio: float = 2.0
    least: float = 0.0
    longest: float | None = None
    relink_to: int = 3
    by: str = "delaunay"

    @staticmethod
    def of(d: dict[str, Any]) -> NetworkConfig:
        by = str(d.get("by", "delaunay")).lower()
        if by not in ("delaunay", "knn"):
            raise ConfigError(f"network: by must be delaunay or knn, not {by!r}")
        longest = d.get("longest")
        return NetworkConfig(truth(d.get("adaptive", True)), _number(d.get("n_edges", 3), "network: n_edges", 1, True), _number(d.get("ratio", 2.0), "network: ratio", 0), _number(d.get("least", 0.0), "network: least", 0), None if longest in (None, "", False) else _number(longest, "network: longest", 0), _number(d.get("relink_to", 3), "network: relink_to", 0, True), by)


@dataclass(frozen=True)
class AssortativityConfig:
    n_shuffle: int = 20
    seed: int = 0

    @staticmethod
    def of(d: dict[str, Any]) -> AssortativityConfig:
        return AssortativityConfig(_number(d.get("n_shuffle", 20), "assortativity: n_shuffle", 0, True), _number(d.get("seed", 0), "assortativity: seed", None, True))


@dataclass(frozen=True)
class NicheConfig:
    columns: tuple[str, ...] = ("phenotype",)
    order: int = 1
    statistics: tuple[str, ...] = ("mean", "std")
    reduce: bool = True
    metric: str = "euclidean"
    n_neighbors: int = 15
    dimensions: int = 2
    epochs: int | None = None
    min_dist: float = 0.0
    clusterer: str = "leiden"
    k_cluster: int = 8
    n_clusters: int = 15
    resolution: float = 0.005
    normalize: tuple[str, ...] = ("total",)
    seed: int = 42
    per_sample: bool = False
    search: str = "exact"
    covariance: str = "diag"
    extra: dict[str, Any] = field(default_factory=dict, compare=False, hash=False)

    @staticmethod
    def of(d: dict[str, Any]) -> NicheConfig:
        from nichegrid.operators.composition import NORMALIZATIONS, expand

        stats = str(d.get("statistics", "np.mean,np.std")).replace(" ", "")
        if stats not in STATISTICS:
            raise ConfigError(f"niches: statistics must be one of {', '.join(STATISTICS)}, not {stats!r}")
        metric = str(d.get("metric", "euclidean")).lower()
        clusterer = str(d.get("clusterer", "leiden")).lower()
        if clusterer in ("ecg", "hdbscan"):
            raise ConfigError(f"niches: clusterer {clusterer} is not available")
        search = str(d.get("search", "exact")).lower()
        if search not in SEARCHES:
            raise ConfigError(f"niches: search must be one of {', '.join(SEARCHES)}, not {search!r}")
        covariance = str(d.get("covariance", "diag")).lower()
        if covariance not in ("diag", "full"):
            raise ConfigError(f"niches: covariance must be diag or full, not {covariance!r}")
        how = str(d.get("normalize", "total")).lower()
        columns = d.get("columns", ["phenotype"])
        columns = tuple([columns] if isinstance(columns, str) else map(str, columns))
        whole = lambda key, default, least: _number(d.get(key, default), f"niches: {key}", least, True)
        return NicheConfig(
            columns, whole("order", 1, 0), STATISTICS[stats], truth(d.get("reduce", True)),
            metric if metric in METRICS else "euclidean", max(2, whole("n_neighbors", 15, 0)), whole("dimensions", 2, 1), None if d.get("epochs") is None else whole("epochs", None, 0), _number(d.get("min_dist", 0.0), "niches: min_dist", 0),
            clusterer if clusterer in CLUSTERERS else "leiden", whole("k_cluster", 8, 1), whole("n_clusters", 15, 1), _number(d.get("resolution", 0.005), "niches: resolution", 0),
            expand(how) if how == "all" or how in NORMALIZATIONS else ("total",), whole("seed", 42, 0), truth(d.get("per_sample", False)), search, covariance,
            {k: v for k, v in d.items() if k not in NicheConfig.__dataclass_fields__},
        )

    def within(self, n: int) -> NicheConfig:
        """With counts of neighbours and clusters that n rows allow."""
        from dataclasses import replace

        return replace(self, n_neighbors=max(2, min(self.n_neighbors, n)), k_cluster=max(1, min(self.k_cluster, n - 1)), n_clusters=max(1, min(self.n_clusters, n)))

    def stages(self) -> dict[str, dict[str, Any]]:
        """What each stage's result depends on, the stages before it included."""
        features = {"columns": list(self.columns), "order": self.order, "statistics": list(self.statistics)}
        reduction = {"reduce": self.reduce} | ({"metric": self.metric, "n_neighbors": self.n_neighbors, "dimensions": self.dimensions, "epochs": self.epochs, "min_dist": self.min_dist, "seed": self.seed} if self.reduce else {})
        if self.search != "exact":
            reduction["search"] = self.search
        own = {"leiden": {"k_cluster": self.k_cluster, "resolution": self.resolution}, "gmm": {"n_clusters": self.n_clusters} | ({"covariance": "full"} if self.covariance == "full" else {}), "spectral": {"n_clusters": self.n_clusters}}
        return {"features": features, "reduction": reduction, "clustering": {"clusterer": self.clusterer, "seed": self.seed} | own[self.clusterer]}


@dataclass(frozen=True)
class Config:
    cohort: CohortConfig
    network: NetworkConfig = NetworkConfig()
    assortativity: AssortativityConfig = AssortativityConfig()
    niches: NicheConfig = NicheConfig()

    @staticmethod
    def of(d: dict[str, Any]) -> Config:
        if "cohort" not in d:
            raise ConfigError("the section cohort is missing")
        section = lambda name: d.get(name) or {}
        return Config(CohortConfig.of(section("cohort")), NetworkConfig.of(section("network")), AssortativityConfig.of(section("assortativity")), NicheConfig.of(section("niches")))

    @staticmethod
    def read(path: str) -> Config:
        return Config.of(load(path))
