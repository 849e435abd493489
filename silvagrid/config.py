"""Run settings, training limits and the feature list notation."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterable, Mapping
from dataclasses import asdict, dataclass, field
from itertools import chain, product

from pyarrow import fs

from silvagrid.sources.files import open_at

# Fixed value: the default feature list, base features by scale with their row and column offsets.
DEFAULT_FEATURES = (
    "0:6({-32|-16|-8|-4|-2|0|2|4|8|16|32},{-32|-16|-8|-4|-2|0|2|4|8|16|32});"
    "6:12({-64|-32|-16|-8|-4|0|4|8|16|32|64},{-64|-32|-16|-8|-4|0|4|8|16|32|64});"
    "12:18({-64|-32|-16|-8|0|8|16|32|64},{-64|-32|-16|-8|0|8|16|32|64});"
    "18:24({-64|-32|-16|0|16|32|64},{-64|-32|-16|0|16|32|64});"
    "24:30({-64|-32|0|32|64},{-64|-32|0|32|64});"
    "30:36({-64|0|64},{-64|0|64})"
)

Offset = tuple[int, tuple[int, int]]

_NUMBER = r"-?\d+"
_SET = re.compile(rf"\{{({_NUMBER}(?:\|{_NUMBER})*)\}}")
_RANGE = re.compile(rf"({_NUMBER})(?::({_NUMBER}))?(?::({_NUMBER}))?")
_BOX = re.compile(r"\(([^(),]+),([^(),]+)\)")
_ENTRY = re.compile(rf"([^()]+)((?:{_BOX.pattern})+)")


def parse_ints(text: str) -> list[int]:
    """``n``, ``a:b`` (half open), ``a:step:b`` or ``{x|y|z}``."""
    if found := _SET.fullmatch(text):
        return [int(item) for item in found[1].split("|")]
    if not (found := _RANGE.fullmatch(text)):
        raise ValueError(f"not an integer list: {text!r}")
    start, *more = [int(item) for item in found.groups() if item is not None]
    stop = more[-1] if more else start + 1
    return [*range(start, stop, more[0] if len(more) == 2 else 1)]


def parse_features(text: str) -> list[Offset]:
    """``feats(rowOffsets,colOffsets)[(...)...]`` entries separated by ``;`` as (feature, (dr, dc)) pairs."""
    result: list[Offset] = []
    for entry in text.split(";"):
        if not entry:
            continue
        if not (found := _ENTRY.fullmatch(entry)):
            raise ValueError(f"each offset box needs a row and a column list: {entry!r}")
        grids = (product(parse_ints(rows), parse_ints(cols)) for rows, cols in _BOX.findall(found[2]))
        result += product(parse_ints(found[1]), chain.from_iterable(grids))
    return result


def expand_tiles(text: str) -> list[str]:
    """A comma list, or ``name*N`` for N replicas; replicas get a suffix so that ids stay unique."""
    name, star, count = text.partition("*")
    if star:
        return [f"{name}#{i}" for i in range(int(count))]
    return text.split(",")


def tile_path(root: str, tile: str) -> str:
    """Folder of a tile; replicas share the folder of their base name."""
    return f"{root}/{tile.split('#')[0]}"


@dataclass(frozen=True)
class TreeConfig:
    """Limits of one forest."""

    num_trees: int = 1
    max_depth: int = 10
    max_bins: int = 10
    min_instances: int = 1
    min_info_gain: float = 0.0
    bagging: float = 1.0
    feature_subset: str = "all"
    impurity: str = "variance"
    seed: int = 1
    categorical: Mapping[int, int] = field(default_factory=dict)
    checkpoint_interval: int = 10
    max_memory_mb: float = 500
    finish_rows: int = 0
    subset_splits: bool = False
    quantiles: str = "sort"

    def __post_init__(self) -> None:
        checks = {
            "only the sort quantile strategy is supported": self.quantiles == "sort",
            "num_trees must be at least 1": self.num_trees >= 1,
            "max_depth must lie in 0..30": 0 <= self.max_depth <= 30,
            "max_bins must be at least 2": self.max_bins >= 2,
            "min_instances must be at least 1": self.min_instances >= 1,
            "max_memory_mb must be at most 10240": 0 < self.max_memory_mb <= 10240,
            "finish_rows must not be negative": self.finish_rows >= 0,
            "bagging must lie in (0, 1]": 0 < self.bagging <= 1,
            "categorical arity must be at least 2": all(k >= 2 for k in self.categorical.values()),
            "categorical arity must not exceed max_bins": all(k <= self.max_bins for k in self.categorical.values()),
        }
        failed = [message for message, ok in checks.items() if not ok]
        if failed:
            raise ValueError("; ".join(failed))
        subset_size(self.feature_subset, 1, self.num_trees)


def subset_size(strategy: str, num_features: int, num_trees: int) -> int:
    """How many features a node may try. ``auto`` means all for one tree, a third for a forest."""
    if strategy == "auto":
        strategy = "all" if num_trees == 1 else "onethird"
    sizes = {
        "all": num_features,
        "sqrt": math.ceil(math.sqrt(num_features)),
        "log2": max(1, math.ceil(math.log2(num_features))) if num_features > 0 else 0,
        "onethird": math.ceil(num_features / 3.0),
    }
    if strategy not in sizes:
        raise ValueError(f"unknown feature subset strategy {strategy!r}; known: auto, {', '.join(sizes)}")
    return sizes[strategy]


@dataclass(frozen=True)
class BinPlan:
    """Bin counts per feature: how many cut points each may have and which are categories."""

    num_bins: tuple[int, ...]
    unordered: frozenset[int]

    def num_splits(self, feature: int) -> int:
        bins = self.num_bins[feature]
        return bins // 2 if feature in self.unordered else bins - 1


def plan_bins(
    num_features: int, num_rows: int, max_bins: int, arity: Mapping[int, int] | None = None, multiclass: bool = False
) -> BinPlan:
    """Continuous features get at most ``min(max_bins, rows)`` bins. A categorical feature gets one bin per
    value, or two per value subset where subsets are tried in any order (multi-class with few values)."""
    arity = arity or {}
    possible = min(max_bins, num_rows)
    if any(k > possible for k in arity.values()):
        raise ValueError("a categorical feature has more values than possible bins")
    bins = [possible] * num_features
    unordered = set()
    for feature, k in arity.items():
        subset_bins = 2 * ((1 << (k - 1)) - 1)
        if multiclass and subset_bins <= possible:
            unordered.add(feature)
            bins[feature] = subset_bins
        else:
            bins[feature] = k
    return BinPlan(tuple(bins), frozenset(unordered))


@dataclass(frozen=True)
class BoostConfig:
    """Boosting schedule around a forest configuration."""

    iterations: int = 50
    trees_per_iteration: int = 1
    learning_rate: float = 0.1
    momentum: float = 0.0
    subsample: float = 1.0
    loss: str = "squared"
    seed: int = 1
    checkpoint_interval: int = 10
    save_gradients: str | None = None

    def __post_init__(self) -> None:
        if self.iterations < 0 or self.trees_per_iteration < 1:
            raise ValueError("iterations must be >= 0 and trees_per_iteration >= 1")


def folder_names(root: str) -> list[str]:
    """Folders below ``root`` in order, on any filesystem that tasks reach; none if it does not exist."""
    system, inner = open_at(root)
    found = system.get_file_info(fs.FileSelector(inner, allow_not_found=True))
    return sorted(x.base_name for x in found if x.type == fs.FileType.Directory)


def _flag(text: str) -> bool:
    return text.lower() == "true"


def _tiles(text: str) -> tuple[str, ...]:
    return tuple(expand_tiles(text))


def _cut_points(text: str) -> tuple[int, ...] | None:
    """``none``, or a comma list; an empty list leaves the choice to the run."""
    points = tuple(int(item) for item in text.split(",") if item and text != "none")
    if points:
        check_cut_points(points)
    return points if points or text == "none" else None


# Setting, argument name, parser.
_ARGUMENTS = {
    "name": ("name", str),
    "num_executors": ("numExecutors", int),
    "max_memory_mb": ("maxMemoryInMB", int),
    "data_root": ("data_root", str),
    "save_to": ("save_to", str),
    "save_model_to": ("save_model_to", str),
    "train_tiles": ("subvolumes_train", _tiles),
    "test_tiles": ("subvolumes_test", _tiles),
    "max_depth": ("maxDepth", int),
    "max_bins": ("maxBins", int),
    "leaf_size": ("leafSize", int),
    "load_model": ("loadModel", str),
    "initial_trees": ("initialTrees", int),
    "n_base_features": ("nBaseFeatures", int),
    "features": ("features", lambda text: tuple(parse_features(text))),
    "feature_subset": ("featureSubsetStrategy", str),
    "master": ("master", str),
    "iterations": ("iterations", int),
    "trees_per_iteration": ("treesPerIteration", int),
    "learning_rate": ("learningRate", float),
    "momentum": ("momentum", float),
    "subsample_proportion": ("subsampleProportion", float),
    "save_gradients": ("saveGradients", _flag),
    "use_node_id_cache": ("useNodeIdCache", _flag),
    "bagging": ("bagging", float),
    "seed": ("seed", int),
    "loss": ("loss", str),
    "test_partial_models": ("testPartialModels", _cut_points),
}


@dataclass(frozen=True)
class RunSettings:
    """Everything a run reads from its ``key=value`` arguments."""

    name: str = "expt"
    num_executors: int | None = None
    max_memory_mb: int = 500
    data_root: str = "/data/tiles"
    save_to: str = "/data/predictions"
    save_model_to: str = ""
    train_tiles: tuple[str, ...] = ()
    test_tiles: tuple[str, ...] = ()
    max_depth: int = 10
    max_bins: int = 10
    leaf_size: int = 1
    load_model: str | None = None
    initial_trees: int = 1
    n_base_features: int = 36
    features: tuple[Offset, ...] = ()
    feature_subset: str = "all"
    master: str = "local"
    iterations: int = 0
    trees_per_iteration: int = 10
    learning_rate: float = 1.0
    momentum: float = 0.0
    subsample_proportion: float = 1.0
    save_gradients: bool = False
    use_node_id_cache: bool = True
    bagging: float = 0.5
    seed: int = 1
    loss: str = "malis"
    test_partial_models: tuple[int, ...] | None = None

    @staticmethod
    def from_args(args: Iterable[str]) -> RunSettings:
        """Settings from ``key=value`` arguments; a key that no setting has is ignored, ``testDepths`` is refused."""
        given = {key: value for key, _, value in (arg.partition("=") for arg in args)}
        if given.get("testDepths"):
            raise ValueError("testDepths is not supported: predictions always use whole trees")
        values = {name: parse(given[key]) for name, (key, parse) in _ARGUMENTS.items() if key in given}
        values.setdefault("features", tuple(parse_features(DEFAULT_FEATURES)))
        if not {"train_tiles", "test_tiles"} <= values.keys():
            # A root that nobody named is not searched.
            tiles = folder_names(values["data_root"]) if "data_root" in values else []
            values.setdefault("train_tiles", tuple(tiles[:1]))
            values.setdefault("test_tiles", tuple(tiles[1:2]))
        return RunSettings(**values)

    def tree_config(self, num_trees: int) -> TreeConfig:
        return TreeConfig(
            num_trees=num_trees,
            max_depth=self.max_depth,
            max_bins=self.max_bins,
            min_instances=self.leaf_size,
            bagging=self.bagging,
            feature_subset=self.feature_subset,
            seed=self.seed,
            checkpoint_interval=1 if self.use_node_id_cache else 10,
            max_memory_mb=self.max_memory_mb,
        )

    def boost_config(self) -> BoostConfig:
        return BoostConfig(
            iterations=self.iterations,
            trees_per_iteration=self.trees_per_iteration,
            learning_rate=self.learning_rate,
            momentum=self.momentum,
            subsample=self.subsample_proportion,
            loss=self.loss,
            seed=self.seed,
            save_gradients=f"{self.save_to}/malis" if self.save_gradients else None,
        )

    def describe(self) -> str:
        return json.dumps(asdict(self), indent=1)


def check_cut_points(points: Iterable[int]) -> None:
    values = list(points)
    if not values or values[0] < 1 or any(b <= a for a, b in zip(values, values[1:], strict=False)):
        raise ValueError("cut points must be >= 1 and strictly ascending")
