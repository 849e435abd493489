import pytest

from silvagrid import config
from silvagrid.functions import heap
from silvagrid.operators.binning import category_subsets
from silvagrid.operators.grid import split_volume
from silvagrid.plans.boost import momentum_weights


def test_feature_list():
    got = config.parse_features("0:2({-1|0|1},0);4(0:2:4,1)")
    assert len(got) == 8 and got[0] == (0, (-1, 0)) and got[-1] == (4, (2, 1))
    assert len(config.parse_features(config.DEFAULT_FEATURES)) == 2436
    assert config.parse_features("3(0,0)(1,{-1|1})") == [(3, (0, 0)), (3, (1, -1)), (3, (1, 1))]


def test_tiles_and_settings():
    assert config.expand_tiles("a,b") == ["a", "b"]
    assert config.expand_tiles("t*3") == ["t#0", "t#1", "t#2"] and config.tile_path("/d", "t#2") == "/d/t"
    s = config.RunSettings.from_args(["maxDepth=4", "testPartialModels=1,3,", "features=0(0,0)", "subvolumes_train=x*2", "momentum=0.5"])
    assert (s.max_depth, s.test_partial_models, s.train_tiles, s.momentum, s.max_bins) == (4, (1, 3), ("x#0", "x#1"), 0.5, 10)
    assert config.RunSettings.from_args(["testPartialModels=none"]).test_partial_models == ()
    with pytest.raises(ValueError):
        config.RunSettings.from_args(["testPartialModels=0,5"])
    with pytest.raises(ValueError, match="testDepths"):
        config.RunSettings.from_args(["testDepths=1,2"])
    with pytest.raises(ValueError, match="offset box"):
        config.parse_features("1(2)")
    with pytest.raises(ValueError, match="integer list"):
        config.parse_ints("1:2:3:4")


def test_tiles_default_to_the_first_two_folders(tmp_path):
    for name in ("b", "a", "c"):
        (tmp_path / name).mkdir()
    (tmp_path / "a.txt").write_text("")
    s = config.RunSettings.from_args([f"data_root={tmp_path}"])
    assert (s.train_tiles, s.test_tiles) == (("a",), ("b",))
    assert config.RunSettings.from_args([f"data_root={tmp_path}/none"]).train_tiles == ()


def test_validation():
    for bad in ({"max_depth": 31}, {"max_bins": 1}, {"num_trees": 0}, {"feature_subset": "half"}, {"max_memory_mb": 20000},
                {"categorical": {0: 1}}, {"categorical": {0: 11}}, {"min_instances": 0}):
        with pytest.raises(ValueError):
            config.TreeConfig(**bad)


def test_subset_sizes_and_bins():
    assert [config.subset_size(x, 36, 5) for x in ("all", "sqrt", "log2", "onethird", "auto")] == [36, 6, 6, 12, 12]
    assert config.subset_size("auto", 36, 1) == 36
    plan = config.plan_bins(3, 1000, 32, {1: 3, 2: 10}, multiclass=True)
    assert plan.num_bins == (32, 6, 10) and plan.unordered == {1} and [plan.num_splits(i) for i in range(3)] == [31, 3, 9]
    assert category_subsets(3) == [[0], [1], [0, 1]]


def test_heap_numbers():
    assert (heap.parent(5), heap.level(5), heap.right(5), heap.is_left(5), heap.path(11)) == (2, 2, 11, False, [1, 2, 5, 11])
    assert (heap.ancestor(11, 1), heap.first_at(3), heap.max_at(3)) == (2, 8, 8)


def test_momentum():
    assert momentum_weights(3, 1.0, 0.5) == [1.0, 1.875, 1.75, 1.5]


def test_momentum_matches_loop():
    lr, mu, n = 0.3, 0.7, 5
    weights = [1.0] + [0.0] * n
    for m in range(1, n + 1):
        weights[m] = lr
        for i in range(1, m + 1):
            weights[i] += lr * mu ** (m + 1 - i)
    assert momentum_weights(n, lr, mu) == pytest.approx(weights)


def test_split_volume():
    boxes = split_volume((40, 40, 40), (2, 2, 2), 10)
    assert len(boxes) == 8 and boxes[-1]["lo"] == (20, 20, 20) and boxes[-1]["outer_hi"] == (39, 39, 39)
