"""Sequential search: better than random draws on a known function, the same in reruns, fewer folds by halving, trials as runs."""

import math
import random
import statistics
import time

import pytest

from foldspark.operators import trials as S
from foldspark.sources import committed as C

SPACE = {"x": ("float", -2.0, 2.0), "rate": ("log", 1e-4, 1.0), "depth": ("int", 2, 20, 2), "kind": ["a", "b", "c"]}


def value(p, fold=0):
    return -((p["x"] - 0.7) ** 2) - (math.log10(p["rate"]) + 2) ** 2 - abs(p["depth"] - 12) / 4 - (p["kind"] != "b") + fold / 100


def test_draws_stay_in_their_ranges():
    rng = random.Random(0)
    for p in [S.draw(SPACE, rng) for _ in range(300)] + [t.params for t in S.search(SPACE, value, 1, 60)]:
        assert -2 <= p["x"] <= 2 and 1e-4 <= p["rate"] <= 1 and p["depth"] in range(2, 21, 2) and p["kind"] in "abc"
    assert S.search({"n": ("int", 5, 5, 1), "z": ("float", 1.0, 1.0)}, lambda p, f: 1.0, 1, 12)[-1].params == {"n": 5, "z": 1.0}


def test_beats_random_draws():
    found = [S.best(S.search(SPACE, value, 1, 50, seed=s, parallel=1)).value for s in range(8)]
    drawn = [max(value(S.draw(SPACE, rng)) for _ in range(50)) for rng in map(random.Random, range(8))]
    assert statistics.mean(found) > statistics.mean(drawn) + 0.1 and sum(a > b for a, b in zip(found, drawn, strict=True)) >= 6


def test_reruns_agree_whatever_ends_first():
    def slow(p, fold):
        time.sleep(random.random() / 200)
        return value(p, fold)

    runs = [[(t.params, t.scores, t.pruned) for t in S.search(SPACE, slow, 3, 25, seed=7, parallel=5)] for _ in range(3)]
    assert runs[0] == runs[1] == runs[2]
    assert runs[0] != [(t.params, t.scores, t.pruned) for t in S.search(SPACE, value, 3, 25, seed=8, parallel=5)]


def test_halving_saves_folds():
    out = S.search(SPACE, value, 4, 40, parallel=2)
    folds = sum(len(t.scores) for t in out)
    assert folds < 0.9 * 160 and all(len(t.scores) == 4 for t in out if not t.pruned) and not S.best(out).pruned
    with pytest.raises(ValueError, match="no trial"):
        S.best([])
    with pytest.raises(ZeroDivisionError):
        S.search(SPACE, lambda p, f: 1 / 0, 1, 3)


def test_trials_are_runs(spark, tmp_path):
    path = str(tmp_path / "runs")
    with C.Run(spark, path, {"model": "m"}) as sweep:
        out = S.search(SPACE, value, 2, 6, parallel=3, store=(spark, path), parent=sweep)
    runs = {int(r["params"]["trial"]): r for r in C.current(C.read(spark, path)).filter("parent_run_id IS NOT NULL").collect()}
    assert len(runs) == 6 and {r["status"] for r in runs.values()} == {C.FINISHED} and {r["parent_run_id"] for r in runs.values()} == {sweep.run_id}
    for t in out:
        assert runs[t.number]["metrics"]["value"] == pytest.approx(t.value) and runs[t.number]["tags"]["pruned"] == str(t.pruned).lower() and runs[t.number]["params"]["kind"] == t.params["kind"]
