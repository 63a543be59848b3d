"""Sequential search of parameters: each trial's parameters come from what earlier trials scored.

Parameters that scored well and those that didn't are two densities, each a mixture of bells around its trials and a flat prior (Parzen
estimators); of some draws from the first, the one that is likeliest under it and unlikeliest under the second is tried. Trials run at
once: trial t is proposed when trial t - parallel is done, from the trials up to that one alone, and those in between count as bad, so that
they aren't proposed again. So a rerun with the same seed proposes the same trials, whatever finishes first.

A trial is scored fold by fold. After each fold it goes on only if its mean so far is among the best 1 / KEEP of the earlier trials that
got so far (successive halving): bad parameters cost one fold. Trials may be committed to a store of runs, a run each.
"""

from __future__ import annotations

import math
import random
import threading
from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from foldspark.sources.committed import Run

#: Trials that are drawn at random first; share of trials that count as good; draws of a proposal; share of trials that go on after a fold.
FIRST, GOOD, DRAWS, KEEP = 8, 0.25, 24, 2
Space = dict[str, tuple | list]


@dataclass
class Trial:
    number: int
    params: dict[str, object]
    scores: list[float] = field(default_factory=list)
    pruned: bool = False

    @property
    def value(self) -> float:
        return sum(self.scores) / len(self.scores) if self.scores else -math.inf


def draw(space: Space, rng: random.Random) -> dict[str, object]:
    return {name: rng.choice(of) if isinstance(of, list) else _out(of, rng.uniform(*_ends(of))) for name, of in space.items()}


def _ends(of: tuple) -> tuple[float, float]:
    """The ends of a range on the scale on which it is searched."""
    if of[0] == "log":
        return math.log(of[1]), math.log(of[2])
    return (of[1] - of[3] / 2, of[2] + of[3] / 2) if of[0] == "int" else (of[1], of[2])


def _in(of: tuple, value: float) -> float:
    return math.log(value) if of[0] == "log" else float(value)


def _out(of: tuple, x: float) -> object:
    if of[0] == "int":
        return min(of[2], max(of[1], of[1] + round((x - of[1]) / of[3]) * of[3]))
    return min(of[2], max(of[1], math.exp(x) if of[0] == "log" else x))


class Bells:
    """A density on [lo, hi]: bells around points, as wide as the gap to their neighbours, and a flat one of the same weight as each."""

    def __init__(self, points: list[float], lo: float, hi: float):
        self.lo, self.hi = lo, hi
        p = sorted(points)
        span = hi - lo
        gaps = [max(b - a for a, b in ((p[i - 1] if i else lo, x), (x, p[i + 1] if i + 1 < len(p) else hi))) for i, x in enumerate(p)]
        self.bells = [(x, min(max(g, span / min(100, 1 + len(p))), span)) for x, g in zip(p, gaps, strict=True)]

    def draw(self, rng: random.Random) -> float:
        k = rng.randrange(len(self.bells) + 1)
        if k == len(self.bells):
            return rng.uniform(self.lo, self.hi)
        for _ in range(100):
            x = rng.gauss(*self.bells[k])
            if self.lo <= x <= self.hi:
                return x
        return self.bells[k][0]

    def log(self, x: float) -> float:
        flat = 1 / (self.hi - self.lo)
        cdf = lambda v, m, s: (1 + math.erf((v - m) / s / math.sqrt(2))) / 2
        each = (math.exp(-(((x - m) / s) ** 2) / 2) / (s * math.sqrt(2 * math.pi)) / max(1e-12, cdf(self.hi, m, s) - cdf(self.lo, m, s)) for m, s in self.bells)
        return math.log((flat + sum(each)) / (len(self.bells) + 1))


def propose(space: Space, done: list[Trial], pending: list[Trial], rng: random.Random) -> dict[str, object]:
    """Parameters of the next trial. Of finished trials the best GOOD share are good; pruned and pending ones are never good."""
    whole = sorted((t for t in done if not t.pruned), key=lambda t: (-t.value, t.number))
    if len(done) < FIRST or not whole:
        return draw(space, rng)
    n = max(1, math.ceil(GOOD * len(whole)))
    good, bad = whole[:n], whole[n:] + [t for t in done if t.pruned] + pending
    out = {}
    for name, of in space.items():
        if isinstance(of, list):
            weight = lambda trials, v: (1 + sum(t.params[name] == v for t in trials)) / (len(of) + len(trials))  # noqa: B023, E731
            tried = rng.choices(of, [weight(good, v) for v in of], k=DRAWS)
            out[name] = max(tried, key=lambda v: weight(good, v) / weight(bad, v))  # noqa: B023
        else:
            lo, hi = _ends(of)
            if lo == hi:
                out[name] = _out(of, lo)
                continue
            likely, unlikely = (Bells([_in(of, t.params[name]) for t in trials], lo, hi) for trials in (good, bad))
            out[name] = _out(of, max((likely.draw(rng) for _ in range(DRAWS)), key=lambda x: likely.log(x) - unlikely.log(x)))
    return out


def search(space: Space, score: Callable[[dict[str, object], int], float], folds: int, trials: int, seed: int = 42, parallel: int = 4, store: tuple[SparkSession, str] | None = None, parent: Run | None = None) -> list[Trial]:
    """All trials in the order of their proposals; score(params, fold) is larger for better ones. best() has the best of them."""
    made: list[Trial] = []
    ended: list[Future] = []
    lock = threading.Lock()

    def goes_on(trial: Trial, before: int) -> bool:
        """Whether the mean so far is among the best share of the first `before` trials that have as many folds."""
        k = len(trial.scores)
        others = sorted((sum(t.scores[:k]) / k for t in made[:before] if len(t.scores) >= k), reverse=True)
        return len(others) < KEEP or trial.value >= others[len(others) // KEEP]

    def run(trial: Trial, before: int) -> None:
        def fold_by_fold() -> None:
            for fold in range(folds):
                trial.scores.append(float(score(trial.params, fold)))
                if fold + 1 < folds and not goes_on(trial, before):
                    trial.pruned = True
                    return

        if store is None:
            fold_by_fold()
            return
        with Run(*store, params=dict(trial.params, trial=trial.number), parent=parent) as r:
            fold_by_fold()
            with lock:
                r.tags = r.tags | {"pruned": str(trial.pruned).lower()}
            r.log({"value": trial.value} | {f"fold_{i}": s for i, s in enumerate(trial.scores)})

    with ThreadPoolExecutor(parallel) as pool:
        for number in range(trials):
            before = max(0, number - parallel + 1)
            for f in ended[:before]:
                f.result()
            params = propose(space, made[:before], made[before:], random.Random(seed * 1_000_003 + number))
            made.append(Trial(number, params))
            ended.append(pool.submit(run, made[-1], before))
        for f in ended:
            f.result()
    return made


def best(trials: list[Trial]) -> Trial:
    """The best of the trials that were scored on all folds, the first of equal ones."""
    whole = [t for t in trials if not t.pruned and t.scores]
    if not whole:
        raise ValueError("no trial was scored")
    return max(whole, key=lambda t: (t.value, -t.number))
