"""Quality rules by weak supervision (DataFrame functions only).

Rules vote good (1), bad (-1) or abstain (0). Expectation-maximisation over the table of vote patterns (at most 3 ** 8 rows,
whatever the number of documents) estimates, for each rule, how often its vote is right on good documents and how often on bad
ones, and the share of good documents. The posterior probability of good replaces an all-must-pass filter: the vote of a rule
that good documents often break weighs little, and one bad vote can be overruled.

Cases: a null text is an empty text: no words, base_failed, not kept. Repeated rows are judged each by itself and alike.
An empty table gives no rows. Further columns are ignored (`quality`) or carried (`filter_docs`), whatever their names. Texts are read whole, at any length.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldspark.llm.common import kept, word_array, written

SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
STOPS = ".,;:"
LEAST_WORDS = 50
MOST_REPEATED = 50
ITERATIONS = 20
KEEP = 0.5
#: Guesses to begin with: the share of good documents, and how often a vote is right on good and on bad documents (a bad
#: document shows few of all flaws). The guess on a rule weighs a quarter of the rule's own votes, and FEW documents.
GOOD, RIGHT_ON_GOOD, RIGHT_ON_BAD = 0.8, 0.97, 0.3
STRENGTH, FEW = 0.25, 10
RULES = ("length", "word_length", "symbols", "shouting", "letters", "lines", "repeats", "stops")


class Model(NamedTuple):
    """The share of good documents, and each rule's shares of right votes on good and on bad ones."""

    good: float
    on_good: list[float]
    on_bad: list[float]


def _without(text: Column, characters: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("long")


def _ordered(hashes: Column) -> Column:
    """Windows with their places, equal windows together; none where no window is found twice, as array_distinct tells."""
    pairs = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p")))
    few = F.size(F.array_distinct(hashes)) == F.size(hashes)
    return F.sort_array(F.when(few, F.slice(pairs, 1, 0)).otherwise(pairs))


def _places(ordered: Column) -> Column:
    """Places of the windows found twice or more, from _ordered() (staged in a column: each element looks at its neighbours).

    A window's hash has 64 bits, and windows are only compared within one text.
    """
    near = F.transform(ordered, lambda x, i: F.when(
        (x["h"] == F.get(ordered, i - 1)["h"]) | (x["h"] == F.get(ordered, i + 1)["h"]), x["p"]))
    return F.sort_array(F.filter(near, lambda p: p.isNotNull()))


def _covered(places: Column) -> Column:
    """Words that windows of three words at these places cover: three a place, less those that the place before covers."""
    return F.aggregate(
        places,
        F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
        lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last")),
        lambda a: a["n"].cast("long"),
    )


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0))


def votes(docs: DataFrame) -> DataFrame:
    """docs (whose columns may not start with q_) with measures and votes.

    Only texts with a repeated window are sorted; array_distinct tells which these are.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.trim(F.translate(x, "\t\x0b\f\r", " " * 4)) != "")
    d = docs.withColumns({
        "q_words": word_array(F.col("text")),
        "q_lines": lines,
        "q_word_chars": F.length(F.translate(text, " \t\n\x0b\f\r", "")).cast("long"),
        "q_n_symbols": _without(text, SYMBOLS),
        "q_n_upper": _without(text, UPPER),
        "q_n_stops": _without(text, STOPS),
    })
    w = F.col("q_words")
    d = d.withColumns({
        "q_n_words": F.size(w).cast("long"),
        "q_n_bare": F.size(F.filter(w, lambda x: ~x.rlike(r"\p{L}"))).cast("long"),
        "q_n_lines": F.size("q_lines").cast("long"),
        "q_n_dup_lines": (F.size("q_lines") - F.size(F.array_distinct("q_lines"))).cast("long"),
        "q_hashes": F.transform(
            F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))),
    }).drop("q_lines", "q_words")
    d = d.withColumn("q_ordered", _ordered(F.col("q_hashes"))).drop("q_hashes")
    d = d.withColumn("q_places", _places(F.col("q_ordered"))).drop("q_ordered")
    d = d.withColumn("q_n_repeat_words", _covered(F.col("q_places"))).drop("q_places")
    n, chars, symbols, upper, stops, bare, total, dup, repeats = (
        F.col(f"q_{c}") for c in ("n_words", "word_chars", "n_symbols", "n_upper", "n_stops", "n_bare", "n_lines", "n_dup_lines", "n_repeat_words"))
    failed = (n < LEAST_WORDS) | (100 * repeats > MOST_REPEATED * n)
    return d.withColumns({
        "q_base_failed": failed,
        "q_v_length": _vote(n < 60, n >= 120),
        "q_v_word_length": _vote((10 * chars < 44 * n) | (chars > 6 * n), (10 * chars >= 46 * n) & (2 * chars <= 11 * n)),
        "q_v_symbols": _vote(50 * symbols > n, symbols == 0),
        "q_v_shouting": _vote(10 * upper > chars, 20 * upper < chars),
        "q_v_letters": _vote(20 * bare > n, 100 * bare <= n),
        "q_v_lines": _vote((total >= 4) & (10 * dup > total), (total >= 4) & (50 * dup <= total)),
        "q_v_repeats": _vote(100 * repeats > 15 * n, (n >= 20) & (100 * repeats <= 5 * n)),
        "q_v_stops": _vote((n >= 20) & ((100 * stops < 6 * n) | (100 * stops > 40 * n)), (100 * stops >= 9 * n) & (100 * stops <= 25 * n)),
    })


def fit(patterns: list[tuple[tuple[int, ...], int]]) -> Model:
    """The model of votes and how many documents cast them, by expectation-maximisation."""
    rules = range(len(RULES))
    model = Model(GOOD, [RIGHT_ON_GOOD] * len(RULES), [RIGHT_ON_BAD] * len(RULES))
    patterns = sorted(patterns)
    for _ in range(ITERATIONS):
        weights = [(v, n, n * posterior_of(v, model)) for v, n in patterns]
        share = lambda right, voted, guess: (right + (STRENGTH * voted + FEW) * guess) / ((1 + STRENGTH) * voted + FEW)
        on_good = [share(sum(g for v, _, g in weights if v[j] > 0), sum(g for v, _, g in weights if v[j]), RIGHT_ON_GOOD) for j in rules]
        on_bad = [share(sum(n - g for v, n, g in weights if v[j] < 0), sum(n - g for v, n, g in weights if v[j]), RIGHT_ON_BAD) for j in rules]
        good = (sum(g for *_, g in weights) + FEW * GOOD) / (sum(n for _, n in patterns) + FEW)
        model = Model(good, on_good, on_bad)
    return model


def log_odds(model: Model) -> tuple[float, list[tuple[float, float]]]:
    """The log odds of good before any vote, and what a good and a bad vote of each rule add."""
    each = [(math.log(a / (1 - b)), math.log((1 - a) / b)) for a, b in zip(model.on_good, model.on_bad, strict=True)]
    return math.log(model.good / (1 - model.good)), each


def posterior_of(v: tuple[int, ...], model: Model) -> float:
    prior, each = log_odds(model)
    x = prior + sum(up if s > 0 else down for s, (up, down) in zip(v, each, strict=True) if s)
    return 1 / (1 + math.exp(-x))


def _names() -> list[str]:
    return [f"q_v_{r}" for r in RULES]


def _fitted(v: DataFrame) -> Model:
    """The model of a table with votes. Only the table of patterns (3 ** 8 rows at most) leaves the executors."""
    table = v.groupBy(*_names()).count().collect()
    return fit([(tuple(row[c] for c in _names()), row["count"]) for row in table])


def _judged(v: DataFrame, model: Model) -> DataFrame:
    """v, a table with votes, with q_posterior and q_kept."""
    prior, each = log_odds(model)
    logit = F.lit(prior)
    for c, (up, down) in zip(_names(), each, strict=True):
        logit = logit + F.when(F.col(c) > 0, F.lit(up)).when(F.col(c) < 0, F.lit(down)).otherwise(F.lit(0.0))
    posterior = F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))
    return v.withColumn("q_posterior", posterior).withColumn("q_kept", ~F.col("q_base_failed") & (F.col("q_posterior") >= KEEP))


def quality(docs: DataFrame) -> DataFrame:
    """doc_id, the measures, base_failed, kept and posterior.

    Measures are written once, without texts, to the shared folder.
    """
    v = written(votes(docs.select("doc_id", "text")).drop("text"))
    j = _judged(v, _fitted(v))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")
    return j.withColumn("q_posterior", F.round("q_posterior", 6)).select("doc_id", *[F.col(f"q_{c}").alias(c) for c in names])


def filter_docs(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with their columns, whatever their names.

    Documents are kept on disk with their votes, so measures aren't computed again for the second pass.
    """
    packed = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("q_row"), F.col("text"))
    v = kept(votes(packed).select("q_row", "q_base_failed", *_names()))
    return _judged(v, _fitted(v)).filter("q_kept").select("q_row.*")
