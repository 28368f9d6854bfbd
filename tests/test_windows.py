"""Cells of a time line, sums and maxima over them, the best of a sliding window, medians by selection and mergeable drawdowns, by brute force."""

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import metrics
from tidemark.operators import asof, topk


@pytest.mark.parametrize("reach", [1, 4])
def test_sums_in_cells(spark, monkeypatch, reach):
    monkeypatch.setattr(asof, "CELL_REACH", reach)
    rng = random.Random(reach)
    hist = [(rng.choice(["a", "b", None]), rng.randint(-40, 400), rng.choice([None, 1, 2, 5])) for _ in range(400)]
    asked = [(k, rng.choice(["a", "b", "c", None]), rng.randint(-60, 460)) for k in range(200)]
    h = spark.createDataFrame(hist, "key string, at long, x long")
    t = spark.createDataFrame(asked, "n long, key string, t long")
    frames = {"near": (-30, -1), "own": (-7, 0), "cell": (None, -1)}
    got = asof.sums_before(t, h, ["key"], "t", "at", frames, {"x": F.col("x"), "n1": F.lit(1)}, cell=asof.cells_of(100), tops={"last": F.when(F.col("x") > 1, F.col("at"))})

    def total(values):
        known = [v for v in values if v is not None]
        return sum(known) if known else None

    for r in got.collect():
        own = [(a, x) for k, a, x in hist if k == r.key]
        assert r.x_near == total(x for a, x in own if r.t - 30 <= a <= r.t - 1), r
        assert r.x_own == total(x for a, x in own if r.t - 7 <= a <= r.t), r
        assert r.x_cell == total(x for a, x in own if a // 100 == r.t // 100 and a < r.t), r
        assert r.n1_near == (len([1 for a, _ in own if r.t - 30 <= a <= r.t - 1]) or None)
        assert r["last"] == max((a for a, x in own if x and x > 1 and a < r.t), default=None), r
    assert got.count() == len(asked)
    plain = asof.sums_before(t, h, ["key"], "t", "at", {"f": (-30, 5)}, {"x": F.col("x")})  # cells of its own, a frame that looks ahead
    for r in plain.collect():
        assert r.x_f == total(x for k, a, x in hist if k == r.key and r.t - 30 <= a <= r.t + 5)
    assert asof.sums_before(t, h.limit(0), ["key"], "t", "at", frames, {"x": F.col("x")}).where("x_near is not null").count() == 0


def test_a_hot_key_is_dealt_to_many_tasks(spark):
    """One team's century lands in as many window groups as it has cells, not in one."""
    days = spark.range(36_500).select(F.lit("t").alias("team"), F.col("id").alias("day"))
    found = asof.sums_before(days, days, ["team"], "day", "day", {"30": (-30, -1)}, {"n": F.lit(1)})
    assert found.where("day >= 30").agg(F.min("n_30"), F.max("n_30")).first() == (30, 30)
    cells = asof.spread(days, "day", asof.cells_of(asof.CELL_REACH * 30), back=30)
    assert cells.select("__cell").distinct().count() > 300 and cells.count() <= 1.3 * 36_500
    assert "__cell" in found._jdf.queryExecution().executedPlan().toString()


def _plain_best(lines, asked, days, k, score):
    out = {}
    for team, day, context in asked:
        sums = {}
        for t, p, d, *values in lines:
            if t == team and day - days <= d < day:
                sums[p] = [a + b for a, b in zip(sums.get(p, [0] * len(values)), values)]
        ranked = sorted((s, str(p), p) for p, v in sums.items() if (s := score(np.array([v]), context)[0]) == s)
        out[team, day] = [p for *_, p in ranked[:k]]
    return out


@pytest.mark.parametrize("moving", [False, True])
def test_best_of_a_sliding_window(spark, moving):
    rng = random.Random(11)
    lines = [(rng.choice("ab"), rng.randrange(12), rng.randint(0, 300), rng.randint(0, 3), rng.randint(1, 4)) for _ in range(700)]
    asked = [(t, d, (rng.randint(1, 3),) if moving else ()) for t in "abc" for d in rng.sample(range(-5, 340), 90)]

    def score(sums, context):
        value = sums[:, 0] * (context[0] if context else 1) - sums[:, 1] // 2
        return np.where(sums[:, 1] >= 4, value.astype(float), np.nan)

    df = spark.createDataFrame(lines, "team string, player long, day long, x long, y long")
    ask = spark.createDataFrame([(t, d, *c) for t, d, c in asked], "team string, day long" + (", z long" if moving else ""))
    got = {}
    for r in topk.best(ask, df, ["team"], "player", "day", 20, ["x", "y"], 3, score, ["z"] if moving else []).collect():
        got.setdefault((r.team, r.day), []).append(r.player)
    want = {k: v for k, v in _plain_best(lines, asked, 20, 3, score).items() if v}
    assert {k: set(v) for k, v in got.items()} == {k: set(v) for k, v in want.items()} and len(want) > 100
    assert all(got[k] == want[k] for k in want)
    assert topk.best(ask.limit(0), df, ["team"], "player", "day", 20, ["x", "y"], 3, score, ["z"] if moving else []).count() == 0


@pytest.mark.parametrize("small, accuracy", [(3, 20), (3, 10_000), (10_000, 10_000)])
def test_medians_by_selection(spark, small, accuracy):
    rng = random.Random(small)
    columns = {
        "wide": [rng.uniform(-1e9, 1e9) for _ in range(501)], "even": [float(rng.randint(0, 5)) for _ in range(500)], "ties": [7.0] * 400 + [9.0] * 400, "gap": [1.0] * 250 + [1e300] * 250,
        "close": [1.0 + k * 2**-52 for k in range(300)], "holes": [None if k % 3 else float(k) for k in range(600)], "nothing": [None] * 5, "one": [-2.5], "nan": [float("nan")] * 300 + [1.0, 4.0], "huge": [-1.7e308, 1.7e308, 1e308, -1e308],
        "skewed": [0.0] * 499 + [10.0**k for k in range(300)], "cut": [0.0] * 10 + [1e-300] * 11}
    n = max(map(len, columns.values()))
    rows = [tuple(v[k] if k < len(v) else None for v in columns.values()) for k in range(n)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in columns))
    got = metrics.medians(df, list(columns), small=small, accuracy=accuracy)
    for c, v in columns.items():
        known = sorted(x for x in v if x is not None and x == x)
        middle = statistics.median_low(known) / 2 + statistics.median_high(known) / 2 if known else 0.0
        assert got[c] == middle, c
    assert metrics.medians(df.limit(0), ["wide", "one"]) == {"wide": 0.0, "one": 0.0}


def test_drawdowns_merge(spark):
    rng = random.Random(5)
    rows = [(k, k // 7, rng.choice(["x", "y", None]), rng.choice([1, 2]), rng.choice([-1.0, -1.0, 0.5, 1.25])) for k in range(300)]
    df = spark.createDataFrame(rows, "n long, day long, band string, book long, u double")
    got = {(r.set, r.band, r.book): (r.units, r.drawdown) for r in metrics.drawdowns(df, [[], ["band"], ["band", "book"]], ["n"], "u", F.col("day")).collect()}

    def plain(own):
        bank = peak = deepest = 0.0
        for x in own:
            bank += x
            peak = max(peak, bank)
            deepest = max(deepest, peak - bank)
        return bank, deepest

    want = {(0, None, None): plain(r[4] for r in rows)}
    for b in ("x", "y", None):
        want[1, b, None] = plain(r[4] for r in rows if r[2] == b)
        want |= {(2, b, k): plain(r[4] for r in rows if r[2] == b and r[3] == k) for k in (1, 2)}
    assert got == want
