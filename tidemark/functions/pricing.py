"""Pricing expressions: odds, margin-free probabilities, edge, expected value, stakes, closing-line value.

Each takes and gives columns. Input outside a function's domain gives NULL, or fails the query if ``strict``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.metrics import rounded

#: Publication thresholds and stake policy.
MIN_EDGE, MIN_EV, MAX_ECE = 0.02, 0.02, 0.03
KELLY_FRACTION, STAKE_CAP = 0.125, 0.02


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def _within(ok: Column, value: Column, strict: bool, what: str) -> Column:
    return F.when(ok, value).otherwise(F.raise_error(F.lit(what)).cast("double") if strict else F.lit(None).cast("double"))


def american_to_decimal(a, strict: bool = False) -> Column:
    a = _col(a)
    return _within(F.abs(a) >= 100, F.when(a > 0, 1 + a / 100).otherwise(1 + 100 / F.abs(a)), strict, "American odds lie outside (-100, 100)")


def decimal_to_american(d, strict: bool = False) -> Column:
    d = _col(d)
    return _within(d > 1, F.when(d >= 2, (d - 1) * 100).otherwise(-100 / F.when(d > 1, d - 1)), strict, "decimal odds are above 1")


def implied_prob(d, strict: bool = False) -> Column:
    d = _col(d)
    return _within(d > 1, 1 / F.when(d > 1, d), strict, "decimal odds are above 1")


def no_vig_two_way(a, b, strict: bool = False) -> Column:
    """struct(p_a, p_b, overround); NULL fields where the two prices leave no margin."""
    pa, pb = implied_prob(a, strict), implied_prob(b, strict)
    total = pa + pb
    ok = total >= 1
    return F.struct(_within(ok, pa / total, strict, "implied probabilities sum to less than 1").alias("p_a"), _within(ok, pb / total, strict, "implied probabilities sum to less than 1").alias("p_b"), F.when(ok, total).alias("overround"))


def _probability(p, value: Column, strict: bool) -> Column:
    return _within(_col(p).between(0, 1), value, strict, "a probability lies in [0, 1]")


def edge(p_model, p_fair, strict: bool = False) -> Column:
    return _probability(p_model, _probability(p_fair, _col(p_model) - _col(p_fair), strict), strict)


def ev_per_unit(p, d, strict: bool = False) -> Column:
    p, d = _col(p), _col(d)
    return _probability(p, _within(d > 1, p * (d - 1) - (1 - p), strict, "decimal odds are above 1"), strict)


def kelly_fraction(p, d, strict: bool = False) -> Column:
    p, d = _col(p), _col(d)
    return _probability(p, _within(d > 1, F.greatest(F.lit(0.0), (p * d - 1) / F.when(d > 1, d - 1)), strict, "decimal odds are above 1"), strict)


def stake(bankroll, kelly, fraction=KELLY_FRACTION, cap=STAKE_CAP) -> Column:
    return _col(bankroll) * F.least(_col(kelly) * _col(fraction), _col(cap))


def clv_prob_pts(taken, close_fair, strict: bool = False) -> Column:
    return _probability(close_fair, _col(close_fair) - implied_prob(taken, strict), strict)


def beat_close(taken, close_decimal) -> Column:
    t, c = _col(taken), _col(close_decimal)
    return F.when((t > 1) & (c > 1), t > c)


def settled_profit(result, price) -> Column:
    r = _col(result)
    return F.when(r == "won", _col(price) - 1).when(r == "lost", F.lit(-1.0)).when(r.isin("push", "void"), F.lit(0.0))


def haircut(close_fair, points=0.005) -> Column:
    """A closing probability as a back-test may take it: worse by some points, never below 0."""
    return F.greatest(F.lit(0.0), _col(close_fair) - _col(points))


def no_bet_reasons(p, p_fair, d, captured_age_s, ece, lineup_known, max_age_s: float = 900) -> Column:
    """Why a side isn't published, in a fixed order; empty if it is. A value at its minimum, but for a double's last digits, is enough."""
    e, v = rounded(edge(p, p_fair), 9), rounded(ev_per_unit(p, d), 9)
    named = (
        (p_fair_missing := _col(p_fair).isNull(), "no_reference_price"),
        (_col(captured_age_s) > max_age_s, "stale_price"),
        (~p_fair_missing & (e < MIN_EDGE), "edge_below_minimum"),
        (v < MIN_EV, "ev_below_minimum"),
        (_col(ece) > MAX_ECE, "model_not_calibrated"),
        (~_col(lineup_known), "lineup_unknown"),
    )
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in named]))


def analysed(home, away, p_home, reference_home=None, reference_away=None, bankroll=1000.0) -> Column:
    """array(home, away) of struct(side, p_model, p_fair, price, edge, ev, kelly, stake, publish); no reference: own prices."""
    rh, ra = F.coalesce(*[_col(x) for x in (reference_home, home) if x is not None]), F.coalesce(*[_col(x) for x in (reference_away, away) if x is not None])
    fair = no_vig_two_way(rh, ra)
    out = []
    for name, p, q, d in (("home", _col(p_home), fair["p_a"], _col(home)), ("away", 1 - _col(p_home), fair["p_b"], _col(away))):
        e, v, k = edge(p, q), ev_per_unit(p, d), kelly_fraction(p, d)
        out.append(F.struct(F.lit(name).alias("side"), p.alias("p_model"), q.alias("p_fair"), d.cast("double").alias("price"), e.alias("edge"), v.alias("ev"), k.alias("kelly"), stake(bankroll, k).alias("stake"), ((e >= MIN_EDGE) & (v >= MIN_EV)).alias("publish")))
    return F.array(*out)
