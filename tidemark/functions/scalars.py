"""Scalar expressions of the domain: instants and innings as the feeds write them, outcomes, hashed stand-ins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def instant(text: Column) -> Column:
    """An ISO-8601 instant with Z; NULL if it can't be read."""
    return F.try_to_timestamp(text)


def tolerant_date(text: Column) -> Column:
    """The date in the first ten characters; NULL if there is none."""
    return F.expr("cast(null as date)") if text is None else F.try_to_timestamp(F.substring(text, 1, 10), F.lit("yyyy-MM-dd")).cast("date")


def innings_to_outs(outs: Column, innings: Column) -> Column:
    """Outs as the feed counts them, else from innings such as 5.2 (five and two thirds)."""
    parts = F.split(innings, r"\.")
    whole = F.try_element_at(parts, F.lit(1)).try_cast("int")
    rest = F.coalesce(F.substring(F.try_element_at(parts, F.lit(2)), 1, 1).try_cast("int"), F.lit(0))
    return F.coalesce(outs, whole * 3 + rest)


def outcome(market: Column, side: Column, home="home_score", away="away_score", f5_home="f5_home", f5_away="f5_away") -> Column:
    """Whether a side won its market; NULL while the score isn't known and on a push."""

    def won(h: Column, a: Column) -> Column:
        return F.when(h != a, F.when(side == "home", h > a).otherwise(a > h))

    return F.when(market == "moneyline", won(F.col(home), F.col(away))).when(market == "f5_moneyline", won(F.col(f5_home), F.col(f5_away)))


def hashed_probability(market: Column, home: Column, away: Column) -> Column:
    """A stable stand-in for a model: the first 16 hexadecimal digits of the SHA-256 of ``market:home@away``, over 2^64, laid into [0.35, 0.65)."""
    digits = F.substring(F.sha2(F.concat(market, F.lit(":"), home, F.lit("@"), away), 256), 1, 16)
    return 0.35 + 0.30 * (F.conv(digits, 16, 10).cast("decimal(20,0)").cast("double") / float(1 << 64))


def percent(p: Column, digits: int = 1) -> Column:
    """A share as a percentage."""
    return F.format_string(f"%.{digits}f%%", p * 100)


def signed_points(x: Column) -> Column:
    """An edge or expected value in points, with the sign of a gain shown."""
    return F.concat(F.when(x >= 0, "+").otherwise(""), percent(x))


def shown_odds(d: Column) -> Column:
    """Decimal odds to two places."""
    return F.format_string("%.2f", d)


def shown_stake(fraction: Column) -> Column:
    """A stake as a percentage of the bankroll."""
    return percent(fraction, 2)


def pairing(home: Column, away: Column) -> Column:
    """A contest's label."""
    return F.concat(away, F.lit(" @ "), home)
