"""Calibration metrics as aggregates: one pass, partial sums before the shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-6


def rounded(x: Column, digits: int = 4) -> Column:
    """Half away from zero on the decimal value (twelve places), so that engines agree near a tie."""
    return F.round(x.cast("decimal(28,12)"), digits).cast("double")


def clipped(p) -> Column:
    return F.least(F.greatest(F.col(p) if isinstance(p, str) else p, F.lit(EPS)), F.lit(1 - EPS))


def logit(p) -> Column:
    q = clipped(p)
    return F.ln(q / (1 - q))


def log_loss(y: str = "y", p: str = "p") -> Column:
    q = clipped(p)
    return F.avg(-(F.col(y) * F.ln(q) + (1 - F.col(y)) * F.ln(1 - q)))


def brier(y: str = "y", p: str = "p") -> Column:
    return F.avg(F.pow(F.col(p) - F.col(y), 2))


def bucket(p, bins: int = 10) -> Column:
    """Equal-width bin from 0, the last one closed."""
    return F.least(F.floor((F.col(p) if isinstance(p, str) else p) * bins), F.lit(bins - 1)).cast("int")


def bins(df: DataFrame, by: list[str] | None = None, y: str = "y", p: str = "p", n: int = 10) -> DataFrame:
    """Rows of each bin: n, mean prediction, observed rate, gap."""
    own = df.groupBy(*(by or []), bucket(p, n).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("predicted"), F.avg(y).alias("observed"))
    return own.withColumn("gap", F.abs(F.col("predicted") - F.col("observed")))


def report(df: DataFrame, by: list[str] | None = None, y: str = "y", p: str = "p", digits: int = 5) -> DataFrame:
    """n, log_loss, brier and ece of each group. The bins' sums carry all, so rows are read and shuffled once."""
    by = by or []
    q = clipped(p)
    part = df.groupBy(*by, bucket(p).alias("__bin")).agg(
        F.count(F.lit(1)).alias("__n"), F.sum(p).alias("__p"), F.sum(F.col(y).cast("double")).alias("__y"),
        F.sum(-(F.col(y) * F.ln(q) + (1 - F.col(y)) * F.ln(1 - q))).alias("__l"), F.sum(F.pow(F.col(p) - F.col(y), 2)).alias("__b"))
    n = F.sum("__n")
    return part.groupBy(*by).agg(n.alias("n"), rounded(F.sum("__l") / n, digits).alias("log_loss"), rounded(F.sum("__b") / n, digits).alias("brier"), rounded(F.sum(F.abs(F.col("__p") - F.col("__y"))) / n, digits).alias("ece"))


def interval(rate: Column, n: Column, z: float = 1.96) -> Column:
    """Normal interval of a rate: struct(low, high), within [0, 1]."""
    half = z * F.sqrt(rate * (1 - rate) / n)
    return F.struct(F.greatest(F.lit(0.0), rate - half).alias("low"), F.least(F.lit(1.0), rate + half).alias("high"))


#: Values of a column that may reach one task when its middle is picked, and the accuracy of the summaries that narrow it.
SMALL, ACCURACY = 10_000, 10_000


def medians(df: DataFrame, columns: list[str], small: int = SMALL, accuracy: int = ACCURACY) -> dict[str, float]:
    """Exact median of each column, 0.0 where all values are unknown; NaN counts as unknown.

    All columns are narrowed in the same passes. A quantile summary, which merges, gives two values between which the middle ranks lie for sure; a count
    of the values under, at and between them tells which ranks these have. That goes on with the values between until few are left or the middle ones are known.
    Each round leaves about ``4 / accuracy`` of the values, whatever their distribution, and ties at either end are counted, not carried."""
    values = [F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in columns]
    first = df.agg(*[f(v).alias(f"{n}{i}") for i, v in enumerate(values) for n, f in (("n", F.count), ("lo", F.min), ("hi", F.max))]).first()
    # of the n values in [lo, hi], those with ranks a and b (from 0) are the middle ones
    left = {i: {"lo": first[f"lo{i}"], "hi": first[f"hi{i}"], "n": first[f"n{i}"], "a": (first[f"n{i}"] - 1) // 2, "b": first[f"n{i}"] // 2} for i in range(len(columns)) if first[f"n{i}"]}
    found = {c: 0.0 for c in columns}
    while wide := {i: x for i, x in left.items() if x["n"] > small}:
        inside = {i: F.when(values[i].between(x["lo"], x["hi"]), values[i]) for i, x in wide.items()}
        room = 2 / accuracy
        near = [F.percentile_approx(inside[i], [max(0.0, x["a"] / x["n"] - room), min(1.0, (x["b"] + 1) / x["n"] + room)], accuracy).alias(f"q{i}") for i, x in wide.items()]
        cut = df.agg(*near).first()
        counts = []
        for i in wide:
            v, (low, high) = inside[i], cut[f"q{i}"]
            between = F.when((v > low) & (v < high), v)
            counts += [F.count_if(v < low).alias(f"u{i}"), F.count_if(v == low).alias(f"l{i}"), F.count_if((v == high) & (v > low)).alias(f"h{i}"), F.count(between).alias(f"n{i}"), F.min(between).alias(f"lo{i}"), F.max(between).alias(f"hi{i}")]
        row = df.agg(*counts).first()
        for i, x in wide.items():
            (low, high), under, lows, n, highs = cut[f"q{i}"], row[f"u{i}"], row[f"l{i}"], row[f"n{i}"], row[f"h{i}"]
            a, b = x["a"] - under, x["b"] - under
            if a < 0 or b >= lows + n + highs:
                raise ArithmeticError(f"the summary of {columns[i]} missed its middle")
            ends = [low if r < lows else high if r >= lows + n else None for r in (a, b)]
            if ends[0] is None and ends[1] is None:
                x |= {"lo": row[f"lo{i}"], "hi": row[f"hi{i}"], "n": n, "a": a - lows, "b": b - lows}
                continue
            # one in the middle and one at an end are neighbours
            one, two = ends[0] if ends[0] is not None else row[f"hi{i}"], ends[1] if ends[1] is not None else row[f"lo{i}"]
            found[columns[i]] = one / 2 + two / 2
            left.pop(i)
    if left:
        row = df.agg(*[_ranked(values[i], x).alias(f"m{i}") for i, x in left.items()]).first()
        found |= {columns[i]: float(row[f"m{i}"]) for i in left}
    return found


def _ranked(value: Column, x: dict) -> Column:
    """The mean of the values of ranks a and b among those in [lo, hi]: few, so they are sorted in one array."""
    inside = F.sort_array(F.collect_list(F.when(value.between(x["lo"], x["hi"]), value)))
    return inside[x["a"]] / 2 + inside[x["b"]] / 2


def long_form(df: DataFrame, columns: Sequence[str], *more: str) -> DataFrame:
    """column (its number), value and ``more``: a row for each known value of each column; NaN counts as unknown. Aggregates over it stay narrow, however many columns."""
    rows = df.select(*more, F.posexplode(F.array(*[F.col(c).cast("double") for c in columns])).alias("column", "value"))
    return rows.where(F.col("value").isNotNull() & ~F.isnan("value"))


def medians_before(df: DataFrame, columns: list[str], by: str, ends: Sequence) -> list[dict[str, float]]:
    """For each of the ends the exact median of each column over the rows whose ``by`` lies before it, 0.0 where all values are unknown: all ends in one job.

    Values are counted before the shuffle, so what is sorted for a column is its different values: for columns that are rounded, as features are, no more on a larger table."""
    if not ends or not columns:
        return [{c: 0.0 for c in columns} for _ in ends]
    values = long_form(df.where(F.col(by) < max(ends)), columns, by)
    counts = values.groupBy("column", "value").agg(*[F.count_if(F.col(by) < e).alias(f"n{k}") for k, e in enumerate(ends)])
    whole = Window.partitionBy("column")
    upto = whole.orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.select("column", "value", *[x for k in range(len(ends)) for x in (f"n{k}", F.sum(f"n{k}").over(upto).alias(f"c{k}"), F.sum(f"n{k}").over(whole).alias(f"t{k}"))])
    c = F.col
    holds = lambda k, rank: (c(f"c{k}") - c(f"n{k}") <= rank) & (rank < c(f"c{k}"))
    middle = lambda k, rank: F.max(F.when(holds(k, F.floor(rank)), c("value")))
    found = placed.groupBy("column").agg(*[(middle(k, (c(f"t{k}") - 1) / 2) / 2 + middle(k, c(f"t{k}") / 2) / 2).alias(f"m{k}") for k in range(len(ends))]).collect()
    out = [{x: 0.0 for x in columns} for _ in ends]
    for r in found:
        for k, own in enumerate(out):
            if r[f"m{k}"] is not None:
                own[columns[r["column"]]] = r[f"m{k}"]
    return out


def fall(parts: Column) -> Column:
    """Of an array of (order, sum, highest prefix, deepest fall) structs, sorted by order: those of the whole run. The triple merges: a fall of
    two parts is one of either, or from the first's peak to the second's lowest point."""
    zero = F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("peak"), F.lit(0.0).alias("fall"))

    def merged(a, p):
        deepest = F.greatest(a["fall"], p["fall"], a["peak"] - (a["sum"] + p["low"]))
        return F.struct((a["sum"] + p["sum"]).alias("sum"), F.greatest(a["peak"], a["sum"] + p["peak"]).alias("peak"), deepest.alias("fall"))

    return F.aggregate(parts, zero, merged)


def drawdowns(df: DataFrame, sets: list[list[str]], order: Sequence, amount: str, grain: Column) -> DataFrame:
    """The columns of all sets (NULL where a set leaves one out), ``set`` (its number), ``units`` and ``drawdown``: the largest fall of the running
    sum from its peak (at least 0), in the order given.

    Rows are summed to parts first, one for each group and ``grain`` (a column that rises with the order, such as a day): a part's sum, its highest and
    lowest prefix and its deepest fall. Parts merge, so what is sorted for a group at the end is its days, not its rows."""
    names = list(dict.fromkeys(c for s in sets for c in s))
    tagged = [F.struct(F.lit(k).alias("set"), *[(F.col(c) if c in s else F.lit(None).cast(df.schema[c].dataType)).alias(c) for c in names]) for k, s in enumerate(sets)]
    rows = df.select(F.col(amount).cast("double").alias("__x"), grain.alias("__grain"), F.struct(*order).alias("__order"), F.inline(F.array(*tagged)))
    group = ["set", *names, "__grain"]
    w = Window.partitionBy(*group).orderBy("__order").rowsBetween(Window.unboundedPreceding, 0)
    run = rows.withColumn("__sum", F.sum("__x").over(w))
    run = run.withColumn("__peak", F.greatest(F.lit(0.0), F.max("__sum").over(w)))
    parts = run.groupBy(*group).agg(F.sum("__x").alias("sum"), F.max("__peak").alias("peak"), F.least(F.lit(0.0), F.min("__sum")).alias("low"), F.max(F.col("__peak") - F.col("__sum")).alias("fall"))
    whole = parts.groupBy("set", *names).agg(fall(F.sort_array(F.collect_list(F.struct("__grain", "sum", "peak", "low", "fall")))).alias("__f"))
    return whole.select("set", *names, F.col("__f.sum").alias("units"), F.col("__f.fall").alias("drawdown"))


def coverage(*columns: str) -> Column:
    """Share of rows in which all columns are known."""
    known = F.lit(True)
    for c in columns:
        known = known & F.col(c).isNotNull()
    return F.avg(known.cast("double"))
