"""Views, metrics, pricing and scalar functions over the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import metrics, pricing, scalars
from tidemark.functions.metrics import rounded
from tidemark.operators.histories import display_name
from tidemark.plans import bindings as B
from tidemark.plans.registry import query
from tidemark.plans.relational_queries import table

_PRED = "pred AS (SELECT doc_id, lang, CAST(quality AS DOUBLE) AS y, least(1.0, n_chars / 6000.0) AS p FROM documents JOIN labels USING (doc_id))"


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored rows: y is the outcome, p the prediction."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    return docs.select("doc_id", "lang", F.col("quality").cast("double").alias("y"), F.least(F.lit(1.0), F.col("n_chars") / 6000).alias("p"))


_CLIP = "least(greatest(p, 0.000001), 0.999999)"


@query(
    "WITH " + _PRED + f""", b AS (SELECT *, least(CAST(floor(p * 10) AS INTEGER), 9) AS bin FROM pred),
    g AS (SELECT lang, bin, abs(sum(p) - sum(y)) AS gap FROM b GROUP BY ALL), e AS (SELECT lang, sum(gap) AS gaps FROM g GROUP BY lang)
    SELECT lang, count(*) AS n, round(avg(-(y * ln({_CLIP}) + (1 - y) * ln(1 - {_CLIP}))), 5) AS log_loss, round(avg((p - y) * (p - y)), 5) AS brier, round(any_value(gaps) / count(*), 5) AS ece FROM b JOIN e USING (lang) GROUP BY lang"""
)
def a12_a15_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log loss, Brier score and calibration error of each group, in one pass over the rows."""
    return metrics.report(predictions(spark, sf_dir), ["lang"])


@query("WITH " + _PRED + " SELECT least(CAST(floor(p * 10) AS INTEGER), 9) + 1 AS bucket, count(*) AS n, round(avg(p), 6) AS predicted, round(avg(y), 6) AS observed, round(abs(avg(p) - avg(y)), 6) AS gap FROM pred GROUP BY 1")
def a11_v5_calibration_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten equal bins, the last one closed."""
    r = lambda c: rounded(F.col(c), 6).alias(c)
    return metrics.bins(predictions(spark, sf_dir)).select((F.col("bin") + 1).alias("bucket"), "n", r("predicted"), r("observed"), r("gap"))


@query("WITH " + _PRED + ", m AS (SELECT median(p) AS mp, median(CASE WHEN y = 0 THEN p END) AS mz FROM pred) SELECT doc_id, round(coalesce(CASE WHEN doc_id % 4 <> 0 THEN p END, mp), 6) AS p, round(coalesce(CASE WHEN y = 0 THEN p END, mz, 0), 6) AS q FROM pred, m")
def a16_l5_median_impute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unknown values become the training rows' exact median, 0 where nothing is known."""
    rows = predictions(spark, sf_dir)
    known = rows.select("doc_id", F.col("p").alias("full"), F.when(F.col("doc_id") % 4 != 0, F.col("p")).alias("p"), F.when(F.col("y") == 0, F.col("p")).alias("q"))
    m = metrics.medians(known, ["full", "q"])
    return known.select("doc_id", rounded(F.coalesce("p", F.lit(m["full"])), 6).alias("p"), rounded(F.coalesce("q", F.lit(m["q"])), 6).alias("q"))


_PICKS = """picks AS (SELECT o_orderkey AS pick_id, o_orderdate AS created, CASE o_orderkey % 4 WHEN 0 THEN 'won' WHEN 1 THEN 'lost' WHEN 2 THEN 'won' ELSE CASE WHEN o_orderkey % 8 = 3 THEN 'push' ELSE 'pending' END END AS status,
  (15000 + o_orderkey % 9000) / 10000 AS price, (1 + o_custkey % 5) * 1.0 AS stake, CASE WHEN o_custkey % 3 = 0 THEN 'moneyline' ELSE 'f5_moneyline' END AS market, o_custkey % 4 AS book,
  CASE WHEN o_orderkey % 3 <> 0 THEN (o_orderkey % 200 - 90) / 1000 END AS clv, (200 + o_orderkey % 300) / 10000 AS edge FROM orders)"""


def picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settled and pending picks with price, stake and, for some, the closing-line value."""
    o = F.col("o_orderkey")
    status = F.when(o % 4 == 0, "won").when(o % 4 == 1, "lost").when(o % 4 == 2, "won").when(o % 8 == 3, "push").otherwise("pending")
    return table(spark, sf_dir, "orders").select(
        o.alias("pick_id"), F.col("o_orderdate").alias("created"), status.alias("status"), ((15000 + o % 9000) / 10000).alias("price"), (1 + F.col("o_custkey") % 5).cast("double").alias("stake"),
        F.when(F.col("o_custkey") % 3 == 0, "moneyline").otherwise("f5_moneyline").alias("market"), (F.col("o_custkey") % 4).alias("book"), F.when(o % 3 != 0, (o % 200 - 90) / 1000).alias("clv"), ((200 + o % 300) / 10000).alias("edge"))


_PROFIT = "CASE status WHEN 'won' THEN price - 1 WHEN 'lost' THEN -1 WHEN 'push' THEN 0 END"


@query(
    "WITH " + _PICKS + f""", s AS (SELECT *, {_PROFIT} AS profit FROM picks WHERE status <> 'pending')
    SELECT date_trunc('month', created)::DATE::VARCHAR AS month, count(*) AS picks, count(*) FILTER (WHERE status = 'won') AS won, count(*) FILTER (WHERE status = 'lost') AS lost, count(*) FILTER (WHERE status = 'push') AS pushed,
      round(count(*) FILTER (WHERE status = 'won') / nullif(count(*) FILTER (WHERE status IN ('won', 'lost')), 0), 4) AS win_rate, round(sum(profit), 4) AS units, round(avg(edge), 4) AS avg_edge,
      round(avg(CASE WHEN clv > 0 THEN 1.0 WHEN clv IS NOT NULL THEN 0.0 END), 4) AS clv_beat_rate FROM s GROUP BY 1"""
)
def v2_a18_monthly_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The monthly view; the beat rate counts picks that have a closing line."""
    p = picks(spark, sf_dir).where("status <> 'pending'").withColumn("profit", pricing.settled_profit("status", "price"))
    s = lambda *x: F.count_if(F.col("status").isin(*x))
    beat = F.avg(F.when(F.col("clv") > 0, 1.0).when(F.col("clv").isNotNull(), 0.0))
    return p.groupBy(F.to_date(F.date_trunc("month", "created")).cast("string").alias("month")).agg(
        F.count(F.lit(1)).alias("picks"), s("won").alias("won"), s("lost").alias("lost"), s("push").alias("pushed"), rounded(s("won") / F.nullif(s("won", "lost"), F.lit(0))).alias("win_rate"),
        rounded(F.sum("profit")).alias("units"), rounded(F.avg("edge")).alias("avg_edge"), rounded(beat).alias("clv_beat_rate"))


@query("WITH " + _PICKS + " SELECT date_trunc('month', created)::DATE::VARCHAR AS month, count(*) AS n, count_if(clv > 0) AS beat, round(count_if(clv > 0) / count(*), 4) AS beat_rate, round(avg(clv), 6) AS mean_clv FROM picks WHERE clv IS NOT NULL GROUP BY 1")
def v4_a19_clv_beat_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of picks that beat the close, by month."""
    p = picks(spark, sf_dir).where("clv is not null")
    return p.groupBy(F.to_date(F.date_trunc("month", "created")).cast("string").alias("month")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("clv") > 0).alias("beat"), rounded(F.count_if(F.col("clv") > 0) / F.count(F.lit(1))).alias("beat_rate"), rounded(F.avg("clv"), 6).alias("mean_clv"))


@query(
    "WITH d AS (SELECT o_orderdate::DATE AS day, count(*) AS scheduled, count_if(o_orderstatus <> 'P') AS evaluated, count_if(o_orderstatus = 'F') AS published FROM orders GROUP BY 1) SELECT day::VARCHAR AS day, scheduled, evaluated, published, round(published / nullif(evaluated, 0), 4) AS publish_rate, round(1 - evaluated / nullif(scheduled, 0), 4) AS unseen FROM d"
)
def v6_a20_selection_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each day's slate was evaluated and published."""
    s, c = F.col("o_orderstatus"), F.col
    d = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("scheduled"), F.count_if(s != "P").alias("evaluated"), F.count_if(s == "F").alias("published"))
    return d.select("*", rounded(c("published") / F.nullif(c("evaluated"), F.lit(0))).alias("publish_rate"), rounded(1 - c("evaluated") / F.nullif(c("scheduled"), F.lit(0))).alias("unseen"))


#: What performance is broken down by, and the bankroll at the period's start.
BREAKDOWNS = ([], ["market"], ["book"], ["band"], ["month"])
_KEYS = ("market", "book", "band", "month")
BANKROLL = 1000.0


def _performance_sql() -> str:
    tagged = " UNION ALL ".join(f"SELECT {k} AS k, {', '.join(c if c in s else f'NULL AS {c}' for c in _KEYS)}, created, pick_id, profit FROM s" for k, s in enumerate(BREAKDOWNS))
    run = f"PARTITION BY k, {', '.join(_KEYS)} ORDER BY created, pick_id ROWS UNBOUNDED PRECEDING"
    level = " ".join(f"WHEN {k} THEN {sum(1 << (3 - i) for i, c in enumerate(_KEYS) if c not in s)}" for k, s in enumerate(BREAKDOWNS))
    rate, n = "(count_if(status = 'won') / count(*))", "count(*)"
    return f"""WITH {_PICKS}, s AS (SELECT *, {_PROFIT} AS profit, CASE WHEN price < 1.75 THEN 'short' WHEN price < 2.1 THEN 'even' ELSE 'long' END AS band, date_trunc('month', created)::DATE::VARCHAR AS month FROM picks WHERE status <> 'pending'),
    x AS ({tagged}), r AS (SELECT *, sum(profit) OVER ({run}) AS e FROM x), f AS (SELECT *, greatest(0, max(e) OVER ({run})) - e AS fall FROM r),
    d AS (SELECT CASE k {level} END AS level, {', '.join(_KEYS)}, max(fall) AS drawdown FROM f GROUP BY ALL),
    g AS (SELECT {', '.join(_KEYS)}, grouping({', '.join(_KEYS)}) AS level, count(*) AS n, round(sum(profit), 4) AS flat_units, round(sum(profit * stake), 4) AS real_units, round(sum(profit * stake) / sum(stake), 4) AS yield, round(sum(profit * stake) / {BANKROLL}, 4) AS roi,
      round(count_if(status = 'won') / nullif(count_if(status IN ('won', 'lost')), 0), 4) AS win_rate, round(avg(1 / price), 4) AS breakeven, round(avg(edge), 4) AS avg_edge,
      round(avg(CASE WHEN status IN ('won', 'lost') THEN CASE WHEN (1 / price + edge > 0.5) = (status = 'won') THEN 1.0 ELSE 0.0 END END), 4) AS accuracy,
      round(greatest(0, {rate} - 1.96 * sqrt({rate} * (1 - {rate}) / {n})), 4) AS low, round(least(1, {rate} + 1.96 * sqrt({rate} * (1 - {rate}) / {n})), 4) AS high FROM s GROUP BY GROUPING SETS ({', '.join('(' + ', '.join(x) + ')' for x in BREAKDOWNS)}))
    SELECT g.*, round(drawdown, 4) AS max_drawdown FROM g JOIN d ON g.level = d.level AND {' AND '.join(f'g.{c} IS NOT DISTINCT FROM d.{c}' for c in _KEYS)}"""


@query(_performance_sql())
def a22_a23_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units, yield, return, win rate against break-even with both ends of its interval, accuracy, average edge and largest drawdown, overall and by
    market, book, odds band and month. Drawdown merges from daily parts, so it goes with the other aggregates."""
    d = F.col("price")
    s = picks(spark, sf_dir).where("status <> 'pending'").withColumn("profit", pricing.settled_profit("status", "price"))
    s = s.withColumn("band", F.when(d < 1.75, "short").when(d < 2.1, "even").otherwise("long")).withColumn("month", F.to_date(F.date_trunc("month", "created")).cast("string"))
    won, n, decided = F.count_if(F.col("status") == "won"), F.count(F.lit(1)), F.col("status").isin("won", "lost")
    ends = metrics.interval(won / n, n)
    right = F.when(decided, ((1 / d + F.col("edge") > 0.5) == (F.col("status") == "won")).cast("double"))
    real = F.sum(F.col("profit") * F.col("stake"))
    g = s.groupingSets(list(BREAKDOWNS), *_KEYS).agg(
        F.grouping_id(*_KEYS).alias("level"), n.alias("n"), rounded(F.sum("profit")).alias("flat_units"), rounded(real).alias("real_units"), rounded(real / F.sum("stake")).alias("yield"), rounded(real / BANKROLL).alias("roi"),
        rounded(won / F.nullif(F.count_if(decided), F.lit(0))).alias("win_rate"), rounded(F.avg(1 / d)).alias("breakeven"), rounded(F.avg("edge")).alias("avg_edge"), rounded(F.avg(right)).alias("accuracy"), rounded(ends["low"]).alias("low"), rounded(ends["high"]).alias("high"))
    levels = [sum(1 << (3 - i) for i, c in enumerate(_KEYS) if c not in x) for x in BREAKDOWNS]
    falls = metrics.drawdowns(s, list(BREAKDOWNS), ["created", "pick_id"], "profit", F.to_date("created"))
    falls = falls.select(F.element_at(F.array(*map(F.lit, levels)), F.col("set") + 1).alias("__level"), *[F.col(c).alias(f"__{c}") for c in _KEYS], rounded(F.col("drawdown")).alias("max_drawdown"))
    same = [F.col("level") == F.col("__level"), *[F.col(c).eqNullSafe(F.col(f"__{c}")) for c in _KEYS]]
    return g.join(falls, same).select(*g.columns, "max_drawdown")


@query(
    B.cte("contests")
    + """, r AS (SELECT * FROM contests WHERE status = 'final'), p AS (SELECT event_id, unnest(['moneyline', 'f5_moneyline']) AS market, CASE WHEN event_id % 2 = 0 THEN 'home' ELSE 'away' END AS side FROM contests)
    SELECT p.event_id, p.market, p.side, CASE WHEN r.event_id IS NULL THEN NULL WHEN market = 'moneyline' THEN CASE WHEN home_score = away_score THEN NULL WHEN side = 'home' THEN home_score > away_score ELSE away_score > home_score END
      WHEN f5_home IS NULL OR f5_home = f5_away THEN NULL WHEN side = 'home' THEN f5_home > f5_away ELSE f5_away > f5_home END AS outcome FROM p LEFT JOIN r ON r.event_id = p.event_id"""
)
def v1_prediction_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome of each prediction; NULL while unplayed and on a push."""
    games = B.contests(spark, sf_dir)
    p = games.select("event_id", F.explode(F.array(F.lit("moneyline"), F.lit("f5_moneyline"))).alias("market"), F.when(F.col("event_id") % 2 == 0, "home").otherwise("away").alias("side"))
    r = games.where("status = 'final'").select("event_id", "home_score", "away_score", "f5_home", "f5_away")
    joined = p.join(r, "event_id", "left")
    return joined.select("event_id", "market", "side", scalars.outcome(F.col("market"), F.col("side")).alias("outcome"))


@query(
    """SELECT event_id, round(1 + value / 100, 6) AS decimal_price, round(CASE WHEN abs(am) >= 100 THEN CASE WHEN am > 0 THEN 1 + am / 100 ELSE 1 + 100 / abs(am) END END, 6) AS from_american,
      round(CASE WHEN d > 1 THEN CASE WHEN d >= 2 THEN (d - 1) * 100 ELSE -100 / (d - 1) END END, 4) AS to_american, round(CASE WHEN d > 1 THEN 1 / d END, 6) AS implied,
      round(pm * (d - 1) - (1 - pm), 6) AS ev, round(greatest(0, (pm * d - 1) / (d - 1)), 6) AS kelly, round(1000 * least(greatest(0, (pm * d - 1) / (d - 1)) * 0.125, 0.02), 4) AS stake, round(pm - 1 / d, 6) AS clv, d > 2 AS beat
      FROM (SELECT *, (10100 + CAST(round(value * 100) AS BIGINT)) / 10000 AS d, CAST(event_id % 500 AS BIGINT) - 250 AS am, (event_id % 100) / 100 AS pm FROM events)"""
)
def m1_m10_pricing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversions, implied probability, value, Kelly share, stake, closing-line value."""
    e = table(spark, sf_dir, "events").select("event_id", "value", ((10100 + F.round(F.col("value") * 100).cast("bigint")) / 10000).alias("d"), (F.col("event_id") % 500 - 250).alias("am"), ((F.col("event_id") % 100) / 100).alias("pm"))
    k = pricing.kelly_fraction("pm", "d")
    return e.select(
        "event_id", rounded(1 + F.col("value") / 100, 6).alias("decimal_price"), rounded(pricing.american_to_decimal("am"), 6).alias("from_american"), rounded(pricing.decimal_to_american("d")).alias("to_american"), rounded(pricing.implied_prob("d"), 6).alias("implied"),
        rounded(pricing.ev_per_unit("pm", "d"), 6).alias("ev"), rounded(k, 6).alias("kelly"), rounded(pricing.stake(1000, k)).alias("stake"), rounded(pricing.clv_prob_pts("d", "pm"), 6).alias("clv"), pricing.beat_close("d", F.lit(2.0)).alias("beat"))


@query(
    B.cte("odds")
    + """, q AS (SELECT event_id, book, arg_max(price, snapshot_id) FILTER (WHERE side = 'home') AS h, arg_max(price, snapshot_id) FILTER (WHERE side = 'away') AS a FROM odds GROUP BY ALL), f AS (SELECT *, 1 / h + 1 / a AS o, (40 + event_id % 30) / 100 AS pm FROM q WHERE h IS NOT NULL AND a IS NOT NULL),
    s AS (SELECT event_id, book, 'home' AS side, pm AS p, CASE WHEN o >= 1 THEN 1 / h / o END AS fair, h AS d, o FROM f UNION ALL SELECT event_id, book, 'away', 1 - pm, CASE WHEN o >= 1 THEN 1 / a / o END, a, o FROM f)
    SELECT event_id, book, side, round(p, 6) AS p_model, round(fair, 6) AS p_fair, round(CASE WHEN o >= 1 THEN o END, 6) AS overround, round(p - fair, 6) AS edge, round(p * (d - 1) - (1 - p), 6) AS ev, round(p - fair, 6) >= 0.02 AND round(p * (d - 1) - (1 - p), 6) >= 0.02 AS publish FROM s"""
)
def m4_m11_analyse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides of a market, margin removed; NULL where two prices leave none."""
    odds = B.entity(spark, sf_dir, "odds")
    q = odds.groupBy("event_id", "book").agg(*[F.max_by(F.when(F.col("side") == s, F.col("price")), F.when(F.col("side") == s, F.col("snapshot_id"))).alias(c) for s, c in (("home", "h"), ("away", "a"))])
    f = q.where("h is not null and a is not null").withColumn("pm", (40 + F.col("event_id") % 30) / 100)
    sides = f.select("event_id", "book", pricing.no_vig_two_way("h", "a")["overround"].alias("o"), F.inline(pricing.analysed("h", "a", "pm")))
    e, v = rounded(F.col("edge"), 6), rounded(F.col("ev"), 6)
    return sides.select("event_id", "book", "side", rounded(F.col("p_model"), 6).alias("p_model"), rounded(F.col("p_fair"), 6).alias("p_fair"), rounded(F.col("o"), 6).alias("overround"), e.alias("edge"), v.alias("ev"), ((e >= 0.02) & (v >= 0.02)).alias("publish"))


@query(
    """WITH e AS (SELECT event_id, (event_id % 100) / 100 AS p, CASE WHEN event_id % 7 <> 0 THEN 0.45 END AS fair, (10100 + CAST(round(value * 100) AS BIGINT)) / 10000 AS d, event_id % 1200 AS age, CASE WHEN event_id % 11 = 0 THEN 0.05 ELSE 0.01 END AS ece, event_id % 5 <> 0 AS known FROM events)
    SELECT event_id, list_filter([CASE WHEN fair IS NULL THEN 'no_reference_price' END, CASE WHEN age > 900 THEN 'stale_price' END, CASE WHEN round(p - fair, 9) < 0.02 THEN 'edge_below_minimum' END, CASE WHEN round(p * (d - 1) - (1 - p), 9) < 0.02 THEN 'ev_below_minimum' END, CASE WHEN ece > 0.03 THEN 'model_not_calibrated' END, CASE WHEN NOT known THEN 'lineup_unknown' END], lambda x: x IS NOT NULL) AS reasons,
      round(greatest(0, coalesce(fair, 0.5) - 0.005), 6) AS close_after_haircut FROM e"""
)
def m13_m15_no_bet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reasons against a bet, in order; the closing haircut."""
    c = F.col("event_id")
    e = table(spark, sf_dir, "events").select(c, ((c % 100) / 100).alias("p"), F.when(c % 7 != 0, F.lit(0.45)).alias("fair"), ((10100 + F.round(F.col("value") * 100).cast("bigint")) / 10000).alias("d"), (c % 1200).alias("age"), F.when(c % 11 == 0, 0.05).otherwise(0.01).alias("ece"), (c % 5 != 0).alias("known"))
    return e.select("event_id", pricing.no_bet_reasons("p", "fair", "d", "age", "ece", "known").alias("reasons"), rounded(pricing.haircut(F.coalesce("fair", F.lit(0.5))), 6).alias("close_after_haircut"))


@query(
    "WITH " + _PRED + """, d AS (SELECT *, CAST(doc_id % 180 AS BIGINT) AS day FROM pred), days AS (SELECT DISTINCT day FROM d),
    b AS (SELECT t.day, least(CAST(floor(p * 10) AS INTEGER), 9) AS bin, count(*) AS n, abs(sum(p) - sum(y)) AS gap FROM days t JOIN d ON d.day BETWEEN t.day - 60 AND t.day - 1 GROUP BY ALL)
    SELECT day, sum(n) AS n, round(sum(gap) / sum(n), 6) AS ece, round(sum(gap) / sum(n), 6) <= 0.03 AS open FROM b GROUP BY day"""
)
def m14_rolling_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibration error of the sixty days before each day. Bins of days are summed first, then a range window."""
    d = predictions(spark, sf_dir).withColumn("day", F.col("doc_id") % 180).withColumn("bin", metrics.bucket("p"))
    daily = d.groupBy("day", "bin").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("sp"), F.sum("y").alias("sy"))
    grid = daily.select("day").distinct().select("day", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("bin")).join(daily, ["day", "bin"], "left")
    w = Window.partitionBy("bin").orderBy("day").rangeBetween(-60, -1)
    sums = grid.select("day", "bin", F.sum("n").over(w).alias("n"), F.abs(F.sum("sp").over(w) - F.sum("sy").over(w)).alias("gap")).where("n is not null")
    e = rounded(F.sum("gap") / F.sum("n"), 6)
    return sums.groupBy("day").agg(F.sum("n").alias("n"), e.alias("ece")).withColumn("open", F.col("ece") <= pricing.MAX_ECE)


@query(
    """SELECT o_orderkey, lower(o_orderpriority) AS low, concat_ws('|', o_orderstatus, o_orderpriority) AS joined, contains(o_orderpriority, 'URG') AS urgent, substr(strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ'), 1, 10) AS day_text,
      (o_orderkey % 7) * 3 + o_orderkey % 3 AS outs, date_trunc('month', o_orderdate)::DATE::VARCHAR AS month, datediff('day', DATE '1995-01-01', o_orderdate::DATE) AS days, (o_orderdate::DATE - INTERVAL 30 DAY)::DATE::VARCHAR AS before,
      date_trunc('year', o_orderdate)::DATE::VARCHAR AS new_year, year(o_orderdate) AS yr, o_orderdate::DATE - DATE '1970-01-01' AS epoch_day, o_orderkey // 100 AS slot, o_orderkey % 100 AS sub, CAST(greatest(least(o_orderkey % 13, 9), 2) AS BIGINT) AS bounded FROM orders"""
)
def x1_x17_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings, innings, instants, dates, bounds, integer parts."""
    o, d, c = F.col("o_orderkey"), F.to_date("o_orderdate"), F.col
    innings = F.concat((o % 7).cast("string"), F.lit("."), (o % 3).cast("string"))
    text = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.lower("o_orderpriority").alias("low"), F.concat_ws("|", "o_orderstatus", "o_orderpriority").alias("joined"), c("o_orderpriority").contains("URG").alias("urgent"), F.substring(text, 1, 10).alias("day_text"),
        scalars.innings_to_outs(F.lit(None).cast("int"), innings).alias("outs"), F.to_date(F.date_trunc("month", scalars.instant(text))).cast("string").alias("month"), F.datediff(scalars.tolerant_date(text), F.lit("1995-01-01").cast("date")).alias("days"), F.date_sub(d, 30).cast("string").alias("before"),
        F.trunc(d, "year").cast("string").alias("new_year"), F.year(d).alias("yr"), F.unix_date(d).alias("epoch_day"), F.expr("o_orderkey div 100").alias("slot"), (o % 100).alias("sub"), F.greatest(F.least(o % 13, F.lit(9)), F.lit(2)).cast("bigint").alias("bounded"))


@query(
    """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.missing.deep') IS NULL AS absent, upper(substr(replace(event_type || '_feed', '_', ' '), 1, 1)) || substr(event_type, 2) || ' Feed' AS title,
      round(ln(least(greatest(value / 100, 0.000001), 0.999999) / (1 - least(greatest(value / 100, 0.000001), 0.999999))), 6) AS logit, sha256(event_id::VARCHAR) AS h FROM events"""
)
def x2_x12_x16_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON paths with defaults, titles, logit, hashing."""
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"), F.get_json_object("props", "$.missing.deep").isNull().alias("absent"), display_name(F.concat("event_type", F.lit("_feed"))).alias("title"),
        rounded(metrics.logit(F.col("value") / 100), 6).alias("logit"), F.sha2(F.col("event_id").cast("string"), 256).alias("h"))


@query("WITH h AS (SELECT o_orderkey AS event_id, sha256('moneyline:T' || (o_custkey % 30) || '@T' || (o_orderkey % 29)) AS x FROM orders) SELECT event_id, round(0.35 + 0.30 * (CAST('0x' || substr(x, 1, 16) AS UBIGINT) / 18446744073709551616.0), 9) AS p_home FROM h")
def x19_hash_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each contest's stable number in [0.35, 0.65), the stand-in for a model that isn't there."""
    team = lambda x: F.concat(F.lit("T"), x.cast("string"))
    p = scalars.hashed_probability(F.lit("moneyline"), team(F.col("o_custkey") % 30), team(F.col("o_orderkey") % 29))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event_id"), rounded(p, 9).alias("p_home"))


@query(
    """WITH v AS (SELECT event_id, (event_id % 1000 + 0.3) / 1000 AS p, (event_id % 401 - 200.3) / 1000 AS edge, 1 + (event_id % 900 + 0.7) / 100 AS odds, (event_id % 200 + 0.3) / 10000 AS stake FROM events)
    SELECT event_id, printf('%.1f%%', p * 100) AS prob, CASE WHEN edge >= 0 THEN '+' ELSE '' END || printf('%.1f%%', edge * 100) AS signed, printf('%.2f', odds) AS odds, printf('%.2f%%', stake * 100) AS stake, 'T' || (event_id % 30) || ' @ T' || (event_id % 29) AS game FROM v"""
)
def x21_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Display strings: probability, signed points, odds, stake, the pairing."""
    c = F.col("event_id")
    team = lambda n: F.concat(F.lit("T"), (c % n).cast("string"))
    return table(spark, sf_dir, "events").select(
        "event_id", scalars.percent((c % 1000 + 0.3) / 1000).alias("prob"), scalars.signed_points((c % 401 - 200.3) / 1000).alias("signed"), scalars.shown_odds(1 + (c % 900 + 0.7) / 100).alias("odds"),
        scalars.shown_stake((c % 200 + 0.3) / 10000).alias("stake"), scalars.pairing(team(29), team(30)).alias("game"))
