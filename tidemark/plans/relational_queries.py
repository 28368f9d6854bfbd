"""Predicates, joins, aggregations, windows and mutations over the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions import metrics
from tidemark.functions.metrics import coverage, rounded
from tidemark.operators import asof, audit, histories
from tidemark.plans import bindings as B
from tidemark.plans.registry import query
from tidemark.session import adopt
from tidemark.sources import tables

DAY, HOUR = B.DAY_US, 3_600_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tables.read(adopt(spark), sf_dir, name)


@query(B.cte("contests") + " SELECT event_id, home_team, away_team FROM contests WHERE start >= TIMESTAMP '1996-01-01' AND start < TIMESTAMP '1997-01-01' AND status = 'final' AND event_id BETWEEN 10 AND 9000 AND home_team NOT IN (3, 4)")
def p1_p5_p7_p15_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lower bound in, upper bound out; BETWEEN; NOT IN; finished games."""
    return B.contests(spark, sf_dir).where("start >= timestamp'1996-01-01' and start < timestamp'1997-01-01' and status = 'final' and event_id between 10 and 9000 and home_team not in (3, 4)").select("event_id", "home_team", "away_team")


@query(B.cte("contests") + " SELECT team, count(*) AS games, min(start_day) AS first_day FROM (SELECT team, start_day FROM contests JOIN (SELECT DISTINCT n_nationkey AS team FROM nation) ON home_team = team OR away_team = team WHERE start_day BETWEEN 9500 AND 9599) GROUP BY team")
def p2_p3_p4_teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A day window; 'home or away' by unpivoting instead of an OR join; IN as a semi-join."""
    rows = B.sides(spark, sf_dir).where("start_day between 9500 and 9599").select("team", "start_day")
    named = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("team"))
    return rows.join(named, "team", "left_semi").groupBy("team").agg(F.count(F.lit(1)).alias("games"), F.min("start_day").alias("first_day"))


@query(
    """SELECT event_id, json_exists(props, '$.k') AS has_k, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, (CASE WHEN value > 50 THEN event_type END) IS DISTINCT FROM 'click' AS differs,
      event_type LIKE 'p%' AS is_p, regexp_matches(event_type, '^[a-z]{4,5}$') AS short_name, CASE WHEN value < 10 THEN 'low' WHEN value < 60 THEN 'mid' WHEN value < 90 THEN 'high' END AS band FROM events"""
)
def p6_p8_p11_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IS DISTINCT FROM, JSON key and value, LIKE, regular expression, searched CASE with NULL."""
    m = F.from_json("props", "map<string,bigint>")
    v = F.col("value")
    return table(spark, sf_dir, "events").select(
        "event_id", F.map_contains_key(m, F.lit("k")).alias("has_k"), F.try_element_at(m, F.lit("k")).alias("k"), (~F.when(v > 50, F.col("event_type")).eqNullSafe(F.lit("click"))).alias("differs"),
        F.col("event_type").like("p%").alias("is_p"), F.col("event_type").rlike("^[a-z]{4,5}$").alias("short_name"), F.when(v < 10, "low").when(v < 60, "mid").when(v < 90, "high").alias("band"))


@query(
    B.cte("sides")
    + ", b AS (SELECT *, TIMESTAMP '1999-01-01' AS now FROM contests) SELECT event_id, CASE WHEN event_id % 2 = 0 THEN home_score ELSE away_score END AS scored, CASE WHEN event_id % 2 = 0 THEN away_score ELSE home_score END AS allowed, home_team < away_team AS was_lower, start <= now + INTERVAL 12 DAY AS soon FROM b WHERE start > now"
)
def p12_p13_p16_p17_pregame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Computed flag, swap by side, only what lies ahead, look-ahead horizon."""
    even, c = F.col("event_id") % 2 == 0, F.col
    now = F.lit("1999-01-01").cast("timestamp")
    return B.contests(spark, sf_dir).where(c("start") > now).select("event_id", F.when(even, c("home_score")).otherwise(c("away_score")).alias("scored"), F.when(even, c("away_score")).otherwise(c("home_score")).alias("allowed"), (c("home_team") < c("away_team")).alias("was_lower"), (c("start") <= now + F.expr("interval 12 days")).alias("soon"))


@query(
    """SELECT o_orderkey, list_filter([CASE WHEN NOT (o_totalprice > 20000) THEN 'minimum' END, CASE WHEN NOT (regexp_matches(o_orderpriority, '^[1-3]')) THEN 'priority' END, CASE WHEN NOT (o_orderstatus IN ('F','O')) THEN 'status' END], lambda x: x IS NOT NULL) AS violations,
      o_totalprice > 20000 AND regexp_matches(o_orderpriority, '^[1-3]') AND o_orderstatus IN ('F','O') AS valid FROM orders"""
)
def p14_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CHECK constraints as a rule set: the names of the rules that a row breaks."""
    rules = {"minimum": "o_totalprice > 20000", "priority": "o_orderpriority rlike '^[1-3]'", "status": "o_orderstatus in ('F','O')"}
    return schemas.checked(table(spark, sf_dir, "orders"), rules).select("o_orderkey", "violations", "valid")


@query("SELECT r_name, n_name, count(*) AS orders, round(sum(CAST(round(o_totalprice * 100) AS BIGINT)) / 100, 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def j1_j2_inner_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fact joins by key, dimensions of fixed size broadcast; summed by customer before the joins."""
    t = lambda n: table(spark, sf_dir, n)
    by_customer = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("cents"))
    dims = F.broadcast(t("nation").join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name"))
    rows = by_customer.join(t("customer").select("c_custkey", "c_nationkey"), "c_custkey").join(dims, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("r_name", "n_name").agg(F.sum("n").alias("orders"), rounded(F.sum("cents") / 100, 2).alias("total"))


@query("SELECT c_custkey, count(o_orderkey) AS orders, max(CAST(o_orderdate AS DATE)) IS NULL AS never FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def j3_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Left outer join; what is missing stays NULL."""
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"), F.max("o_orderdate").alias("last"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(orders, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("orders"), F.col("last").isNull().alias("never"))


_STARTS = ", starts AS (SELECT event_id, max(captured_at_us) AS start_us FROM odds WHERE book = 'purchase' GROUP BY event_id)"


def starts(odds: DataFrame) -> DataFrame:
    return odds.where("book = 'purchase'").groupBy("event_id").agg(F.max("captured_at_us").alias("start_us"))


@query(B.cte("odds") + _STARTS + f" SELECT s.event_id, count(o.snapshot_id) AS captures, max(o.captured_at_us) AS last_us FROM starts s LEFT JOIN odds o ON o.event_id = s.event_id AND o.captured_at_us BETWEEN s.start_us - {10 * HOUR} AND s.start_us GROUP BY s.event_id")
def j5_interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures within [start - 10 h, start] of each event: an equi-join with a residual, aggregated at once."""
    odds = B.entity(spark, sf_dir, "odds").select("event_id", "snapshot_id", "captured_at_us")
    inside = F.col("captured_at_us").between(F.col("start_us") - 10 * HOUR, F.col("start_us"))
    joined = odds.join(starts(B.entity(spark, sf_dir, "odds")), "event_id", "right")
    return joined.groupBy("event_id").agg(F.count(F.when(inside, F.col("snapshot_id"))).alias("captures"), F.max(F.when(inside, F.col("captured_at_us"))).alias("last_us"))


@query(B.cte("probables") + ", h AS (SELECT event_id, pitcher, seen_at_us FROM probables WHERE kind = 'purchase'), t AS (SELECT seen_id, event_id, seen_at_us FROM probables WHERE kind = 'view') SELECT t.seen_id, t.event_id, h.pitcher, h.seen_at_us AS since_us FROM t ASOF LEFT JOIN h ON t.event_id = h.event_id AND t.seen_at_us >= h.seen_at_us")
def j6_asof_probable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest value at or before an instant, without a range join."""
    rows = B.entity(spark, sf_dir, "probables")
    history = rows.where("kind = 'purchase'").select("event_id", "pitcher", F.col("seen_at_us").alias("since_us"))
    return asof.latest(rows.where("kind = 'view'").select("seen_id", "event_id", "seen_at_us"), history, ["event_id"], "seen_at_us", "since_us", ["pitcher", "since_us"]).drop("seen_at_us")


@query(
    B.cte("probables")
    + f""", h AS (SELECT DISTINCT event_id, seen_at_us // {6 * HOUR} AS seen, kind FROM probables), t AS (SELECT DISTINCT event_id, seen_at_day * 4 + 2 AS at FROM probables),
    l AS (SELECT t.event_id, t.at, max(h.seen) AS seen FROM t JOIN h ON h.event_id = t.event_id AND h.seen <= t.at GROUP BY ALL)
    SELECT l.event_id, l.at, l.seen, h.kind FROM l JOIN h USING (event_id, seen)"""
)
def j7_asof_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All members of the latest snapshot at or before an instant."""
    rows = B.entity(spark, sf_dir, "probables")
    history = rows.select("event_id", F.expr(f"seen_at_us div {6 * HOUR}").alias("seen"), "kind").distinct()
    targets = rows.select("event_id", (F.col("seen_at_day") * 4 + 2).alias("at")).distinct()
    return asof.latest_set(history, targets, ["event_id"], "at", "seen", ["kind"])


@query(B.cte("contests") + " SELECT e.event_id, coalesce(list(s.event_id ORDER BY s.event_id) FILTER (WHERE s.event_id IS NOT NULL), []) AS siblings FROM contests e LEFT JOIN contests s ON s.home_team = e.home_team AND s.away_team = e.away_team AND s.event_id <> e.event_id AND abs(s.start_day - e.start_day) <= 5 GROUP BY e.event_id")
def j13_siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Other games of the same teams within five days, as an ordered array: a window of days, no pairs."""
    games = B.contests(spark, sf_dir).select("event_id", "home_team", "away_team", "start_day")
    near = Window.partitionBy("home_team", "away_team").orderBy("start_day").rangeBetween(-5, 5)
    found = F.array_sort(F.collect_list("event_id").over(near))
    return games.withColumn("found", found).select("event_id", F.array_remove("found", F.col("event_id")).alias("siblings"))


@query(
    B.cte("probables")
    + f""", l AS (SELECT seen_id, event_id, seen_at_us AS t FROM probables WHERE kind = 'signup'), r AS (SELECT seen_id AS id, event_id, seen_at_us AS h FROM probables WHERE kind = 'purchase'),
    n AS (SELECT l.seen_id, r.id, row_number() OVER (PARTITION BY l.seen_id ORDER BY abs(r.h - l.t), r.h, r.id) AS rn FROM l JOIN r ON r.event_id = l.event_id AND abs(r.h - l.t) <= {3 * HOUR})
    SELECT l.seen_id, n.id AS matched FROM l LEFT JOIN n ON n.seen_id = l.seen_id AND rn = 1"""
)
def j14_nearest_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest row of the same key within three hours, earlier one first at equal distance."""
    rows = B.entity(spark, sf_dir, "probables")
    left = rows.where("kind = 'signup'").select("seen_id", "event_id", F.col("seen_at_us").alias("t"))
    right = rows.where("kind = 'purchase'").select("event_id", F.col("seen_id").alias("matched"), F.col("seen_at_us").alias("h"))
    return asof.nearest(left, right, ["event_id"], "t", "h", 3 * HOUR, ["matched"], ["matched"]).select("seen_id", "matched")


@query("SELECT o_orderdate::DATE::VARCHAR AS day, count(*) AS orders, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45)) AS large FROM orders GROUP BY ALL")
def j16_exists_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EXISTS inside an aggregate's filter, as a flag from a distinct key set."""
    large = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("large", F.lit(True))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate").join(large, "o_orderkey", "left")
    return rows.groupBy(F.to_date("o_orderdate").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("orders"), F.count_if(F.coalesce("large", F.lit(False))).alias("large"))


@query("SELECT (SELECT count(*) FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')) AS with_open, (SELECT count(*) FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)) AS without_any, (SELECT count(*) FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey)) AS unsold")
def j17_j19_semi_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Semi- and anti-joins."""
    t = lambda n: table(spark, sf_dir, n)
    keyed = t("orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus")
    parts = [
        t("customer").join(keyed.where("o_orderstatus = 'P'"), "c_custkey", "left_semi").agg(F.count(F.lit(1)).alias("n"), F.lit("with_open").alias("k")),
        t("customer").join(keyed, "c_custkey", "left_anti").agg(F.count(F.lit(1)).alias("n"), F.lit("without_any").alias("k")),
        t("part").join(t("lineitem").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_anti").agg(F.count(F.lit(1)).alias("n"), F.lit("unsold").alias("k")),
    ]
    one = parts[0].unionAll(parts[1]).unionAll(parts[2])
    return one.agg(*[F.max(F.when(F.col("k") == k, F.col("n"))).alias(k) for k in ("with_open", "without_any", "unsold")])


@query("SELECT c_custkey, coalesce(u.prio, c_mktsegment) AS segment FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderpriority) AS prio FROM orders WHERE o_totalprice > 300000 GROUP BY o_custkey) u ON u.o_custkey = c_custkey")
def j20_update_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UPDATE ... FROM as a join with coalesce."""
    new = table(spark, sf_dir, "orders").where("o_totalprice > 300000").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderpriority").alias("segment"))
    return tables.update_from(table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment")), new, ["c_custkey"], ["segment"])


@query(
    """SELECT o_orderkey, c_name, cn.n_name AS customer_nation, cr.r_name AS customer_region, s_name, sn.n_name AS supplier_nation, p_brand, l_linenumber, quality, toxic
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation cn ON c_nationkey = cn.n_nationkey JOIN region cr ON cn.n_regionkey = cr.r_regionkey
      JOIN supplier ON l_suppkey = s_suppkey JOIN nation sn ON s_nationkey = sn.n_nationkey JOIN part ON l_partkey = p_partkey LEFT JOIN labels ON doc_id = o_orderkey WHERE o_totalprice > 450000"""
)
def j21_star_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit trail as one star join; the selective side first, dimensions of fixed size broadcast."""
    t = lambda n: table(spark, sf_dir, n)
    nation = t("nation").join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey"))
    cn = F.broadcast(nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("customer_nation"), F.col("r_name").alias("customer_region")))
    sn = F.broadcast(t("nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("supplier_nation")))
    rows = t("orders").where("o_totalprice > 450000").select("o_orderkey", "o_custkey").join(t("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey", "l_partkey", "l_linenumber"), "o_orderkey")
    rows = rows.join(t("customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_nationkey"), "o_custkey").join(cn, "c_nationkey")
    rows = rows.join(t("supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name", "s_nationkey"), "l_suppkey").join(sn, "s_nationkey")
    rows = rows.join(t("part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey").join(t("labels").select(F.col("doc_id").alias("o_orderkey"), "quality", "toxic"), "o_orderkey", "left")
    return rows.select("o_orderkey", "c_name", "customer_nation", "customer_region", "s_name", "supplier_nation", "p_brand", "l_linenumber", "quality", "toxic")


@query("WITH a AS (SELECT *, CASE n_name WHEN 'NATION_2' THEN 'NATION_9' WHEN 'NATION_7' THEN 'NATION_9' ELSE n_name END AS name FROM nation) SELECT name, count(*) AS customers FROM customer JOIN a ON c_nationkey = n_nationkey GROUP BY name")
def j24_alias_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names brought to their canonical form by a literal map before an equi-join."""
    named = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), histories.canonical_name(F.col("n_name"), {"NATION_2": "NATION_9", "NATION_7": "NATION_9"}).alias("name"))
    return table(spark, sf_dir, "customer").join(F.broadcast(named), "c_nationkey").groupBy("name").agg(F.count(F.lit(1)).alias("customers"))


@query(
    """SELECT user_id, count(*) AS n, count(*) FILTER (WHERE event_type = 'click') AS clicks, count(DISTINCT date_trunc('minute', ts)) AS minutes, round(avg(CAST(round(value * 100) AS BIGINT)) / 100, 4) AS mean,
      round(count(*) FILTER (WHERE event_type = 'error') / nullif(count(*) FILTER (WHERE event_type = 'view'), 0), 4) AS ratio, max(value) FILTER (WHERE event_id % 2 = 0) AS even_max, coalesce(list(event_id ORDER BY event_id) FILTER (WHERE value > 95), []) AS high FROM events GROUP BY user_id"""
)
def a4_a10_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filtered, conditional, distinct-instant aggregates, averages, ratios by NULLIF, ordered arrays."""
    c = F.col
    return table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(c("event_type") == "click").alias("clicks"), F.count_distinct(F.date_trunc("minute", "ts")).alias("minutes"), rounded(F.avg(F.round(c("value") * 100).cast("bigint")) / 100).alias("mean"),
        rounded(F.count_if(c("event_type") == "error") / F.nullif(F.count_if(c("event_type") == "view"), F.lit(0))).alias("ratio"), F.max(F.when(c("event_id") % 2 == 0, c("value"))).alias("even_max"), F.array_sort(F.collect_list(F.when(c("value") > 95, c("event_id")))).alias("high"))


@query("SELECT DISTINCT date_trunc('hour', ts)::VARCHAR AS hour, event_type FROM events")
def a7_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct truncated instants."""
    return table(spark, sf_dir, "events").select(F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH:mm:ss").alias("hour"), "event_type").distinct()


@query("SELECT DISTINCT ON (user_id) user_id, event_id, event_type FROM events ORDER BY user_id, ts DESC, event_id DESC")
def a8_distinct_on(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last row of each key; an aggregate, so partial results shrink before the shuffle."""
    last = F.max_by(F.struct("event_id", "event_type"), F.struct("ts", "event_id"))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(last.alias("l")).select("user_id", "l.event_id", "l.event_type")


@query("SELECT lang, round(avg(CASE WHEN quality IS NOT NULL AND toxic IS NOT NULL THEN 1.0 ELSE 0 END), 4) AS covered, count(*) AS n FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY lang")
def a17_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of rows on which both sides are known."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return rows.groupBy("lang").agg(rounded(coverage("quality", "toxic")).alias("covered"), F.count(F.lit(1)).alias("n"))


@query("SELECT event_type, count(*) AS n, count_if(value < 5) AS low, list(DISTINCT user_id ORDER BY user_id)[1:5] AS sample_users FROM events GROUP BY event_type")
def a24_a25_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters with a bounded sorted sample (distinct before collecting, so the array is of keys, not rows)."""
    e = table(spark, sf_dir, "events")
    users = e.select("event_type", "user_id").distinct().withColumn("part", F.pmod(F.hash("user_id"), F.lit(64)))  # the first five of each part, then of the parts
    users = asof.first_by(asof.first_by(users, ["event_type", "part"], ["user_id"], 5), ["event_type"], ["user_id"], 5).groupBy("event_type").agg(F.array_sort(F.collect_list("user_id")).alias("sample_users"))
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") < 5).alias("low")).join(users, "event_type")


@query(
    B.cte("odds")
    + _STARTS
    + f""", c AS (SELECT DISTINCT s.event_id, s.start_us, o.captured_at_us AS t FROM starts s LEFT JOIN odds o ON o.event_id = s.event_id AND o.captured_at_us BETWEEN s.start_us - {10 * HOUR} AND s.start_us - 1),
    g AS (SELECT event_id, start_us, t, lead(t, 1, start_us) OVER (PARTITION BY event_id ORDER BY t) AS nxt FROM c)
    SELECT event_id, coalesce(t, start_us - {10 * HOUR}) AS from_us, nxt AS to_us FROM g WHERE t IS NULL OR nxt - t > {2 * HOUR}"""
)
def w7_v7_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holes of over two hours between captures of the last ten hours, up to the start; no capture: one whole hole."""
    odds = B.entity(spark, sf_dir, "odds")
    captures = odds.select("event_id", F.col("captured_at_us").alias("at"))
    return audit.gaps(starts(odds), captures, ["event_id"], "start_us", "at", 10 * HOUR, 2 * HOUR).withColumnsRenamed({"from": "from_us", "to": "to_us"})


@query(
    B.cte("odds")
    + _STARTS
    + f""", runs AS (SELECT DISTINCT captured_at_us // 60000000 AS minute FROM odds), cap AS (SELECT s.event_id, s.start_us, count(o.snapshot_id) AS n FROM starts s LEFT JOIN odds o ON o.event_id = s.event_id AND o.book <> 'purchase' AND o.captured_at_us BETWEEN s.start_us - {HOUR} AND s.start_us GROUP BY ALL),
    al AS (SELECT DISTINCT c.event_id FROM cap c JOIN runs r ON r.minute BETWEEN (c.start_us - {HOUR}) // 60000000 AND c.start_us // 60000000 - 1)
    SELECT event_id, CASE WHEN n > 0 THEN 'priced' WHEN event_id IN (SELECT event_id FROM al) THEN 'unpriced' ELSE 'miss' END AS class FROM cap"""
)
def v7_capture_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event without captures is unpriced if some capture ran in its window, else a miss."""
    odds = B.entity(spark, sf_dir, "odds")
    captures = odds.where("book <> 'purchase'").select("event_id", F.col("captured_at_us").alias("at"))
    return audit.classes(starts(odds), captures, odds.select((F.expr("captured_at_us div 60000000") * 60000000).alias("run")), ["event_id"], "start_us", "at", HOUR)


@query(
    B.cte("odds")
    + _STARTS
    + f""", p AS (SELECT DISTINCT s.event_id FROM starts s JOIN odds o ON o.event_id = s.event_id AND o.book <> 'purchase' AND o.captured_at_us BETWEEN s.start_us - {10 * HOUR} AND s.start_us),
    e AS (SELECT DATE '1970-01-01' + CAST(start_us // {DAY} AS INTEGER) AS day, count(*) AS events, count_if(event_id IN (SELECT event_id FROM p)) AS events_with_pregame FROM starts GROUP BY 1),
    r AS (SELECT DATE '1970-01-01' + CAST(captured_at_us // {DAY} AS INTEGER) AS day, count(DISTINCT captured_at_us // 60000000) AS capture_runs, count(*) AS snapshot_rows FROM odds WHERE book <> 'purchase' GROUP BY 1)
    SELECT CAST(day AS VARCHAR) AS day, events, events_with_pregame, coalesce(capture_runs, 0) AS capture_runs, coalesce(snapshot_rows, 0) AS snapshot_rows FROM e LEFT JOIN r USING (day)"""
)
def a21_archive_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archive by day: events, those with a capture in their last ten hours, capture runs and rows."""
    odds = B.entity(spark, sf_dir, "odds")
    captures = odds.where("book <> 'purchase'").select("event_id", F.col("captured_at_us").alias("at"))
    return audit.days(starts(odds), captures, ["event_id"], "start_us", "at", 10 * HOUR).withColumn("day", F.col("day").cast("string"))


@query(
    """WITH o AS (SELECT o_orderkey AS pick_id, CASE o_orderkey % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'won' ELSE 'lost' END AS status, o_totalprice AS price, o_orderpriority AS book, CASE WHEN o_orderkey % 4 > 0 THEN o_custkey END AS odds_id FROM orders)
    SELECT pick_id, CASE WHEN pick_id % 10 = 1 THEN 'immutable' WHEN pick_id % 10 = 2 THEN 'deleted' WHEN pick_id % 3 > 0 AND pick_id % 10 = 3 THEN 'transition' ELSE 'ok' END AS verdict,
      'schedule=' || pick_id || CASE WHEN pick_id % 5 = 0 THEN ',odds=new' || pick_id WHEN odds_id IS NOT NULL THEN ',odds=' || odds_id ELSE '' END AS ids FROM o"""
)
def x13_x14_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Updates of an append-only table judged by their difference but for the status; external ids merged."""
    c, k = F.col, F.col("pick_id")
    text = lambda x: x.cast("string")
    state = F.when(k % 3 == 0, "pending").when(k % 3 == 1, "won").otherwise("lost")
    old = table(spark, sf_dir, "orders").select(c("o_orderkey").alias("pick_id"), c("o_totalprice").alias("price"), c("o_orderpriority").alias("book"), "o_custkey")
    ids = F.map_filter(F.create_map(F.lit("schedule"), text(k), F.lit("odds"), F.when(k % 4 > 0, text(c("o_custkey")))), lambda n, v: v.isNotNull())
    old = old.withColumns({"status": state, "ids": ids})
    said = F.when((k % 10 == 3) & (k % 3 > 0), "void").when((k % 3 == 0) & (k % 2 == 0), "won").otherwise(c("status"))
    new = old.where("pick_id % 10 <> 2").withColumn("price", c("price") + F.when(k % 10 == 1, 1).otherwise(0)).withColumn("status", said)
    judged = histories.guarded(old.drop("ids", "o_custkey"), new.drop("ids", "o_custkey"), "pick_id")
    given = F.create_map(F.lit("odds"), F.when(k % 5 == 0, F.concat(F.lit("new"), text(k))))
    shown = F.transform(F.array_sort(F.map_entries("ids")), lambda e: F.concat_ws("=", e["key"], e["value"]))
    merged = old.select("pick_id", histories.merged_ids(c("ids"), given).alias("ids")).select("pick_id", F.array_join(F.reverse(shown), ",").alias("ids"))
    return judged.join(merged, "pick_id")


@query(B.cte("contests") + ", p AS (SELECT event_id, start_us, home_team, CASE WHEN home_score > away_score THEN 0.9 ELSE -1.0 END AS u FROM contests WHERE status = 'final'), r AS (SELECT *, sum(CAST(u AS DECIMAL(10,1))) OVER (PARTITION BY home_team ORDER BY start_us, event_id) AS bank FROM p), d AS (SELECT *, greatest(0, max(bank) OVER (PARTITION BY home_team ORDER BY start_us, event_id)) AS peak FROM r) SELECT home_team, CAST(max(peak - bank) AS DOUBLE) AS max_drawdown, CAST(sum(CAST(u AS DECIMAL(10,1))) AS DOUBLE) AS units, count(*) AS n FROM d GROUP BY home_team")
def w8_drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest fall of a running sum from its peak, merged from monthly parts."""
    u = F.when(F.col("home_score") > F.col("away_score"), F.lit(9)).otherwise(F.lit(-10)).cast("bigint")
    rows = B.contests(spark, sf_dir).where("status = 'final'").select("home_team", "start_us", "event_id", u.alias("u"))
    n = rows.groupBy("home_team").agg(F.count(F.lit(1)).alias("n"))
    month = F.date_trunc("month", F.timestamp_micros("start_us"))
    found = metrics.drawdowns(rows, [["home_team"]], ["start_us", "event_id"], "u", month).select("home_team", (F.col("drawdown") / 10).alias("max_drawdown"), (F.col("units") / 10).alias("units"))
    return found.join(n, "home_team")


@query(B.cte("contests") + ", d AS (SELECT start_us, sum(CASE WHEN home_score > away_score THEN 1 ELSE 0 END) AS w, count(*) AS n FROM contests WHERE status = 'final' GROUP BY start_us), r AS (SELECT start_us, sum(w) OVER x AS w, sum(n) OVER x AS n FROM d WINDOW x AS (ORDER BY start_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT start_us, round(coalesce(w / nullif(n, 0), 0.5), 4) AS home_rate FROM r")
def w6_l6_home_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expanding home rate strictly before each instant; summed by instant first, so the one window is small."""
    games = B.contests(spark, sf_dir).where("status = 'final'")
    daily = games.groupBy("start_us").agg(F.sum((F.col("home_score") > F.col("away_score")).cast("bigint")).alias("w"), F.count(F.lit(1)).alias("n"))
    x = Window.partitionBy(F.lit(0)).orderBy("start_us").rowsBetween(Window.unboundedPreceding, -1)
    return daily.select("start_us", rounded(F.coalesce(F.sum("w").over(x) / F.sum("n").over(x), F.lit(0.5))).alias("home_rate"))


@query("WITH u AS (SELECT user_id, event_id, event_type, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id::VARCHAR) AS rn FROM events) SELECT user_id, event_type, event_id, value FROM u WHERE rn <= 3")
def w9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top three of each group, ties by the id as a string."""
    return asof.first_by(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], [F.desc("value"), F.col("event_id").cast("string")], 3)


@query("WITH p AS (SELECT o_orderkey AS doc, unnest(range(1, 5)) AS ord, o_custkey FROM orders), s AS (SELECT doc, ord, (o_custkey + ord * ord) % 3 AS slot FROM p) SELECT doc, slot, max(ord) AS last_listing FROM s GROUP BY ALL")
def w11_last_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of repeated listings the last one wins, by its place in the array."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc"), F.posexplode(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda o: (F.col("o_custkey") + o * o) % 3)).alias("pos", "slot"))
    return rows.groupBy("doc", "slot").agg((F.max("pos") + 1).alias("last_listing"))


@query(B.cte("probables") + ", w AS (SELECT event_id, seen_id, pitcher, lag(pitcher) OVER x AS p, row_number() OVER x AS rn FROM probables WHERE kind = 'purchase' WINDOW x AS (PARTITION BY event_id ORDER BY seen_at_us, seen_id)) SELECT event_id, seen_id, pitcher FROM w WHERE rn = 1 OR pitcher IS DISTINCT FROM p")
def u7_append_on_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only listings that change what was known are appended."""
    rows = B.entity(spark, sf_dir, "probables").where("kind = 'purchase'")
    return asof.changed(rows, ["event_id"], ["seen_at_us", "seen_id"], F.col("pitcher")).select("event_id", "seen_id", "pitcher")


@query(
    B.cte("probables")
    + f""", s AS (SELECT event_id, seen_at_us // {12 * HOUR} AS seen, list(DISTINCT kind ORDER BY kind) AS members FROM probables GROUP BY ALL),
    w AS (SELECT *, lag(members) OVER x AS p, row_number() OVER x AS rn FROM s WINDOW x AS (PARTITION BY event_id ORDER BY seen)) SELECT event_id, seen, members FROM w WHERE rn = 1 OR members IS DISTINCT FROM p"""
)
def u8_append_set_on_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U8, §2.9: snapshots are compared as sets and appended only on change."""
    snaps = B.entity(spark, sf_dir, "probables").groupBy("event_id", F.expr(f"seen_at_us div {12 * HOUR}").alias("seen")).agg(F.array_sort(F.collect_set("kind")).alias("members"))
    return asof.changed(snaps, ["event_id"], ["seen"], F.col("members"))


@query("WITH b AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events WHERE event_id % 3 = 0) SELECT user_id, event_type, event_id FROM b WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM events e WHERE e.event_id % 3 = 1 AND e.value > 60 AND e.user_id = b.user_id AND e.event_type = b.event_type)")
def u1_s10_insert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that an insert-or-ignore adds; the first of a key in the batch, none that exists."""
    e = table(spark, sf_dir, "events")
    return tables.insert_ignore(e.where("event_id % 3 = 1 and value > 60"), e.where("event_id % 3 = 0").select("user_id", "event_type", "event_id", "ts"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


@query(
    """WITH o AS (SELECT c_custkey AS k, c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS hand FROM customer WHERE c_custkey % 5 <> 0),
    b AS (SELECT o_custkey AS k, arg_max('New ' || o_orderstatus, o_orderkey) AS name, arg_max(CASE WHEN o_orderkey % 3 = 0 THEN 'R' ELSE '?' END, o_orderkey) AS hand FROM orders WHERE o_custkey % 3 = 0 GROUP BY o_custkey)
    SELECT k, coalesce(b.name, o.name) AS name, CASE WHEN b.hand = 'R' THEN 'R' ELSE o.hand END AS hand FROM o FULL JOIN b USING (k)"""
)
def u2_u6_latest_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upsert; the last row of the batch wins, an unknown hand never overwrites a known one."""
    old = table(spark, sf_dir, "customer").where("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("hand"))
    batch = table(spark, sf_dir, "orders").where("o_custkey % 3 = 0").select(F.col("o_custkey").alias("k"), F.concat(F.lit("New "), "o_orderstatus").alias("name"), F.when(F.col("o_orderkey") % 3 == 0, F.lit("R")).alias("hand"), "o_orderkey")
    return tables.latest_wins(old, batch, ["k"], [F.desc("o_orderkey")], keep_old=["hand"])


@query("WITH n AS (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY user_id), e AS (SELECT user_id, event_id FROM events WHERE event_type = 'view') SELECT user_id, event_id FROM e WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error') UNION ALL SELECT user_id, event_id FROM events WHERE event_type = 'error'")
def u5_force_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of the batch replaced whole, the others kept."""
    e = table(spark, sf_dir, "events")
    return tables.replace_groups(e.where("event_type = 'view'").select("user_id", "event_id"), e.where("event_type = 'error'").select("user_id", "event_id"), ["user_id"])


@query("SELECT n_nationkey, n_name FROM nation UNION ALL SELECT * FROM (VALUES (100, 'NOWHERE')) v(n_nationkey, n_name) WHERE n_nationkey NOT IN (SELECT n_nationkey FROM nation)")
def s14_seed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seed rows, added only where their key is missing."""
    rows = adopt(spark).createDataFrame([(100, "NOWHERE"), (1, "TAKEN")], "n_nationkey int, n_name string")
    return tables.seeded(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), rows, ["n_nationkey"])
