"""Registered queries and their SQL.

The supplied tables have no market feed; events stand in for a tape: event_id is the id, ts the receipt clock, user_id
the symbol or connection, event_type the topic, value the price and props.k the sequence.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapelake.functions import classify, extract, text
from tapelake.operators import admission, archive, backtest, candles, joins, normalize, operations, orderbook, paper, planning, quality, signals
from tapelake.operators import ordering
from tapelake.sources import tape

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = f(spark, sf_dir)
            return out.select(*[F.col(n).cast("timestamp_ntz").alias(n) if kind == "timestamp" else F.col(n) for n, kind in out.dtypes])

        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with k, the sequence in its properties."""
    return table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))


def chunk(name: str, rows: int = 1_000_000):
    """Parts of an id's range, so that a busy group is many tasks."""
    return F.floor(F.col(name) / rows)


def tape_of(df: DataFrame, kind: str | None = None) -> DataFrame:
    """events under the tape's names: id, received_at, exchange_at, symbol, event_type, value."""
    rows = df.where(F.col("event_type") == kind) if kind else df
    return rows.select(F.col("event_id").alias("id"), F.col("ts").alias("received_at"), F.col("ts").alias("exchange_at"), F.col("user_id").alias("symbol"), "event_type", "value", "k")


CANDLE_SQL = """SELECT {keys}, date_trunc('{unit}', ts) AS "timestamp", arg_min(value, event_id) AS open, max(value) AS high, min(value) AS low,
    arg_max(value, event_id) AS close, {volume} AS volume, count(*) AS trade_count FROM (SELECT *, {k} AS k FROM events) WHERE event_type = 'purchase' AND value > 0 GROUP BY ALL"""


@query(CANDLE_SQL.format(keys="user_id AS symbol", unit="hour", volume="sum(k)::DOUBLE", k=K))
def q_candles_hourly(spark, sf_dir):
    rows = tape_of(events(spark, sf_dir), "purchase")
    return candles.candles(rows, extract.finite_positive(F.col("value")), F.col("k").cast("double"), "hour")


@query(CANDLE_SQL.format(keys="event_type AS symbol", unit="day", volume="CASE WHEN count(*) FILTER (k >= 10) = count(*) THEN sum(k)::DOUBLE END", k=K))
def q_candle_null_volume(spark, sf_dir):
    rows = tape_of(events(spark, sf_dir), "purchase").withColumn("symbol", F.col("event_type"))
    return candles.candles(rows, extract.finite_positive(F.col("value")), F.when(F.col("k") >= 10, F.col("k").cast("double")), "day")


@query(f"""SELECT date_trunc('day', ts)::DATE::VARCHAR AS symbol, event_type, count(*) AS events, count(*) FILTER (k < 20) AS missing_exchange_time, count(*) FILTER (k >= 80) AS missing_sequence,
    round(avg(value), 6) AS avg_latency_ms, max(value) AS max_latency_ms FROM (SELECT *, {K} AS k FROM events) GROUP BY ALL""")
def q_daily_quality(spark, sf_dir):
    rows = events(spark, sf_dir).select(F.to_date("ts").cast("string").alias("symbol"), "event_type", F.when(F.col("k") >= 20, F.col("ts")).alias("exchange_at"), F.when(F.col("k") < 80, F.col("k")).alias("sequence"), F.col("value").alias("latency_ms"))
    return quality.daily_quality(rows).withColumn("avg_latency_ms", F.round("avg_latency_ms", 6))


@query("""WITH n AS (SELECT max(ts) AS now FROM events) SELECT count(*) AS events, min(ts) AS first_at, max(ts) AS last_at, count(*) FILTER (ts >= now - INTERVAL 86400 SECOND) AS recent_events,
    round(avg(value) FILTER (ts >= now - INTERVAL 86400 SECOND), 6) AS recent_latency_ms FROM events, n""")
def q_status(spark, sf_dir):
    rows = events(spark, sf_dir)
    now = rows.agg(F.max("ts").alias("now"))
    return quality.status(rows.crossJoin(F.broadcast(now)), "ts", F.col("now"), "value", 86_400).withColumn("recent_latency_ms", F.round("recent_latency_ms", 6))


@query("SELECT event_id, ts, user_id, value FROM events WHERE event_type IN ('purchase', 'view') AND ts >= TIMESTAMP '2024-01-02' ORDER BY ts, event_id LIMIT 1000")
def q_replay_scan(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumnsRenamed({"event_id": "id", "ts": "received_at"}).withColumn("received_at", F.col("received_at").cast("timestamp"))
    found = tape.replay(rows, 1000, start=datetime(2024, 1, 2, tzinfo=timezone.utc), types=["purchase", "view"])
    return found.select(F.col("id").alias("event_id"), F.col("received_at").alias("ts"), "user_id", "value")


@query("SELECT event_id, ts, event_type FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 50) ORDER BY ts, event_id")
def q_recent_topn(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "ts", "event_type").orderBy(F.desc("ts"), F.desc("event_id")).limit(50).orderBy("ts", "event_id")


@query("""SELECT user_id, count(*) AS events, coalesce(sum(CASE WHEN p > ts THEN 1 END), 0)::BIGINT AS disorder, round(coalesce(max(CASE WHEN p <= ts THEN epoch(ts) - epoch(p) END), 0), 3) AS largest_gap_s
    FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events) GROUP BY user_id""")
def q_receipt_gaps(spark, sf_dir):
    rows = ordering.previous(table(spark, sf_dir, "events").select("event_id", "user_id", "ts"), ["user_id"], ["event_id"], {"before": F.col("ts")})
    bad, gap = ordering.fell(F.col("before"), F.col("ts")), ordering.seconds_since(F.col("before"), F.col("ts"))
    return rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("events"), F.sum(bad).alias("disorder"), F.round(F.coalesce(F.max(gap), F.lit(0.0)), 3).alias("largest_gap_s"))


@query(f"""SELECT event_type, count(*) AS events, sum((p > x)::INT)::BIGINT AS disorder FROM (SELECT *, lag(x) OVER (PARTITION BY event_type ORDER BY event_id) AS p
    FROM (SELECT *, ts - to_minutes({K}) AS x FROM events) WHERE {K} % 9 <> 0) GROUP BY event_type""")
def q_exchange_order(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("x", F.when(F.col("k") % 9 != 0, F.expr("ts - make_interval(0, 0, 0, 0, 0, cast(k as int), 0)")))  # without an exchange time: left out
    rows = ordering.previous(rows.select("event_id", "event_type", "x"), ["event_type"], ["event_id"], {"before": F.col("x")}, chunk("event_id"))
    return rows.groupBy("event_type").agg(F.count("x").alias("events"), F.sum(ordering.fell(F.col("before"), F.col("x"))).alias("disorder"))


@query(f"""SELECT event_type, count(*) AS rows, sum((k % 10 <> 0 AND p IS NOT NULL AND k <> p + 1)::INT)::BIGINT AS anomalies
    FROM (SELECT *, lag(k) OVER (PARTITION BY event_type ORDER BY event_id) AS p FROM (SELECT *, {K} AS k FROM events) WHERE k IS NOT NULL) GROUP BY event_type""")
def q_sequence_anomalies(spark, sf_dir):
    rows = events(spark, sf_dir)
    found = ordering.sequence_anomalies(rows.select("event_id", "event_type", "k"), ["event_type"], ["event_id"], "k", F.col("k") % 10 == 0, chunk("event_id"))
    return found.groupBy("event_type").agg(F.count(F.lit(1)).alias("rows"), F.sum("anomaly").alias("anomalies"))


@query(f"""SELECT event_type, count(*) AS rows, count(s) AS with_sequence, CASE WHEN count(s) = 0 THEN 'absent' WHEN count(s) = count(*) THEN 'present' ELSE 'partial' END AS availability
    FROM (SELECT *, CASE WHEN event_type = 'purchase' THEN NULL WHEN event_type = 'view' AND {K} > 50 THEN NULL ELSE {K} END AS s FROM events) GROUP BY event_type""")
def q_sequence_availability(spark, sf_dir):
    t, k = F.col("event_type"), F.col("k")
    rows = events(spark, sf_dir).withColumn("s", F.when((t == "purchase") | ((t == "view") & (k > 50)), None).otherwise(k))
    return quality.sequence_availability(rows, ["event_type"], "s")


@query("""SELECT event_type, sum((abs(value / p - 1) * 100 >= 50)::INT)::BIGINT AS jumps FROM (SELECT *, lag(value) OVER (PARTITION BY event_type ORDER BY event_id) AS p FROM events WHERE value > 0) GROUP BY event_type""")
def q_price_jumps(spark, sf_dir):
    price = F.when(F.col("value") > 0, F.col("value"))  # rows without a valid price are left out
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", price.alias("price"))
    rows = ordering.previous(rows, ["event_type"], ["event_id"], {"before": F.col("price")}, chunk("event_id"))
    return rows.groupBy("event_type").agg(F.sum(ordering.jumped(F.col("before"), F.col("price"), 50)).alias("jumps"))


@query("SELECT sum(n - 1)::BIGINT AS duplicate_rows FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_suppkey, l_quantity, l_discount, l_returnflag)")
def q_exact_duplicates(spark, sf_dir):
    return quality.exact_duplicates(table(spark, sf_dir, "lineitem").select("l_suppkey", "l_quantity", "l_discount", "l_returnflag"))


@query("SELECT count(*) AS duplicate_groups, coalesce(sum(n - 1), 0)::BIGINT AS extra_rows FROM (SELECT count(*) AS n FROM events WHERE event_type IS NOT NULL AND user_id IS NOT NULL GROUP BY event_type, user_id, date_trunc('day', ts) HAVING count(*) > 1)")
def q_logical_duplicates(spark, sf_dir):
    return quality.logical_duplicates(table(spark, sf_dir, "events"), F.col("event_type"), F.col("user_id"), F.date_trunc("day", "ts"))


@query("""WITH b AS (SELECT max(ts) AS e FROM events), c AS (SELECT count(*) FILTER (ts >= e - INTERVAL 2 DAY AND ts < e - INTERVAL 1 DAY) AS previous_half_count, count(*) FILTER (ts >= e - INTERVAL 1 DAY AND ts <= e) AS current_half_count FROM events, b)
    SELECT *, CASE WHEN current_half_count < 30 OR previous_half_count < 30 THEN 'unknown' WHEN current_half_count < 0.5 * previous_half_count THEN 'low' WHEN current_half_count > 2 * previous_half_count THEN 'high' ELSE 'normal' END AS rate_state FROM c""")
def q_rate_halves(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    both = rows.crossJoin(F.broadcast(rows.agg(F.max("ts").alias("e"))))
    return quality.half_counts(both, "ts", F.expr("e - INTERVAL 2 DAYS"), F.expr("e - INTERVAL 1 DAY"), F.col("e"))


@query("""WITH b AS (SELECT max(ts) - INTERVAL 1 HOUR AS now FROM events) SELECT event_type, count(*) FILTER (ts > now + INTERVAL 5 MINUTE OR event_type IS NULL OR user_id IS NULL OR coalesce(value - 5 < 0, FALSE)) AS malformed FROM events, b GROUP BY event_type""")
def q_malformed(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    both = rows.crossJoin(F.broadcast(rows.agg((F.max("ts") - F.expr("INTERVAL 1 HOUR")).alias("now")))).withColumn("lat", F.col("value") - 5)
    return both.groupBy("event_type").agg(F.count_if(quality.malformed(F.col("now"), "ts", ["event_type", "user_id"], "lat")).alias("malformed"))


REPORT_SQL = f"""WITH e AS (SELECT event_id, 'd' || user_id % 8 AS dataset, event_type AS topic, ts AS r, {K} AS k, CASE WHEN {K} % 6 <> 0 THEN ts - to_seconds({K} % 9) END AS x, CASE WHEN {K} % 5 <> 0 THEN event_id // 3 END AS q,
        {K} % 10 = 1 AS snap, CASE WHEN {K} % 7 <> 0 AND value > 0 THEN value END AS p, {K} % 7 <> 0 OR {K} % 2 = 0 AS priced, event_type = 'purchase' AS traded FROM events),
    b AS (SELECT min(ts) + INTERVAL 2 SECOND AS s, max(ts) AS t FROM events),
    ro AS (SELECT *, lag(r) OVER w AS pr FROM e WINDOW w AS (PARTITION BY dataset ORDER BY event_id)),
    r1 AS (SELECT dataset, count(*) AS row_count, min(r) AS first_at, max(r) AS last_at, min(x) AS first_exchange_at, max(x) AS last_exchange_at, count(*) FILTER (CASE WHEN priced THEN p IS NULL ELSE traded END) AS invalid_prices,
        coalesce(sum((pr > r)::INT), 0)::BIGINT AS receipt_order, count(*) FILTER (r < s OR r >= t) AS receipt_range, count(*) FILTER (x < s - INTERVAL 5 SECOND OR x >= t + INTERVAL 5 SECOND) AS exchange_range,
        count(*) FILTER ((x < s AND x >= s - INTERVAL 5 SECOND) OR (x >= t AND x < t + INTERVAL 5 SECOND)) AS excursions, round(coalesce(max(CASE WHEN pr <= r THEN epoch(r) - epoch(pr) END), 0), 3) AS largest_gap_s, count(q) AS known FROM ro, b GROUP BY dataset),
    xo AS (SELECT dataset, coalesce(sum((px > x)::INT), 0)::BIGINT AS exchange_order FROM (SELECT *, lag(x) OVER (PARTITION BY dataset, topic ORDER BY event_id) AS px FROM e WHERE x IS NOT NULL) GROUP BY dataset),
    so AS (SELECT dataset, sum((NOT snap AND pq IS NOT NULL AND q <> pq + 1)::INT)::BIGINT AS n FROM (SELECT *, lag(q) OVER (PARTITION BY dataset, topic ORDER BY event_id) AS pq FROM e WHERE q IS NOT NULL) GROUP BY dataset),
    jo AS (SELECT dataset, coalesce(sum((abs(p / pp - 1) * 100 >= 20)::INT), 0)::BIGINT AS jumps FROM (SELECT *, lag(p) OVER (PARTITION BY dataset ORDER BY event_id) AS pp FROM e WHERE p IS NOT NULL) GROUP BY dataset),
    st AS (SELECT dataset, count(*) FILTER (0 < h AND h < n)::INT AS partial_streams FROM (SELECT dataset, topic, count(*) AS n, count(q) AS h FROM e GROUP BY ALL) GROUP BY dataset),
    f AS (SELECT dataset, row_count, first_at, last_at, first_exchange_at, last_exchange_at, invalid_prices, receipt_order, exchange_order, receipt_range, exchange_range, excursions, CASE WHEN known > 0 THEN coalesce(so.n, 0) END AS sequence_anomalies, largest_gap_s, coalesce(jumps, 0) AS jumps,
        0::BIGINT AS duplicates, partial_streams FROM r1 LEFT JOIN xo USING (dataset) LEFT JOIN so USING (dataset) LEFT JOIN jo USING (dataset) LEFT JOIN st USING (dataset))
    SELECT *, CASE WHEN receipt_order + exchange_order + receipt_range + exchange_range > 0 THEN 'rejected' WHEN invalid_prices + sequence_anomalies + jumps > 0 OR largest_gap_s > 60 OR partial_streams > 0 THEN 'warning' ELSE 'pass' END AS status FROM f"""


@query(REPORT_SQL)
def q_quality_report(spark, sf_dir):
    k = F.col("k")
    rows = events(spark, sf_dir)
    rows = rows.crossJoin(F.broadcast(rows.agg((F.min("ts") + F.expr("INTERVAL 2 SECONDS")).alias("s"), F.max("ts").alias("t"))))
    rows = rows.select(
        "event_id", F.concat(F.lit("d"), F.col("user_id") % 8).alias("dataset"), F.lit("s").alias("source"), F.col("event_type").alias("topic"), F.col("ts").alias("received_at"), "k", "value", "s", "t",
        F.when(k % 6 != 0, F.expr("ts - make_interval(0, 0, 0, 0, 0, 0, k % 9)")).alias("exchange_at"), F.when(k % 5 != 0, F.floor(F.col("event_id") / 3)).alias("sequence"),
    )
    price = F.when((k % 7 != 0) & (F.col("value") > 0), F.col("value"))
    out = quality.report(rows, ["event_id"], by=("dataset",), start=F.col("s"), end=F.col("t"), snapshot=k % 10 == 1, price=price, priced=(k % 7 != 0) | (k % 2 == 0), traded=F.col("topic") == "purchase", chunk=chunk("event_id"))
    return out.drop("sequence_availability", "findings").withColumns({"largest_gap_s": F.round("largest_gap_s", 3), "partial_streams": F.size("partial_streams")})


@query(f"""WITH p AS (SELECT *, avg(value) OVER w AS m, count(value) OVER w AS n FROM events WHERE event_type = 'view' AND value > 0 WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
    s AS (SELECT *, CASE WHEN (value / m - 1) * 10000 >= 5000 THEN 1 WHEN (value / m - 1) * 10000 <= -5000 THEN -1 ELSE 0 END AS state FROM p WHERE n = 5),
    e AS (SELECT *, lag(state, 1, 0) OVER (PARTITION BY user_id ORDER BY event_id) AS was FROM s) SELECT user_id, event_id, state, round((value / m - 1) * 10000, 6) AS momentum_bps FROM e WHERE state <> 0 AND state <> was""")
def q_momentum_signals(spark, sf_dir):
    rows = table(spark, sf_dir, "events").where("event_type = 'view' AND value > 0")
    found = signals.edges(signals.momentum(rows, ["user_id"], ["event_id"], "value", 5, 5000), ["user_id"], ["event_id"])
    return found.select("user_id", "event_id", "state", F.round("momentum_bps", 6).alias("momentum_bps"))


@query(ORACLES["q_momentum_signals"].replace("SELECT user_id, event_id, state, round((value / m - 1) * 10000, 6) AS momentum_bps FROM e WHERE state <> 0 AND state <> was", """, g AS (SELECT * FROM e WHERE state <> 0 AND state <> was),
    l AS (SELECT user_id, max(ts) AS last_at, arg_max(value, event_id) AS last_price FROM events WHERE event_type = 'view' AND value > 0 GROUP BY user_id),
    c AS (SELECT g.user_id, g.state, g.value, coalesce(lead(g.ts) OVER o, CASE WHEN last_at > g.ts THEN last_at END) AS x, coalesce(lead(g.value) OVER o, last_price) AS xp FROM g JOIN l USING (user_id) WINDOW o AS (PARTITION BY g.user_id ORDER BY event_id)),
    r AS (SELECT user_id, state * (xp / value - 1) AS r FROM c WHERE x IS NOT NULL)
    SELECT user_id, count(*) AS trades, round(sum(r * 1000), 6) AS pnl, round(avg((r > 0)::INT), 6) AS win_rate, round(avg(r), 9) AS mean_return, round(CASE WHEN count(*) > 1 AND stddev_pop(r) > 0 THEN avg(r) / stddev_pop(r) * sqrt(count(*)) ELSE 0 END, 6) AS sharpe FROM r GROUP BY user_id"""))
def q_momentum_trades(spark, sf_dir):
    rows = table(spark, sf_dir, "events").where("event_type = 'view' AND value > 0")
    found = signals.edges(signals.momentum(rows, ["user_id"], ["event_id"], "value", 5, 5000), ["user_id"], ["event_id"])
    last = rows.groupBy("user_id").agg(F.max("ts").alias("last_at"), F.max_by("value", "event_id").alias("last_price"))
    stats = signals.statistics(signals.paired(found, last, ["user_id"], ["event_id"], "ts", "value"), ["user_id"])
    return stats.select("user_id", "trades", *[F.round(c, d).alias(c) for c, d in (("pnl", 6), ("win_rate", 6), ("mean_return", 9), ("sharpe", 6))])


@query("""SELECT user_id, event_id, round((f / s - 1) * 10000, 6) AS edge_bps FROM (SELECT *, avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS f, avg(value) OVER w AS s, count(value) OVER w AS n
    FROM events WHERE value > 0 WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)) WHERE n = 10""")
def q_fast_slow_ma(spark, sf_dir):
    rows = table(spark, sf_dir, "events").where("value > 0")
    return signals.moving_averages(rows, ["user_id"], ["event_id"], "value", 3, 10).where("edge_bps IS NOT NULL").select("user_id", "event_id", F.round("edge_bps", 6).alias("edge_bps"))


@query("""WITH e AS (SELECT user_id, event_id, sum(value - 50) OVER (PARTITION BY user_id ORDER BY event_id) AS q FROM events WHERE event_type = 'purchase'),
    p AS (SELECT user_id, greatest(0, max(q) OVER (PARTITION BY user_id ORDER BY event_id)) - q AS d FROM e) SELECT user_id, round(max(d), 6) AS maximum_drawdown FROM p GROUP BY user_id""")
def q_drawdown(spark, sf_dir):
    rows = table(spark, sf_dir, "events").where("event_type = 'purchase'").withColumn("r", F.col("value") - 50)
    return signals.drawdown(rows, ["user_id"], ["event_id"], "r").withColumn("maximum_drawdown", F.round("maximum_drawdown", 6))


@query("""SELECT o_orderkey, round(g, 6) AS gross_pnl, round(f, 6) AS fees, round(u, 6) AS funding, round(s, 6) AS slippage_and_latency, round(g - f - u - s, 6) AS net_pnl FROM (SELECT o_orderkey, 1000 / o_totalprice * (o_totalprice * 1.01 - o_totalprice) AS g,
    (1000 + 1000 / o_totalprice * (o_totalprice * 1.01)) * 0.001 AS f, 1000 * 0.001 * 3600 / 28800 AS u, (1000 + 1000 / o_totalprice * (o_totalprice * 1.01)) * 2 / 10000 AS s FROM orders WHERE o_totalprice > 0)""")
def q_trade_costs(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").where("o_totalprice > 0")
    p = F.col("o_totalprice")
    costs = signals.trade_costs(F.lit(1), p, p * 1.01, F.lit(3600.0), 1000.0, 0.001, 0.001, 1.0, 1.0)
    return rows.select("o_orderkey", *[F.round(x, 6).alias(n) for n, x in costs.items()])


WALK_SQL = """h AS (SELECT {series} AS series, date_trunc('hour', ts) AS t, arg_max(value, event_id) AS close FROM events WHERE value > 0 {only} GROUP BY ALL),
    r AS (SELECT series, t, epoch(t) AS sec, close, row_number() OVER w AS place, lag(close, 3) OVER w AS old, lead(epoch(t)) OVER w AS run_at, lead(close) OVER w AS run_price FROM h WINDOW w AS (PARTITION BY series ORDER BY t)),
    b AS (SELECT *, (close / old - 1) * 10000 AS bps FROM r), m AS (SELECT * FROM b WHERE old IS NOT NULL AND abs(bps) >= 1000 AND run_at IS NOT NULL),
    x AS (SELECT m.*, o.sec AS out_at, o.place AS out_place, o.close AS out_price FROM m ASOF LEFT JOIN b o ON m.series = o.series AND o.sec >= m.run_at + 7200),
    n AS (SELECT x.*, f.place AS next FROM x ASOF LEFT JOIN m f ON x.series = f.series AND f.sec >= x.out_at + 3600),
    k AS (SELECT series, place, next FROM n QUALIFY row_number() OVER (PARTITION BY series ORDER BY place) = 1 UNION ALL SELECT n.series, n.place, n.next FROM k JOIN n ON n.series = k.series AND n.place = k.next),
    l AS (SELECT series, max(place) AS last_place, max(sec) AS last_at, arg_max(close, place) AS last_close FROM b GROUP BY series),
    s AS (SELECT n.*, CASE WHEN bps > 0 THEN 1 ELSE -1 END AS direction, last_at, last_close, out_place IS NOT NULL OR last_at > run_at AS done FROM n JOIN k ON n.series = k.series AND n.place = k.place JOIN l ON n.series = l.series)"""
HOW = backtest.Baseline(lookback=3, delay=1, threshold_bps=1000, holding_s=7200, cooldown_s=3600)


def _bars(spark, sf_dir, kind=None):
    rows = tape_of(events(spark, sf_dir), kind).withColumn("symbol", F.col("event_type"))
    return candles.candles(rows, extract.finite_positive(F.col("value")), F.col("k").cast("double"), "hour")


@query("WITH RECURSIVE " + WALK_SQL.format(series="event_type", only="AND event_type = 'purchase'") + """,
    c AS (SELECT *, direction * (1000 / run_price) * (coalesce(out_price, last_close) - run_price) AS gross, (1000 + 1000 / run_price * coalesce(out_price, last_close)) AS turned, coalesce(out_at, last_at) - run_at AS held, coalesce(out_at, last_at) AS e FROM s),
    d AS (SELECT *, turned * 0.0005 AS fee, 1000 * 0.0001 * greatest(0, held) / 28800 AS fund, turned / 10000 + turned * 0.5 / 10000 AS slip FROM c), p AS (SELECT *, gross - fee - fund - slip AS net FROM d),
    q AS (SELECT *, sum(net) OVER (PARTITION BY series, done ORDER BY e) AS eq FROM p), u AS (SELECT *, greatest(0, max(eq) OVER (PARTITION BY series, done ORDER BY e)) - eq AS fall FROM q)
    SELECT series, count(*) AS signals, round(sum(gross) FILTER (done), 6) AS gross_pnl, round(sum(fee) FILTER (done), 6) AS fees, round(sum(fund) FILTER (done), 6) AS funding, round(sum(slip) FILTER (done), 6) AS slippage_and_latency, round(sum(net) FILTER (done), 6) AS net_pnl,
        round(avg((net > 0)::INT) FILTER (done), 6) AS win_rate, round(avg(held) FILTER (done), 6) AS average_holding_s, count(*) FILTER (done) AS exits, round(max(fall) FILTER (done), 6) AS maximum_drawdown FROM u GROUP BY series""")
def q_backtest(spark, sf_dir):
    out = backtest.report(backtest.outcomes(_bars(spark, sf_dir, "purchase"), "symbol", "timestamp", "close", HOW), HOW)
    return out.select(*[F.round(n, 6).alias(n) if kind == "double" else F.col(n) for n, kind in out.dtypes])


@query("WITH RECURSIVE " + WALK_SQL.format(series="event_type", only="") + """,
    g AS (SELECT b.*, s.place AS own, last_value(s.place IGNORE NULLS) OVER w AS lp, last_value(CASE WHEN s.place IS NOT NULL THEN coalesce(s.out_place, 1000000000) END IGNORE NULLS) OVER w AS op, last_value(CASE WHEN s.place IS NOT NULL THEN coalesce(s.out_at, 1e18) END IGNORE NULLS) OVER w AS oa
        FROM b LEFT JOIN s ON b.series = s.series AND b.place = s.place WINDOW w AS (PARTITION BY b.series ORDER BY b.place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    z AS (SELECT series, CASE WHEN own IS NOT NULL THEN 'signal' WHEN lp IS NOT NULL AND place < op THEN 'position_open' WHEN old IS NULL THEN 'insufficient_history' WHEN sec - oa < 3600 THEN 'cooldown' WHEN abs(bps) < 1000 THEN 'below_threshold' ELSE 'execution_delay_out_of_range' END AS outcome FROM g
        UNION ALL SELECT series, CASE WHEN done THEN 'trade' ELSE 'unclosed_at_end' END FROM s)
    SELECT series, outcome, count(*) AS "count" FROM z GROUP BY ALL""")
def q_backtest_skips(spark, sf_dir):
    return backtest.outcomes(_bars(spark, sf_dir), "symbol", "timestamp", "close", HOW).groupBy("series", "outcome").count()


ASOF_SQL = """WITH l AS (SELECT event_id, user_id, ts, value FROM events WHERE event_type = 'purchase'), r AS (SELECT event_id AS rid, user_id, ts AS matched_at, value AS quote FROM events WHERE event_type = 'view')
    SELECT l.event_id, l.user_id, l.ts, matched_at, quote{more} FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.matched_at"""


def _asof(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    left = rows.where("event_type = 'purchase'").select("event_id", "user_id", "ts", "value")
    right = rows.where("event_type = 'view'").select("event_id", "user_id", "ts", F.col("value").alias("quote"))
    return joins.asof(left, right, "user_id", "ts", ["quote"], "event_id")


@query(ASOF_SQL.format(more=""))
def q_asof_quote(spark, sf_dir):
    return _asof(spark, sf_dir).select("event_id", "user_id", "ts", "matched_at", "quote")


@query(ASOF_SQL.format(more=", CASE WHEN quote IS NULL OR epoch(l.ts) - epoch(matched_at) > 600 THEN 'not_comparable' WHEN round(value) = round(quote) THEN 'match' ELSE 'mismatch' END AS verdict"))
def q_book_vs_quote(spark, sf_dir):
    seconds = F.col("ts").cast("timestamp").cast("double") - F.col("matched_at").cast("timestamp").cast("double")
    value, quote = F.round("value"), F.round("quote")
    return _asof(spark, sf_dir).select("event_id", "user_id", "ts", "matched_at", "quote", classify.book_match(seconds, value, value, quote, quote, 600).alias("verdict"))


PLAN_SQL = """b AS (SELECT date_trunc('day', min(ts)) AS s, date_trunc('day', max(ts)) + INTERVAL 1 DAY AS e FROM events), g AS (SELECT unnest(generate_series(s, e - INTERVAL 1 HOUR, INTERVAL 1 HOUR)) AS window_start FROM b),
    c AS (SELECT date_trunc('hour', ts) AS h, count(*) AS n, count(*) FILTER (event_type = 'purchase') AS t FROM events GROUP BY 1),
    p AS (SELECT window_start, window_start + INTERVAL 1 HOUR AS window_end, coalesce(n, 0) AS expected_event_count, coalesce(t, 0) AS expected_trade_count, (row_number() OVER (ORDER BY window_start) - 1)::INT AS "index" FROM g LEFT JOIN c ON h = window_start)"""


def _plan(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    bounds = rows.agg(F.date_trunc("day", F.min("ts")).alias("start"), (F.date_trunc("day", F.max("ts")) + F.expr("INTERVAL 1 DAY")).alias("end"))
    return planning.window_plan(bounds, rows, "ts", "1 HOUR", "hour", F.col("event_type") == "purchase")


@query(f"WITH {PLAN_SQL} SELECT * FROM p")
def q_window_plan(spark, sf_dir):
    return _plan(spark, sf_dir)


@query(f"""WITH {PLAN_SQL}, q AS (SELECT *, CASE WHEN "index" % 7 = 3 THEN 'completed_quarantined' WHEN "index" % 5 = 1 THEN 'skipped_verified' ELSE 'completed_admissible' END AS status, lead(window_start) OVER (ORDER BY "index") AS nx FROM p)
    SELECT TRUE AS all_storage_complete, bool_and(coalesce(nx = window_end, TRUE)) AS boundary_continuity, FALSE AS failed_storage, bool_or(status = 'completed_quarantined') AS has_quarantined, TRUE AS checksums_valid, sum(expected_event_count)::BIGINT AS storage_event_total,
    sum(expected_event_count) FILTER (status <> 'completed_quarantined')::BIGINT AS admissible_event_total, sum(expected_event_count) FILTER (status = 'completed_quarantined')::BIGINT AS quarantined_event_total, sum(expected_event_count)::BIGINT AS range_expected_event_count, TRUE AS unique_dataset_ids,
    bool_and(coalesce(nx = window_end, TRUE)) AS storage_coverage_continuous, FALSE AS admissible_coverage_continuous, 'pass' AS status FROM q""")
def q_reconcile(spark, sf_dir):
    plan = _plan(spark, sf_dir).withColumn("dataset_id", F.concat(F.lit("d"), F.col("index")))
    i = F.col("index")
    progress = plan.select("index", F.when(i % 7 == 3, "completed_quarantined").when(i % 5 == 1, "skipped_verified").otherwise("completed_admissible").alias("status"), F.col("expected_event_count").alias("event_count"), F.col("expected_trade_count").alias("trade_count"), F.lit(True).alias("checksums_ok"))
    return planning.reconcile(plan, progress)


@query("SELECT c AS o_custkey, count(DISTINCT d) AS covered_days FROM (SELECT o_custkey AS c, unnest(generate_series(o_orderdate::DATE, (o_orderdate + to_days((o_orderkey % 5 + 1)::INT) - INTERVAL 1 MICROSECOND)::DATE, INTERVAL 1 DAY)) AS d FROM orders) GROUP BY c")
def q_covered_days(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderdate").alias("start"), F.expr("o_orderdate + make_interval(0, 0, 0, cast(o_orderkey % 5 + 1 as int))").alias("end"))
    return admission.covered_days(rows, ["o_custkey"])


@query("""WITH d AS (SELECT date_trunc('month', o_orderdate) AS start, count(*) AS trades, round(sum(o_totalprice), 2) AS net_pnl FROM orders GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY start) AS p, count(*) OVER () AS n FROM d)
    SELECT CASE WHEN p > n - 2 THEN 'out_of_sample' WHEN p > n - 3 THEN 'validation' ELSE 'training' END AS split, count(*) AS datasets, sum(trades)::BIGINT AS trades, round(sum(net_pnl), 2) AS net_pnl FROM r GROUP BY 1""")
def q_split_oos(spark, sf_dir):
    months = table(spark, sf_dir, "orders").groupBy(F.date_trunc("month", "o_orderdate").alias("start")).agg(F.count(F.lit(1)).alias("trades"), F.round(F.sum("o_totalprice"), 2).alias("net_pnl")).withColumn("dataset_id", F.col("start").cast("string"))
    return admission.split(months).groupBy("split").agg(F.count(F.lit(1)).alias("datasets"), F.sum("trades").alias("trades"), F.round(F.sum("net_pnl"), 2).alias("net_pnl"))


@query("""WITH d AS (SELECT date_trunc('day', ts) AS s, count(*) AS n FROM events GROUP BY 1), c AS (SELECT *, lag(s + INTERVAL 1 DAY) OVER (ORDER BY s) AS p FROM d WHERE n % 7 <> 0 AND s + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 3 DAY)
    SELECT count(*) AS days, coalesce(sum(n), 0)::BIGINT AS eligible_rows, coalesce(bool_or(p <> s), FALSE) AS has_gap, CASE WHEN coalesce(bool_or(p <> s), FALSE) THEN 'gap' WHEN count(*) > 0 THEN 'eligible' ELSE 'nothing_eligible' END AS state FROM c""")
def q_retention_plan(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    days = rows.groupBy(F.date_trunc("day", "ts").alias("start")).agg(F.count(F.lit(1)).alias("row_count")).withColumn("end", F.col("start") + F.expr("INTERVAL 1 DAY"))
    days = days.withColumn("status", F.when(F.col("row_count") % 7 != 0, "verified").otherwise("pending")).withColumn("destination", F.lit("s3")).withColumn("dataset_group", F.lit("raw_and_normalized"))
    days = days.crossJoin(F.broadcast(rows.agg((F.max("ts") - F.expr("INTERVAL 3 DAYS")).alias("cutoff"))))
    return planning.retention_summary(planning.retention(days, F.col("cutoff")))


@query("""SELECT s_suppkey, CASE WHEN 600 * 1048576.0 * 3 > u OR floor(u / (600 * 1048576.0)) < 3 OR f <= 4294967296 THEN 'blocked' WHEN u / (800 * 1048576.0) <= 7 THEN 'warning' ELSE 'safe' END AS state
    FROM (SELECT s_suppkey, f, greatest(f - 3221225472, 0) AS u FROM (SELECT s_suppkey, (abs(s_acctbal) * 1500000)::BIGINT AS f FROM supplier))""")
def q_capacity(spark, sf_dir):
    free = F.round(F.abs("s_acctbal") * 1_500_000).cast("bigint")
    return table(spark, sf_dir, "supplier").select("s_suppkey", classify.capacity_plan(free, F.lit(600.0), F.lit(0.0), F.lit(200.0), F.lit(3), F.lit(0), F.lit(False)).alias("state"))


@query(f"SELECT event_id, {K} AS sequence, CASE WHEN {K} > 0 THEN {K}::DOUBLE END AS number FROM events")
def q_json_extract(spark, sf_dir):
    v = F.col("v")
    rows = table(spark, sf_dir, "events").withColumn("v", F.try_parse_json(F.replace(F.col("props"), F.lit('"k"'), F.lit('"seq"'))))
    return rows.select("event_id", extract.sequence(v).alias("sequence"), extract.payload_number(v, ("seq",)).alias("number"))


@query("SELECT event_id, date_trunc('second', ts) AS at FROM events")
def q_epoch_magnitude(spark, sf_dir):
    seconds = F.floor(F.col("ts").cast("timestamp").cast("double"))
    scaled = F.element_at(F.array(F.lit(1.0), F.lit(1e3), F.lit(1e6), F.lit(1e9)), (F.col("event_id") % 4 + 1).cast("int")) * seconds
    return table(spark, sf_dir, "events").select("event_id", F.timestamp_micros(extract.epoch_micros(scaled.cast("double"))).alias("at"))


@query(f"""SELECT code AS error_code, count(*) AS events FROM (SELECT CASE WHEN event_type NOT IN ('view', 'click', 'purchase') THEN 'unsupported_event_type' WHEN {K} % 11 = 0 THEN 'identity_mismatch' WHEN {K} % 7 = 0 THEN 'invalid_decimal' WHEN {K} % 5 = 0 THEN 'impossible_value' ELSE 'ok' END AS code FROM events) GROUP BY code""")
def q_normalize_route(spark, sf_dir):
    k, t = F.col("k"), F.col("event_type")
    topic = F.when(t.isin("view", "click", "purchase"), "mark_price").otherwise(t)
    price = F.when(k % 7 == 0, F.lit("12")).when(k % 5 == 0, F.lit('"0"')).otherwise(F.lit('"101.5"'))
    body = F.concat(F.lit('{"topic":"mark_price","symbol":"'), F.when(k % 11 == 0, F.lit("other")).otherwise(F.col("user_id").cast("string")), F.lit('","data":{"markPrice":'), price, F.lit("}}"))
    rows = events(spark, sf_dir).select(
        F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("received_at"), F.lit(None).cast("timestamp").alias("exchange_at"), F.lit("x").alias("source"), topic.alias("event_type"), F.col("user_id").cast("string").alias("symbol"),
        F.lit(None).cast("string").alias("connection_id"), F.lit(None).cast("long").alias("local_sequence"), F.lit(None).cast("long").alias("exchange_sequence"), F.lit(2).cast("short").alias("schema_version"), body.alias("payload"),
    )
    return normalize.checked(rows).groupBy(F.coalesce("error_code", F.lit("ok")).alias("error_code")).agg(F.count(F.lit(1)).alias("events"))


@query("SELECT o_orderkey, o_custkey FROM orders o WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0)")
def q_idempotent_insert(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return joins.new_rows(rows.union(rows), rows.where("o_orderkey % 3 = 0"), ["o_orderkey"])


@query("""WITH t AS (SELECT l_orderkey AS r, l_linenumber AS n, l_extendedprice - l_tax AS net, l_extendedprice - CASE WHEN l_partkey % 50 = 0 THEN l_tax + 1 ELSE l_tax END AS want, l_shipdate AS entry_at, l_shipdate + to_hours(l_linenumber) AS exit_at FROM lineitem),
    c AS (SELECT r, net, abs(net - want) > 0.01 OR exit_at < entry_at OR coalesce(lag(exit_at) OVER (PARTITION BY r ORDER BY entry_at, n) > entry_at, FALSE) AS bad FROM t), s AS (SELECT r, sum(net) AS net, bool_or(bad) AS bad FROM c GROUP BY r)
    SELECT o_orderkey FROM orders LEFT JOIN s ON r = o_orderkey WHERE coalesce(bad, FALSE) OR abs(coalesce(net, 0) - CASE WHEN o_orderkey % 10 = 0 THEN 0 ELSE coalesce(net, 0) END) > 0.01""")
def q_trade_consistency(spark, sf_dir):
    zero = F.lit(0.0)
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("trade_id"), (F.col("l_extendedprice") - F.col("l_tax")).alias("net_pnl"), F.col("l_extendedprice").alias("gross_pnl"),
        (F.col("l_tax") + F.when(F.col("l_partkey") % 50 == 0, 1.0).otherwise(0.0)).alias("fees"), zero.alias("funding"), zero.alias("slippage_and_latency"), F.col("l_shipdate").alias("entry_at"), F.expr("l_shipdate + make_interval(0, 0, 0, 0, l_linenumber)").alias("exit_at"),
    )
    sums = rows.groupBy("o_orderkey").agg(F.sum("net_pnl").alias("net_pnl"))
    headers = table(spark, sf_dir, "orders").select("o_orderkey").join(sums, "o_orderkey", "left").withColumn("net_pnl", F.when(F.col("o_orderkey") % 10 == 0, 0.0).otherwise(F.coalesce("net_pnl", zero)))
    return admission.inconsistent(rows, headers, "o_orderkey", 0.01)


DIGEST_SQL = "sha256(unhex(string_agg(printf('%016X', event_id), '' ORDER BY event_id)))"


@query(f"SELECT event_type, event_id // 10000 AS part, count(*) AS row_count, min(event_id) AS min_id, max(event_id) AS max_id, {DIGEST_SQL} AS id_sha256 FROM events GROUP BY ALL")
def q_id_digest(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_type", "event_id", archive.part("event_id").alias("part"))
    return archive.chunk_digests(rows, ["event_type", "part"], "event_id")


@query(f"WITH c AS (SELECT event_type, date_trunc('day', ts) AS d, event_id // 10000 AS part, count(*) AS n, min(event_id) AS lo, max(event_id) AS hi, {DIGEST_SQL} AS h FROM events GROUP BY ALL) SELECT event_type, sum(n)::BIGINT AS row_count, min(lo) AS min_id, max(hi) AS max_id, sha256(string_agg(h, '' ORDER BY lo)) AS chunks_sha256 FROM c GROUP BY event_type")
def q_day_digest(spark, sf_dir):
    chunks = archive.chunk_digests(table(spark, sf_dir, "events").select("event_type", "event_id", F.date_trunc("day", "ts").alias("d"), archive.part("event_id").alias("part")), ["event_type", "d", "part"], "event_id")
    return archive.day_digest(chunks, ["event_type"])


@query("""SELECT event_type, part, CASE event_type WHEN 'purchase' THEN 'row_count_differs' ELSE 'missing' END AS problem FROM (SELECT event_type, event_id // 10000 AS part, count(*) FILTER (event_id % 97 = 1) AS lost FROM events GROUP BY ALL)
    WHERE event_type = 'view' OR (event_type = 'purchase' AND lost > 0)""")
def q_archive_verify(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_type", "event_id", archive.part("event_id").alias("part"))
    manifest = archive.chunk_digests(rows, ["event_type", "part"], "event_id")
    found = archive.chunk_digests(rows.where("event_type <> 'view' AND NOT (event_type = 'purchase' AND event_id % 97 = 1)"), ["event_type", "part"], "event_id")
    return archive.verify(manifest, found, ["event_type", "part"])


@query(r"""SELECT doc_id, md5(coalesce(CASE WHEN starts_with(coalesce(text, ''), '  File ') OR t = '' OR starts_with(t, 'Traceback') THEN NULL
        ELSE substr(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '(?i)(password|passwd|token|secret|api[_-]?key|authorization)\s*([=:])\s*[^\s,;]+', '\1\2[REDACTED]', 'g'), '(?i)\b(?:[a-z][a-z0-9+.-]*://)[^\s]+', '[REDACTED]', 'g'),
            '(?:[A-Za-z]:\\|/)[^\s:]+', '[REDACTED]', 'g'), '(?i)\b(?:\d{1,3}\.){3}\d{1,3}\b|\b[a-z0-9][a-z0-9.-]*\.(?:com|net|org|io|dev|local|internal)\b', '[REDACTED]', 'g'), 1, 160) END, 'none')) AS line_md5
    FROM (SELECT doc_id, text, trim(regexp_replace(coalesce(text, ''), '[\x00-\x1f\x7f]+', ' ', 'g'), ' ') AS t FROM documents)""")
def q_redact(spark, sf_dir):
    clean = text.sanitize_line(F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.coalesce(clean, F.lit("none")).cast("binary")).alias("line_md5"))


@query("SELECT o_orderkey, lower(replace('ETH/USDT-P', '/', '-')) || '_' || strftime(o_orderdate, '%Y%m%dT%H%M%S%fZ') || '_' || strftime(o_orderdate + INTERVAL 1 HOUR, '%Y%m%dT%H%M%S%fZ') || '_v2' AS dataset_id FROM orders")
def q_dataset_id(spark, sf_dir):
    start = F.col("o_orderdate").cast("timestamp")
    return table(spark, sf_dir, "orders").select("o_orderkey", text.dataset_id(F.lit("ETH/USDT-P"), start, start + F.expr("INTERVAL 1 HOUR")).alias("dataset_id"))


@query("SELECT event_type, count(*) AS rows FROM events GROUP BY event_type")
def q_counts_by_type(spark, sf_dir):
    return tape.counts_by(table(spark, sf_dir, "events"), "event_type")


@query(f"""WITH e AS (SELECT user_id, event_id, {K} AS k, {K} % 10 = 0 AS snap FROM events), w AS (SELECT *, sum(snap::INT) OVER o AS seen, lag(k) OVER o AS previous FROM e WINDOW o AS (PARTITION BY user_id ORDER BY event_id)),
    r AS (SELECT *, CASE WHEN snap THEN NULL WHEN seen = 0 THEN 'missing_snapshot' WHEN k > previous + 1 THEN 'sequence_gap' WHEN k <= previous THEN 'sequence_regression' END AS reason FROM w)
    SELECT user_id, event_id, k, coalesce(previous, -1) AS previous, reason FROM r WHERE reason IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1""")
def q_desyncs(spark, sf_dir):
    rows = events(spark, sf_dir).select("user_id", "event_id", "k")
    return operations.desyncs(rows, "user_id", ["event_id"], "k", F.col("k") % 10 == 0).withColumn("previous", F.coalesce("previous", F.lit(-1)))


@query("SELECT event_id, user_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 20")
def q_newest_records(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts").withColumn("at", F.struct("ts", "event_id"))
    return operations.newest(rows, ["user_id"], "at").drop("at")


def _book_events(spark, sf_dir):
    """lineitem as book events: suppliers are symbols, each line moves one level on a side; every 40th is a snapshot."""
    d = lambda c, n: c.cast("decimal(38,18)").alias(n)
    li = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("l_quantity"))  # one event a number
    li = li.withColumn("rid", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    level = lambda p, q: F.array(F.struct(d(p, "price"), d(q, "quantity")))
    bid, ask = level(F.lit(100) - F.col("l_quantity") % 7, F.col("l_linenumber") % 4), level(F.lit(101) + F.col("l_quantity") % 5, F.col("l_linenumber") % 3)
    snap = F.col("rid") % 40 < 10
    return li.select(
        F.col("l_suppkey").cast("string").alias("symbol"), F.col("rid").alias("raw_event_id"), F.lit("c").alias("connection_id"), F.lit(None).cast("long").alias("exchange_sequence"), F.col("rid").alias("local_sequence"), F.lit(2).cast("short").alias("raw_schema_version"),
        F.when(snap, "Snapshot").otherwise("Update").alias("message_type"), F.when(snap, level(F.lit(99), F.lit(1))).otherwise(bid).alias("bids"), F.when(snap, level(F.lit(102), F.lit(1))).otherwise(ask).alias("asks"),
    )


def _ladder_sql() -> str:
    """Levels of the synthetic books as a column a price: prices are few, so that no fold is needed."""
    bids, asks = range(94, 101), range(101, 106)
    cell = lambda side, p: f"last_value(CASE WHEN snap THEN CASE WHEN {p} = {99 if side == 'b' else 102} THEN 1 ELSE 0 END WHEN {side}p = {p} THEN {side}q END IGNORE NULLS) OVER w AS {side}{p}"
    cells = ", ".join([*(cell("b", p) for p in bids), *(cell("a", p) for p in asks)])
    best = lambda side, prices, least: f"{'least' if least else 'greatest'}({', '.join(f'CASE WHEN {side}{p} > 0 THEN {p} END' for p in prices)})"
    count = " + ".join([*(f"coalesce(b{p} > 0, FALSE)::INT" for p in bids), *(f"coalesce(a{p} > 0, FALSE)::INT" for p in asks)])
    return f"""e AS (SELECT l_suppkey::VARCHAR AS symbol, l_orderkey * 10 + l_linenumber AS rid, (l_orderkey * 10 + l_linenumber) % 40 < 10 AS snap, 100 - l_quantity % 7 AS bp, l_linenumber % 4 AS bq, 101 + l_quantity % 5 AS ap, l_linenumber % 3 AS aq
        FROM (SELECT l_suppkey, l_orderkey, l_linenumber, max(l_quantity) AS l_quantity FROM lineitem GROUP BY ALL)),
    g AS (SELECT *, sum(snap::INT) OVER (PARTITION BY symbol ORDER BY rid) AS seg FROM e),
    c AS (SELECT symbol, rid, seg, {cells} FROM g WINDOW w AS (PARTITION BY symbol, seg ORDER BY rid ROWS UNBOUNDED PRECEDING)),
    t AS (SELECT symbol, rid, seg, {best('b', bids, False)} AS bid, {best('a', asks, True)} AS ask, {count} AS levels FROM c),
    f AS (SELECT *, bool_or(coalesce(bid >= ask, TRUE)) OVER (PARTITION BY symbol, seg ORDER BY rid) AS broken FROM t),
    s AS (SELECT symbol, rid, CASE WHEN seg = 0 THEN 'invalid_waiting_snapshot' WHEN broken THEN 'invalid_crossed' ELSE 'valid_sequence_unverified' END AS state, CASE WHEN seg > 0 AND NOT broken THEN bid END AS bid, CASE WHEN seg > 0 AND NOT broken THEN ask END AS ask,
        CASE WHEN seg > 0 AND NOT broken THEN levels ELSE 0 END AS levels FROM f)"""


BOOK_SQL = _ladder_sql()


@query(f"WITH {BOOK_SQL} SELECT symbol, state, count(*) AS \"count\" FROM s GROUP BY ALL")
def q_book_fold(spark, sf_dir):
    return orderbook.histogram(orderbook.reconstruct(_book_events(spark, sf_dir), ["raw_event_id"], chunk=chunk("raw_event_id")))


@query(f"WITH {BOOK_SQL} SELECT symbol, arg_max(state, rid) AS state, count(bid) AS quoted, sum(bid)::BIGINT AS bids, sum(ask)::BIGINT AS asks, sum(levels)::BIGINT AS levels FROM s GROUP BY symbol")
def q_book_states(spark, sf_dir):
    states = orderbook.reconstruct(_book_events(spark, sf_dir), ["raw_event_id"])
    sums = states.groupBy("symbol").agg(F.count("best_bid").alias("quoted"), F.sum("best_bid").cast("long").alias("bids"), F.sum("best_ask").cast("long").alias("asks"), F.sum("level_count").cast("long").alias("levels"))
    return orderbook.final_state(states).join(sums, "symbol")


@query("""WITH e AS (SELECT user_id::VARCHAR AS symbol, epoch(ts) AS sec, event_id AS id, CASE WHEN event_type = 'purchase' THEN value END AS m, CASE WHEN event_type <> 'purchase' THEN value END AS b FROM events WHERE value > 0),
    k AS (SELECT symbol, sec, id, last_value(m IGNORE NULLS) OVER w AS mark, last_value(b IGNORE NULLS) OVER w AS bid FROM e WINDOW w AS (PARTITION BY symbol ORDER BY sec, id ROWS UNBOUNDED PRECEDING)),
    t AS (SELECT *, bid * 1.001 AS ask, row_number() OVER o AS n, (avg(mark) OVER (PARTITION BY symbol ORDER BY sec, id ROWS 1 PRECEDING) / avg(mark) OVER (PARTITION BY symbol ORDER BY sec, id ROWS 4 PRECEDING) - 1) * 10000 AS edge FROM k WHERE mark IS NOT NULL AND bid IS NOT NULL WINDOW o AS (PARTITION BY symbol ORDER BY sec, id)),
    p AS (SELECT *, lag(now, 1, 0) OVER o AS was FROM (SELECT *, CASE WHEN n >= 5 AND edge > 2 THEN 1 WHEN n >= 5 AND edge < -2 THEN -1 ELSE 0 END AS now FROM t) WINDOW o AS (PARTITION BY symbol ORDER BY sec, id)),
    h AS (SELECT *, last_value(CASE WHEN now <> was THEN CASE now WHEN 1 THEN ask * 1.0001 WHEN -1 THEN bid * 0.9999 ELSE 0 END END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY sec, id ROWS UNBOUNDED PRECEDING) AS held FROM p),
    g AS (SELECT *, lag(held) OVER (PARTITION BY symbol ORDER BY sec, id) AS had, CASE was WHEN 1 THEN bid * 0.9999 WHEN -1 THEN ask * 1.0001 END AS out, CASE now WHEN 1 THEN bid * 0.9999 WHEN -1 THEN ask * 1.0001 END AS leave FROM h),
    c AS (SELECT *, now <> was AND was <> 0 AS closing, now <> was AND now <> 0 AS opening, CASE WHEN now <> was AND was <> 0 THEN was * 1000 / had * (out - had) ELSE 0 END AS gain,
        CASE WHEN now <> was AND was <> 0 THEN 1000 / had * out * 0.00045 ELSE 0 END + CASE WHEN now <> was AND now <> 0 THEN 0.45 ELSE 0 END AS fee FROM g),
    q AS (SELECT *, 10000 + sum(gain - fee) OVER (PARTITION BY symbol ORDER BY sec, id) + CASE WHEN now <> 0 THEN now * 1000 / held * (mark - held) ELSE 0 END AS equity, 10000 + sum(gain - fee) OVER (PARTITION BY symbol ORDER BY sec, id) AS cash FROM c),
    f AS (SELECT *, equity <= greatest(10000, max(equity) OVER w) * 0.9 AS hit, greatest(10000, max(equity) OVER w) AS peak FROM q WINDOW w AS (PARTITION BY symbol ORDER BY sec, id)),
    v AS (SELECT *, coalesce(bool_or(hit) OVER (PARTITION BY symbol ORDER BY sec, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) AS over, row_number() OVER (PARTITION BY symbol ORDER BY sec DESC, id DESC) = 1 AS final FROM f),
    l AS (SELECT *, NOT over AND now <> 0 AND (hit OR final) AS leaving, now * 1000 / nullif(held, 0) * (leave - held) AS gain2, 1000 / nullif(held, 0) * leave * 0.00045 AS fee2 FROM v),
    y AS (SELECT *, last_value(CASE WHEN NOT over THEN CASE WHEN hit THEN cash + CASE WHEN now <> 0 THEN gain2 - fee2 ELSE 0 END ELSE equity END END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY sec, id ROWS UNBOUNDED PRECEDING) AS curve FROM l),
    z AS (SELECT *, curve / lag(curve) OVER (PARTITION BY symbol ORDER BY sec, id) - 1 AS step, 1 - curve / greatest(10000, max(curve) OVER (PARTITION BY symbol ORDER BY sec, id)) AS fall FROM y),
    r AS (SELECT symbol, sum(gain) FILTER (NOT over) + coalesce(sum(gain2) FILTER (leaving), 0) AS gains, sum(fee) FILTER (NOT over) + coalesce(sum(fee2) FILTER (leaving), 0) AS fees, count(*) FILTER (NOT over AND closing) + count(*) FILTER (NOT over AND opening) + count(*) FILTER (leaving) AS fills,
        count(*) FILTER (NOT over AND gain <> 0) + count(*) FILTER (leaving AND gain2 <> 0) AS closed, count(*) FILTER (NOT over AND gain > 0) + count(*) FILTER (leaving AND gain2 > 0) AS wins, min(curve) AS low, max(peak) FILTER (NOT over) AS top, greatest(max(fall), 0) AS path,
        CASE WHEN count(step) > 1 AND stddev_pop(step) > 0 THEN avg(step) / stddev_pop(step) * sqrt(count(step)) ELSE 0 END AS sharpe, bool_or(hit) AS halted FROM z GROUP BY symbol)
    SELECT e.symbol, round(10000 + coalesce(gains - fees, 0), 6) AS final_equity, round(coalesce(gains - fees, 0), 6) AS net_pnl, round(coalesce(gains, 0), 6) AS realized_pnl, round(coalesce(fees, 0), 6) AS fees_paid, 0.0::DOUBLE AS funding_paid, coalesce(fills, 0)::BIGINT AS fills, coalesce(closed, 0)::BIGINT AS closed_trades,
        round(CASE WHEN closed > 0 THEN wins / closed ELSE 0 END, 6) AS win_rate, round(1 - coalesce(low, 10000) / coalesce(top, 10000), 6) AS max_drawdown_fraction, round(coalesce(path, 0), 6) AS path_drawdown_fraction, round(coalesce(sharpe, 0), 6) AS sharpe, coalesce(halted, FALSE) AS halted, 0.0::DOUBLE AS open_position
    FROM (SELECT DISTINCT symbol FROM e) e LEFT JOIN r USING (symbol)""")
def q_paper(spark, sf_dir):
    v = F.col("value")
    t = F.col("event_type")
    payload = F.when(t == "purchase", F.to_json(F.struct(F.lit("mark_price").alias("topic"), v.alias("markPrice")))).otherwise(F.to_json(F.struct(F.lit("ask_bid_price").alias("topic"), v.alias("bidPrice"), (v * 1.001).alias("askPrice"))))
    rows = table(spark, sf_dir, "events").where("value > 0").select(F.col("user_id").cast("string").alias("symbol"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("received_at"), payload.alias("payload"))
    out = paper.simulate(paper.inputs(rows), paper.Paper(fast=2, slow=5))
    return out.select(*[F.round(n, 6).alias(n) if kind == "double" else F.col(n) for n, kind in out.dtypes])
