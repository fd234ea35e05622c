"""Times the headline queries: one warm-up, then the median of three runs into the no-op sink. Prints one JSON line."""

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from tapelake.operators import normalize
from tapelake.plans import catalog, market
from tapelake.streaming.pipelines import TABLES

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = (
    "q_candles_hourly", "q_daily_quality", "q_receipt_gaps", "q_sequence_anomalies", "q_quality_report", "q_momentum_signals", "q_momentum_trades", "q_fast_slow_ma", "q_drawdown",
    "q_backtest", "q_asof_quote", "q_window_plan", "q_reconcile", "q_normalize_route", "q_trade_consistency", "q_id_digest", "q_book_fold", "q_paper",
)


def timed(spark: SparkSession, name: str) -> float:
    began = time.perf_counter()
    catalog.QUERIES[name](spark, SF).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def normalized(spark: SparkSession) -> float:
    """Seconds for all five outputs of the normalizer over a tape of six topics."""
    began = time.perf_counter()
    parts = normalize.normalize(market.payload_tape(spark, SF))
    for name in TABLES:
        getattr(parts, name).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def main() -> None:
    began = time.perf_counter()
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", CPUS).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    start_s = time.perf_counter() - began
    took = {}
    for name in HEADLINE:
        timed(spark, name)
        took[name] = round(statistics.median(timed(spark, name) for _ in range(3)), 3)
    normalized(spark)
    five = statistics.median(normalized(spark) for _ in range(3))
    rows = spark.read.parquet(f"{SF}/events.parquet").count()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(SF.rstrip("/")).removeprefix("sf"), "events": rows, "normalize_s": round(five, 3), "normalize_rows_per_s": round(rows / five), "shuffle_partitions": int(CPUS), "spark_start_s": round(start_s, 1)}))
    spark.stop()


if __name__ == "__main__":
    main()
