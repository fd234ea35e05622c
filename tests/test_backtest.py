"""The baseline backtest against a walk over all candles."""

import random
from datetime import datetime, timedelta

import pytest

from tapelake.operators import backtest

T0 = datetime(2026, 7, 18)


def walk(rows, how):
    """(place, outcome, entry time, exit time) of each candle and trade, candle by candle."""
    out, trade, cooled = [], None, None
    for k, (at, price) in enumerate(rows):
        if trade and at - trade[0] >= how.holding_s:
            out.append((k + 1, "trade", trade[0], at))
            trade, cooled = None, at
        elif trade:
            out.append((k + 1, "position_open", None, None))
            continue
        if k < how.lookback:
            what = "insufficient_history"
        elif cooled is not None and at - cooled < how.cooldown_s:
            what = "cooldown"
        elif abs((price / rows[k - how.lookback][1] - 1) * 10_000) < how.threshold_bps:
            what = "below_threshold"
        elif k + how.delay >= len(rows):
            what = "execution_delay_out_of_range"
        else:
            what, trade = "signal", rows[k + how.delay]
        out.append((k + 1, what, trade[0] if what == "signal" else None, None))
    if trade:
        end = rows[-1][0]
        out.append((len(rows), "trade", trade[0], end) if end > trade[0] else (len(rows), "unclosed_at_end", None, None))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_outcomes_are_those_of_a_walk(spark, seed):
    rng = random.Random(seed)
    how = backtest.Baseline(lookback=rng.randint(1, 4), delay=rng.randint(0, 3), threshold_bps=rng.choice([5, 20, 60]), holding_s=rng.choice([1, 30, 90]), cooldown_s=rng.choice([0, 15, 200]))
    tapes = {}
    for name in "abcd":
        at, price, rows = 0, 100.0, []
        for _ in range(rng.randint(1, 150)):
            at, price = at + rng.choice([1, 10, 10, 60, 500]), price * (1 + rng.gauss(0, 0.002))
            rows.append((float(at), price))
        tapes[name] = rows
    df = spark.createDataFrame([(n, T0 + timedelta(seconds=at), p) for n, rows in tapes.items() for at, p in rows], "series string, at timestamp, close double").repartition(3)
    got = backtest.outcomes(df, "series", "at", "close", how).collect()
    base = T0.replace(tzinfo=__import__("datetime").timezone.utc).timestamp()
    less = lambda x: None if x is None else x - base
    for name, rows in tapes.items():
        mine = sorted(((r.place, r.outcome, less(r.entry_at), less(r.exit_at)) for r in got if r.series == name), key=repr)
        assert mine == sorted(walk(rows, how), key=repr), (name, how)
