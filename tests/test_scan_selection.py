"""Exact selection and segmented scans against plain Python, with skewed keys and awkward values."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathwise.operators import events as EV
from pathwise.operators import scan, selection


def same(a, b):
    return (a is None and b is None) or (a is not None and b is not None and (a == b or (math.isnan(a) and math.isnan(b))))


def brute(values, q, rule):
    vals = sorted((v for v in values if v is not None), key=lambda v: (math.isnan(v), v))
    if not vals:
        return None
    place = q * (len(vals) - 1)
    low, high = math.floor(place), math.ceil(place)
    if rule == "floor" or low == high or vals[low] == vals[high]:
        return vals[low]
    return (high - place) * vals[low] + (place - low) * vals[high]


@pytest.mark.parametrize("few", [5_000, 0])
@pytest.mark.parametrize("rule", ["linear", "floor"])
def test_quantiles_equal_sorting(spark, monkeypatch, few, rule):
    monkeypatch.setattr(selection, "FEW", few)
    monkeypatch.setattr(selection, "BINS", 16)
    rng = random.Random(few)
    inf, nan = math.inf, math.nan
    columns = {"plain": [rng.gauss(0, 100) for _ in range(700)], "ties": [float(rng.choice([1, 2, 2, 2, 9])) for _ in range(700)],
               "wide": [rng.choice([-1, 1]) * 10.0 ** rng.randint(-300, 300) for _ in range(700)],
               "extreme": [rng.choice([1.7e308, -1.7e308, 0.0, 5e-324]) for _ in range(700)],
               "special": [rng.choice([None, nan, inf, -inf, 1.0, 2.5]) for _ in range(700)], "empty": [None] * 700,
               "single": [None] * 699 + [4.0], "zeros": [rng.choice([-0.0, 0.0]) for _ in range(700)]}
    frame = spark.createDataFrame(list(zip(*columns.values())), ", ".join(f"{c} double" for c in columns)).repartition(3)
    qs = [0.0, 0.05, 0.5, 0.73, 0.99, 1.0]
    got = selection.quantiles(frame, {c: qs for c in columns}, rule)
    for c, values in columns.items():
        for q, v in zip(qs, got[c]):
            assert same(v, brute(values, q, rule)), (c, q, v)


def test_quantiles_of_nothing(spark):
    assert selection.quantiles(spark.createDataFrame([], "x double"), {"x": [0.5]}) == {"x": [None]}


def test_many_distinct_values_pass_through_few_counters(spark):
    """Passes hold at most BINS counters a rank, whatever the number of distinct values."""
    frame = spark.range(200_000).select((F.pmod(F.xxhash64("id"), F.lit(10 ** 9)) / 7.0).alias("x"))
    values = np.sort(np.asarray([r.x for r in frame.collect()]))
    assert selection.quantiles(frame, {"x": [0.5, 0.9]}, "floor")["x"] == [values[int(0.5 * 199_999)], values[int(0.9 * 199_999)]]


def skewed(spark):
    rng = random.Random(9)
    start = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(2_000):
        user = rng.choice([None, 2, 3, 4]) if rng.random() < 0.1 else 1  # nine in ten rows on one key
        ts = None if rng.random() < 0.02 else start + dt.timedelta(minutes=rng.randint(0, 3_000))
        kind = rng.choice(["recommendation_shown", "recommendation_clicked", "lesson_completed", "rating_submitted"])
        rows.append((i, user, f"t{user}" if user else None, ts, kind, rng.choice([None, 1, 5]) if kind == "rating_submitted" else None))
    return rows, spark.createDataFrame(rows, "event_id long, user_id long, item_id string, timestamp_utc timestamp, event_type string, rating int")


@pytest.mark.parametrize("limit", [100_000, 50, 1])
def test_running_counters_do_not_depend_on_ranges(spark, monkeypatch, limit):
    monkeypatch.setattr(scan, "LIMIT", limit)
    rows, frame = skewed(spark)
    got = {r.event_id: (r.interactions, r.clicks, r.completions, r.latest_rating) for r in EV.running_user_counters(frame.repartition(4)).collect()}
    items = {r.event_id: (r.views, r.item_clicks) for r in EV.running_item_counters(frame).collect()}
    state, views = {}, {}
    for i, user, item, ts, kind, rating in sorted(rows, key=lambda r: (r[3] is None, r[3] or dt.datetime.min, r[0])):
        n, c, d, last = state.get(user, (0, 0, 0, None))
        state[user] = (n + 1, c + (kind == "recommendation_clicked"), d + (kind == "lesson_completed"), last if rating is None else rating)
        assert got[i] == state[user]
        if item is not None:
            v, k = views.get(item, (0, 0))
            views[item] = (v + (kind == "recommendation_shown"), k + (kind == "recommendation_clicked"))
            assert items[i] == views[item]
    assert len(got) == len(rows)


def test_a_hot_key_is_spread_over_ranges(spark, monkeypatch):
    """No sorted group holds much more than the limit."""
    monkeypatch.setattr(scan, "LIMIT", 100)
    _, frame = skewed(spark)
    plan = EV.running_user_counters(frame)._jdf.queryExecution().analyzed().toString()
    assert "__range" in plan
    hot = frame.filter("user_id = 1 and timestamp_utc is not null")
    lo, hi, n = hot.agg(F.min(F.unix_micros("timestamp_utc")), F.max(F.unix_micros("timestamp_utc")), F.count("*")).first()
    width = (hi - lo) * 100 // n
    ranges = hot.groupBy(F.floor((F.unix_micros("timestamp_utc") - lo) / width)).count().collect()
    assert len(ranges) >= n // 100 and max(r["count"] for r in ranges) < 200
