"""Rolling medians against brute force: ties, nulls, repeated ids, borders of chunks, hot times and values."""

import datetime as dt
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from lodestone.llm.rolling_median import SlidingWindow, cents, rolling_median

SCHEMA = "click_id long, ts timestamp_ntz, kind string, value double, n string, far string, chunk int, copies int"
START = dt.datetime(2024, 3, 10, 1, 30)  # a time zone's clock jumps here, but these times have none
SECOND = dt.timedelta(seconds=1)


def frame(spark, rows):
    """Clicks with columns whose names clash with the operator's own."""
    return spark.createDataFrame([(i, t, k, v, "x", "y", 1, 2) for i, t, k, v in rows], SCHEMA)


def middle2(values):
    values = sorted(values)
    return values[(len(values) - 1) // 2] + values[len(values) // 2]


def brute(rows, minutes=60):
    first = {}
    order = lambda x: tuple((y is not None, y) if y is not None else (False, 0) for y in x)
    for i, t, k, v in rows:
        if t is not None:
            c = None if v is None else (Fraction(100.0 * v + 0.5).__floor__())
            row = (t, k, c)
            if i not in first or order(row) < order(first[i]):
                first[i] = row
    out = {}
    for i, (t, k, c) in first.items():
        window = [y for u, j, y in first.values() if j == k and t - minutes * 60 * SECOND <= u <= t and y is not None]
        if len(window) < 2:
            out[i] = (k, len(window), None, None, None)
            continue
        m = middle2(window)
        mad = middle2([abs(2 * y - m) for y in window])
        out[i] = (k, len(window), m, mad, None if c is None else 2 * abs(2 * c - m) > 3 * mad)
    return out


def found(df):
    rows = df.collect()
    out = {r.click_id: (r.kind, r.n, r.median2, r.mad4, r.far) for r in rows}
    assert len(out) == len(rows)
    return out


def clicks(seed, n, kinds=("a", "b", None), spread=7200, distinct=50):
    pick = random.Random(seed)
    rows = []
    for i in range(n):
        t = START + pick.randrange(spread) * SECOND * pick.choice([1, 1, 0.5])
        v = None if pick.random() < 0.1 else pick.randrange(-distinct, distinct) / 4
        rows.append((i, None if pick.random() < 0.03 else t, pick.choice(kinds), v))
    return rows + [pick.choice(rows) for _ in range(n // 5)]


@pytest.mark.parametrize("chunks", [1, 3, 16])
def test_against_brute_force(spark, chunks):
    rows = clicks(chunks, 500)
    df = rolling_median(frame(spark, rows), cents(F.col("value")), chunks=chunks)
    assert df.columns == ["click_id", "kind", "n", "median2", "mad4", "far"]
    assert found(df) == brute(rows)


def test_windows_that_reach_over_many_chunks(spark):
    rows = clicks(7, 300, kinds=("a",), spread=600)
    assert found(rolling_median(frame(spark, rows), cents(F.col("value")), chunks=20)) == brute(rows)
    assert found(rolling_median(frame(spark, rows), cents(F.col("value")), minutes=1, chunks=20)) == brute(rows, 1)


def test_one_time_and_one_value_hold_most_rows(spark):
    rows = [(i, START, "a", 1.25) for i in range(400)] + [(400 + i, START, "a", i / 4) for i in range(50)] + [(500 + i, START + 3600 * SECOND, "a", 2.0) for i in range(9)]
    rows += [(600, START + 3600 * SECOND + dt.timedelta(microseconds=1), "a", 2.0), (601, START - dt.timedelta(microseconds=1), "a", 9.0)]
    assert found(rolling_median(frame(spark, rows), cents(F.col("value")), chunks=9)) == brute(rows)


def test_rows_of_a_repeated_id(spark):
    """Of rows that differ the first by time, series and value counts; a null id is one id."""
    rows = [(1, START + SECOND, "a", 1.0), (1, START, "b", 2.0), (1, START, "b", None), (1, None, "a", 0.0), (None, START, None, 5.0), (None, START, None, 5.0), (2, START, None, 7.0), (3, None, None, 7.0)]
    assert found(rolling_median(frame(spark, rows), cents(F.col("value")), chunks=2)) == brute(rows)


def test_nothing_and_odd_values(spark):
    assert rolling_median(frame(spark, []), cents(F.col("value"))).count() == 0
    odd = [float("nan"), float("inf"), -float("inf"), 1e300, None, 0.005, -0.005, -1e-9, 1e14]
    rows = [(i, START + i * SECOND, "a", v) for i, v in enumerate(odd)]
    assert [r[0] for r in frame(spark, rows).orderBy("click_id").select(cents(F.col("value"))).collect()] == [None] * 5 + [1, 0, 0, 10**16]
    assert found(rolling_median(frame(spark, rows), cents(F.col("value")))) == brute([(i, t, k, v if i > 4 else None) for i, t, k, v in rows])


def test_sliding_window_against_a_sorted_list():
    pick = random.Random(3)
    window, inside, time = SlidingWindow(50), [], 0
    for step in range(4000):
        time += pick.choice([0, 0, 1, 1, 2, 40 if step % 500 == 0 else 1])
        window.move(time)
        inside = [x for x in inside if x[0] >= time - 50]
        for _ in range(pick.randrange(6)):
            value, copies = pick.randrange(2000), pick.choice([1, 1, 1, 5])
            window.enter(time, value, copies)
            inside += [(time, value)] * copies
        values = sorted(v for _, v in inside)
        assert window.n == len(values)
        if values:
            k = pick.randrange(len(values))
            assert window.rank(k) == values[k]
        if len(values) > 1:
            m = middle2(values)
            assert window.measures() == (len(values), m, middle2([abs(2 * v - m) for v in values]))
        assert all(window.values) and sum(map(len, window.values)) == window.distinct
    assert max(map(len, window.values)) <= 64
