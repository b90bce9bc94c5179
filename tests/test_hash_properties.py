"""Property tests for the hash-based draws (ranges, grids, weighted picks) and the fast mode."""

from decimal import Decimal

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewell.functions import hashing as H
from tidewell.functions import spec as S


@settings(max_examples=15, deadline=None)
@given(lo=st.integers(-10**6, 10**6), width=st.integers(0, 10**6), seed=st.integers(0, 999))
def test_int_between_stays_in_range(spark, lo, width, seed):
    hi = lo + width
    r = spark.range(200).select(H.int_between(H.unif(seed, "x", "id"), lo, hi).alias("v")).agg(
        F.min("v"), F.max("v")).first()
    assert lo <= r[0] <= r[1] <= hi


@settings(max_examples=10, deadline=None)
@given(lo=st.decimals(-1000, 1000, places=2), width=st.decimals(0, 1000, places=2))
def test_decimal_draws_on_grid(spark, lo, width):
    hi = lo + width
    df = spark.range(100).select(H.decimal_between(H.unif(1, "d", "id"), lo, hi, 10, 2).alias("v"))
    vals = [r["v"] for r in df.collect()]
    assert all(Decimal(lo) <= v <= Decimal(hi) for v in vals)
    assert all(v == v.quantize(Decimal("0.01")) for v in vals)


@settings(max_examples=10, deadline=None)
@given(weights=st.lists(st.integers(0, 9), min_size=1, max_size=6).filter(lambda w: sum(w) > 0))
def test_weighted_pick_never_picks_zero_weight(spark, weights):
    values = [f"v{i}" for i in range(len(weights))]
    got = {r["p"] for r in spark.range(500).select(
        H.weighted_pick(H.unif(3, "w", "id"), values, weights).alias("p")).distinct().collect()}
    assert got <= {v for v, w in zip(values, weights) if w > 0}


def test_fast_mode_is_deterministic_and_in_range(spark):
    spec = [{"name": "a", "type": "int", "min": 1, "max": 6, "random": True},
            {"name": "b", "type": "string", "values": ["x", "y"], "weights": [3, 1]}]
    one = sorted(map(tuple, S.generate(spark, spec, 300, 1, fast=True).collect()))
    eight = sorted(map(tuple, S.generate(spark, spec, 300, 8, fast=True).collect()))
    assert one == eight
    assert all(1 <= a <= 6 and b in ("x", "y") for a, b in one)
