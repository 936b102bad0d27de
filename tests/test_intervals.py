from itertools import groupby

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tessaro.operators.intervals import periods_and_gaps

SCHEMA = "k long, j string, s long, e long"


def brute(rows):
    valid = sorted({(k, j, s, e) for k, j, s, e in rows if s is not None and e is not None and e > s}, key=lambda r: (repr(r[:2]), r[2:]))
    out = []
    for key, group in groupby(valid, key=lambda r: r[:2]):
        merged = []
        for *_, s, e in group:
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        out += [(*key, "period", *m) for m in merged]
        out += [(*key, "gap", a[1], b[0]) for a, b in zip(merged, merged[1:])]
    return sorted(out, key=repr)


def run(spark, rows, schema=SCHEMA):
    found = periods_and_gaps(spark.createDataFrame(rows, schema), ["k", "j"], "s", "e")
    return sorted(map(tuple, found.select("k", "j", "kind", "s", "e").collect()), key=repr)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from([1, 2, None]), st.sampled_from(["a", None]), st.one_of(st.none(), st.integers(0, 60)), st.one_of(st.none(), st.integers(0, 60))), max_size=80))
def test_against_brute_force(spark, rows):
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("reach", [12, 10, 9])
def test_one_group_over_many_partitions(spark, reach):
    rows = [(1, "a", i * 10, i * 10 + reach) for i in range(200)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert run(spark, rows) == brute(rows)
        nested = [*rows, (1, "a", 5, 100_000), (2, "b", 1, 2)]
        assert run(spark, nested) == brute(nested)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_empty_ties_and_clashing_names(spark):
    assert run(spark, []) == []
    rows = [(1, "a", 0, 5)] * 50 + [(1, "a", 5, 5), (1, "a", 7, 6)]
    assert run(spark, rows) == [(1, "a", "period", 0, 5)]
    df = spark.createDataFrame([(1, "a", 0, 5, "x", 3)], SCHEMA + ", kind string, _partition int")
    assert [tuple(r) for r in periods_and_gaps(df, ["k", "j"], "s", "e").collect()] == [(1, "a", "period", 0, 5)]
