from pyspark.sql import functions as F

from tessaro.operators.packing import fitting, packed


def brute(pieces, limit):
    parts = []
    for p in pieces:
        if parts and len(parts[-1]) + 1 + len(p) <= limit:
            parts[-1] += " " + p
        else:
            parts.append(p)
    return parts


def test_packed(spark):
    rows = [["aa", "bb", "c" * 20, "", "d", "e" * 9, "f"], [], None, ["日本", "x" * 8]]
    found = spark.createDataFrame([(r,) for r in rows], "p array<string>").select(packed(F.col("p"), 10)).collect()
    assert [r[0] for r in found] == [None if r is None else brute(r, 10) for r in rows]


def test_fitting(spark):
    rows = [([5, 9, 4, 1],), ([],), ([20],)]
    found = spark.createDataFrame(rows, "c array<long>").select(fitting(F.col("c"), 10)).collect()
    assert [r[0] for r in found] == [[1, 3, 4], [], []]
