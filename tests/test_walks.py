"""Walks of any length, against plain Python."""

import pytest

from doctide.operators.walks import reached
from doctide.registry import queries


@pytest.mark.parametrize("pairs", [[(i, i + 1) for i in range(300)] + [(500, 0)], [(0, 1), (1, 2), (2, 0), (7, 8)], [(0, 3), (0, 5), (5, 9), (9, 9), (4, 0)], [(1, 2)]])
def test_reached(spark, pairs):
    want, waiting = {0}, [0]
    while waiting:
        x = waiting.pop()
        new = {b for a, b in pairs if a == x} - want
        want |= new
        waiting += new
    got = reached(spark.createDataFrame(pairs, "a long, b long"), spark.createDataFrame([(0,)], "node long")).collect()
    assert sorted(r["node"] for r in got) == sorted(want)


def test_reachability_of_a_long_walk(spark, tmp_path):
    # node k leads to 7 k + nation = k + 1, modulo 400
    n = 400
    rows = [(k, (1 - 6 * k) % n) for k in range(n)]
    spark.createDataFrame(rows, "s_suppkey long, s_nationkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    got = queries()["reachability"](spark, str(tmp_path)).collect()
    assert sorted((r["node"], r["dead"]) for r in got) == [(k, False) for k in range(n)]
