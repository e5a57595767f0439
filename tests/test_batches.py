"""First-fit requests and debouncing on hand-made queues."""

import random

from pyspark.sql import functions as F

from doctide.operators.batches import debounced, first_fit


def test_first_fit_passes_over_and_goes_on(spark):
    queue = [("a", i, s) for i, s in enumerate([30, 40, 20, 90, 10, 0, 5])]
    got = first_fit(spark.createDataFrame(queue, "k string, at int, s long"), ["k"], ["at"], F.col("s"), 60, 3).orderBy("at").collect()
    # 40 does not fit beside 30, 20 does; 90 is over the budget and alone, even without a width beside it
    assert [r["batch"] for r in got] == [0, 1, 0, 2, 0, 1, 1]


def test_debounced_like_a_clock(spark):
    r = random.Random(3)
    rows = [(k, i, r.randrange(0, 400)) for k in range(5) for i in range(60)] + [(9, 0, 7), (9, 1, 7), (9, 2, 37), (9, 3, 66), (9, 4, 67)]
    got = debounced(spark.createDataFrame(rows, "k int, id int, t long"), "k", "t", "id", 30, 60).collect()
    want = set()
    for k in {x[0] for x in rows}:
        first = last = None
        for t, i in sorted((t, i) for j, i, t in rows if j == k):
            if first is None or t >= min(last + 30, first + 60):
                first = t
            last = t
            want.add((k, i, first))
    assert {(x["k"], x["id"], x["first"]) for x in got} == want and len(got) == len(rows)
    assert all(x["fires"] == min(x["last"] + 30, x["first"] + 60) for x in got)
