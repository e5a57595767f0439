"""Which stored answers count again."""

import random

import duckdb

from doctide.operators.stores import reusable
from doctide.plans import stores as plans


def test_reusable(spark):
    services = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "service string, rank int")
    cases = {
        1: ("a", True, [], True), 2: ("b", True, [(None, "a", "refused")], True), 3: ("b", True, [], False), 4: ("b", True, [(None, "a", "refused"), (None, "a", "cooling")], False),
        5: ("c", True, [(None, "a", "refused")], False), 6: ("c", True, [(None, "a", "refused"), (None, "b", "refused"), (None, "b", "refused")], True), 7: ("self", True, [], False), 8: ("gone", True, [], False),
        9: ("a", False, [], False), 10: ("runs:a", True, [(None, s, "refused") for s in "abc"] + [("1", "a", "refused")], True), 11: ("runs:a", True, [(None, s, "refused") for s in "abc"] + [("1", "a", "no key")], False),
        12: ("runs:a", True, [(None, s, "refused") for s in "ab"], False), 13: ("b", True, [("1", "a", "refused")], False), 14: (None, True, [], False),
    }
    results = spark.createDataFrame([(u, ok, by) for u, (by, ok, *_) in cases.items()], "unit int, ok boolean, by string")
    passes = spark.createDataFrame([(u, *p) for u, (_, _, ps, _) in cases.items() for p in ps], "unit int, part string, service string, why string")
    got = {r["unit"]: r["reusable"] for r in reusable(results, passes, services).collect()}
    assert got == {u: want for u, (*_, want) in cases.items()}


def test_first_answer_with_odd_rows(spark, tmp_path):
    """Repeated events and services, services without a key, negative and missing numbers, and a user whom none answers."""
    r = random.Random(9)
    events = [(r.choice([None, *range(-6, 30)]), r.choice([None, *range(-3, 0), *range(60)])) for _ in range(80)]
    events = [(e, k if e is None else u) for k, (e, u) in enumerate(events)] + [(40, 26), (40, 26), (41, 26), (42, 24), (43, None)]
    # users that share an event have regions of their own, as what stands first of a tie is open
    events = list({(e, None if u is None else u % 25): (e, u) for e, u in events}.values()) + [(40, 26)]
    services = [(r.choice([None, *range(-4, 40)]), r.choice([None, 30, *range(24)])) for _ in range(90)]
    services = list({s: (s, n) for s, n in services if s is not None}.values()) + [(None, n) for n in (1, 1, 5)] + [(6, 1)] * 2
    spark.createDataFrame(events, "event_id long, user_id long").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    spark.createDataFrame(services, "s_suppkey long, s_nationkey int").coalesce(1).write.parquet(str(tmp_path / "supplier.parquet"))
    con = duckdb.connect()
    for name in ("events", "supplier"):
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    want = con.execute(plans.ORACLE["fallback_first"]).fetchall()
    assert {r[1] is None for r in want} == {True, False}
    key = lambda t: tuple((v is None, v or 0) for v in t)
    assert sorted(map(tuple, plans.fallback_first(spark, str(tmp_path)).collect()), key=key) == sorted(want, key=key)
