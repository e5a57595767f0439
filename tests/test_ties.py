"""Ties against a plain loop, and a chain of them."""

import random

from doctide.operators import ties
from doctide.operators.ties import tied


def plain(members, ties):
    scale, own = ({m: o for m, o, *_ in members} for _ in range(2))
    floor, first, rounds = {m: f for m, _, f, _ in members}, {m: p for m, *_, p in members}, dict.fromkeys(own, 0)
    while True:
        caps = {}
        for on in ties.values():
            for o in on if len(on) > 1 else ():
                least = min(scale[q] if first[q] <= first[o] else own[q] for q in on)
                if scale[o] > max(least, floor[o]) + 1e-9:
                    caps[o] = min(caps.get(o, 1e9), max(least, floor[o]))
        if not caps:
            return sorted((m, scale[m], rounds[m]) for m in own)
        for m, c in caps.items():
            scale[m], rounds[m] = c, rounds[m] + 1


def found(spark, members, ties):
    t = spark.createDataFrame([(k, m) for k, on in ties.items() for m in on], "tie string, member int")
    return sorted(map(tuple, tied(spark.createDataFrame(members, "member int, own double, floor double, first int"), t).collect()))


def test_a_chain_of_ties(spark):
    members = [(1, 1.0, 0.1, 1), (2, 2.0, 0.1, 1), (3, 3.0, 0.1, 1), (4, 4.0, 2.5, 1), (5, 0.2, 0.1, 2), (6, 9.0, 0.1, 1), (7, 5.0, 0.1, 1)]
    ties = {"a": [1, 2], "b": [2, 3], "c": [3, 4], "d": [7], "e": [1, 1, 1]}
    got = found(spark, members, ties)
    assert got == plain(members, {k: sorted(set(v)) for k, v in ties.items()})
    assert got == [(1, 1.0, 0), (2, 1.0, 1), (3, 1.0, 2), (4, 2.5, 2), (5, 0.2, 0), (6, 9.0, 0), (7, 5.0, 0)]
    # along a chain the least goes on by one tie a round
    chain = [(i, float(10 + i), 0.1, 1) for i in range(5)]
    links = {f"t{i}": [i, i + 1] for i in range(4)}
    assert found(spark, chain, links) == plain(chain, links) == [(0, 10.0, 0), (1, 10.0, 1), (2, 10.0, 2), (3, 10.0, 3), (4, 10.0, 4)]
    # a later page's member counts with its own size, not with one that it was lowered to
    later = [(1, 2.0, 0.1, 1), (2, 3.0, 0.1, 2), (3, 1.0, 0.1, 2)]
    assert found(spark, later, {"a": [1, 2], "b": [2, 3]}) == [(1, 2.0, 0), (2, 1.0, 1), (3, 1.0, 0)] == plain(later, {"a": [1, 2], "b": [2, 3]})


def test_random_ties(spark):
    r = random.Random(2)
    members = [(i, float(r.randrange(1, 60)), float(r.randrange(1, 20)), r.randrange(4)) for i in range(60)]
    ties = {f"t{k}": sorted(r.sample(range(60), r.randrange(1, 5))) for k in range(40)}
    assert found(spark, members, ties) == plain(members, ties)


def test_rounds_look_at_ties_that_changed(spark, monkeypatch):
    """A chain beside many ties that hold from the first round on: later rounds read the chain's ties alone."""
    members = [(i, float(10 + i), 0.1, 1) for i in range(12)] + [(100 + i, 5.0, 0.1, 1) for i in range(400)]
    links = {f"t{i}": [i, i + 1] for i in range(11)} | {f"s{i}": [100 + i, 101 + i] for i in range(399)}
    sizes, caps = [], ties._caps
    monkeypatch.setattr(ties, "_caps", lambda met: sizes.append(met.count()) or caps(met))
    assert found(spark, members, links) == plain(members, links)
    assert len(sizes) == 12 and sizes[0] == 820 and max(sizes[1:]) <= 44
