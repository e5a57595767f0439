"""Letters of numbers of any size, against the rule in plain Python."""

from doctide.registry import queries


def test_alpha_ids_without_bound(spark, tmp_path):
    ids = [0, 25, 26, 701, 702, 18_277, 18_278, 19_999, 475_253, 475_254, 2**40, 2**63 - 2]
    spark.createDataFrame([(i,) for i in ids], "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    want = {}
    for i in ids:
        n, out = i + 1, ""
        while n > 0:
            r = (n - 1) % 26
            out, n = chr(97 + r) + out, (n - 1 - r) // 26
        want[i] = out
    got = queries()["alpha_ids"](spark, str(tmp_path)).collect()
    assert {r["p_partkey"]: r["alpha"] for r in got} == want and len(got) == len(ids)
