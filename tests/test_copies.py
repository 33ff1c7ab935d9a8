"""Sites at the same place, many times: results go to all of them."""

from landrank import catalog


def test_site_rules_with_copies_of_places(spark, tmp_path):
    keys = [1 + 3000 * i for i in range(40)] + [6 + 3000 * i for i in range(40)] + [2, 1501]
    rows = [(k, "BUILDING" if k % 2 else "MACHINERY") for k in keys]
    spark.createDataFrame(rows, "c_custkey long, c_mktsegment string").write.parquet(str(tmp_path / "customer.parquet"))
    at = {k: (500000.0 + k * 53 % 1000, 4000000.0 - k * 101 % 1500) for k in keys}
    near = lambda a, b, d: (at[a][0] - at[b][0]) ** 2 + (at[a][1] - at[b][1]) ** 2 <= d * d
    got = {r.site_id: r.satisfied for r in catalog.QUERIES["sites_paired"](spark, str(tmp_path)).collect()}
    assert got == {k: any(near(k, o, 50.0) for o in keys if o % 2 == 0) for k in keys if k % 2}
    confirmed = [k for k in keys if k % 5 == 1]
    groups = []
    for k in confirmed:
        mine = [g for g in groups if any(near(k, o, 24.0) for o in g)]
        groups = [g for g in groups if g not in mine] + [sum(mine, [k])]
    got = {r.cluster: r.sites for r in catalog.QUERIES["site_clusters"](spark, str(tmp_path)).collect()}
    assert got == {min(g): len(g) for g in groups}
