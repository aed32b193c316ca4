"""What depended on the number of files, and clouds that have no samples."""

from __future__ import annotations

import duckdb

from pointlake.plans.queries import ORACLES, QUERIES
from pointlake.sources import cloud_files


def test_partitions_do_not_grow_with_files():
    """every 64 KB made a task, 120,000 of them at 6 GB, each planned in the driver's memory."""
    files = [(f"f{k}", 20_000 + k % 7) for k in range(40_000)] + [("long", 90_000_000)]
    plan = cloud_files.planned(files, 1 << 16)
    assert len(plan) <= 2 * cloud_files.PARTS
    ranges = [r for part in plan for r in part.parts]
    assert sum(b - a for _, a, b in ranges) == sum(n for _, n in files)
    assert sum(a > 0 for _, a, _ in ranges) <= cloud_files.PARTS
    assert [r[0] for r in ranges if r[1] == 0] == [f for f, _ in files]
    few = cloud_files.planned([("a", 100), ("b", 10), ("c", 10)], 40)
    assert [p.parts for p in few] == [[("a", 0, 40)], [("a", 40, 80)], [("a", 80, 100), ("b", 0, 10), ("c", 0, 10)]]


def test_subsample_of_an_even_cloud_without_samples(spark, tmp_path):
    """points of such a cloud were drawn by their ids, where the SQL takes the first points."""
    con = duckdb.connect()
    con.execute(f"""copy (select i AS l_orderkey, 1::BIGINT AS l_partkey, (1 + i % 4)::BIGINT AS l_suppkey, 1::INT AS l_linenumber, 5.0 AS l_quantity, 1000.0 * i AS l_extendedprice, 0.01 AS l_discount
        from range(400) r(i) where i % 4 <> 1 or (i * 10000000000 + 100000 + (1 + i % 4) * 10 + 1) % 101 <> 0) to '{tmp_path}/lineitem.parquet' (format parquet)""")
    con.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet'")
    want = sorted(con.execute(ORACLES["t6_subsample"]).fetchall())
    assert (2, "point") in {r[:2] for r in want} and (4, "sample") in {r[:2] for r in want}
    assert sorted(map(tuple, QUERIES["t6_subsample"](spark, str(tmp_path)).collect())) == want
