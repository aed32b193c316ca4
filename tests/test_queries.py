"""Every query with an oracle against DuckDB on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import pytest

from pointlake.plans import file_queries  # noqa: F401
from pointlake.plans.queries import ORACLES, QUERIES

DATA = Path("/root/testdata/sf0.001")
SOME = ("c0_flagship", "a2_voxelize", "j1_radius_join", "a9_finger_placements", "a12_deepen", "a14_antipodal_label", "i8_minmax_u8", "i5_normals_image", "i10_describe_3", "i10_describe_15", "i12_shadow_intersection", "t5_subsample_indices", "c8_align_scans", "c3_detect", "c4_describe_candidates", "a6_local_frames", "a17_cluster_exclusive", "j9_nearest_centre", "s1_ingest_pcd", "s7_write_instances")


@pytest.mark.skipif(not DATA.is_dir(), reason="the given tables are not here")
@pytest.mark.parametrize("name", SOME)
def test_oracle(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("region", "nation", "lineitem", "events", "documents", "embeddings", "labels"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    text = lambda frame: sorted(map(str, frame[sorted(frame.columns)].astype(str).itertuples(index=False, name=None)))
    got, want = QUERIES[name](spark, str(DATA)).toPandas(), con.execute(ORACLES[name]).df()
    for c in got.columns:
        if str(got[c].dtype) != str(want[c].dtype) and str(got[c].dtype) != "object":
            got[c], want[c] = got[c].astype(float), want[c].astype(float)
    assert text(got) == text(want)


def test_entry_module_imports():
    import __spark_entry__

    known = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(known) and len(known) > 90
