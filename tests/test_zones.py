"""Zone maps: bounds that never lie, scans that open less, rows that do not change."""

import math

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from flowloom.sources import zones as Z

NAN = math.nan


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Two sorted files of ten row groups each, one without statistics, one that lacks a column."""
    path = tmp_path_factory.mktemp("zones")
    for f in range(2):
        k = list(range(f * 1000, f * 1000 + 1000))
        x = [NAN if i % 7 == 0 else None if i % 11 == 0 else i / 4 for i in k]
        pq.write_table(pa.table({"k": k, "x": pa.array(x, pa.float64(), from_pandas=False), "s": [str(i) for i in k]}), path / f"a{f}.parquet", row_group_size=100)
    pq.write_table(pa.table({"k": [5, 5000], "x": [1.0, 2.0]}), path / "blind.parquet", write_statistics=False)
    pq.write_table(pa.table({"k": [6, 6000]}), path / "narrow.parquet")
    return str(path)


def plain(folder, lo, hi):
    out = []
    for f in ("a0", "a1", "blind", "narrow"):
        t = pq.read_table(f"{folder}/{f}.parquet").to_pydict()
        for i, k in enumerate(t["k"]):
            x = t["x"][i] if "x" in t else None
            if (lo is None or k >= lo) and (hi is None or k <= hi):
                out.append((float(k), x if x is not None and math.isfinite(x) else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("lo,hi", [(250, 260), (None, 5), (1990, None), (None, None), (7000, 8000)])
def test_same_rows_as_a_plain_filter(spark, folder, lo, hi):
    zones = Z.zone_maps(spark, folder)
    got = sorted(((r.k, r.x) for r in Z.zoned_scan(zones, ["k", "x"], {"k": (lo, hi)}).collect()), key=str)
    assert got == plain(folder, lo, hi)


def test_fewer_bytes(spark, folder):
    zones = Z.zone_maps(spark, folder, "a*.parquet")
    cost = {r.column: r for r in Z.scan_bytes(zones, ["x"], {"k": (250, 260)}).collect()}
    assert set(cost) == {"k", "x"} and all((r.n_groups, r.n_kept) == (20, 1) for r in cost.values())
    assert all(r.bytes_kept < r.bytes_all / 10 for r in cost.values())


def test_missing_statistics_and_nan_never_prune(spark, folder):
    zones = Z.zone_maps(spark, folder)
    blind = zones.where("file = 'blind.parquet'").collect()
    assert len(blind) == 2 and all(r.low is None and r.high is None for r in blind)
    kept = Z.marked_groups(zones, {"k": (7000, 8000), "x": (0, 1)}).where("kept").collect()
    assert [r.path.endswith("blind.parquet") for r in kept] == [True]
    assert all(r.low is None for r in zones.where("column = 's'").collect())


def test_bounds_round_outward():
    class Stats:
        has_null_count, null_count, has_min_max = True, 0, True

        def __init__(self, low, high):
            self.min, self.max = low, high

    big = 2**53 + 1
    _, low, high = Z._bounds(Stats(big, big))
    assert low <= big <= high and low < high
    assert Z._bounds(Stats(NAN, 1.0)) == (0, None, None) and Z._bounds(Stats(1.0, NAN)) == (0, None, None)
    assert Z._bounds(Stats(True, True)) == (0, None, None) and Z._bounds(None) == (None, None, None)


def test_all_missing_group_is_left_out(spark, tmp_path):
    pq.write_table(pa.table({"k": pa.array([None, None], pa.int64())}), tmp_path / "n.parquet")
    zones = Z.zone_maps(spark, str(tmp_path))
    assert Z.marked_groups(zones, {"k": (0, None)}).collect()[0].kept is False
    assert Z.zoned_scan(zones, ["k"], {"k": (0, None)}).count() == 0
    assert Z.zoned_scan(zones, ["k"], {}).count() == 2
