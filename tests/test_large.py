"""Places whose products pass 2**31, with few rows."""

import pytest

from rasterloom.operators import resample
from rasterloom.plans import registry
from rasterloom.plans import geo
from rasterloom.sources import derived

#: Lines of tie points over a scene of three lines and two columns, and those that its pixels meet.
LINES, H, W = 1_500_000_000, 3, 2
THERE = (0, 1, 749_999_999, 750_000_000, LINES - 2, LINES - 1)


def test_tie_grid_places_points_far_down(spark):
    ties = spark.createDataFrame([(6_000_002, -80.0, 3.0)], "n long, lat double, lon double")
    (row,) = resample.tie_grid(ties, 9, 666_667, 102_564, 64).collect()
    assert (row["i"], row["j"], row["row_px"], row["col_px"]) == (666_666, 8, 102_563.0, 63.0)


@pytest.fixture
def many_lines(spark, monkeypatch):
    """Latitudes that grow along the lines, longitudes along the columns."""
    ties = spark.createDataFrame([(i * geo.N_RG + j, -89.0 + i / LINES, 10.0 * j) for i in THERE for j in range(geo.N_RG)], "n long, lat double, lon double")
    grid = spark.createDataFrame([(r, k, 10.0 * r + k) for r in range(H) for k in range(W)], "r int, c int, v double")
    for module, name, value in ((geo, "shape", (H, W)), (geo, "n_az", LINES), (derived, "ties", ties), (derived, "grid", grid)):
        monkeypatch.setattr(module, name, lambda *_, value=value: value)


def run(spark, name):
    return [tuple(r) for r in registry.queries()[name](spark, "").collect()]


def test_geolocation_by_very_many_lines(spark, many_lines):
    assert sorted(run(spark, "T3_geolocate")) == [(r, k, -89 + r / 2, 80.0 * k) for r in range(H) for k in range(W)]


def test_along_track_by_very_many_lines(spark, many_lines):
    assert sorted(run(spark, "T4_along_track")) == [(r, -89 + r / 2) for r in range(H)]


def test_forward_grid_by_very_many_lines(spark, many_lines):
    got = run(spark, "T7_forward_grid")
    assert sum(n for _, _, n, _ in got) == H * W and sum(n * mean for _, _, n, mean in got) == pytest.approx(63.0)


def test_georeferenced_by_very_many_lines(spark, many_lines):
    assert sorted((tr, tc, mean) for tr, tc, _, mean in run(spark, "T7_forward_grid")) == sorted(run(spark, "T7_georeferenced"))
