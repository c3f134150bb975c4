"""Every registered query against its SQL, and which have none."""

import pytest

from rasterloom.plans import registry
from tests.oracle import difference

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, name):
    assert difference(spark, registry.queries()[name], registry.oracle_sql()[name], SF) == ""


def test_only_these_have_no_sql():
    assert set(registry.queries()) - set(registry.oracle_sql()) == {"I3_rover_path"}


def test_coverage():
    have = {q.split("_")[0] for q in registry.queries()}
    want = {f"A{i}" for i in range(1, 17)} | {f"B{i}" for i in range(1, 32)} | {f"C{i}" for i in range(1, 14)} | {f"D{i}" for i in range(1, 12)}
    want |= {f"F{i}" for i in range(1, 23)} | {f"G{i}" for i in range(1, 16)} | {f"W{i}" for i in range(1, 21)} | {f"T{i}" for i in (1, 2, 3, 4, 5, 6, 8, 10, 11, 12)}
    want |= {"I1", "I2", "J1", "J2", "J3", "J4", "K1", "K2", "K3", "K4", "K5", "K6"}
    assert want <= have


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["r", "c", "score", "n_valid"] and df.count() > 0


def test_subsample_is_stable(spark):
    a, b = (sorted(registry.queries()["J3_subsample"](spark, SF).collect()) for _ in range(2))
    assert a == b and len(a) == 5000
