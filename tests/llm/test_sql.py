"""The queries whose rows SQL can state, and the shape of the others."""

import pytest

from tests.oracle import difference

SF = "/root/testdata/sf0.001"


def test_every_operator_is_registered():
    from rasterloom.llm.queries import queries

    assert {q.split("_")[0] for q in queries()} == {f"op{n}" for n in range(1, 14)}


@pytest.mark.parametrize("name", ["op3_chat_format", "op4_quality_rules", "op5_url_filter", "op8_sharding", "op9_decontamination", "op11_centroid_clustering", "op13_hard_negatives"])
def test_equals_sql(spark, name):
    from rasterloom.llm.queries import oracle_sql, queries

    assert difference(spark, queries()[name], oracle_sql()[name], SF) == ""
