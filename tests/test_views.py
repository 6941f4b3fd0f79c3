"""Shapes of the derived relations."""

from __future__ import annotations

from tessera.sources import views as v

SF = "/root/testdata/sf0.001"


def test_columns(spark):
    assert v.g_nodes(spark, SF).columns == ["id", "type", "name", "module", "score"]
    assert v.g_edges(spark, SF).columns == ["from_id", "to_id", "type", "confidence", "weight"]
    assert v.s_edges(spark, SF).count() == 25
    assert v.u_edges(spark, SF).count() <= 64
    assert v.hrefs(spark, SF).filter("href = ''").count() == 0
    assert v.lines(spark, SF).filter("pos < 1").count() == 0
