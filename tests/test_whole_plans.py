"""Queries that cover every row and the whole text."""

from chronofold.plans import catalog
from chronofold.plans.segments import _base, grid
from chronofold.sources import tables

SF = "/root/testdata/sf0.001"


def test_every_window_is_resolved(spark):
    windows = {(r.media_id, r.clip) for r in grid(_base(spark, SF)[2]).collect()}
    assert {(r.media_id, r.clip) for r in catalog.QUERIES["i12_resolve_every_window"](spark, SF).collect()} == windows


def test_whole_texts_make_names_and_titles(spark):
    texts = {r.item_id: r.text for r in tables.read(spark, SF, "benchmark").collect()}
    names = {r.item_id: r.name for r in catalog.QUERIES["x8_whole_publish_name"](spark, SF).collect()}
    assert set(names) == set(texts) and all(texts[k].split()[-1].strip('.:*?"<>|/\\') in names[k] for k in texts)
    long = {r.item_id for r in catalog.QUERIES["f8_whole_title_issues"](spark, SF).collect() if r.issue == "title too long"}
    assert long == {k for k, t in texts.items() if k % 5 and len(t.strip()) > 70}


def test_adjusting_reads_its_tables_once(spark):
    for name in ("c3_f10_f11_apply_adjustments", "c4_f12_f18_apply_persona"):
        assert "conversations.parquet" not in catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
