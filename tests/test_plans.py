"""What the physical plans may and may not hold."""

import pytest

from deckloom.plans import QUERIES

#: Queries that measure whole images on Arrow batches; all others stay in the JVM.
PYTHON = {
    "s4_decoded_images", "i1_structure_metrics", "i5_ink_components", "i6_band_energy", "g5_structure_gates", "g10_end_badge",
    "g11_audit_by_mode", "a1_corpus_summary", "a13_scoreboard", "j8_batch_against_baseline", "o1_corpus_listing",
    "flow_score", "w5_edge_runs", "i2_flat_edge_share", "i3_black_inset", "i4_trim_rectangle", "g8_matte_gate",
    "a8_colour_profile", "a9_leading_mana", "g6_colour_identity",
}
STREAMS = {"t1_live_progress", "t2_upsert_stream", "t3_first_seen_memo"}


def plan(spark, sf, name):
    return QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - STREAMS))
def test_plan(spark, sf, name):
    text = plan(spark, sf, name)
    assert "CartesianProduct" not in text
    assert "BatchEvalPython" not in text and "MapInPandas" not in text
    assert ("ArrowEvalPython" in text) == (name in PYTHON)
    if name not in ("a4_compliance", "flow_compliance"):  # one row joined to one row
        assert "BroadcastNestedLoopJoin" not in text


def test_columns_are_pruned_at_the_scan(spark, sf):
    text = plan(spark, sf, "a5_job_progress")
    assert "l_extendedprice" not in text and "l_comment" not in text


def test_image_queries_do_not_shuffle_pixels(spark, sf):
    """One exchange at most: the spreading of the small test file over the cores."""
    for name in ("i1_structure_metrics", "i4_trim_rectangle", "i6_band_energy", "g9_obstruction_gate", "g1_layout_audit"):
        text = plan(spark, sf, name)
        assert "hashpartitioning" not in text and text.count("Exchange") <= 1, name


def test_group_limit_before_the_shuffle(spark, sf):
    assert plan(spark, sf, "w6_first_exemplars").count("WindowGroupLimit") == 2
