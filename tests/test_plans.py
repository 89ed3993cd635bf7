"""The physical plans keep the shape they were designed for."""

import re

from pyspark.sql import functions as F

from brightloom.operators import charts, duplicates, missing
from brightloom.plans import recommend
from catalog.queries import QUERIES, events, table


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_forward_fill_shuffles_the_table_once(spark, data_folder):
    df = missing.forward_fill(events(spark, data_folder), ["value"], ["ts", "event_id"], ["user_id"], 100)
    plan = plan_of(df)
    wide = re.findall(r"Exchange hashpartitioning\(_group#\d+, _stretch#\d+", plan)
    assert len(wide) <= 2       # rows once, and the partial ends; the join adds none


def test_ordered_duplicates_aggregate_before_the_shuffle(spark, data_folder):
    df = table(spark, data_folder, "documents").select("doc_id", "text")
    plan = plan_of(duplicates.remove(df, "last", ["doc_id"]))
    assert "partial_max" in plan and "Window" not in plan


def test_top_k_is_limited_before_the_shuffle(spark, data_folder):
    plan = plan_of(QUERIES["cosine_topk"](spark, data_folder))
    assert re.search(r"WindowGroupLimit .*Partial", plan)


def test_previews_limit_hot_groups(spark, data_folder):
    df = table(spark, data_folder, "documents").select("doc_id", "text")
    plan = plan_of(duplicates.preview(df, "first", ["doc_id"]))
    assert re.search(r"WindowGroupLimit .*Partial", plan)


def test_only_needed_columns_are_read(spark, data_folder):
    df = table(spark, data_folder, "lineitem")
    scan = re.findall(r"ReadSchema: struct<([^>]*)>", plan_of(missing.drop_missing(df, "l_tax").select("l_tax")))
    assert scan == ["l_tax:double"]
    plan = plan_of(charts.histogram(df, "l_tax"))
    assert "l_comment" not in plan and "l_quantity" not in plan
    assert "PushedFilters: [IsNotNull(l_tax)]" in plan


def test_candidates_are_a_broadcast_equi_join(spark):
    from tests.test_recommend import profile

    plan = plan_of(recommend.candidates(profile(spark)))
    assert "BroadcastHashJoin" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_keep_in_range_is_one_scan(spark, data_folder):
    plan = plan_of(QUERIES["keep_in_range"](spark, data_folder))
    assert "Exchange" not in plan


def test_imputation_is_a_projection(spark, data_folder):
    df = missing.impute(table(spark, data_folder, "part"), "p_size", "constant", 1)
    assert "Exchange" not in plan_of(df) and df.where(F.col("p_size").isNull()).count() == 0
