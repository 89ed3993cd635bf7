"""The registered queries: each runs one operator over whole tables of a data folder.

The test tables hold no NULL, so gaps are made by rule (``id % n``) on both the Spark
and the SQL side.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brightloom.errors import ColumnNotFound, EmptyDataset
from brightloom.functions.columns import col, numeric_columns, require
from brightloom.functions.runtime import shared_folder
from brightloom.functions.values import broadcast_if_small
from brightloom.models import agglomerate, neighbours, range_finder, survival, target_codes
from brightloom.operators import (
    audit_log, charts, columns, correlation, duplicates, encoding, many_profiles, missing, outliers, profile,
    quality, scaling,
)
from brightloom.plans import job, knowledge, recommend, training
from brightloom.plans.blueprint import blueprint
from brightloom.plans.recipe import FittedRecipe, Recipe
from brightloom.sources import file_audit
from brightloom.sources.tables import export_table, load_table

QUERIES = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def events(spark, folder) -> DataFrame:
    """Events with gaps in value (every 7th) and event_type (every 5th)."""
    return table(spark, folder, "events").select(
        "event_id", "ts", "user_id",
        F.when(col("event_id") % 5 != 0, col("event_type")).alias("event_type"),
        F.when(col("event_id") % 7 != 0, col("value")).alias("value"), "props",
    )


def poor_documents(spark, folder) -> DataFrame:
    """Documents without their key, a third of the languages missing: duplicates, gaps, outliers."""
    return table(spark, folder, "documents").select(
        "text", F.when(col("doc_id") % 3 != 0, col("lang")).alias("lang"), "source", "n_chars"
    )


def rounded(df: DataFrame, digits: int = 6, *names: str) -> DataFrame:
    """Round doubles so that the order of summation does not show."""
    return df.select(*[
        F.round(col(f.name), digits).alias(f.name)
        if f.dataType.typeName() == "double" and (not names or f.name in names) else col(f.name)
        for f in df.schema
    ])


def spread(previewed: DataFrame) -> DataFrame:
    """A preview as rows: side, affected_rows and the sampled columns."""
    before = previewed.select("affected_rows", F.lit("before").alias("side"), F.inline("sample_before"))
    after = previewed.select("affected_rows", F.lit("after").alias("side"), F.inline("sample_after"))
    return before.unionByName(after, allowMissingColumns=True)


# -- profiling -----------------------------------------------------------------
@query
def inspect_columns(spark, folder):
    return profile.inspect(table(spark, folder, "lineitem"))


@query
def inspect_documents(spark, folder):
    return profile.inspect(poor_documents(spark, folder))


@query
def inspect_approximate(spark, folder):
    return profile.inspect(profile.TableStats(table(spark, folder, "lineitem"), exact=False))


@query
def table_shape(spark, folder):
    return profile.shape(table(spark, folder, "lineitem"))


@query
def data_volume(spark, folder):
    return profile.data_volume(table(spark, folder, "documents"))


@query
def column_list(spark, folder):
    """Column names with the rows that hold a value there."""
    df = events(spark, folder)
    return profile.column_list(df).join(
        profile.inspect(df).select("name", "missing"), "name"
    )


@query
def column_search(spark, folder):
    return profile.find_columns(profile.inspect(table(spark, folder, "orders")), "ORDER")


@query
def columns_by_class(spark, folder):
    inspected = profile.with_display_class(profile.inspect(events(spark, folder)))
    return inspected.select("name", "type_class", "missing")


@query
def columns_of_one_class(spark, folder):
    inspected = profile.inspect(table(spark, folder, "part"))
    named = profile.columns_of_class(inspected, "categorical")
    return inspected.join(named, "name", "left_semi").select("name", "unique")


@query
def numeric_moments(spark, folder):
    found = profile.skew_and_variance(events(spark, folder).select("user_id", "value"))
    return rounded(found, 5)


@query
def numeric_moments_documents(spark, folder):
    return rounded(profile.skew_and_variance(table(spark, folder, "documents").select("n_chars")), 4)


@query
def column_classes(spark, folder):
    return profile.column_classes(table(spark, folder, "orders"))


@query
def target_candidates(spark, folder):
    return profile.column_classes(table(spark, folder, "labels")).select("name", "is_target_candidate")


@query
def datetime_columns(spark, folder):
    orders = table(spark, folder, "orders").select(
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("iso"),
        F.date_format("o_orderdate", "MM/dd/yyyy").alias("american"),
        "o_orderpriority", "o_orderdate", "o_orderkey",
    )
    return profile.column_classes(orders).select("name", "is_datetime", "is_categorical")


@query
def first_rows(spark, folder):
    return profile.first_rows(events(spark, folder), 20, ["event_id"])


@query
def class_imbalance(spark, folder):
    return quality.class_imbalance(table(spark, folder, "labels"), "quality")


@query
def class_balance_bars(spark, folder):
    return charts.class_bars(table(spark, folder, "orders"), "o_orderpriority")


@query
def quality_score(spark, folder):
    return quality.quality_score(poor_documents(spark, folder)).select(
        "score", F.array_join("warnings", " | ").alias("warnings")
    )


@query
def quality_penalties(spark, folder):
    return rounded(quality.penalties(poor_documents(spark, folder)))


@query
def quality_report(spark, folder):
    report = quality.quality_report(poor_documents(spark, folder), "documents", 0, "2026-01-01T00:00:00")
    missing_one, outlier_one = F.col("missing.details")[0], F.col("outliers.details")[0]
    return report.select(
        F.col("summary.name").alias("name"), F.col("summary.total_rows").alias("total_rows"),
        F.col("summary.total_columns").alias("total_columns"),
        F.col("duplicates.duplicate_rows").alias("duplicate_rows"),
        F.col("duplicates.duplicate_percent").alias("duplicate_percent"),
        F.col("missing.columns_with_missing").alias("columns_with_missing"),
        missing_one["column"].alias("missing_column"),
        missing_one["missing_count"].alias("missing_count"),
        missing_one["recommended_strategy"].alias("missing_strategy"),
        F.col("outliers.columns_with_outliers").alias("columns_with_outliers"),
        outlier_one["column"].alias("outlier_column"),
        outlier_one["outliers_count"].alias("outliers_count"),
        outlier_one["upper_bound"].alias("upper_bound"),
        F.col("quality_score.score").alias("score"),
        F.size("quality_score.warnings").cast("long").alias("warnings"),
    )


@query
def answer_missing(spark, folder):
    return recommend.answer(events(spark, folder), "Which values are missing?")


@query
def answer_outliers(spark, folder):
    return recommend.answer(events(spark, folder), "Show the outlier columns")


@query
def answer_models(spark, folder):
    return recommend.answer(
        table(spark, folder, "labels").select("quality", "toxic"), "Suggest a model to train"
    )


@query
def answer_summary(spark, folder):
    return recommend.answer(poor_documents(spark, folder), "hello").withColumn(
        "targets", F.array_join("targets", ",")
    )


# -- duplicates ----------------------------------------------------------------
@query
def dup_detect(spark, folder):
    return duplicates.detect(table(spark, folder, "documents").drop("doc_id"))


@query
def dup_detect_wide(spark, folder):
    return duplicates.detect(table(spark, folder, "lineitem"))


@query
def dup_remove_first(spark, folder):
    return duplicates.remove(table(spark, folder, "documents").drop("doc_id"), "first")


@query
def dup_remove_none(spark, folder):
    return duplicates.remove(table(spark, folder, "documents").drop("doc_id"), "none")


@query
def dup_keep_first_ordered(spark, folder):
    return duplicates.remove(table(spark, folder, "documents").select("doc_id", "text"), "first", ["doc_id"])


@query
def dup_keep_last_ordered(spark, folder):
    return duplicates.remove(table(spark, folder, "documents").select("doc_id", "text"), "last", ["doc_id"])


@query
def dup_preview_first(spark, folder):
    df = table(spark, folder, "documents").select("doc_id", "text")
    return spread(duplicates.preview(df, "first", ["doc_id"]))


@query
def dup_preview_last(spark, folder):
    df = table(spark, folder, "documents").select("doc_id", "text")
    return spread(duplicates.preview(df, "last", ["doc_id"]))


@query
def dup_preview_none(spark, folder):
    df = table(spark, folder, "documents").select("doc_id", "text")
    return spread(duplicates.preview(df, "none", ["doc_id"]))


@query
def dup_rows_remaining(spark, folder):
    df = table(spark, folder, "documents").drop("doc_id")
    return spark.createDataFrame(
        [(keep, duplicates.rows_remaining(df, keep)) for keep in duplicates.KEEP],
        "keep string, rows long",
    )


# -- missing values ------------------------------------------------------------
@query
def missing_scan(spark, folder):
    return missing.recommend(events(spark, folder))


@query
def missing_kpis(spark, folder):
    return missing.kpis(events(spark, folder))


@query
def impute_mean(spark, folder):
    return rounded(missing.impute(events(spark, folder), "value", "mean").select("event_id", "value"))


@query
def impute_median(spark, folder):
    return rounded(missing.impute(events(spark, folder), "value", "median").select("event_id", "value"))


@query
def impute_mode(spark, folder):
    return missing.impute(events(spark, folder), "event_type", "mode").select("event_id", "event_type")


@query
def impute_constant(spark, folder):
    filled = missing.impute(events(spark, folder), "value", "constant", "-1")
    return missing.impute(filled, "event_type", "constant", "unknown").select(
        "event_id", "event_type", "value"
    )


@query
def drop_missing(spark, folder):
    return missing.impute(events(spark, folder), "value", "drop")


@query
def missing_preview(spark, folder):
    df = events(spark, folder).select("event_id", "user_id", "value")
    return rounded(spread(missing.preview(df, "value", "median", order_by=["event_id"])))


@query
def missing_preview_drop(spark, folder):
    df = events(spark, folder).select("event_id", "event_type")
    return spread(missing.preview(df, "event_type", "drop", order_by=["event_id"]))


@query
def forward_fill(spark, folder):
    return missing.forward_fill(
        events(spark, folder), ["value", "event_type"], ["ts", "event_id"], ["user_id"],
        rows_per_stretch=1000,
    ).select("event_id", "user_id", "value", "event_type")


@query
def lag_features(spark, folder):
    """Two earlier values of each user's events, as a time-series model gets them."""
    df = events(spark, folder).select("event_id", "ts", "user_id", "value")
    return missing.lags(df, "value", 2, ["ts", "event_id"], ["user_id"], rows_per_stretch=1000).drop("ts")


@query
def forward_fill_ties(spark, folder):
    """One group whose first order column has a single value: stretches are cut by the whole order."""
    df = events(spark, folder).withColumn("day", F.lit(1))
    filled = missing.forward_fill(df, ["value", "event_type"], ["day", "event_id"], rows_per_stretch=500)
    return filled.select("event_id", "value", "event_type")


@query
def lag_features_ties(spark, folder):
    df = events(spark, folder).select("event_id", F.lit(1).alias("day"), "value")
    return missing.lags(df, "value", 3, ["day", "event_id"], rows_per_stretch=500).drop("day")


# -- outliers ------------------------------------------------------------------
@query
def outliers_iqr(spark, folder):
    return outliers.detect(events(spark, folder), "iqr")


@query
def outliers_iqr_documents(spark, folder):
    return outliers.detect(table(spark, folder, "documents"), "iqr")


@query
def outliers_zscore(spark, folder):
    return outliers.detect(events(spark, folder), "zscore")


@query
def outliers_iforest(spark, folder):
    return outliers.detect(events(spark, folder), "iforest")


@query
def outlier_remove(spark, folder):
    return outliers.treat(events(spark, folder), "value", "iqr", "remove")


@query
def outlier_remove_zscore(spark, folder):
    return outliers.treat(table(spark, folder, "documents"), "n_chars", "zscore", "remove").select(
        "doc_id", "n_chars"
    )


@query
def forest_ranges(spark, folder):
    """What the ranges of the forests of all numbers of lineitem hold together, and whether the cut keeps its share."""
    lines = table(spark, folder, "lineitem")
    stats = profile.TableStats(lines)
    found = outliers.forest.ranges_of(lines, stats.numeric, [stats.present(c) for c in stats.numeric])
    counted = outliers.forest.fit_all(lines, stats.numeric, 0.05, {c: stats.present(c) for c in stats.numeric})
    rows = []
    for c, part in found.groupby("c"):
        name = stats.numeric[c]
        apart = bool((part["low"].to_numpy()[1:] > part["high"].to_numpy()[:-1]).all())
        rows.append((name, int(part["n"].sum()), float(part["low"].min()), float(part["high"].max()), apart, counted[name].outliers <= 0.05 * stats.present(name)))
    return spark.createDataFrame(rows, "name string, held long, least double, most double, apart boolean, within_share boolean")


@query
def outlier_remove_iforest(spark, folder):
    return outliers.treat(events(spark, folder), "value", "iforest", "remove")


@query
def outlier_cap(spark, folder):
    return rounded(outliers.treat(events(spark, folder), "value", "iqr", "cap").select("event_id", "value"))


@query
def outlier_cap_zscore(spark, folder):
    return rounded(outliers.treat(events(spark, folder), "value", "zscore", "cap").select("event_id", "value"))


@query
def outlier_keep(spark, folder):
    return outliers.treat(events(spark, folder), "value", "iqr", "keep").select("event_id", "value")


@query
def keep_in_range(spark, folder):
    return outliers.keep_between(events(spark, folder), "value", 10.0, 100.0).select("event_id", "value")


@query
def outlier_recommend(spark, folder):
    return outliers.recommend(events(spark, folder))


@query
def outlier_recommend_documents(spark, folder):
    return outliers.recommend(table(spark, folder, "documents"))


@query
def outlier_preview(spark, folder):
    df = events(spark, folder).select("event_id", "value")
    return rounded(spread(outliers.preview(df, "value", "iqr", "cap", order_by=["event_id"])))


@query
def outlier_total(spark, folder):
    return outliers.total_outliers(outliers.detect(events(spark, folder), "iqr"))


# -- encoding ------------------------------------------------------------------
@query
def encode_label(spark, folder):
    return encoding.label_encode(events(spark, folder), "event_type").select("event_id", "event_type")


@query
def encode_label_many_values(spark, folder):
    return encoding.label_encode(table(spark, folder, "customer"), "c_name").select("c_custkey", "c_name")


@query
def encode_label_numbers(spark, folder):
    return encoding.label_encode(table(spark, folder, "orders"), "o_totalprice").select(
        "o_orderkey", "o_totalprice"
    )


@query
def encode_onehot(spark, folder):
    return encoding.onehot_encode(events(spark, folder), "event_type").drop("ts", "props")


@query
def encode_ordinal_unknown(spark, folder):
    customers = table(spark, folder, "customer")
    known = encoding.code_map(customers.where("c_mktsegment <> 'MACHINERY'"), "c_mktsegment")
    return encoding.ordinal_encode(customers, "c_mktsegment", known).select("c_custkey", "c_mktsegment")


@query
def encode_recommend(spark, folder):
    return encoding.recommend(table(spark, folder, "part"))


@query
def encode_preview_label(spark, folder):
    return spread(encoding.preview(events(spark, folder), "event_type", "label", ["event_id"]).withColumn(
        "sample_before", F.transform("sample_before", lambda x: F.struct(
            x["event_id"].alias("event_id"), x["event_type"].alias("text")))
    ))


@query
def encode_preview_onehot(spark, folder):
    return spread(encoding.preview(
        table(spark, folder, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", "onehot",
        ["o_orderkey"],
    ))


# -- scaling -------------------------------------------------------------------
@query
def scale_standard(spark, folder):
    df = table(spark, folder, "part")
    return rounded(scaling.scale(df, ["p_size", "p_retailprice"], "standard").select(
        "p_partkey", "p_size", "p_retailprice"))


@query
def scale_minmax(spark, folder):
    return rounded(scaling.scale(table(spark, folder, "customer"), ["c_acctbal"], "minmax").select(
        "c_custkey", "c_acctbal"))


@query
def scale_robust(spark, folder):
    return rounded(scaling.scale(events(spark, folder), ["value"], "robust").select("event_id", "value"))


@query
def scale_preview(spark, folder):
    df = events(spark, folder).select("event_id", "value")
    return rounded(spread(scaling.preview(df, ["value"], "standard", ["event_id"])))


# -- columns -------------------------------------------------------------------
@query
def drop_rename_select(spark, folder):
    df = columns.drop(table(spark, folder, "orders"), ["o_orderdate", "o_custkey"])
    return columns.rename(df, "o_totalprice", "total price")


@query
def cast_int(spark, folder):
    texts = columns.cast(table(spark, folder, "part").select("p_partkey", "p_size"), "p_size", "string")
    return columns.cast(texts, "p_size", "int")


@query
def cast_float(spark, folder):
    texts = columns.cast(table(spark, folder, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", "string")
    return columns.cast(texts, "c_acctbal", "float")


@query
def cast_string(spark, folder):
    return columns.cast(
        table(spark, folder, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "string"
    )


@query
def cast_datetime(spark, folder):
    texts = table(spark, folder, "orders").select(
        "o_orderkey", F.date_format("o_orderdate", "MM/dd/yyyy").alias("day"))
    return columns.cast(texts, "day", "datetime").select(
        "o_orderkey", F.date_format("day", "yyyy-MM-dd HH:mm:ss").alias("day"))


@query
def cast_check(spark, folder):
    part = table(spark, folder, "part").select(
        F.when(col("p_partkey") % 4 != 0, col("p_retailprice").cast("string"))
        .otherwise(col("p_brand")).alias("mixed"), "p_retailprice", "p_size",
    )
    checks = [columns.cast_check(part, "mixed", "float"), columns.cast_check(part, "p_retailprice", "int"),
              columns.cast_check(part, "p_size", "int"), columns.cast_check(part, "mixed", "string")]
    result = checks[0]
    for check in checks[1:]:
        result = result.unionByName(check)
    return result


# -- correlation and charts ------------------------------------------------------
@query
def corr_matrix(spark, folder):
    return rounded(correlation.matrix_table(table(spark, folder, "part")))


@query
def corr_long(spark, folder):
    return correlation.heatmap(table(spark, folder, "lineitem"))


@query
def corr_long_with_gaps(spark, folder):
    df = events(spark, folder).select(
        "user_id", "value", F.when(col("event_id") % 3 != 0, col("value") + col("user_id")).alias("sum"),
        F.lit(1).alias("constant"),
    )
    return correlation.heatmap(df)


@query
def corr_high_pairs(spark, folder):
    df = table(spark, folder, "lineitem").select(
        "l_quantity", "l_extendedprice", (col("l_extendedprice") * (1 - col("l_discount"))).alias("net")
    )
    return correlation.high_pairs(df, 0.9)


@query
def corr_target_rank(spark, folder):
    return correlation.target_ranking(table(spark, folder, "lineitem"), "l_extendedprice")


@query
def histogram(spark, folder):
    return charts.histogram(events(spark, folder), "value", 10)


@query
def histogram_fine(spark, folder):
    return charts.histogram(table(spark, folder, "lineitem"), "l_extendedprice", 40)


@query
def boxplot(spark, folder):
    drawn = charts.boxplot(events(spark, folder), "value", ["event_id"])
    return drawn.withColumn("outliers_sample", F.size("outliers_sample").cast("long"))


@query
def boxplot_points(spark, folder):
    drawn = charts.boxplot(table(spark, folder, "documents"), "n_chars", ["doc_id"])
    return drawn.select("column", F.posexplode("outliers_sample").alias("position", "point"))


@query
def missing_heatmap(spark, folder):
    return charts.missing_heatmap(events(spark, folder), ["event_id"])


@query
def scatter_sample(spark, folder):
    return charts.scatter(events(spark, folder), "user_id", "value", ["event_id"])


# -- recipes -------------------------------------------------------------------
def cleaning_recipe() -> Recipe:
    return (
        Recipe()
        .then("duplicates", keep="first")
        .then("missing", column="value", strategy="median")
        .then("missing", column="event_type", strategy="mode")
        .then("outliers", column="value", method="iqr", action="cap")
        .then("column_encode", column="event_type", method="label")
        .then("column_rename", old_name="props", new_name="details")
        .then("scaling", columns=["value"], method="standard")
    )


@query
def recipe_replay(spark, folder):
    return rounded(cleaning_recipe().apply(events(spark, folder)).drop("ts"))


@query
def recipe_undo(spark, folder):
    return rounded(cleaning_recipe().undo().undo().apply(events(spark, folder)).drop("ts"))


@query
def recipe_frozen(spark, folder):
    """Fitted on the events of even users, applied to all."""
    whole = events(spark, folder)
    recipe = Recipe().then("missing", column="value", strategy="mean").then(
        "scaling", columns=["value"], method="minmax")
    return rounded(recipe.fit(whole.where("user_id % 2 = 0")).transform(whole).select("event_id", "value"))


@query
def recipe_affected_rows(spark, folder):
    return cleaning_recipe().affected_rows(events(spark, folder))


@query
def recipe_history(spark, folder):
    """The recorded steps next to the rows that each has touched."""
    recipe = cleaning_recipe()
    touched = recipe.affected_rows(events(spark, folder))
    return recipe.history(spark).join(touched, ["step", "type"]).select("step", "type", "description", "affected_rows")


@query
def recipe_read_back(spark, folder):
    """Replayed from its text."""
    recipe = Recipe.from_json(Recipe.from_yaml(cleaning_recipe().to_yaml()).to_json())
    return rounded(recipe.apply(events(spark, folder)).drop("ts"))


@query
def recipe_stored_frozen(spark, folder):
    """Fitted on the events of even users, stored, loaded and applied to all."""
    whole = events(spark, folder)
    recipe = Recipe().then("missing", column="value", strategy="mean").then(
        "scaling", columns=["value"], method="minmax")
    stored = recipe.fit(whole.where("user_id % 2 = 0")).save(spark, shared_folder(spark, "frozen"))
    return rounded(FittedRecipe.load(spark, stored).transform(whole).select("event_id", "value"))


@query
def recipe_job(spark, folder):
    """A stored recipe run as a job on a stored table."""
    place = shared_folder(spark, "job")
    source = export_table(events(spark, folder), f"{place}/in.parquet")
    steps = cleaning_recipe().save(spark, f"{place}/steps.yaml")
    return rounded(load_table(spark, job.run(spark, steps, source, f"{place}/out.parquet")).drop("ts"))


@query
def recipe_blueprint(spark, folder):
    """The fitted blueprint of a recipe: filled and scaled values, value codes by name."""
    recipe = Recipe().then("missing", column="value", strategy="mean").then(
        "scaling", columns=["value"], method="standard").then("column_encode", column="props", method="label")
    df = events(spark, folder).select("event_id", "value", F.coalesce("event_type", F.lit("none")).alias("props"))
    ready = blueprint(recipe).fit(df).transform(df)
    return rounded(ready.select(
        "event_id", col("value_imputed").alias("filled"), vector_to_array("value_scaled")[0].alias("scaled"),
        col("props_code").cast("long").alias("code"))).withColumn("scaled", col("scaled") + 0.0)   # no -0.0


# -- sources -------------------------------------------------------------------
@query
def empty_tables_refused(spark, folder):
    """The events of three remainders, one of which has none, stored and loaded."""
    rows = []
    for rest in range(3):
        path = f"{shared_folder(spark, 'parts')}.parquet"
        events(spark, folder).where(col("event_id") % 2 == rest).write.parquet(path)
        try:
            rows.append((rest, False, load_table(spark, path).count()))
        except EmptyDataset:
            rows.append((rest, True, 0))
    return spark.createDataFrame(rows, "rest int, refused boolean, rows long")


@query
def report_written(spark, folder):
    """The summary and the duplicates of a report that was written and read again."""
    path = quality.write_report(poor_documents(spark, folder), shared_folder(spark, "report"), "documents", 3)
    read = spark.read.json(path)
    return read.select(
        "summary.total_rows", "summary.total_columns", col("duplicates")["duplicate_rows"].alias("duplicate_rows"),
        F.size("missing.details").cast("long").alias("columns_with_gaps"))


@query
def suggested_targets(spark, folder):
    """The suggested target of each table, with its number of values."""
    rows = []
    for name in ("labels", "part", "customer", "lineitem"):
        df = table(spark, folder, name)
        target = profile.suggested_target(df)
        rows.append(df.agg(F.lit(name).alias("table"), F.lit(target).alias("target"),
                           F.count_distinct(col(target)).alias("values")))
    return reduce(DataFrame.unionAll, rows)


@query
def quartiles_full_and_sparse(spark, folder):
    """Exact quartiles of a full column next to one filled in few rows."""
    df = table(spark, folder, "lineitem").select(
        "l_extendedprice", F.when(col("l_orderkey") % 50 == 0, col("l_extendedprice")).alias("sparse"),
        F.when(col("l_orderkey") % 3 > 0, F.lit(7.0)).alias("constant"))
    found = profile.TableStats(df).quartiles()
    return rounded(spark.createDataFrame([(c, *v) for c, v in found.items()], "name string, q1 double, q2 double, q3 double"))


@query
def roles_last_in_answer(spark, folder):
    """Answers that give one id two roles: the later one holds, in both result tables."""
    roles = ("fastest", "most_interpretable", "recommended")
    e = table(spark, folder, "events").select(
        col("event_id").cast("string").alias("session_id"), (col("event_id") % 3).cast("int").alias("a"))
    one = F.array(*[F.lit(r) for r in roles])[col("a")]
    two = F.array(*[F.lit(r) for r in roles])[(col("a") + 1) % 3]
    answers = e.select("session_id", F.concat(
        F.lit('{"assignments": [{"id": "x", "role": "'), one, F.lit('"}, {"id": "x", "role": "'), two, F.lit('"}]}')).alias("response"))
    rankings = e.select("session_id", F.lit("x").alias("id"), F.lit(1).alias("rank"), F.lit("X").alias("name"),
                        *[F.lit("fast").alias(c) for c in ("speed", "accuracy_potential", "interpretability")],
                        F.lit(True).alias("handles_categorical"), F.lit(True).alias("handles_imbalance"), F.lit(0.5).alias("combined_score"))
    valid = recommend.valid_assignments(recommend.extract_assignments(answers), rankings, places=True)
    return recommend.alternatives(rankings, valid).select("session_id", "algorithm", "role")


@query
def audit_undo_nested(spark, folder):
    """Undo leaves flags inside nested objects alone."""
    nested = F.concat(F.lit('{"note": "x", "is_active" : true, "b": {"is_active": true, "k": '), col("id"), F.lit("}}"))
    changed = audit_log.deactivate_last(
        _operations(spark, folder).withColumn("parameters", nested), F.lit("2026-01-01 00:00:00").cast("timestamp"))
    return changed.select(
        "id", *[F.get_json_object("parameters", f"$.{p}").alias(n) for n, p in (
            ("note", "note"), ("outer", "is_active"), ("inner", "b.is_active"), ("k", "b.k"))])


@query
def csv_long_ids(spark, folder):
    """Whole numbers of 19 digits stay whole; a column with longer ones stays text."""
    df = table(spark, folder, "orders").select(
        (F.lit(1234567890123000000) + col("o_orderkey")).alias("long_id"),
        F.concat(F.lit("98765432109876543210"), col("o_orderkey").cast("string")).alias("longer_id"),
        F.when(col("o_orderkey") % 5 > 0, col("o_orderstatus")).alias("status"))
    path = export_table(df, f"{shared_folder(spark, 'ids')}.csv")
    typed = load_table(spark, path)
    given = load_table(spark, path, schema="long_id long, longer_id string, status string").groupBy("status").agg(F.count("*").alias("given"))
    return typed.groupBy("status").agg(
        F.count_distinct("long_id").alias("ids"), F.min("long_id").alias("least"), F.max("longer_id").alias("longest"),
    ).join(given.withColumnRenamed("status", "s"), col("status").eqNullSafe(col("s"))).drop("s")


def _there_and_back(spark, df, fmt):
    path = shared_folder(spark, "round-trip") + f".{fmt}"
    return load_table(spark, export_table(df, path))


@query
def csv_round_trip(spark, folder):
    return _there_and_back(spark, events(spark, folder).drop("ts"), "csv")


@query
def json_round_trip(spark, folder):
    df = events(spark, folder).drop("ts")
    return _there_and_back(spark, df, "json").select(*df.columns)


@query
def parquet_round_trip(spark, folder):
    """NaN in the file comes back as a missing value."""
    df = events(spark, folder).select("event_id", F.coalesce("value", F.lit(float("nan"))).alias("value"))
    return _there_and_back(spark, df, "parquet")


@query
def file_audit_folder(spark, folder):
    return file_audit.audit_files(spark, folder).select(
        F.regexp_extract("path", "([^/]+)$", 1).alias("file"), "length", "extension", "verdict"
    )


@query
def file_audit_written(spark, folder):
    """Files written from the orders of each status: some with a mark of another format or a null byte in front."""
    path, orders = shared_folder(spark, "audited"), table(spark, folder, "orders")
    mark = F.when(col("o_orderstatus") == "F", "PAR1").when(col("o_orderstatus") == "O", "a\0b").otherwise("x")
    by_status = orders.select("o_orderstatus", F.concat(mark, col("o_orderkey").cast("string")).alias("v")).repartition("o_orderstatus")
    for kind in ("csv", "json", "text", "parquet"):
        by_status.write.partitionBy("o_orderstatus").format(kind).save(f"{path}/{kind}")
    found = file_audit.audit_files(spark, path).where(F.col("extension") != "")
    status = F.regexp_extract("path", "o_orderstatus=([^/]*)", 1)
    return found.select(status.alias("status"), "extension", "verdict").distinct()


@query
def column_existence(spark, folder):
    """Which of some asked column names the table lacks, as the error says."""
    orders, rows = table(spark, folder, "orders"), []
    for name in ("o_orderkey", "O_ORDERKEY", "price", "o_totalprice"):
        try:
            require(orders, [name])
            rows.append((name, ""))
        except ColumnNotFound as error:
            rows.append((name, error.column))
    return spark.createDataFrame(rows, "asked string, missing string")


# -- modelling profile and recommendation -----------------------------------------
def profiles(spark, folder) -> DataFrame:
    """One profile per modelling question over the test tables."""
    labels = table(spark, folder, "labels").select("quality", "toxic")
    return profile.profile_many([
        {"table": labels, "session_id": "labels", "target": "quality", "goal": "find poor texts"},
        {"table": table(spark, folder, "part"), "session_id": "part", "target": "p_retailprice"},
        {"table": table(spark, folder, "customer"), "session_id": "customer", "target": "c_mktsegment"},
        {"table": table(spark, folder, "supplier"), "session_id": "supplier"},
    ])


def flat_profiles(rows: DataFrame) -> DataFrame:
    return rows.select(*[
        F.array_join(col(f.name), ",").alias(f.name) if f.dataType.typeName() == "array" else col(f.name)
        for f in rows.schema
    ])


@query
def profile_row(spark, folder):
    return flat_profiles(profile.profile_row(events(spark, folder), "events", "event_type"))


@query
def profile_rows(spark, folder):
    return flat_profiles(profiles(spark, folder)).drop("feature_description")


GIVEN = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
         "conversations").split()


@query
def profiles_of_all_tables(spark, folder):
    """Every given table profiled at once."""
    rows = profile.profile_many([{"table": table(spark, folder, t), "session_id": t} for t in GIVEN])
    return flat_profiles(rows.drop("feature_description", "target_column", "class_balance", "problem_type"))


@query
def quartiles_of_all_tables(spark, folder):
    """Exact quartiles of every number of every given table, closed in by brackets together."""
    tables = [table(spark, folder, t) for t in GIVEN]
    counted = many_profiles.counts(tables, profile.parse_date)
    found = many_profiles.quantiles(tables, [numeric_columns(df) for df in tables], [n for _, n, _ in counted], (0.25, 0.5, 0.75), 20_000, 5_000)
    rows = [(GIVEN[t], tables[t].columns[c], *(round(v, 6) for v in own)) for (t, c), own in found.items()]
    return spark.createDataFrame(rows, "table_name string, column_name string, q1 double, q2 double, q3 double")


@query
def profile_description(spark, folder):
    return profiles(spark, folder).select("session_id", "feature_description")


@query
def kb_candidates(spark, folder):
    return recommend.candidates(profiles(spark, folder)).select("session_id", "id")


@query
def kb_no_candidates(spark, folder):
    """Profiles too small for every algorithm of their kind."""
    tiny = profiles(spark, folder).withColumn("row_count", F.lit(25).cast("long"))
    return recommend.without_candidates(tiny)


@query
def kb_filter_scores(spark, folder):
    rows = recommend.with_filter_score(recommend.candidates(profiles(spark, folder)))
    return rounded(rows.select("session_id", "id", "filter_score"))


@query
def text_similarity(spark, folder):
    return rounded(recommend.text_similarity(profiles(spark, folder)))


def _ranked(spark, folder):
    return recommend.ranked(recommend.with_scores(recommend.candidates(profiles(spark, folder))))


@query
def kb_topk(spark, folder):
    return rounded(_ranked(spark, folder).select(
        "session_id", F.col("rank").cast("long").alias("rank"), "id", "similarity_score", "combined_score"))


@query
def kb_roles(spark, folder):
    return recommend.roles(_ranked(spark, folder)).select("session_id", "id", "role")


@query
def kb_recommendations(spark, folder):
    rankings = _ranked(spark, folder)
    return recommend.recommendations(rankings, recommend.roles(rankings)).select(
        "session_id", F.col("rank").cast("long").alias("rank"), "id", "role", "is_primary", "reasoning")


@query
def kb_alternatives(spark, folder):
    rankings = _ranked(spark, folder)
    return recommend.alternatives(rankings, recommend.roles(rankings)).drop("rank", "confidence")


@query
def kb_steps(spark, folder):
    return recommend.preprocessing_steps(recommend.candidates(profiles(spark, folder))).select(
        "session_id", "id", F.col("position").cast("long").alias("position"), "step", "component",
        "parameters")


@query
def kb_related(spark, folder):
    rows = recommend.candidates(profiles(spark, folder)).select("session_id", "id")
    return recommend.related(rows).select(
        "session_id", "id", "upgrade", "fast_alternative", "interpretable_alternative",
        "ensemble_partner", "upgrade_name")


@query
def kb_grids(spark, folder):
    rows = recommend.candidates(profiles(spark, folder)).select("session_id", "id")
    return rows.join(F.broadcast(knowledge.grids(spark)), "id")


@query
def preprocessing_confidence(spark, folder):
    return rounded(recommend.preprocessing_confidence(profiles(spark, folder)), 2)


@query
def cosine_topk(spark, folder):
    """The eight vectors of each label most similar to the label's first vector."""
    vectors = table(spark, folder, "embeddings")
    anchor = vectors.groupBy("label").agg(
        F.min_by("embedding", "vec_id").alias("anchor"), F.min("vec_id").alias("anchor_id"))
    scored = vectors.join(broadcast_if_small(anchor, 10_000), "label").where(col("vec_id") != col("anchor_id")).select(
        F.col("label").cast("string").alias("session_id"), F.col("vec_id").alias("position"),
        F.round(recommend.cosine(F.col("embedding"), F.col("anchor")), 9).alias("combined_score"))
    return recommend.ranked(scored).select(
        "session_id", "position", F.round("combined_score", 6).alias("similarity"),
        F.col("rank").cast("long").alias("rank"))


def _responses(spark, folder) -> DataFrame:
    """One answer text per event: bare, fenced, embedded in prose, or unreadable."""
    e = table(spark, folder, "events")
    name = F.concat(F.lit("algo_"), (col("event_id") % 3).cast("string"))
    role = F.when(col("event_type") == "click", "fastest").when(col("event_type") == "view", "recommended") \
        .when(col("event_type") == "error", "winner").otherwise("most_interpretable")
    body = F.concat(
        F.lit('{"assignments": [{"id": "'), name, F.lit('", "role": "'), role,
        F.lit('", "reasoning": "r'), col("user_id").cast("string"), F.lit('"}, {"id": "algo_0", "role": "'),
        role, F.lit('"}]}'))
    kind = col("event_id") % 4
    return e.select(
        col("event_id").cast("string").alias("session_id"),
        F.when(kind == 0, body)
        .when(kind == 1, F.concat(F.lit("Here it is:\n```json\n"), body, F.lit("\n```\nDone.")))
        .when(kind == 2, F.concat(F.lit("I suggest "), body, F.lit(" as the result.")))
        .otherwise(F.lit("no idea")).alias("response"),
    )


@query
def json_extract(spark, folder):
    read = recommend.extract_assignments(_responses(spark, folder))
    return read.select(
        "session_id", F.size("assignments").cast("long").alias("n"),
        F.col("assignments")[0]["id"].alias("first_id"), F.col("assignments")[0]["role"].alias("first_role"))


@query
def json_extract_nested(spark, folder):
    """All assignments of answers that hold braces, quotes and ends of lists inside their values."""
    e = table(spark, folder, "events")
    said = F.when(col("event_id") % 3 == 0, "ends in ]} here").when(col("event_id") % 3 == 1, 'a "quoted" {brace').otherwise("back\\slash }")
    answer = F.to_json(F.struct(F.struct(F.array(F.struct(
        F.concat(F.lit("algo_"), (col("event_id") % 3).cast("string")).alias("id"), F.lit("fastest").alias("role"), said.alias("reasoning"))).alias("assignments")).alias("answer")))
    prose = F.when(col("event_id") % 4 == 0, answer).when(col("event_id") % 4 == 1, F.concat(F.lit("Take {this}: "), answer, F.lit(" }")))         .when(col("event_id") % 4 == 2, F.concat(F.lit("```json\n"), answer, F.lit("\n```"))).otherwise('{"assignments": "none"}')
    read = recommend.extract_assignments(e.select(col("event_id").cast("string").alias("session_id"), prose.alias("response")))
    return read.select("session_id", F.explode("assignments").alias("a")).select("session_id", "a.id", "a.role", "a.reasoning")


@query
def assignments_validate(spark, folder):
    rankings = table(spark, folder, "events").select(
        col("event_id").cast("string").alias("session_id"),
        F.concat(F.lit("algo_"), (col("event_id") % 2).cast("string")).alias("id"))
    read = recommend.extract_assignments(_responses(spark, folder))
    return recommend.valid_assignments(read, rankings)


# -- audit tables ----------------------------------------------------------------
def _operations(spark, folder) -> DataFrame:
    """Events as operations of a user's session; every fourth is already undone."""
    flag = F.when(col("event_id") % 4 == 0, ', "is_active": false}').when(
        col("event_id") % 4 == 1, ', "is_active": true}').otherwise("}")
    return table(spark, folder, "events").select(
        col("event_id").cast("string").alias("id"), col("user_id").cast("string").alias("session_id"),
        col("event_id").cast("int").alias("step_number"), col("event_type").alias("operation_type"),
        F.concat(F.expr("substring(props, 1, length(props) - 1)"), flag).alias("parameters"),
        col("ts").cast("timestamp").alias("created_at"),
    )


def _sessions(spark, folder) -> DataFrame:
    return table(spark, folder, "orders").select(
        col("o_orderkey").cast("string").alias("id"), col("o_custkey").cast("string").alias("dataset_id"),
        col("o_orderstatus").alias("status"), col("o_orderdate").cast("timestamp").alias("created_at"),
        col("o_orderdate").cast("timestamp").alias("last_accessed"),
    )


def _datasets(spark, folder) -> DataFrame:
    return table(spark, folder, "customer").select(
        col("c_custkey").cast("string").alias("id"), col("c_nationkey").cast("string").alias("user_id"),
        col("c_name").alias("filename"),
    )


@query
def audit_active_ops(spark, folder):
    return audit_log.active_operations(_operations(spark, folder)).select("id", "session_id", "step_number")


@query
def audit_undo_last(spark, folder):
    changed = audit_log.deactivate_last(
        _operations(spark, folder), F.lit("2026-01-01 00:00:00").cast("timestamp"))
    return changed.select(
        "id", F.get_json_object("parameters", "$.is_active").alias("is_active"),
        F.get_json_object("parameters", "$.undone_at").alias("undone_at"),
        F.get_json_object("parameters", "$.k").cast("long").alias("k"))


@query
def audit_owner_view(spark, folder):
    lines = table(spark, folder, "lineitem").select(
        col("l_orderkey").cast("string").alias("session_id"), col("l_linenumber").alias("step_number"),
        col("l_returnflag").alias("operation_type"))
    seen = audit_log.visible_operations(lines, _sessions(spark, folder), _datasets(spark, folder), "7")
    return seen.groupBy("operation_type").agg(F.count(F.lit(1)).alias("n"))


@query
def audit_recommendation_view(spark, folder):
    rows = table(spark, folder, "lineitem").select(
        col("l_orderkey").cast("string").alias("session_id"),
        F.when(col("l_linenumber") % 2 == 0, (col("l_suppkey") % 25).cast("string")).alias("user_id"),
        col("l_returnflag").alias("top_algorithm"))
    seen = audit_log.visible_recommendations(rows, _sessions(spark, folder), _datasets(spark, folder), "7")
    return seen.groupBy("top_algorithm").agg(F.count(F.lit(1)).alias("n"), F.count("user_id").alias("own"))


@query
def audit_idle_sessions(spark, folder):
    now = F.lit("1998-06-01 00:00:00").cast("timestamp")
    return audit_log.idle_sessions(_sessions(spark, folder), now, 3600).select("id", "status")


@query
def audit_touch(spark, folder):
    operations = table(spark, folder, "lineitem").select(
        col("l_orderkey").cast("string").alias("session_id"), col("l_shipdate").cast("timestamp").alias("created_at"))
    return audit_log.touch_sessions(_sessions(spark, folder), operations).select(
        "id", F.date_format("last_accessed", "yyyy-MM-dd").alias("last_accessed"))


@query
def audit_append(spark, folder):
    """Rows appended in two writes and read back with the audit schema."""
    target = shared_folder(spark, "audit")
    operations = _operations(spark, folder)
    audit_log.append(operations.where("step_number % 2 = 0"), "operations", target)
    audit_log.append(operations.where("step_number % 2 = 1"), "operations", target)
    stored = audit_log.read(spark, "operations", target)
    return stored.select(
        "id", "session_id", "step_number",
        F.get_json_object("parameters", "$.is_active").alias("is_active"))


# -- training --------------------------------------------------------------------
def _labelled_texts(spark, folder) -> DataFrame:
    documents = table(spark, folder, "documents").select(
        "doc_id", "lang", "source", "n_chars",
        F.size(F.split("text", r"\s+")).alias("words"), F.size(F.split("text", "\n")).alias("lines"))
    return table(spark, folder, "labels").select("doc_id", "quality").join(documents, "doc_id").drop("doc_id")


@query
def train_classifier(spark, folder):
    return training.train(_labelled_texts(spark, folder), "logistic_regression", "quality").metrics


@query
def train_regressor(spark, folder):
    part = table(spark, folder, "part").drop("p_partkey", "p_name")
    return training.train(part, "ridge_regression", "p_retailprice").metrics


@query
def train_segments(spark, folder):
    lines = table(spark, folder, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", "l_returnflag")
    return training.train(lines, "kmeans").metrics


@query
def train_tuned(spark, folder):
    """The regularisation of a ridge regression chosen by cross-validation over its grid."""
    part = training.split(table(spark, folder, "part").drop("p_partkey", "p_name").withColumn("label", col("p_retailprice")))[0]
    ready = training.preparation(part.drop("label", "p_retailprice"), "ridge_regression").fit(part).transform(part)
    best = training.tune(ready, "ridge_regression", folds=2)
    rows = [(i, float(list(p.values())[0]), float(m)) for i, (p, m) in enumerate(zip(best.getEstimatorParamMaps(), best.avgMetrics))]
    return spark.createDataFrame(rows, "place int, parameter double, rmse double")


def _held_out(name):
    """About a fifth of the rows, by the first digit of a hash of their id."""
    return F.substring(F.md5(col(name).cast("string")), 1, 1) < "3"


@query
def train_neighbours(spark, folder):
    """The label of held-out embeddings by their nearest neighbours among the others."""
    rows = table(spark, folder, "embeddings").select("vec_id", col("embedding").cast("array<double>").alias("features"), "label")
    model = neighbours.Neighbours(k=5, exact=True).fit(rows.where(~_held_out("vec_id")))
    return model.transform(rows.where(_held_out("vec_id"))).select("vec_id", "label", col("prediction").cast("int").alias("prediction"))


@query
def train_hazards(spark, folder):
    """How the language changes the risk that a document ends, by length; a rule says whose end was seen."""
    docs = table(spark, folder, "documents").where("n_chars is not null").select(
        "doc_id", F.array(F.coalesce((col("lang") == "en").cast("double"), F.lit(0.0))).alias("features"), col("n_chars").alias("label"),
        (col("doc_id") % 3 != 0).cast("double").alias("censor"))
    model = survival.CoxHazards().fit(docs)
    likelihood = F.lit(round(model.logLikelihood, 2)).alias("log_likelihood")
    return model.transform(docs).select("doc_id", F.round("prediction", 6).alias("hazard"), likelihood)


def _six_digits(*names):
    """Rounded a little above the half, as halves are common among means of whole numbers."""
    return [F.round(col(c) + 1e-9, 6).alias(c) for c in names]


@query
def encode_ordered_target(spark, folder):
    """Language and source of a document coded by the lengths of the documents before it."""
    docs = table(spark, folder, "documents").select("doc_id", "lang", "source", "n_chars")
    coded = target_codes.ordered(docs, ["lang", "source"], "n_chars", ["doc_id"])
    return coded.select("doc_id", *_six_digits("lang__target", "source__target"))


@query
def encode_target_of_new_rows(spark, folder):
    """The codes of held-out documents, by all others."""
    docs = table(spark, folder, "documents").select("doc_id", "lang", "source", "n_chars")
    codes = target_codes.fit(docs.where(~_held_out("doc_id")), ["lang", "source"], "n_chars")
    return codes.transform(docs.where(_held_out("doc_id"))).select("doc_id", *_six_digits("lang__target", "source__target"))


@query
def train_kernel(spark, folder):
    """A radial support vector machine on the labelled documents."""
    return training.train(_labelled_texts(spark, folder), "svm_classifier", "quality").metrics


@query
def train_joined_clusters(spark, folder):
    """Sizes of the clusters of the embeddings, by joining."""
    rows = table(spark, folder, "embeddings").select(col("embedding").cast("array<double>").alias("features"))
    return agglomerate.JoinedClusters(k=3).fit(rows).transform(rows).groupBy("prediction").agg(F.count("*").alias("n"))


@query
def components_of_embeddings(spark, folder):
    """The fewest principal components that hold 95 % of the variance of the embeddings, with their shares."""
    rows = table(spark, folder, "embeddings").select(array_to_vector(col("embedding").cast("array<double>")).alias("f"))
    _, shares = range_finder.find(rows, share=0.95)
    return spark.createDataFrame([(i, round(float(s), 6)) for i, s in enumerate(shares)], "place int, share double")


@query
def components_of_lengths(spark, folder):
    """Both components of characters and spaces of the documents, with the variance share of each."""
    docs = table(spark, folder, "documents").select(
        F.coalesce(F.char_length("text"), F.lit(0)).cast("double").alias("a"), F.coalesce(F.char_length(F.regexp_replace("text", "[^ ]", "")), F.lit(0)).cast("double").alias("b"))
    found, shares = range_finder.find(docs.select(array_to_vector(F.array("a", "b")).alias("f")), share=1.0)
    rows = [(i, round(float(found[0, i]), 6), round(float(found[1, i]), 6), round(float(shares[i]), 6)) for i in range(len(shares))]
    return spark.createDataFrame(rows, "place int, chars double, spaces double, share double")
