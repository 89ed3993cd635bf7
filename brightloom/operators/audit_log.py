"""Audit tables (datasets, sessions, operations, ...) as Parquet, and queries over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The audit tables and their columns; JSON is kept as text.
SCHEMAS = {
    "datasets": "id string, user_id string, filename string, rows int, columns int, file_type string, "
                "created_at timestamp",
    "sessions": "id string, dataset_id string, status string, created_at timestamp, "
                "last_accessed timestamp",
    "operations": "id string, session_id string, step_number int, operation_type string, "
                  "parameters string, created_at timestamp",
    "exports": "id string, session_id string, format string, file_url string, created_at timestamp",
    "reports": "id string, session_id string, report_url string, created_at timestamp",
    "recommendation_feedback": "id string, user_id string, session_id string, "
                               "recommended_algorithm string, accepted boolean, created_at timestamp",
    "ml_recommendations": "id string, session_id string, user_id string, goal string, "
                          "top_algorithm string, confidence double, recommendations string, "
                          "created_at timestamp",
}
IDLE_SECONDS = 3600


def append(rows: DataFrame, table: str, folder: str) -> str:
    """Append rows to an audit table; id and created_at are filled in where absent."""
    spark = rows.sparkSession
    schema = spark.createDataFrame([], SCHEMAS[table]).schema
    defaults = {
        "id": F.expr("uuid()"), "created_at": F.current_timestamp(),
        "last_accessed": F.current_timestamp(), "status": F.lit("active"),
    }
    given = set(rows.columns)
    unknown = given - set(schema.names)
    if unknown:
        raise ValueError(f"unknown columns for {table}: {sorted(unknown)}")
    complete = rows.select(*[
        (F.coalesce(F.col(f.name), defaults[f.name]) if f.name in given and f.name in defaults
         else F.col(f.name) if f.name in given
         else defaults.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name)
        for f in schema
    ])
    if table == "operations":
        complete = complete.withColumn("parameters", _with_flag(F.coalesce("parameters", F.lit("{}"))))
    path = f"{folder.rstrip('/')}/{table}"
    complete.write.mode("append").parquet(path)
    return path


def read(spark: SparkSession, table: str, folder: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[table]).parquet(f"{folder.rstrip('/')}/{table}")


def _changed(parameters: Column, **values: Column) -> Column:
    """The JSON object with top-level keys set; nested objects and the order of other keys stay."""
    entries = F.from_json(parameters, "map<string,variant>")
    kept = F.map_filter(entries, lambda key, _: ~key.isin(*values))
    new = F.create_map(*[x for key, value in values.items() for x in (F.lit(key), F.parse_json(value))])
    return F.coalesce(F.to_json(F.map_concat(kept, new)), parameters)      # no object: unchanged


def _with_flag(parameters: Column) -> Column:
    """Add "is_active": true to a JSON object that says nothing about it."""
    absent = F.get_json_object(parameters, "$.is_active").isNull()
    return F.when(absent, _changed(parameters, is_active=F.lit("true"))).otherwise(parameters)


def is_active(parameters: Column) -> Column:
    """False only where the JSON flag says so; an absent flag means active."""
    return F.coalesce(F.get_json_object(parameters, "$.is_active") != "false", F.lit(True))


def active_operations(operations: DataFrame) -> DataFrame:
    """Active operations, by session and step."""
    return operations.where(is_active(F.col("parameters"))).orderBy("session_id", "step_number")


def deactivate_last(operations: DataFrame, at: Column | None = None) -> DataFrame:
    """Mark the latest active operation of each session as undone.

    The latest step per session is one aggregate (combined before the shuffle), and the
    join is on session and step, so a session with very many operations stays spread.
    """
    latest = operations.where(is_active(F.col("parameters"))).groupBy("session_id").agg(
        F.max("step_number").alias("step_number")
    ).withColumn("_last", F.lit(True))
    undone_at = F.date_format(F.current_timestamp() if at is None else at, "yyyy-MM-dd'T'HH:mm:ss")
    rewritten = _changed(
        F.col("parameters"), is_active=F.lit("false"), undone_at=F.concat(F.lit('"'), undone_at, F.lit('"'))
    )
    joined = operations.join(latest, ["session_id", "step_number"], "left")
    hit = F.col("_last").isNotNull() & is_active(F.col("parameters"))
    return joined.withColumn(
        "parameters", F.when(hit, rewritten).otherwise(F.col("parameters"))
    ).select(*operations.columns)


def visible_operations(operations: DataFrame, sessions: DataFrame, datasets: DataFrame,
                       user_id) -> DataFrame:
    """Operations whose session belongs to a dataset of the user."""
    return operations.join(
        user_sessions(sessions, datasets, user_id).select(F.col("id").alias("session_id")),
        "session_id", "left_semi",
    ).select(*operations.columns)


def user_sessions(sessions: DataFrame, datasets: DataFrame, user_id) -> DataFrame:
    own = datasets.where(F.col("user_id") == F.lit(user_id)).select(F.col("id").alias("dataset_id"))
    return sessions.join(own, "dataset_id", "left_semi").select(*sessions.columns)


def visible_recommendations(rows: DataFrame, sessions: DataFrame, datasets: DataFrame,
                            user_id) -> DataFrame:
    """Rows of the user, and rows of nobody in a session of the user."""
    mine = user_sessions(sessions, datasets, user_id).select(F.col("id").alias("session_id"))
    nobody = rows.where(F.col("user_id").isNull()).join(mine, "session_id", "left_semi")
    return rows.where(F.col("user_id") == F.lit(user_id)).unionByName(nobody.select(*rows.columns))


def idle_sessions(sessions: DataFrame, now: Column | None = None, seconds: int = IDLE_SECONDS) -> DataFrame:
    """Sessions not accessed for longer than ``seconds``."""
    now = F.current_timestamp() if now is None else now
    idle = F.unix_timestamp(now) - F.unix_timestamp("last_accessed")
    return sessions.where(idle > seconds)


def touch_sessions(sessions: DataFrame, operations: DataFrame) -> DataFrame:
    """last_accessed moved up to the latest operation of each session."""
    latest = operations.groupBy(F.col("session_id").alias("id")).agg(F.max("created_at").alias("_latest"))
    return sessions.join(latest, "id", "left").withColumn(
        "last_accessed", F.greatest("last_accessed", "_latest")
    ).select(*sessions.columns)
