"""Derived tables on shared storage: append, partitioned stores, migration, deletion."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.quality import detect_profile
from ..schema import GRAVITY, PROFILES_BY_FIDELITY

# Fixed: window profiles a session must have, by its native profile.
REQUIRED_PROFILES = {"50hz": ["50hz"], "100hz_grav": ["100hz_grav", "50hz"], "100hz": ["50hz"]}
DEFAULT_PARAMS = (1.0, 0.5, 2500.0)
TILT_FEATURES = ("tilt_x_mean", "tilt_y_mean", "tilt_z_mean", "tilt_change")


def append(df: DataFrame, path: str) -> None:
    """Append rows; columns the table has not seen yet become part of it."""
    df.write.mode("append").parquet(path)


def read_evolved(spark: SparkSession, path: str) -> DataFrame:
    """Read a table whose files differ in columns; absent ones are NULL."""
    return spark.read.option("mergeSchema", True).parquet(path)


def with_layout(df: DataFrame, layout: DataFrame) -> DataFrame:
    """Bring ``df`` to the union of both column sets."""
    return layout.limit(0).unionByName(df, allowMissingColumns=True)


def write_windows(windows: DataFrame, path: str) -> None:
    """Store windows under their profile, clustered by session.

    One folder per profile prunes on read; sessions are ranges inside its files
    (row-group statistics), so millions of sessions do not become as many files.
    """
    clustered = windows.repartitionByRange("profile", "session_id").sortWithinPartitions("session_id")
    clustered.write.mode("append").partitionBy("profile").parquet(path)


def best_profile(available: DataFrame, profile: str | None = None) -> DataFrame:
    """(session_id, profile) to read: an explicit one, else the highest fidelity."""
    if profile is not None:
        return available.filter(F.col("profile") == profile).select("session_id", "profile").distinct()
    order = F.array(*[F.lit(p) for p in PROFILES_BY_FIDELITY])
    return available.groupBy("session_id").agg(
        F.min_by("profile", F.array_position(order, F.col("profile"))).alias("profile")
    )


def read_windows(windows: DataFrame, profile: str | None = None) -> DataFrame:
    """Windows of the profile picked for each session."""
    pick = best_profile(windows.select("session_id", "profile").distinct(), profile)
    return windows.join(pick, ["session_id", "profile"], "left_semi")


def param_tag(window_sec: float, stride_sec: float, max_gap_ms: float) -> str:
    return f"w{window_sec:g}s{stride_sec:g}_g{round(max_gap_ms)}"


def is_default_params(window_sec: float, stride_sec: float, max_gap_ms: float) -> bool:
    return (window_sec, stride_sec, max_gap_ms) == DEFAULT_PARAMS


def ensure_param_windows(
    spark: SparkSession,
    path: str,
    sessions: DataFrame,
    pool: str,
    params: tuple[float, float, float],
    build: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """Feature store keyed by (pool, parameters): builds only sessions it lacks."""
    tag = param_tag(*params)
    home = f"{path}/pool={pool}/param_tag={tag}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(home)
    known = jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)
    todo = sessions
    if known:
        todo = sessions.join(spark.read.parquet(home).select("session_id").distinct(), "session_id", "left_anti")
    built = build(todo)
    if pool == "legacy":
        built = built.drop(*[c for c in TILT_FEATURES if c in built.columns])
    built.write.mode("append").parquet(home)
    return spark.read.parquet(home)


def missing_views(
    sessions: DataFrame, merged: DataFrame, available: DataFrame,
    required: Mapping[str, list[str]] = REQUIRED_PROFILES,
) -> DataFrame:
    """Profiles each non-test, merged session still needs."""
    rules = F.create_map(
        *[x for k, v in required.items() for x in (F.lit(k), F.array(*[F.lit(p) for p in v]))]
    )
    need = (
        sessions.filter("coalesce(study_mode, '') <> 'test'")
        .join(merged.select("session_id"), "session_id", "left_semi")
        .select("session_id", F.explode(rules[F.col("watch_profile")]).alias("profile"))
    )
    return need.join(available.select("session_id", "profile"), ["session_id", "profile"], "left_anti")


def rehome_flat(flat: DataFrame, merged: DataFrame) -> DataFrame:
    """Give unpartitioned windows the profile found in their merged samples.

    Sessions without merged samples keep a NULL profile and stay where they are.
    """
    cols = [c for c in ("session_id", "ts", "_ord", "_chunk", *GRAVITY) if c in merged.columns]
    return flat.join(detect_profile(merged.select(*cols)).select("session_id", "profile"), "session_id", "left")


def without_sessions(table: DataFrame, removed: DataFrame) -> DataFrame:
    """Cascade delete of one table: every row of a removed session goes."""
    return table.join(removed.select("session_id"), "session_id", "left_anti")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)
