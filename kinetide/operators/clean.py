"""Cleaning, timelines and session / pool / block filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lenient_double
from ..kernels import Ordering, attach, interval_anti, scan, with_chunks
from ..schema import ACC, GRAVITY, GYRO, IMU, SENSOR_CHUNK_MS, WRITING_DOTS

TILT_FEATURES = ("tilt_x_mean", "tilt_y_mean", "tilt_z_mean", "tilt_change")


def coerce_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({c: lenient_double(c) for c in cols})


def capture_clock(df: DataFrame) -> DataFrame:
    """``_wall``: the sample's own clock, arrival time only where it is missing."""
    return df.withColumn("_wall", F.coalesce("ts", "local_ts_ms")).filter("_wall is not null")


def drop_replays(df: DataFrame) -> DataFrame:
    """One row per (session, ts, axes): the first in time and arrival.

    An aggregate rather than a window: copies collapse before the shuffle, so a
    sample delivered any number of times costs one row.
    """
    keys = ["session_id", "ts", *[c for c in (*IMU, *GRAVITY) if c in df.columns]]
    rest = [c for c in df.columns if c not in keys]
    pos = F.struct(*[c for c in ("_wall", "_ord") if c in df.columns])
    kept = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), pos).alias("_r"))
    return kept.select(*[F.col(c) if c in keys else F.col(f"_r.{c}").alias(c) for c in df.columns])


def pen_kinematics(
    pen: DataFrame, *, width: int = SENSOR_CHUNK_MS, max_rows: int | None = 1_000_000
) -> DataFrame:
    """Valid dots in device-time order with dt, distance and speed.

    The first dot of a session and dots without a finite speed are dropped.
    """
    dots = with_chunks(pen.filter("x <> -1 and y <> -1"), ["session_id"], "ts", "_ord", width, max_rows)
    out = scan(dots, Ordering(("session_id",), ("ts", "_ord")), prev={"_p": ["ts", "x", "y"]})
    writing = ", ".join(f"'{d}'" for d in WRITING_DOTS)
    return (
        out.selectExpr(
            "session_id", "_ord", "ts", "(ts - _p.ts) / 1000.0D as dt",
            "x - _p.x as dx", "y - _p.y as dy",
            f"cast(dot_type in ({writing}) as int) as label_writing",
        )
        .withColumn("distance", F.expr("sqrt(dx*dx + dy*dy)"))
        .withColumn("speed", F.expr("case when dt <> 0 then distance / dt end"))
        .filter("speed is not null and distance is not null")
    )


def device_timeline(df: DataFrame, *, anchored: bool = False) -> DataFrame:
    """``device_time_ms`` = ts minus the session's first ts in arrival order.

    With ``anchored`` the column ``anchor_local_ms`` shifts the start by the
    session's first local time.
    """
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("_ord")))
    heads = df.groupBy("session_id").agg(first("ts").alias("_t0"), first("local_ts").alias("_l0"))
    joined = attach(df, heads, ["session_id"])
    rel = F.col("ts") - F.col("_t0")
    if anchored:
        rel = rel + F.coalesce(F.col("_l0") - F.col("anchor_local_ms"), F.lit(0))
    return joined.withColumn("device_time_ms", rel).drop("_t0", "_l0")


def frame_profile(df: DataFrame) -> DataFrame:
    """(column, rows, missing) from one aggregate over the frame."""
    cols = df.columns
    one = df.agg(F.count("*").alias("_n"), *[F.count_if(F.isnull(c)).alias(c) for c in cols])
    items = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("missing")) for c in cols])
    return one.select(F.col("_n").alias("rows"), F.inline(items))


def eligible_sessions(
    sessions: DataFrame, windows: DataFrame, *, min_windows: int = 0, include_all: bool = False
) -> DataFrame:
    """Sessions fit for training: verdict, not a test, enough windows."""
    out = sessions
    if not include_all:
        out = out.filter("verdict in ('trainable', 'usable') and coalesce(study_mode, '') <> 'test'")
    counts = windows.groupBy("session_id").agg(F.count("*").alias("n_windows"))
    return out.join(counts, "session_id").filter(F.col("n_windows") >= min_windows)


def filter_pool(windows: DataFrame, pool: str, *, drop_gravity: bool = False) -> DataFrame:
    """auto / legacy / modern; modern needs every gravity value of the session."""
    if pool not in ("auto", "legacy", "modern"):
        raise ValueError(f"unknown pool {pool!r}")
    tilt = [c for c in TILT_FEATURES if c in windows.columns]
    if not tilt:
        if pool == "modern":
            raise ValueError("no session has gravity features")
        return windows
    state = windows.groupBy("session_id").agg(
        F.bool_and(F.col(tilt[0]).isNotNull()).alias("_modern")
    )
    if pool == "auto":
        # One boolean decides the output columns of the whole frame.
        mixed = state.filter("not _modern").limit(1).count() > 0
        return windows.drop(*tilt) if mixed or drop_gravity else windows
    wanted = state.filter("_modern" if pool == "modern" else "not _modern")
    out = windows.join(wanted.select("session_id"), "session_id", "left_semi")
    return out.drop(*tilt) if pool == "legacy" or drop_gravity else out


def exclude_task(
    windows: DataFrame, blocks: DataFrame, task_id: str = "drawing", *, width: int = SENSOR_CHUNK_MS
) -> DataFrame:
    """Drop windows centred in a block of ``task_id``; sessions without blocks stay whole."""
    return interval_anti(
        windows, blocks.filter(F.col("task_id") == task_id), ["session_id"], "t_center_ms", width=width
    )


def exclude_mixed(windows: DataFrame, lo: float, hi: float, share: str = "writing_share") -> DataFrame:
    """Drop windows whose writing share lies strictly between the limits."""
    return windows.filter(~((F.col(share) > lo) & (F.col(share) < hi)))


def is_gyro_feature(name: str) -> bool:
    return name.startswith((*[f"{a}_" for a in GYRO], "gyro_")) or name in (
        "corr_rx_ry", "corr_rx_rz", "corr_ry_rz",
    )


def is_offset_sensitive(name: str) -> bool:
    return name.startswith("acc_mag") or name in {
        f"{a}_{s}" for a in ACC for s in ("mean", "min", "max", "rms")
    }


def feature_subset(names: Sequence[str], subset: str) -> list[str]:
    """``acc_only`` leaves out gyro features, ``invariant`` also offset-sensitive ones."""
    kept = [n for n in names if not is_gyro_feature(n)]
    if subset == "acc_only":
        return kept
    if subset == "invariant":
        return [n for n in kept if not is_offset_sensitive(n)]
    raise ValueError(f"unknown subset {subset!r}")


def total_acceleration(df: DataFrame) -> DataFrame:
    """User acceleration plus gravity, per axis."""
    return df.withColumns({a: F.col(a) + F.col(g) for a, g in zip(ACC, GRAVITY)})


def route_unsessioned(samples: DataFrame, active: DataFrame) -> DataFrame:
    """Samples take the id of the session active at their source, else ``unsessioned``."""
    live = active.select("source", F.col("session_id").alias("_live"))
    return attach(samples, live, ["source"], "left").withColumn(
        "session_id", F.coalesce("_live", F.lit("unsessioned"))
    ).drop("_live")
