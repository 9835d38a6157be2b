"""Table layouts and fixed domain values (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


_S, _L, _D, _I = T.StringType(), T.LongType(), T.DoubleType(), T.IntegerType()

SESSION, TS, ORD = "session_id", "ts", "_ord"

ACC = ("ax", "ay", "az")
GYRO = ("rx", "ry", "rz")
IMU = ACC + GYRO
GRAVITY = ("gx", "gy", "gz")

WATCH = _struct(
    local_ts=_S, local_ts_ms=_L, session_id=_S, sequence=_L, sample_rate_hz=_D, watch_sent_at=_L,
    phone_received_at=_L, server_received_ms=_L, source=_S, ts=_L,
    ax=_D, ay=_D, az=_D, rx=_D, ry=_D, rz=_D, gx=_D, gy=_D, gz=_D, qx=_D, qy=_D, qz=_D, qw=_D,
)
PEN = _struct(
    local_ts=_S, local_ts_ms=_L, timestamp=_L, x=_D, y=_D, pressure=_I, dot_type=_S, tilt_x=_I,
    tilt_y=_I, section=_I, owner=_I, note=_I, page=_I,
)
AIRPODS = _struct(
    local_ts=_S, local_ts_ms=_L, session_id=_S, sequence=_L, sample_rate_hz=_D, airpods_sent_at=_L,
    phone_received_at=_L, server_received_ms=_L, source=_S, ts=_L,
    ax=_D, ay=_D, az=_D, rx=_D, ry=_D, rz=_D, qw=_D, qx=_D, qy=_D, qz=_D, gx=_D, gy=_D, gz=_D,
)
MARKERS = _struct(
    timestamp_ms=_L, event=_S, task_id=_S, task_name=_S, task_index=_I, task_category=_S, protocol_id=_S,
)
SESSIONS = _struct(
    session_id=_S, person_id=_S, description=_S, start_time=_S, end_time=_S, pen_samples=_L,
    watch_samples=_L, airpods_samples=_L, status=_S, duration_seconds=_D, ml_status=_S,
    recording_status=_S, alignment_sigma=_D, verdict=_S, issue_codes=_S, flagged=_S, flag_note=_S,
    study_mode=_S, protocol_id=_S, subject_index=_I, watch_profile=_S,
)
INFERENCE_LOG = _struct(ts_ms=_L, proba=_D, writing=_I, model_id=_S, fs_hz=_D)

# Fixed values that results depend on.
WRITING_DOTS = ("PEN_DOWN", "PEN_MOVE")
STROKE_DOTS = ("PEN_DOWN", "PEN_MOVE", "PEN_UP")
VALID_RATES_HZ = (50.0, 100.0)
RATE_TOLERANCE = 0.20
HEAD_RATE_HZ = 25.0
COVERAGE_MIN = 0.7
PEN_IN_RANGE_MIN = 0.80
COUNT_TOLERANCE_FLOOR = 20
COUNT_TOLERANCE_SHARE = 0.02
SIGMA_OK = -2.0
SIGMA_WEAK = -1.0
SIGMA_TRAINABLE = -3.0
TRAINABLE_SECONDS = 300
LABEL_TOLERANCE_MS = 40
LABEL_GAP_MS = 2500
STRETCH_GAP_MS = 2500
STRETCH_MIN_SECONDS = 1.0
PROFILES_BY_FIDELITY = ("100hz_grav", "100hz", "50hz")

# Chunk length of raw sensor streams: 60 000 rows at 100 Hz.
SENSOR_CHUNK_MS = 600_000
