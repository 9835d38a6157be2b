"""Clock offset between pen and watch: stroke-variance search and tap matching."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..kernels import Ordering, attach, islands, mad, quantiles, scan, with_chunks
from ..kernels.groups import map_groups
from ..kernels.islands import gap_exceeds
from ..kernels.moving import CENTRED, rolling
from ..kernels.order import CHUNK
from ..schema import ACC, SENSOR_CHUNK_MS, SIGMA_OK
from ..session import staged
from .strokes import ARRIVAL, TIME, by_arrival, strokes

# Search grid (seconds) and the sizes below which no offset is estimated.
COARSE = (-20.0, 20.0, 0.5)
FINE_HALF, FINE_STEP = 5.0, 0.01
VARIANCE_SECONDS = 0.2
MIN_SAMPLES = 50
# Tap matching.
PEAK_SEPARATION_MS, PEAK_FLOOR, PEAK_MADS, PEAKS_MAX = 250, 0.015, 4.0, 80
TAP_MAX_MS, TAP_MAX_DOTS, TAP_KEEP_EACH, TAP_SEARCH_MS = 1400, 80, 12, 1600
HIGH_MATCHES, HIGH_ERROR_MS, LOW_ERROR_MS = 6, 350, 900

_ROW_BLOCK = 1 << 16
_SHIFT_BLOCK = 1 << 15
# Strokes last about a second: finer buckets than chunks keep the range join narrow.
MASK_BUCKET_MS = 1000


def pen_strokes(pen: DataFrame) -> DataFrame:
    """Stroke spans with stroke numbers counted in arrival order."""
    dots = pen.filter(
        "ts is not null and (dot_type in ('PEN_DOWN', 'PEN_UP') or (dot_type = 'PEN_MOVE' and x <> -1 and y <> -1))"
    )
    down = F.when(F.col("dot_type") == "PEN_DOWN", 1).otherwise(0)
    numbered = scan(by_arrival(dots.drop(CHUNK)), ARRIVAL, sums={"stroke_id": down})
    return strokes(numbered.filter("stroke_id > 0").withColumn("stroke_id", F.col("stroke_id") - 1))


def motion_variance(watch: DataFrame, *, width: int = SENSOR_CHUNK_MS, max_rows: int | None = 1_000_000) -> DataFrame:
    """Row number, sample rate and normalised rolling acceleration variance ``v`` of each sample.

    Rows without a full window around them have ``v`` = 0.
    """
    rows = watch.filter("ts is not null and ax is not null and ay is not null and az is not null")
    rows = with_chunks(rows.select("session_id", "_ord", "ts", *ACC), ["session_id"], "ts", "_ord", width, max_rows)
    one = F.lit(1).cast("long")
    rows = scan(rows, TIME, sums={"rn": one}, totals={"n_rows": one}, prev={"_p": ["ts"]})
    # Numbered samples feed two quantiles and the rolling pass.
    rows = staged(rows.selectExpr("session_id", "_ord", "ts", *ACC, "rn - 1 as rn", "n_rows", "ts - _p.ts as dt"), "numbered")
    dt = quantiles(rows, ["session_id"], "dt", {"_dt": 0.5})
    norm = quantiles(
        rows.selectExpr("session_id", "sqrt(ax*ax + ay*ay + az*az) as _g"), ["session_id"], "_g", {"_g": 0.5}
    )
    # n_rows rides along as a key total; both dimension tables hold one row per session.
    rates = dt.filter("_dt > 0").join(norm, "session_id").selectExpr(
        "session_id", "1000.0D / _dt as fs_hz", f"greatest(2, cast({VARIANCE_SECONDS}D * (1000.0D / _dt) as int)) as _w",
        "if(_g = 0, 1.0D, _g) as _g",
    )
    sized = attach(rows, rates, ["session_id"]).filter(F.col("n_rows") >= MIN_SAMPLES)
    out = rolling(
        sized, ["session_id"], "rn", "_w",
        {"_full": "count(*)", **{f"_v{a}": f"var_samp({a})" for a in ACC}, "_sd": "stddev_samp(sqrt(ax*ax + ay*ay + az*az))"},
        CENTRED,
    )
    return out.selectExpr(
        "session_id", "_ord", "ts", "rn", "n_rows", "fs_hz",
        "if(_full = _w, sqrt(_vax*_vax + _vay*_vay + _vaz*_vaz) / _g, 0.0D) as v",
        "if(_full = _w, _sd, null) as motion_sd",
    )


def _mask_edges(samples: DataFrame, spans: DataFrame, width: int) -> DataFrame:
    """Row ranges inside any stroke as weighted end points: +1 at the last row, -1 before the first."""
    blocks = spans.selectExpr(
        "session_id", "start_ms as _s", "end_ms as _e",
        f"explode(sequence(floor(start_ms / {width}), floor(end_ms / {width}))) as _b",
    ).alias("b")
    p = samples.withColumn("_b", F.floor(F.col("ts") / F.lit(width)))
    cond = F.expr("p.session_id = b.session_id and p._b = b._b and p.ts between b._s and b._e")
    inside = p.alias("p").join(blocks, cond, "left_semi").select("session_id", "rn")
    # Neighbouring masked rows cancel; what is left are the range borders.
    w = inside.selectExpr("session_id", "explode(array(struct(rn as i, 1 as w), struct(rn - 1 as i, -1 as w))) as e")
    return w.groupBy("session_id", "e.i").agg(F.sum("e.w").alias("w")).filter("w <> 0")


def _shift_sums(points: int, step: float):
    """Kernel of one row block: masked sums of v for every shift of the grid.

    ``j`` counts rows from 1, S[j] is the sum of v up to row j, S[0] = 0.  Borders
    and the S values they can reach under any shift arrive together.
    """

    def run(g: dict[str, np.ndarray]) -> dict[str, list]:
        j, w = g["j"].astype(np.int64), g["w"].astype(np.int64)
        is_edge = w != 0
        if not is_edge.any():
            return {}
        n, total = int(g["n_rows"][0]), float(g["s_total"][0])
        d = np.unique(np.rint((g["start"][0] + np.arange(points) * step) * g["fs_hz"][0]).astype(np.int64))
        known = ~is_edge
        low = int(j[known].min()) if known.any() else 0
        table = np.zeros((int(j[known].max()) if known.any() else 0) - low + 1)
        table[j[known] - low] = g["s"][known]
        num, cnt = np.zeros(len(d)), np.zeros(len(d), dtype=np.int64)
        ej, ew = j[is_edge], w[is_edge]
        for at in range(0, len(ej), 256):
            idx = np.clip(ej[at:at + 256, None] + d[None, :], 0, n)
            s = np.where(idx == n, total, np.where(idx == 0, 0.0, table[np.clip(idx - low, 0, len(table) - 1)]))
            num += (ew[at:at + 256, None] * s).sum(axis=0)
            cnt += (ew[at:at + 256, None] * idx).sum(axis=0)
        size = len(d)
        return {"session_id": [g["session_id"][0]] * size, "d": d.tolist(), "num": num.tolist(), "cnt": cnt.tolist()}

    return run


def _objective(edges: DataFrame, prefix: DataFrame, base: DataFrame, step: float, points: int) -> DataFrame:
    """Mean variance under the mask shifted by each row count ``d`` of the grid.

    With running sums S of v, the sum over a shifted range is a difference of two
    entries of S, so the cost is borders times grid, not samples times grid.
    Rows meet in blocks of their session; an S value is copied to the one or two
    blocks whose shifts can reach it.  ``base``: session_id, n_rows, fs_hz,
    s_total and the grid's ``start`` in seconds.
    """
    rows = prefix.selectExpr("session_id", "rn + 1 as j", "s", "0L as w").unionByName(
        edges.selectExpr("session_id", "i + 1 as j", "cast(null as double) as s", "w")
    )
    rows = attach(rows, base.select("session_id", "n_rows", "fs_hz", "s_total", "start"), ["session_id"], spread="j")
    lo, hi = "floor(start * fs_hz) - 1", f"ceil((start + {points * step}D) * fs_hz) + 1"
    own = f"floor(j / {_SHIFT_BLOCK})"
    rows = rows.selectExpr(
        "*", f"explode(if(w <> 0, array({own}), filter(sequence(floor((j - ({hi})) / {_SHIFT_BLOCK}), "
        f"floor((j - ({lo})) / {_SHIFT_BLOCK})), b -> b >= 0))) as _blk",
    )
    key = dict(rows.dtypes)["session_id"]
    parts = map_groups(
        rows, ["session_id", "_blk"], ["j"], _shift_sums(points, step), f"session_id {key}, d bigint, num double, cnt bigint", arrays=True
    )
    return parts.groupBy("session_id", "d").agg(F.sum("num").alias("_s"), F.sum("cnt").alias("_n")).selectExpr(
        "session_id", "d", "case when _n > 0 then _s / _n end as value"
    )


def _grid(base: DataFrame, step: float, points: int) -> DataFrame:
    return base.selectExpr("*", f"explode(sequence(0, {points - 1})) as i").selectExpr(
        "*", f"start + i * {step}D as delta_sec"
    ).selectExpr("*", "cast(bround(delta_sec * fs_hz) as bigint) as d")


def offset_search(
    watch: DataFrame, pen: DataFrame, *, width: int = SENSOR_CHUNK_MS, max_rows: int | None = 1_000_000,
    coarse: tuple[float, float, float] = COARSE, keep_curve: bool = False,
) -> DataFrame:
    """Pen offset per session that puts strokes on the calmest motion.

    ``pen.ts`` is the pen's arrival clock.  Sessions without strokes or with too
    few samples have no row.  ``keep_curve`` returns the fine curve instead.
    """
    # Read four times below: written once to the shared folder.
    v = staged(motion_variance(watch, width=width, max_rows=max_rows), "motion")
    spans = pen_strokes(pen)
    n_strokes = spans.groupBy("session_id").agg(F.count("*").alias("n_strokes"))
    edges = staged(_mask_edges(v.select("session_id", "ts", "rn"), spans, MASK_BUCKET_MS), "mask-edges")
    by_row = v.select("session_id", "rn", "v").withColumn(CHUNK, F.floor(F.col("rn") / _ROW_BLOCK))
    prefix = scan(by_row, Ordering(("session_id",), ("rn",)), sums={"s": F.col("v")}).select("session_id", "rn", "s")
    prefix = staged(prefix, "motion-sums")
    base = v.groupBy("session_id").agg(
        F.max("n_rows").alias("n_rows"), F.max("fs_hz").alias("fs_hz"), F.sum("v").alias("s_total")
    ).join(n_strokes, "session_id")
    lo, hi, step = coarse
    points = int(np.ceil((hi - lo) / step))
    first = base.withColumn("start", F.lit(float(lo)))
    scored = _grid(first, step, points).join(_objective(edges, prefix, first, step, points), ["session_id", "d"], "left")
    # No shift with any masked sample: the search falls back to zero.
    best = scored.groupBy("session_id").agg(
        F.max("n_rows").alias("n_rows"), F.max("fs_hz").alias("fs_hz"), F.max("n_strokes").alias("n_strokes"),
        F.max("s_total").alias("s_total"),
        F.coalesce(F.min_by("delta_sec", F.when(F.col("value").isNotNull(), F.struct("value", "i"))), F.lit(0.0)).alias("coarse_sec"),
    )
    # One row per session, needed twice by the fine pass.
    best = staged(best.withColumn("start", F.col("coarse_sec") - F.lit(FINE_HALF)), "coarse-offsets")
    points = round(2 * FINE_HALF / FINE_STEP)
    curve = _grid(best, FINE_STEP, points).join(_objective(edges, prefix, best, FINE_STEP, points), ["session_id", "d"], "left")
    if keep_curve:
        return curve.select("session_id", "i", "delta_sec", "value")
    known = F.when(F.col("value").isNotNull(), F.struct("value", "i"))
    out = curve.groupBy("session_id").agg(
        F.coalesce(F.min_by("delta_sec", known), F.lit(0.0)).alias("delta_sec"), F.min("value").alias("min_variance"),
        F.avg("value").alias("mean_variance"), F.stddev_samp("value").alias("sd_variance"),
        F.max("coarse_sec").alias("coarse_sec"), F.max("n_strokes").alias("n_strokes"),
        F.max("n_rows").alias("n_samples"), F.max("fs_hz").alias("fs_hz"),
    )
    return out.selectExpr(
        "*", "case when sd_variance > 0 then (min_variance - mean_variance) / sd_variance end as sigma"
    ).selectExpr(
        "*", f"coalesce(sigma <= {SIGMA_OK}, false) as applied",
        f"if(coalesce(sigma <= {SIGMA_OK}, false), delta_sec, 0.0D) as delta_applied",
        "case when min_variance > 0 then mean_variance / min_variance end as improvement",
    )


def half_drift(watch: DataFrame, pen: DataFrame, **options) -> DataFrame:
    """Offset of each half of a session, split at the middle of the watch's local time."""
    mid = watch.groupBy("session_id").agg(((F.min("local_ts") + F.max("local_ts")) / 2.0).alias("_mid"))
    half = lambda df, t: attach(df, mid, ["session_id"]).withColumn(
        "session_id", F.struct("session_id", F.when(F.col(t) < F.col("_mid"), 1).otherwise(2).alias("half"))
    )
    out = offset_search(half(watch, "local_ts"), half(pen, "ts"), **options)
    return out.groupBy(F.col("session_id.session_id").alias("session_id")).agg(
        *[F.max(F.when(F.col("session_id.half") == h, F.col("delta_sec"))).alias(f"delta_{h}") for h in (1, 2)],
        F.when(F.count("*") == 2, F.min("n_strokes")).otherwise(F.lit(0)).cast("long").alias("min_strokes"),
    ).withColumn("drift_ms", F.abs(F.col("delta_2") - F.col("delta_1")) * 1000.0)


def thin(df: DataFrame, keys: Sequence[str], rn: str, total: str, points: int) -> DataFrame:
    """At most ``points`` rows at even positions, first and last included."""
    # Row r is picked iff some k has trunc(k * (n - 1) / (points - 1)) = r.
    last = points - 1
    k = f"ceil({rn} * {last}D / ({total} - 1))"
    hit = f"{total} <= {points} or ({k} <= {last} and floor({k} * (({total} - 1) / {last}D)) = {rn})"
    return df.filter(hit)


def diagnostic_timeline(v: DataFrame, points: int = 300) -> DataFrame:
    """Thinned rolling standard deviation of motion for the alignment chart."""
    start = v.groupBy("session_id").agg(F.min("ts").alias("_t0"))
    return thin(v, ["session_id"], "rn", "n_rows", points).join(start, "session_id").selectExpr(
        "session_id", "rn", "(ts - _t0) / 1000.0D as rel_s", "motion_sd"
    )


# ── motion peaks and taps ────────────────────────────────────────────────────


def _separated(batches):
    """Greedy separation over rows sorted by (session, island, ts): a later row within
    the distance of the peak's first row replaces it only when larger."""
    import pandas as pd

    open_key, anchor, best = None, None, None
    for pdf in batches:
        rows = []
        for sid, isl, ts, mag in zip(pdf["session_id"], pdf["island"], pdf["ts"], pdf["motion_mag"]):
            key = (sid, isl)
            if open_key == key and ts - anchor < PEAK_SEPARATION_MS:
                if mag > best[2]:
                    best = (sid, ts, mag)
                continue
            if best is not None:
                rows.append(best)
            open_key, anchor, best = key, ts, (sid, ts, mag)
        yield pd.DataFrame(rows, columns=["session_id", "ts", "motion_mag"])
    if best is not None:
        yield pd.DataFrame([best], columns=["session_id", "ts", "motion_mag"])


def motion_peaks(
    watch: DataFrame, *, width: int = SENSOR_CHUNK_MS, max_rows: int | None = 1_000_000, top: int = PEAKS_MAX
) -> DataFrame:
    """Separated motion maxima above median + max(0.015, 4 MAD); the largest ``top`` per session.

    Rows farther apart than the separation cannot influence each other, so the
    greedy pass runs per island of close candidates, streaming in time order.
    """
    # Read by both medians, the count and the filter; the few high rows by the chunks and both passes of the islands.
    rows = staged(watch.filter("ts is not null and motion_mag is not null").select("session_id", "_ord", "ts", "motion_mag"), "motion-rows")
    limits = mad(rows, ["session_id"], "motion_mag", "_mad").join(
        rows.groupBy("session_id").agg(F.count("*").alias("_n")), "session_id"
    ).filter("_n >= 5").selectExpr("session_id", f"median + greatest({PEAK_FLOOR}D, _mad * {PEAK_MADS}D) as _limit")
    high = staged(attach(rows, limits, ["session_id"]).filter("motion_mag >= _limit").drop("_limit"), "motion-high")
    high = with_chunks(high, ["session_id"], "ts", "_ord", width, max_rows)
    near = islands(high, TIME, ["ts"], gap_exceeds("ts", PEAK_SEPARATION_MS - 1))
    schema = high.select("session_id", "ts", "motion_mag").schema
    peaks = (
        near.select("session_id", "island", "ts", "_ord", "motion_mag")
        .repartition("session_id", "island").sortWithinPartitions("session_id", "island", "ts", "_ord")
        .mapInPandas(_separated, schema)
        .withColumn("motion_mag", F.round("motion_mag", 6))
    )
    return top_per_key(peaks, ["session_id"], [F.desc("motion_mag"), F.asc("ts")], top, F.pmod(F.hash("ts"), F.lit(64)))


def top_per_key(df: DataFrame, keys: Sequence[str], order, n: int, salt) -> DataFrame:
    """First ``n`` rows per key, ranked in salted parts before they meet."""
    part = Window.partitionBy(*keys, "_salt").orderBy(*order)
    whole = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("_salt", salt)
        .withColumn("_r", F.row_number().over(part)).filter(F.col("_r") <= n)
        .withColumn("_r", F.row_number().over(whole)).filter(F.col("_r") <= n)
        .drop("_salt", "_r")
    )


def tap_candidates(pen: DataFrame, intervals: DataFrame, keep_each: int = TAP_KEEP_EACH) -> DataFrame:
    """Start times of short strokes, else of all DOWN dots: the first and last ``keep_each`` of a session.

    Taps stand at both ends of a recording by protocol, so those in between are none.
    """
    short = staged(intervals.filter(
        f"duration_ms <= {TAP_MAX_MS} and dot_count <= {TAP_MAX_DOTS}"
    ).selectExpr("session_id", "source_start_ms as pen_ts"), "tap-short")
    downs = pen.filter("dot_type = 'PEN_DOWN' and ts is not null").selectExpr("session_id", "ts as pen_ts")
    rest = downs.join(short.select("session_id").distinct(), "session_id", "left_anti")
    pool = staged(short.unionByName(rest).distinct(), "tap-pool")
    salt = F.pmod(F.hash("pen_ts"), F.lit(64))
    first = top_per_key(pool, ["session_id"], [F.asc("pen_ts")], keep_each, salt)
    last = top_per_key(pool, ["session_id"], [F.desc("pen_ts")], keep_each, salt)
    return first.unionByName(last).distinct()


def tap_matches(watch: DataFrame, pen: DataFrame, intervals: DataFrame, **options) -> DataFrame:
    """Candidates with their nearest motion peak under the median clock offset.

    At most 80 peaks meet at most 24 candidates per session.
    """
    med = lambda df, n: quantiles(
        df.selectExpr("session_id", "local_ts - ts as _o"), ["session_id"], "_o", {n: 0.5}
    )
    approx = med(pen, "_p").join(med(watch, "_w"), "session_id").selectExpr("session_id", "_p - _w as approx_ms")
    cand = tap_candidates(pen, intervals).join(approx, "session_id")
    peaks = motion_peaks(watch, **options).selectExpr("session_id", "ts as peak_ts", "motion_mag")
    hit = cand.join(peaks, "session_id").withColumn("_e", F.col("peak_ts") - (F.col("pen_ts") + F.col("approx_ms")))
    best = hit.groupBy("session_id", "pen_ts", "approx_ms").agg(
        F.min_by(F.struct("peak_ts", "_e", "motion_mag"), F.struct(F.abs("_e"), F.col("peak_ts"))).alias("_m")
    )
    return best.filter(F.abs("_m._e") <= TAP_SEARCH_MS).selectExpr(
        "session_id", "pen_ts", "approx_ms", "_m.peak_ts as peak_ts", "round(_m.peak_ts - pen_ts, 3) as offset_ms",
        "round(_m._e, 3) as error_ms", "_m.motion_mag as motion_mag",
    )


def tap_estimate(matches: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """Offsets of the first and second half of the matches, drift, confidence and why there is none.

    With ``sessions`` every one of them has a row.  Below two matches no offset is given and the confidence
    is 'none'.

    At most 24 matches per session, so plain windows and percentiles apply.
    """
    w = Window.partitionBy("session_id")
    ranked = matches.withColumn("_r", F.row_number().over(w.orderBy("pen_ts", "peak_ts"))).withColumn(
        "_n", F.count("*").over(w)
    ).withColumn("_first", F.expr("_r <= greatest(1, _n div 2)"))
    mid = lambda c=None: F.percentile(F.when(c, F.col("offset_ms")) if c is not None else F.col("offset_ms"), 0.5)
    out = ranked.groupBy("session_id").agg(
        F.count("*").alias("matches"), mid().alias("median_offset_ms"), mid(F.col("_first")).alias("start_offset_ms"),
        mid(~F.col("_first")).alias("end_offset_ms"), F.max(F.abs("error_ms")).alias("max_error_ms"),
    )
    if sessions is not None:
        out = sessions.select("session_id").distinct().join(out, "session_id", "left").withColumn("matches", F.coalesce("matches", F.lit(0).cast("long")))
    offsets = [f"case when matches >= 2 then {c} end as {c}" for c in ("median_offset_ms", "start_offset_ms", "end_offset_ms")]
    return out.selectExpr(
        "session_id", "matches", "matches >= 2 as usable", *offsets,
        "case when matches >= 2 then end_offset_ms - start_offset_ms end as drift_ms", "max_error_ms",
        f"case when matches < 2 then 'none' when max_error_ms > {LOW_ERROR_MS} then 'low' "
        f"when matches >= {HIGH_MATCHES} and max_error_ms <= {HIGH_ERROR_MS} then 'high' else 'medium' end as confidence",
        "case when matches = 0 then 'no matches' when matches = 1 then 'one match' end as reason",
    )
