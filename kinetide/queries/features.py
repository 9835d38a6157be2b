"""Sliding-window features: eight events per window for the event log, embeddings as 64-sample windows."""

from pyspark.sql import functions as F

from ..operators import features as ft
from .data import HOUR, PEN, SAMPLES, WATCH, WIDTH, embeddings, pen, rnd, samples, watch
from .evaluate import r6
from .label import CLOSE
from .registry import query

SIX = ("ax", "ay", "az", "rx", "ry", "rz")
OPTS = dict(fs_hz=8.0, width=WIDTH, max_gap_ms=12 * HOUR)


def merged(spark, sf):
    return watch(spark, sf).withColumnRenamed("label", "label_writing").withColumn("task_id", F.col("event_type")).drop("local_ts", "sequence")


WIN = WATCH + """, num AS (SELECT *, row_number() OVER w - 1 AS rn, count(*) OVER (PARTITION BY session_id) AS n, sqrt(ax*ax + ay*ay + az*az) AS acc_mag, sqrt(rx*rx + ry*ry + rz*rz) AS gyro_mag
  FROM watch WINDOW w AS (PARTITION BY session_id ORDER BY ts, _ord)), stp AS (SELECT *, """ + ", ".join(
    f"({c} - lag({c}) OVER w) * 8 AS j_{c}" for c in ("ax", "ay", "az", "rx", "ry", "rz", "acc_mag", "gyro_mag")) + """ FROM num WINDOW w AS (PARTITION BY session_id ORDER BY rn)), win AS (
  SELECT s.*, k.k, s.rn = k.k * 4 AS head FROM stp s JOIN (SELECT session_id, CAST(unnest(range(0, (n - 8) // 4 + 1)) AS BIGINT) AS k FROM (SELECT DISTINCT session_id, n FROM num WHERE n >= 8)) k
  ON k.session_id = s.session_id AND s.rn BETWEEN k.k * 4 AND k.k * 4 + 7)"""


@query("f1_window_assembly", "WITH" + WIN + CLOSE.replace(SAMPLES, "") + f""", cl AS (
  SELECT _ord, CASE WHEN ru.run > 0 AND ru.run < last AND l = 0 AND t1 - t0 <= {12 * HOUR} THEN 1 ELSE label END AS c FROM rr JOIN ru ON ru.session_id = rr.session_id AND ru.run = rr.run)
  SELECT session_id, k, count(*) AS n, round(avg(c), 6) AS writing_share, CASE WHEN avg(c) >= 0.6 THEN 1 ELSE 0 END AS label, round(avg(ts), 3) AS t_center_ms FROM win JOIN cl USING (_ord) GROUP BY 1, 2""")
def _(spark, sf):
    w = ft.build_windows(merged(spark, sf), spectral=False, **OPTS)
    return r6(w.select("session_id", "k", F.lit(8).cast("long").alias("n"), "writing_share", "label", rnd(F.col("t_center_ms"), 3).alias("t_center_ms")), "writing_share")


def agg_query(name, pairs):
    """Register window aggregates with their SQL."""
    sql = "WITH" + WIN + " SELECT session_id, k, " + ", ".join(f"round({e} + 1e-9, 7) + 0.0 AS {c}" for c, e in pairs) + " FROM win GROUP BY 1, 2"

    @query(name, sql)
    def _(spark, sf):
        cols = [c for c, _ in pairs]
        hard = any(c.startswith(("rx_jerk", "corr_ax_rx")) for c in cols)
        w = ft.build_windows(merged(spark, sf), spectral=False, hard_negative=hard, **OPTS)
        # The offset keeps exact decimal ties from rounding either way.
        return r6(w.select("session_id", "k", *[(F.col(c) + 1e-9).alias(c) for c in cols]), *cols, d=7)


STAT_SQL = {"mean": "avg({a})", "std": "stddev_pop({a})", "min": "min({a})", "max": "max({a})", "rms": "sqrt(avg({a} * {a}))", "range": "max({a}) - min({a})"}
corr_sql = "CASE WHEN stddev_pop({a}) < 1e-12 OR stddev_pop({b}) < 1e-12 THEN 0 ELSE corr({a}, {b}) END"
agg_query("f2_axis_stats", [(f"{a}_{s}", e.format(a=a)) for a in ("ax", "ay", "az", "rx", "ry", "rz") for s, e in STAT_SQL.items()])
agg_query("f5_jerk", [(f"{a}_jerk_{s}", e.format(d=f"CASE WHEN NOT head THEN j_{a} END")) for a in ("ax", "ay", "az", "acc_mag", "gyro_mag") for s, e in (("std", "stddev_pop({d})"), ("mean_abs", "avg(abs({d}))"))])
agg_query("f6_magnitudes", [(f"{m}_{s}", e.format(m=m)) for m in ("acc_mag", "gyro_mag") for s, e in (("mean", "avg({m})"), ("std", "stddev_pop({m})"), ("energy", "avg({m} * {m})"))])
agg_query("f7_axis_correlations", [(f"corr_{a}_{b}", corr_sql.format(a=a, b=b)) for a, b in (("ax", "ay"), ("ax", "az"), ("ay", "az"), ("rx", "ry"), ("rx", "rz"), ("ry", "rz"))])
agg_query("f10_hard_negatives", [(f"{a}_jerk_{s}", e.format(d=f"CASE WHEN NOT head THEN j_{a} END")) for a in ("rx", "ry", "rz") for s, e in (("std", "stddev_pop({d})"), ("mean_abs", "avg(abs({d}))"))]
          + [(f"corr_{a}_rx", corr_sql.format(a=a, b="rx")) for a in ("ax", "ay", "az")])


@query("f8_tilt", "WITH" + WIN + """, g AS (SELECT *, sqrt(gx*gx + gy*gy + gz*gz) AS g FROM num), gs AS (SELECT *, lag(gx) OVER w AS px, lag(gy) OVER w AS py, lag(gz) OVER w AS pz, lag(g) OVER w AS pg FROM g WINDOW w AS (PARTITION BY session_id ORDER BY rn))
  SELECT w.session_id, w.k, round(avg(acos(gs.gx / g)), 5) AS tilt_x_mean, round(avg(acos(gs.gy / g)), 5) AS tilt_y_mean, round(avg(acos(gs.gz / g)), 5) AS tilt_z_mean,
    round(avg(CASE WHEN NOT head THEN acos(greatest(-1, least(1, (gs.gx*px + gs.gy*py + gs.gz*pz) / (g * pg)))) END), 5) AS tilt_change FROM win w JOIN gs USING (_ord) GROUP BY 1, 2""")
def _(spark, sf):
    w = ft.build_windows(merged(spark, sf), spectral=False, **OPTS)
    return r6(w.select("session_id", "k", *ft.TILT_FEATURES), *ft.TILT_FEATURES, d=5)


@query("f16_task_mode", "WITH" + WIN + """, c AS (SELECT session_id, k, event_type, count(*) AS n FROM win GROUP BY ALL)
  SELECT session_id, k, event_type AS task_id FROM c QUALIFY row_number() OVER (PARTITION BY session_id, k ORDER BY n DESC, event_type) = 1""")
def _(spark, sf):
    return ft.build_windows(merged(spark, sf), spectral=False, **OPTS).select("session_id", "k", "task_id")


@query("f15_full_feature_table")
def _(spark, sf):
    return ft.build_windows(merged(spark, sf), rhythm=True, hard_negative=True, winners=True, **OPTS)


# ── array features on embeddings ────────────────────────────────────────────

EMB = """e AS (SELECT vec_id, i - 1 AS i, embedding[i]::DOUBLE AS x FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS i FROM embeddings)), m AS (
  SELECT vec_id, avg(x) AS mu, var_pop(x) AS var, quantile_cont(x, 0.2) AS lo, quantile_cont(x, 0.8) AS hi, quantile_cont(x, 0.7) AS q70, quantile_cont(x, 0.9) AS q90 FROM e GROUP BY 1)"""
DFT = EMB + """, d AS (SELECT e.vec_id, f.k, sum((x - mu) * cos(2 * pi() * f.k * i / 64)) ** 2 + sum((x - mu) * sin(2 * pi() * f.k * i / 64)) ** 2 AS p FROM e JOIN m USING (vec_id) CROSS JOIN (SELECT unnest(range(1, 33)) AS k) f GROUP BY 1, 2), t AS (
  SELECT vec_id, sum(p) AS total FROM d GROUP BY 1)"""


def emb_features(spark, sf, *cols, spectral=False):
    out = ft.array_features(embeddings(spark, sf), "x", "64.0D" if spectral else None)
    return r6(out.select("vec_id", *cols), *cols, d=5)


@query("f3_spectral", "WITH " + DFT + """ SELECT vec_id, arg_max(k, p)::DOUBLE AS dom_freq, round(sum(k * p / total), 5) AS spec_centroid, round(-sum(p / total * ln(p / total + 1e-12)), 5) AS spec_entropy,
  round(sum(CASE WHEN k BETWEEN 3 AND 8 THEN p / total ELSE 0 END), 5) AS band_3_8 FROM d JOIN t USING (vec_id) GROUP BY 1""")
def _(spark, sf):
    return emb_features(spark, sf, *ft.SPECTRAL, spectral=True)


@query("f4_zero_crossings", "WITH " + EMB + """, s AS (SELECT vec_id, i, CASE WHEN x - mu < 0 THEN -1 ELSE 1 END AS s FROM e JOIN m USING (vec_id))
  SELECT vec_id, round(avg(CASE WHEN s <> p THEN 1.0::DOUBLE ELSE 0 END), 5) AS zcr FROM (SELECT *, lag(s) OVER (PARTITION BY vec_id ORDER BY i) AS p FROM s) WHERE p IS NOT NULL GROUP BY 1""")
def _(spark, sf):
    return emb_features(spark, sf, "zcr")


@query("f9_rhythm", "WITH " + DFT + """, ac AS (SELECT a.vec_id, b.i - a.i AS lag, sum((a.x - mu) * (b.x - mu)) / min(64 * var) AS r FROM e a JOIN e b ON a.vec_id = b.vec_id AND b.i - a.i BETWEEN 5 AND 32 JOIN m ON m.vec_id = a.vec_id GROUP BY 1, 2)
  SELECT d.vec_id, round(exp(avg(ln(p + 1e-12))) / avg(p + 1e-12), 5) AS flatness, round((SELECT max(r) FROM ac WHERE ac.vec_id = d.vec_id), 5) AS autocorr_peak FROM d GROUP BY 1""")
def _(spark, sf):
    return emb_features(spark, sf, "flatness", "autocorr_peak", spectral=True)


@query("f11_autocorrelation", "WITH " + EMB + """, ac AS (SELECT a.vec_id, b.i - a.i AS lag, sum((a.x - mu) * (b.x - mu)) / ((64 - (b.i - a.i)) * min(var)) AS r FROM e a JOIN e b ON a.vec_id = b.vec_id AND b.i - a.i BETWEEN 2 AND 5 JOIN m ON m.vec_id = a.vec_id GROUP BY 1, 2)
  SELECT vec_id, """ + ", ".join(f"round(max(r) FILTER (lag = {g}), 5) AS ac_lag{g}" for g in (2, 3, 4, 5)) + " FROM ac GROUP BY 1")
def _(spark, sf):
    return emb_features(spark, sf, "ac_lag2", "ac_lag3", "ac_lag4", "ac_lag5")


@query("f12_quantiles", "WITH " + EMB + " SELECT vec_id, round(q70, 5) AS q70, round(q90, 5) AS q90 FROM m")
def _(spark, sf):
    return emb_features(spark, sf, "q70", "q90")


DIF = EMB + ", df AS (SELECT e.vec_id, x, lag(x) OVER (PARTITION BY e.vec_id ORDER BY i) AS p, lo, hi, var FROM e JOIN m USING (vec_id))"


@query("f13_change_quantiles", "WITH " + DIF + " SELECT vec_id, round(coalesce(avg(abs(x - p)) FILTER (p IS NOT NULL AND x BETWEEN lo AND hi AND p BETWEEN lo AND hi), 0), 5) AS cq_20_80 FROM df GROUP BY 1")
def _(spark, sf):
    return emb_features(spark, sf, "cq_20_80")


@query("f14_complexity", "WITH " + DIF + " SELECT vec_id, round(sqrt(sum((x - p) ** 2) / min(var)), 5) AS cid FROM df WHERE p IS NOT NULL GROUP BY 1")
def _(spark, sf):
    return emb_features(spark, sf, "cid")


@query("e21_channel_zscore", "WITH x AS (SELECT label AS session_id, vec_id, i % 2 AS c, i // 2 AS t, embedding[i + 1]::DOUBLE AS v FROM (SELECT *, unnest(range(64)) AS i FROM embeddings)), s AS (SELECT session_id, c, avg(v) AS m, stddev_pop(v) AS s FROM x GROUP BY 1, 2) SELECT vec_id, round(sum(abs((v - m) / s)), 2) AS norm FROM x JOIN s USING (session_id, c) GROUP BY 1")
def _(spark, sf):
    e = embeddings(spark, sf).selectExpr(
        "label as session_id", "vec_id as k", "transform(sequence(0, 31), i -> array(x[2 * i], x[2 * i + 1])) as x"
    )
    z = ft.zscore_channels(e)
    return z.selectExpr("k as vec_id", "round(aggregate(flatten(x), 0.0D, (acc, v) -> acc + abs(cast(v as double))), 2) as norm")


# ── raw windows, sampling, reshaping ────────────────────────────────────────


@query("f17_sequence_windows", "WITH" + WIN + " SELECT session_id, k, count(*) AS n, round(avg(ts), 3) AS t_center_ms, " + ", ".join(
    f"round(sum((rn - k * 4 + 1) * CAST({c} AS FLOAT)::DOUBLE), 3) AS {c}" for c in SIX) + " FROM win GROUP BY 1, 2")
def _(spark, sf):
    w = ft.sequence_windows(merged(spark, sf), seq_len=8, stride=4, width=WIDTH)
    place = "round(aggregate(transform(x, (r, i) -> (i + 1) * cast(r[{0}] as double)), 0.0D, (a, v) -> a + v), 3) as {1}"
    return w.selectExpr("session_id", "k", "cast(size(x) as bigint) as n", "round(t_center_ms, 3) as t_center_ms", *[place.format(i, c) for i, c in enumerate(SIX)])


def tap_sql(up, down):
    return "[" + ", ".join(f"{float(t)!r}::DOUBLE" for t in ft.lowpass_taps(up, down)) + "]"


# Every third session at 100 Hz, the others at 50, as measured a little off.
RATES = "if(session_id % 3 = 0, 99.5D, 50.4D)"
NUM = ", num AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts, _ord) - 1 AS rn, count(*) OVER (PARTITION BY session_id) AS n FROM watch)"
# Outputs of one ratio: each the sum of the samples that its filter reaches.
CONV = """, o{name} AS (SELECT session_id, unnest(range(CAST(ceil(n * {up} / {down}.0) AS BIGINT))) AS m FROM (SELECT DISTINCT session_id, n FROM num WHERE {which})), y{name} AS (
  SELECT o{name}.session_id, m, max(n) AS n, min(ts) AS low, {sums} FROM o{name} JOIN num ON num.session_id = o{name}.session_id AND m * {down} - rn * {up} BETWEEN -{half} AND {half} GROUP BY 1, 2)"""


def conv(name, up, down, which, cols=SIX, level=False):
    half = 10 * max(up, down)
    tap = f"{tap_sql(up, down)}[CAST(m * {down} - rn * {up} + {half} + 1 AS INT)]"
    sums = ", ".join(f"sum({c} * {tap}){f' / sum({tap})' if level else ''} AS {c}" for c in cols)
    return CONV.format(name=name, up=up, down=down, which=which, half=half, sums=sums)


BOTH = conv("a", 3, 5, "session_id % 3 <> 0") + conv("b", 3, 10, "session_id % 3 = 0") + ", y AS (SELECT * FROM ya UNION ALL SELECT * FROM yb)"


@query("f18_resample_30hz", "WITH" + WATCH + NUM + BOTH + " SELECT session_id, m, " + ", ".join(f"round({c}, 5) AS {c}" for c in SIX) + " FROM y")
def _(spark, sf):
    """All channels of sessions of both rates at 30 Hz."""
    rows = ft.number_samples(watch(spark, sf), fs_hz=1.0, width=WIDTH)
    rows = rows.selectExpr("*", "3 as up", "if(session_id % 3 = 0, 10, 5) as down")
    return r6(ft.polyphase(rows, SIX), *SIX, d=5)


CLOSED = CLOSE[len(SAMPLES):] + f""", closed AS (SELECT _ord, CASE WHEN ru.run > 0 AND ru.run < last AND l = 0 AND t1 - t0 <= {12 * HOUR} THEN 1 - label ELSE label END AS label
  FROM rr JOIN ru ON ru.session_id = rr.session_id AND ru.run = rr.run)"""


@query("f18_resampled_windows", "WITH" + WATCH + CLOSED + NUM + BOTH + """, s AS (
  SELECT session_id, min(ts) AS t0, max(n) AS n, CASE WHEN session_id % 3 = 0 THEN 100.0::DOUBLE ELSE 50.0::DOUBLE END AS hz FROM num GROUP BY session_id), l AS (
  SELECT y.session_id, y.m, t0 + y.m * (1000.0::DOUBLE / 30) AS t, ax, ay, az, least(CAST(round_even(y.m * hz / 30, 0) AS BIGINT), s.n - 1) AS rn, count(*) OVER (PARTITION BY y.session_id) AS n30 FROM y JOIN s USING (session_id)), c AS (
  SELECT l.*, closed.label AS lab FROM l JOIN num ON num.session_id = l.session_id AND num.rn = l.rn JOIN closed ON closed._ord = num._ord), w AS (
  SELECT c.*, k.k FROM c JOIN (SELECT session_id, unnest(range(0, (n30 - 12) // 6 + 1)) AS k FROM (SELECT DISTINCT session_id, n30 FROM c WHERE n30 >= 12)) k ON k.session_id = c.session_id AND m BETWEEN k.k * 6 AND k.k * 6 + 11)
  SELECT session_id, k, count(*) AS n, round(avg(t), 1) AS t_center_ms, CAST(avg(lab) >= 0.5 AS INT) AS label, """ + ", ".join(f"round(sum(CAST({c} AS FLOAT)::DOUBLE * (m - k * 6 + 1)), 3) AS {c}" for c in ("ax", "ay", "az")) + " FROM w GROUP BY 1, 2")
def _(spark, sf):
    """Windows over both rates: every value of the three channels by its place."""
    m = merged(spark, sf)
    w = ft.resampled_windows(m, m.select("session_id").distinct().selectExpr("session_id", f"{RATES} as source_hz"), win=12, stride=6, max_gap_ms=12 * HOUR, width=WIDTH)
    place = "round(aggregate(transform(x[{0}], (v, i) -> (i + 1) * cast(v as double)), 0.0D, (a, v) -> a + v), 3) as {1}"
    return w.selectExpr("session_id", "k", "cast(size(x[0]) as bigint) as n", "round(t_center_ms, 1) as t_center_ms", "label", *[place.format(i, c) for i, c in enumerate(("ax", "ay", "az"))])


@query("f19_decimation", "WITH" + WATCH + NUM + conv("d", 1, 2, "session_id % 3 = 0", (*SIX, "gx", "gy", "gz"), True) + """
  SELECT d.session_id, _ord, ts, 50.0::DOUBLE AS sample_rate_hz, """ + ", ".join(f"round(d.{c}, 5) AS {c}" for c in (*SIX, "gx", "gy", "gz")) + """ FROM yd d JOIN num ON num.session_id = d.session_id AND num.rn = 2 * d.m
  UNION ALL SELECT session_id, _ord, ts, 50.4::DOUBLE, """ + ", ".join(f"round({c}, 5)" for c in (*SIX, "gx", "gy", "gz")) + " FROM watch WHERE session_id % 3 <> 0")
def _(spark, sf):
    """Sessions at 100 Hz to 50, with gravity; sessions at 50 stay as they are."""
    w = watch(spark, sf).withColumn("sample_rate_hz", F.expr(RATES))
    factors = ft.decimation_factors(w.groupBy("session_id").agg(F.max("sample_rate_hz").alias("source_hz")), 50.0)
    nine = (*SIX, "gx", "gy", "gz")
    out = ft.decimate(w, factors, target_hz=50.0, keep_gravity=True, width=WIDTH).select("session_id", "_ord", "ts", "sample_rate_hz", *nine)
    return r6(out, *nine, d=5)


def raw6(spark, sf):
    """Embeddings as ten rows of six channels."""
    return embeddings(spark, sf).selectExpr("vec_id as k", "transform(sequence(0, 9), i -> slice(x, 6 * i + 1, 6)) as x")


NORM6 = "WITH e AS (SELECT vec_id AS k, unnest(range(60)) AS i, embedding FROM embeddings) SELECT k, 10::BIGINT AS rows, round(sqrt(sum(embedding[i + 1]::DOUBLE ** 2)), 4) AS norm FROM e GROUP BY 1"
norm6 = "round(sqrt(aggregate(flatten(x), 0.0D, (a, v) -> a + v * v)), 4) as norm"


@query("f20_rotate", NORM6)  # a rotation keeps every vector's length
def _(spark, sf):
    return ft.augment(raw6(spark, sf), "rotate").selectExpr("k", "cast(size(x) as bigint) as rows", norm6)


@query("f20_augmentations")
def _(spark, sf):
    out = None
    for kind in ("scale", "jitter", "magnitude_warp", "time_warp"):
        d = ft.augment(raw6(spark, sf), kind).selectExpr("k", f"'{kind}' as kind", "size(x) as rows", norm6)
        out = d if out is None else out.unionByName(d)
    return out


@query("f21_long_format", "WITH" + WIN + ", l AS (" + " UNION ALL ".join(f"SELECT session_id, k, rn - k * 4 AS time, '{a}' AS variable, {a} AS value FROM win" for a in SIX) + ") SELECT session_id, k, variable, count(*) AS n, round(sum(value * (time + 1)), 6) AS s FROM l GROUP BY ALL")
def _(spark, sf):
    l = ft.long_format(watch(spark, sf), window_sec=1.0, stride_sec=0.5, fs_hz=8.0, cols=list(SIX), width=WIDTH)
    return l.groupBy("session_id", "k", "variable").agg(F.count("*").alias("n"), rnd(F.expr("sum(value * (time + 1))"), 6).alias("s"))


@query("f21_balanced_sample", "WITH" + SAMPLES + """, c AS (SELECT session_id, label, count(*) AS n, sum(count(*)) OVER (PARTITION BY session_id) AS t FROM samples GROUP BY 1, 2)
  SELECT session_id, label, CASE WHEN t <= 40 THEN n ELSE least(n, 20) END AS n FROM c""")
def _(spark, sf):
    s = ft.balanced_sample(samples(spark, sf).drop("k").withColumnRenamed("_ord", "k"), 40)
    return s.groupBy("session_id", "label").agg(F.count("*").alias("n"))


@query("f22_stratified_sample", "WITH" + SAMPLES + """, c AS (SELECT person_id, label, count(*) AS n, sum(count(*)) OVER () AS t FROM samples GROUP BY 1, 2)
  SELECT person_id, label, CASE WHEN t <= 2000 THEN n ELSE greatest(1, CAST(round_even(n * (2000 / t::DOUBLE), 0) AS BIGINT)) END AS n FROM c""")
def _(spark, sf):
    s = ft.stratified_sample(samples(spark, sf), 2000, ["_ord"])
    return s.groupBy("person_id", "label").agg(F.count("*").alias("n"))


@query("f23_gravity_orientation", "WITH" + WATCH + """ SELECT _ord, round(-gx / sqrt(gx*gx + gy*gy + gz*gz), 6) + 0.0 AS down_x, round(-gy / sqrt(gx*gx + gy*gy + gz*gz), 6) + 0.0 AS down_y, 1.0::DOUBLE AS det FROM watch""")
def _(spark, sf):
    # A flipped gravity keeps clear of the half turn; the third column is minus the image of down.
    w = watch(spark, sf).withColumn("gz", -F.col("gz"))
    o = ft.orientation_from_gravity(w)
    det = "r00*(r11*r22 - r12*r21) - r01*(r10*r22 - r12*r20) + r02*(r10*r21 - r11*r20)"
    return r6(o.selectExpr("_ord", "r02 as down_x", "r12 as down_y", f"{det} as det"), "down_x", "down_y", "det")


@query("f23_quaternion_orientation")
def _(spark, sf):
    w = watch(spark, sf).selectExpr("*", "ax as qx", "ay as qy", "az as qz", "1.0D as qw")
    o = ft.orientation_from_quaternion(w)
    return r6(o.select("_ord", "session_id", "transposed", "r00", "r11", "r22"), "r00", "r11", "r22")


@query("e33_pen_polyline", "WITH" + PEN + f""", l AS (SELECT *, ts - lag(ts) OVER (PARTITION BY session_id ORDER BY ts, _ord) AS dt FROM pen)
  SELECT _ord, CASE WHEN dot_type IN ('PEN_DOWN','PEN_MOVE') AND NOT coalesce(dt > {6 * HOUR}, false) THEN x END AS x, CASE WHEN dot_type IN ('PEN_DOWN','PEN_MOVE') AND NOT coalesce(dt > {6 * HOUR}, false) THEN y END AS y FROM l""")
def _(spark, sf):
    return ft.pen_polyline(pen(spark, sf), 6 * HOUR, width=WIDTH).select("_ord", "x", "y")


@query("e34_first_mixed_window", "WITH" + SAMPLES + f""", s AS (SELECT session_id, min(ts) AS t0, max(ts) AS t1 FROM samples GROUP BY 1), g AS (
  SELECT session_id, t0, 20 + 4 * unnest(range(0, greatest(0, CAST(ceil((((t1 - t0) / {HOUR}.0) - 100 - 20) / 4) AS BIGINT)))) AS c, (t1 - t0) / {HOUR}.0 - 100 AS lim FROM s), h AS (
  SELECT g.session_id, c FROM g JOIN samples x ON x.session_id = g.session_id AND (x.ts - t0) / {HOUR}.0::DOUBLE BETWEEN c AND c + 100 WHERE c < lim GROUP BY 1, 2 HAVING count(*) > 5 AND avg(label) > 0.3 AND avg(label) < 0.85)
  SELECT s.session_id, coalesce(min(c), 30)::DOUBLE AS start_s FROM s LEFT JOIN h USING (session_id) GROUP BY 1""")
def _(spark, sf):
    return ft.first_mixed_window(samples(spark, sf), 100, unit_ms=HOUR)
