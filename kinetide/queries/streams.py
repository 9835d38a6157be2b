"""Streaming plans run to the end of the given tables."""

from pyspark.sql import functions as F

from ..kernels import Ordering, scan, with_chunks
from ..kernels.attach import marked
from ..models import panel
from ..operators import decode as hmm
from ..operators import evaluate as ev
from ..operators import features as ft
from ..session import fresh_path, staged
from ..streaming import ingest, scoring, state
from ..streaming.runtime import drain, files_of_part, folder_stream, latest, merge_late, replay, split_late, with_end
from .data import HOUR, SAMPLES, WIDTH, millis, rnd, samples
from .evaluate import FWD, r6
from .focus import GAP
from .registry import query


def stream(spark, sf, name="events", key="event_id"):
    """The whole table in its order, over at least four micro-batches."""
    from ..session import configure

    return replay(configure(spark).read.parquet(f"{sf}/{name}.parquet"), name, key)


def sample_stream(spark, sf):
    e = stream(spark, sf)
    k = F.get_json_object("props", "$.k").cast("double")
    return e.select(
        F.col("user_id").alias("session_id"), (F.col("user_id") % 20).alias("person_id"), F.col("event_id").alias("_ord"),
        millis("ts").alias("ts"), "event_type", F.col("value").alias("v"), k.alias("k"),
        F.when(F.col("event_type").isin("click", "purchase"), 1).otherwise(0).alias("label"),
        F.least(F.col("value") / 200.0, F.lit(1.0)).alias("p"),
    )


LATENESS = "6 hours"


def arriving(rows, delay="if(_ord % 10 = 3, 2, 0) * 3600000", key="ts", end_ms=None, batches=6, **end):
    """Rows in the order of their arrival, some of them delayed; with a last row that closes what is open."""
    rows = rows.withColumn("_arrival", F.expr(f"{key} + {delay}"))
    if end_ms is not None:
        rows = with_end(rows, key, end_ms, session_id=-1, _ord=1 << 62, **end).withColumn("_arrival", F.coalesce("_arrival", F.lit(1 << 62)))
    return replay(rows, "arriving", "_arrival", batches).drop("_arrival")


def wire(spark, sf):
    """Events as wire payloads: some bare lists, some with a broken sample."""
    s = sample_stream(spark, sf)
    sample = F.to_json(F.struct("ts", F.col("v").alias("ax"), F.col("k").alias("rx")))
    env = F.concat(
        F.lit('{"samples":['), sample, F.when(F.col("_ord") % 5 == 0, F.lit(',"bad",7')).otherwise(F.lit("")), F.lit('],"sequence":'),
        F.col("k").cast("bigint").cast("string"), F.lit(',"watchSentAt":'), F.col("ts").cast("string"),
        F.lit(',"phoneReceivedAt":'), (F.col("ts") + 30).cast("string"), F.lit(',"sessionId":"'), F.col("session_id").cast("string"), F.lit('"}'),
    )
    bare = F.concat(F.lit("["), sample, F.lit("]"))
    return s.select("_ord", (F.col("ts") + 50).alias("received_ms"), F.when(F.col("_ord") % 7 == 0, bare).otherwise(env).alias("value"))


@query("i1_envelope_ingest", "WITH" + SAMPLES + """ SELECT _ord, CASE WHEN _ord % 7 <> 0 THEN CAST(session_id AS VARCHAR) ELSE 'none' END AS session_id, ts, v AS ax, k AS rx, ts + 50 AS server_received_ms FROM samples""")
def _(spark, sf):
    rows = drain(ingest.parse_envelopes(wire(spark, sf)), "ingest")
    return rows.select("_ord", F.coalesce("session_id", F.lit("none")).alias("session_id"), "ts", "ax", "rx", "server_received_ms")


@query("i2_head_ingest", "WITH" + SAMPLES + """ SELECT CASE WHEN person_id % 3 > 0 THEN 'live' WHEN _ord % 7 <> 0 THEN CAST(session_id AS VARCHAR) ELSE 'unsessioned' END AS session_id, count(*) AS n FROM samples GROUP BY 1""")
def _(spark, sf):
    src = wire(spark, sf).withColumn("value", F.regexp_replace("value", "watchSentAt", "airpodsSentAt"))
    rows = drain(ingest.parse_envelopes(src), "head")
    owner = spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_id").alias("_ord"), (F.col("user_id") % 20).cast("string").alias("source"))
    rows = rows.drop("source").join(owner, "_ord")
    active = owner.select("source").distinct().filter("cast(source as int) % 3 > 0").withColumn("session_id", F.lit("live"))
    return ingest.assign_sessions(rows, active).groupBy("session_id").agg(F.count("*").alias("n"))


@query("i3_redelivery", "WITH" + SAMPLES + " SELECT session_id, count(*) AS n, round(sum(v), 4) AS sum_v FROM samples GROUP BY 1")
def _(spark, sf):
    """Some samples come twice, some two hours late, some two weeks late, each is in the table once."""
    s = samples(spark, sf).select("session_id", "_ord", "ts", "v", "k")
    delay = "case when _ord % 10 = 3 then 2 when _ord % 101 = 7 then 14 * 24 else 0 end * 3600000"
    twice = s.withColumn("again", F.lit(0)).unionByName(s.filter("k < 40").withColumn("again", F.lit(1)))
    stream = arriving(twice, f"{delay} + again * 3600000 * (_ord % 200)").drop("again")
    on_time, late = split_late(stream, "late", "ts", 6 * HOUR)
    keys, table = ["session_id", "ts", "v", "k"], fresh_path(spark, "deduplicated")
    rows = ingest.drop_redelivered(folder_stream(spark, on_time), keys, LATENESS).drop("event_time")
    drain(rows, "dedup", paths=(table, fresh_path(spark, "dedup-state")))
    late = spark.read.option("basePath", late).parquet(f"{late}/_batch=*").drop("_batch")
    for _ in range(2):  # a batch that is merged again changes nothing
        out = merge_late(spark, table, late, "1000000000", keys, "ts")
    return out.groupBy("session_id").agg(F.count("*").alias("n"), rnd(F.sum("v"), 4).alias("sum_v"))


@query("i4_live_gaps", "WITH" + SAMPLES + """, g AS (SELECT session_id, _ord, CAST(k AS BIGINT) AS s, CAST(lag(k) OVER (PARTITION BY session_id ORDER BY _ord) AS BIGINT) AS p FROM samples)
  SELECT session_id, _ord, p AS after_seq, s AS next_seq, s - p - 1 AS gap, CAST(sum(s - p - 1) OVER (PARTITION BY session_id ORDER BY _ord) AS BIGINT) AS total FROM g WHERE s - p > 1""")
def _(spark, sf):
    s = sample_stream(spark, sf).selectExpr("session_id", "_ord", "cast(k as bigint) as sequence")
    out = state.run(s, state.SequenceGaps(), "session_id bigint, _ord bigint, after_seq bigint, next_seq bigint, gap bigint, total bigint")
    return drain(out, "gaps").drop("_batch")


@query("i5_telemetry", "WITH" + SAMPLES + """, w AS (SELECT CAST(session_id AS VARCHAR) AS session_id, CAST(k AS BIGINT) AS sequence, ts FROM samples WHERE _ord % 7 <> 0)
  SELECT session_id, sequence, count(*) AS batch_size, 30 AS phone_latency_ms, 20 AS server_latency_ms, 50 AS clock_skew_ms, round(CASE WHEN max(ts) > min(ts) THEN (count(*) - 1) * 1000.0::DOUBLE / (max(ts) - min(ts)) END, 9) AS batch_hz FROM w GROUP BY 1, 2""")
def _(spark, sf):
    rows = drain(ingest.parse_envelopes(wire(spark, sf)).filter("session_id is not null"), "telemetry")
    t = ingest.telemetry(rows)
    return t.select("session_id", "sequence", "batch_size", *[F.col(c).cast("int") for c in ("phone_latency_ms", "server_latency_ms", "clock_skew_ms")], rnd(F.col("batch_hz"), 9).alias("batch_hz"))


@query("i6_chart_windows", "WITH" + SAMPLES + f""" SELECT session_id, ts // {6 * HOUR} * {6 * HOUR} AS t, round(avg(v), 6) AS acc, round(avg(k), 6) AS gyro, max(label) AS writing FROM samples GROUP BY 1, 2""")
def _(spark, sf):
    s = arriving(samples(spark, sf)).selectExpr("session_id", "ts", "v as acc_mag", "k as gyro_mag", "label as writing")
    out = latest(drain(ingest.chart_points(s, "6 hours", lateness=LATENESS), "chart", mode="update"), ["session_id", "t"])
    return r6(out.select("session_id", "t", "acc", "gyro", "writing"), "acc", "gyro")


@query("i7_is_writing", "WITH" + SAMPLES + f""", t AS (SELECT * FROM samples WHERE event_type IN ('view','error')), d AS (SELECT * FROM samples WHERE event_type NOT IN ('view','error')), j AS (
  SELECT t.session_id, t._ord, t.ts, d.ts AS dt, d.event_type AS de FROM t LEFT JOIN d ON d.session_id = t.session_id AND d.ts <= t.ts QUALIFY row_number() OVER (PARTITION BY t._ord ORDER BY d.ts DESC NULLS LAST, d._ord DESC) = 1)
  SELECT session_id, _ord, CASE WHEN ts - dt <= {6 * HOUR} AND de IN ('click','signup') THEN 1 ELSE 0 END AS is_writing FROM j""")
def _(spark, sf):
    s = sample_stream(spark, sf).selectExpr(
        "session_id", "_ord", "ts", "if(event_type in ('view', 'error'), 'tick', 'pen') as kind", "cast(event_type in ('click', 'signup') as int) as writing"
    )
    p = state.Freshness()
    p.max_age = 6 * HOUR
    return drain(state.run(s, p, "session_id bigint, _ord bigint, is_writing int"), "fresh").drop("_batch")


@query("i7_writing_status", "WITH" + SAMPLES + f""", d AS (
  SELECT session_id, ts, CASE WHEN event_type IN ('click','signup') THEN 1 ELSE 0 END AS w FROM samples WHERE event_type NOT IN ('view','error') QUALIFY row_number() OVER (PARTITION BY session_id, ts ORDER BY _ord DESC) = 1), n AS (
  SELECT *, lead(ts) OVER (PARTITION BY session_id ORDER BY ts) AS next FROM d), e AS (
  SELECT session_id, ts AS t, w FROM n UNION ALL SELECT session_id, ts + {6 * HOUR} + 1, 0 FROM n WHERE w = 1 AND (next IS NULL OR next > ts + {6 * HOUR} + 1))
  SELECT session_id, t AS "at", w AS is_writing FROM e QUALIFY w <> coalesce(lag(w) OVER (PARTITION BY session_id ORDER BY t), 0)""")
def _(spark, sf):
    """Changes of the flag; when the last dot grows old a timer says so."""
    dots = samples(spark, sf).filter("event_type not in ('view', 'error')").selectExpr("session_id", "_ord", "ts", "cast(event_type in ('click', 'signup') as int) as writing")
    p = state.WritingStatus()
    p.max_age = 6 * HOUR
    s = arriving(dots, end_ms=2 * 24 * HOUR, writing=0)
    return drain(state.run_timed(s, p, "session_id bigint, at bigint, is_writing int", LATENESS), "status").filter("session_id >= 0").drop("_batch")


@query("i8_liveness", "WITH" + SAMPLES + f""", g AS (SELECT session_id, ts, lag(ts) OVER (PARTITION BY session_id ORDER BY ts, _ord) AS p FROM samples)
  SELECT session_id, ts AS at, 1 AS connected FROM g WHERE p IS NULL OR ts - p >= {24 * HOUR} UNION ALL SELECT session_id, p + {24 * HOUR}, 0 FROM g WHERE ts - p >= {24 * HOUR}
  UNION ALL SELECT session_id, max(ts) + {24 * HOUR}, 0 FROM samples GROUP BY session_id""")
def _(spark, sf):
    """Every session ends with a row that no event brings: its timer."""
    p = state.Liveness()
    p.timeout = 24 * HOUR
    s = arriving(samples(spark, sf).select("session_id", "_ord", "ts"), end_ms=3 * 24 * HOUR)
    return drain(state.run_timed(s, p, "session_id bigint, at bigint, connected int", LATENESS), "liveness").filter("session_id >= 0").drop("_batch")


def channels(spark, sf):
    """Samples with nine channels and a clock 1.2 million times as fast, so that windows of a second hold rows."""
    v, k = F.col("v"), F.col("k")
    return samples(spark, sf).select(
        "session_id", "_ord", F.expr("ts div 1200000").alias("ts"), (v / 10).alias("ax"), (k / 10).alias("ay"), ((v - k) / 20).alias("az"),
        F.sqrt(v).alias("rx"), (k * k / 1000).alias("ry"), ((v * k) / 1000).alias("rz"),
        *[F.lit(None).cast("double").alias(c) for c in ("gx", "gy", "gz")], F.col("label").alias("label_writing"),
    )


LIVE = {"fs_hz": 25.0, "tick_ms": 200, "stale_ms": 300, "lateness": "40 milliseconds"}


def live_ticks(spark, sf, transform=None, paths=None):
    s = arriving(channels(spark, sf).drop("label_writing"), "if(_ord % 10 = 3, 20, 0)", end_ms=2000, batches=4)
    ticks = scoring.live_windows(s, **LIVE).filter("session_id >= 0")
    return drain(ticks, "live", transform=transform, paths=paths)


TICKS = """, l AS (
  SELECT session_id, _ord, ts // 1200000 AS ts, v, k, row_number() OVER (PARTITION BY session_id ORDER BY ts // 1200000, _ord) AS r FROM samples), tk AS (
  SELECT session_id, unnest(generate_series(min(ts) + 200, max(ts) + 500, 200)) AS tick FROM l GROUP BY session_id), c AS (
  SELECT tk.session_id, tick, count(*) AS n, max(l.ts) AS last FROM tk JOIN l ON l.session_id = tk.session_id AND l.ts <= tick GROUP BY 1, 2), f AS (
  SELECT c.*, l.ts AS first, least(n, 125) AS held FROM c JOIN l ON l.session_id = c.session_id AND l.r = greatest(1, n - 124) WHERE tick - last <= 500), tg AS (
  SELECT session_id, tick AS tick_ms, n AS n_seen, last AS last_ts, CASE WHEN n < 25 THEN 'too_few' WHEN tick - last > 300 THEN 'stale' WHEN last = first THEN 'rate_mismatch'
    WHEN abs((held - 1) * 1000.0::DOUBLE / (last - first) - 25) / 25 > 0.2 THEN 'rate_mismatch' ELSE '' END AS guard FROM f)"""


@query("i9_live_windows", "WITH" + SAMPLES + TICKS + """, w AS (
  SELECT session_id, r, min(ts) OVER q AS first_ts, round(avg(v / 10) OVER q, 6) AS ax_mean, round(max(v * k / 1000) OVER q, 6) AS rz_max, round(sum(k * k / 1000) OVER q, 4) AS ry_sum
  FROM l WINDOW q AS (PARTITION BY session_id ORDER BY r ROWS 24 PRECEDING))
  SELECT tg.*, CASE WHEN guard = '' THEN first_ts ELSE -1 END AS first_ts, CASE WHEN guard = '' THEN ax_mean END AS ax_mean, CASE WHEN guard = '' THEN rz_max END AS rz_max, CASE WHEN guard = '' THEN ry_sum END AS ry_sum
  FROM tg LEFT JOIN w ON w.session_id = tg.session_id AND w.r = tg.n_seen""")
def _(spark, sf):
    """Each tick, its guard and its window: 25 rows at least, a silence gives one stale tick, the rate is that of 125 rows."""
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    return live_ticks(spark, sf).select(
        "session_id", "tick_ms", "n_seen", "last_ts", "guard", F.coalesce(F.get("t", F.lit(0)), F.lit(-1)).alias("first_ts"), rnd(total("ax") / F.size("ax")).alias("ax_mean"),
        rnd(F.array_max("rz")).alias("rz_max"), rnd(total("ry"), 4).alias("ry_sum"))


NAMES = [n for n in ft.BASE_FEATURES if not n.startswith("corr_")]


def batch_windows(spark, sf, spectral=True):
    """All windows of 25 rows by the batch builder; the window of n rows seen so far is number n - 25."""
    return ft.build_windows(channels(spark, sf).drop("gx", "gy", "gz"), window_sec=1.0, stride_sec=0.04, fs_hz=25.0, spectral=spectral, width=WIDTH // 1_200_000)


@query("g16_replay_comparison", "WITH" + SAMPLES + TICKS + ", nm AS (SELECT unnest(" + str(NAMES) + """) AS feature)
  SELECT feature, (SELECT count(*) FROM tg WHERE guard = '') AS windows, (SELECT count(*) FROM tg WHERE guard = '') AS equal FROM nm""")
def _(spark, sf):
    """Every feature of every live window against the batch builder over the raw samples."""
    ticks = live_ticks(spark, sf)
    live = scoring.live_features(ticks, fs_hz=25.0).join(ticks.selectExpr("session_id", "tick_ms as k", "n_seen"), ["session_id", "k"])
    # Of all windows those that no tick has are left out before the join by a mark, so they aren't shuffled.
    scored = ticks.filter("guard = ''").select("session_id", "n_seen")
    batch = marked(batch_windows(spark, sf).withColumn("n_seen", F.col("k") + 25), scored)
    parts = ", ".join(f"'{c}', a.{c}, b.{c}" for c in NAMES)
    both = live.alias("a").join(batch.alias("b"), ["session_id", "n_seen"]).selectExpr(f"stack({len(NAMES)}, {parts}) as (feature, x, y)")
    near = F.abs(F.col("x") - F.col("y")) <= 1e-6 * (1 + F.abs("y"))
    return both.groupBy("feature").agg(F.count("*").alias("windows"), F.count_if(near).alias("equal"))


SCORED = ["ax_mean", "ax_std", "ay_mean", "az_range", "rx_rms", "ry_max", "az_jerk_std", "acc_mag_energy", "gyro_mag_std"]


@query("a11_live_log", "WITH" + SAMPLES + TICKS + """
  SELECT session_id, count(*) AS ticks, count(*) FILTER (guard = '') AS scored, count(*) FILTER (guard = '') AS same_proba, count(*) FILTER (guard = '') AS same_posterior, count(*) FILTER (guard = '') AS logged
  FROM tg GROUP BY session_id""")
def _(spark, sf):
    """Samples to ticks, features, stored scaling and model, posterior and log on streams; against batch windows, the same
    stored model and the batch filter, restarted after each guard."""
    # A sample is in 25 of these windows: only what the model and the comparison read is aggregated.
    read = ["session_id", "t_center_ms", "label", (F.col("k") + 25).alias("n_seen"), *SCORED]
    batch = staged(batch_windows(spark, sf, spectral=False).select(*read), "batch-windows")
    model = fresh_path(spark, "live-model")
    panel.train_final(batch, SCORED, model, "logreg", fs_hz=25.0)
    table = fresh_path(spark, "scored")
    live_ticks(spark, sf, scoring.scorer(spark, model, "m1"), (table, fresh_path(spark, "scored-state")))
    params = spark.createDataFrame([(0.9, 0.1, 0.2, 0.8, 0.6, 0.4)], ", ".join(f"{c} double" for c in hmm.PARAMS))
    # A part's ticks at a time: a session's are in one file of each part, and the parts' files come in order.
    ticks = folder_stream(spark, table, files_of_part(spark, table))
    posterior = drain(scoring.live_posterior(ticks, params), "posterior").drop("_batch")
    scored = spark.read.option("basePath", table).parquet(f"{table}/_batch=*").drop("_batch")
    log = scoring.log_of(scored, posterior)
    # The batch side: the same model on batch windows, and the filter over runs between guards.
    want = panel.score_table(spark, batch, SCORED, model).select("session_id", "n_seen", F.col("proba").alias("want"))
    seq = Ordering(("session_id",), ("ts", "_ord"))
    ordered = with_chunks(scored.filter("guard <> 'too_few'").withColumn("_ord", F.col("ts")), ["session_id"], "ts", "_ord", 10_000)
    runs = scan(ordered, seq, sums={"run": (F.col("guard") != "").cast("long")}).filter("guard = ''").join(want, ["session_id", "n_seen"])
    runs = staged(runs.withColumn("_ord", F.concat_ws(":", "session_id", "ts")).withColumn("t_center_ms", F.col("ts")), "runs")
    filtered = hmm.decode(runs.crossJoin(F.broadcast(params)), "want", width=10_000).select("_ord", F.col("filtered").alias("want_filtered"))
    both = scored.join(runs.select("session_id", "ts", "want", "_ord"), ["session_id", "ts"], "left").join(filtered, "_ord", "left").join(posterior, ["session_id", "ts"], "left")
    near = lambda a, b: F.count_if(F.abs(F.col(a) - F.col(b)) < 1e-7)
    out = both.groupBy("session_id").agg(
        F.count("*").alias("ticks"), F.count("proba").alias("scored"), near("proba", "want").alias("same_proba"), near("filtered", "want_filtered").alias("same_posterior"))
    logged = log.groupBy("session_id").agg(F.count("proba").alias("logged"))
    return out.join(logged, "session_id", "left").na.fill({"logged": 0})


@query("i10_online_hmm", "WITH" + FWD + " SELECT _ord, round(x1, 6) AS filtered FROM fw")
def _(spark, sf):
    """Stream-static join of the parameters, state carried from tick to tick; equals the batch filter."""
    from .data import oof

    o = oof(spark, sf)
    params = hmm.parameters(hmm.leave_one_out(hmm.transition_counts(o, ["person_id"], width=WIDTH)))
    s = sample_stream(spark, sf).selectExpr(
        "session_id", "person_id", "_ord", "ts", "(k + 50.0D * label) / 150.0D as proba", "cast(null as string) as guard", "'m1' as model_id"
    ).join(params, "person_id")
    ticks = hmm.likelihoods(s, "proba").drop("person_id", "proba")
    out = drain(state.run(ticks, state.OnlineFilter(), "session_id bigint, _ord bigint, filtered double"), "online")
    return r6(out.select("_ord", "filtered"), "filtered")


@query("i11_running_seconds", "WITH" + SAMPLES + """ SELECT session_id, strftime(to_timestamp(ts / 1000.0), '%Y-%m-%d') AS date, count(*)::DOUBLE AS seconds FROM samples WHERE label = 1 GROUP BY 1, 2""")
def _(spark, sf):
    s = arriving(samples(spark, sf)).selectExpr("session_id", "ts", "label as writing")
    out = latest(drain(ingest.running_writing_seconds(s, lateness=LATENESS), "daily", mode="update"), ["session_id", "day"])
    return out.select("session_id", F.date_format("day", "yyyy-MM-dd").alias("date"), "seconds")


@query("i12_sparkline", "WITH" + SAMPLES + """, r AS (SELECT session_id, ts, p FROM samples QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, _ord DESC) <= 10)
  SELECT session_id, count(*) AS n, min(ts) AS first_ts, round(arg_max(p, ts), 6) AS last_p, round(sum(p), 6) AS sum_p FROM r GROUP BY 1""")
def _(spark, sf):
    rows = drain(sample_stream(spark, sf).select("session_id", "_ord", "ts", F.col("p").alias("proba")), "ticks")
    pts = ingest.recent_probabilities(rows, 10)
    return pts.selectExpr(
        "session_id", "cast(size(points) as bigint) as n", "points[0].ts as first_ts", "round(element_at(points, -1).proba, 6) as last_p",
        "round(aggregate(points, 0.0D, (a, x) -> a + x.proba), 6) as sum_p",
    )


@query("i13_session_windows", "WITH" + SAMPLES + f""", w AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY session_id ORDER BY ts, _ord) > {GAP} THEN 1 ELSE 0 END AS b FROM samples WHERE label = 1), n AS (
  SELECT *, sum(b) OVER (PARTITION BY session_id ORDER BY ts, _ord) AS i FROM w) SELECT session_id, min(ts) AS start_ms, max(ts) AS end_ms, (max(ts) - min(ts)) / 1000.0::DOUBLE AS duration_s FROM n GROUP BY session_id, i""")
def _(spark, sf):
    """Closed by the watermark on the stream; ticks behind it come as corrections."""
    ticks = samples(spark, sf).selectExpr("session_id", "_ord", "ts", "label as writing")
    delay = "case when _ord % 10 = 3 then 2 when _ord % 101 = 7 then 14 * 24 else 0 end * 3600000"
    on_time, late = split_late(arriving(ticks, delay, end_ms=GAP + 2 * 24 * HOUR, writing=1), "late-ticks", "ts", 6 * HOUR)
    closed = drain(ingest.session_stretches(folder_stream(spark, on_time), GAP, lateness=LATENESS), "stretches").filter("session_id >= 0")
    return ingest.with_late_ticks(closed, spark.read.parquet(f"{late}/_batch=*"), GAP)


@query("i14_training_progress", """SELECT 'R' || (o_custkey % 40) AS run_id, max(o_custkey % 15) AS folds, count(*) FILTER (o_orderstatus = 'F') AS done, round(avg(o_totalprice) FILTER (o_orderstatus = 'F'), 4) AS mean_acc, round(sum(o_totalprice / 1000) FILTER (o_orderstatus = 'F'), 3) AS sec FROM orders GROUP BY 1""")
def _(spark, sf):
    o = stream(spark, sf, "orders", "o_orderkey").selectExpr(
        "to_json(struct(concat('R', cast(o_custkey % 40 as string)) as run_id, if(o_orderstatus = 'F', 'fold_done', 'fold_start') as event, "
        "o_custkey % 15 as folds, o_totalprice as accuracy, o_totalprice / 1000 as sec)) as value"
    )
    out = latest(drain(ingest.training_progress(o), "training", mode="update"), ["run_id"])
    return r6(r6(out, "mean_acc", d=4), "sec", d=3)


@query("i15_stream_rates", "WITH" + SAMPLES + f" SELECT event_type AS stream, ts // {HOUR} * {HOUR} AS t, count(*) AS n FROM samples GROUP BY 1, 2")
def _(spark, sf):
    s = arriving(samples(spark, sf)).selectExpr("event_type as stream", "ts")
    return latest(drain(ingest.stream_rates(s, "1 hour", lateness=LATENESS), "rates", mode="update"), ["stream", "t"]).select("stream", "t", "n")


@query("i16_change_only_stream", "WITH" + SAMPLES + """ SELECT session_id, _ord, event_type AS value FROM (SELECT *, lag(event_type) OVER (PARTITION BY session_id ORDER BY _ord) AS prev FROM samples) WHERE prev IS NULL OR prev <> event_type""")
def _(spark, sf):
    s = sample_stream(spark, sf).selectExpr("session_id", "_ord", "event_type as value")
    return drain(state.run(s, state.ChangeOnly(), "session_id bigint, _ord bigint, value string"), "changes").drop("_batch")


@query("a11_inference_log", "WITH" + SAMPLES + """ SELECT session_id, ts AS ts_ms, round(least(v / 207.3, 1.0), 4) AS proba, label AS writing, 'm1' AS model_id, round(k, 1) AS fs_hz FROM samples WHERE event_type NOT IN ('error','signup')""")
def _(spark, sf):
    s = sample_stream(spark, sf).selectExpr(
        "session_id", "ts", "least(v / 207.3D, 1.0D) as proba", "label as writing", "'m1' as model_id", "k as fs_hz",
        "case event_type when 'error' then 'rate_mismatch' when 'signup' then 'missing_channels' end as guard",
    )
    return drain(ingest.inference_log(s), "inference-log").drop("_batch")


@query("b13_quarantine_stream", "WITH" + SAMPLES + """ SELECT CASE WHEN person_id % 3 = 0 THEN 'unsessioned' ELSE 'live-' || person_id END AS session_id, count(*) AS n FROM samples GROUP BY 1""")
def _(spark, sf):
    from ..operators.clean import route_unsessioned

    active = samples(spark, sf).select("person_id").distinct().filter("person_id % 3 <> 0").selectExpr(
        "person_id as source", "concat('live-', cast(person_id as string)) as session_id"
    )
    s = sample_stream(spark, sf).withColumn("source", F.col("person_id")).drop("session_id")
    return drain(route_unsessioned(s, active), "routed").groupBy("session_id").agg(F.count("*").alias("n"))
