"""Evaluation over out-of-fold predictions: blocks, tasks, curves, tests, comparisons.

All measures take grouping keys, so every fold, scale or task is computed in one
plan.  Frames with one row per fold or configuration are small by nature; frames
with one row per window are not, and only meet partial aggregates or the chunked
kernels.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..kernels import Ordering, attach, auc, islands, nearest_asof, quantiles, ranked, scan, with_chunks
from ..kernels.moving import CENTRED, TRAILING, rolling
from ..kernels.order import CHUNK, row_numbers
from ..kernels.stats import average_rank
from ..schema import SENSOR_CHUNK_MS

SCALES = (60.0, 300.0, None)
BURSTS = (5.0, 10.0, 30.0)
STRIDE_FALLBACK_MS = 500.0
SPLIT_TEST, SPLIT_BUFFER = 0.2, 4
THRESHOLDS = tuple(round(0.05 + 0.01 * i, 2) for i in range(91))
TIME = Ordering(("session_id",), ("t_center_ms", "_ord"))


def in_time(df: DataFrame, width: int = SENSOR_CHUNK_MS, max_rows: int | None = 1_000_000) -> DataFrame:
    return with_chunks(df.drop(CHUNK), ["session_id"], "t_center_ms", "_ord", width, max_rows)


# ── classification measures ─────────────────────────────────────────────────


def confusion(df: DataFrame, keys: Sequence[str], proba: str, label: str = "label", threshold: float = 0.5) -> DataFrame:
    """Counts, accuracy and F1 of the writing class; an undefined F1 is 0."""
    hit = lambda p, y: F.count_if(F.expr(f"({proba} >= {threshold}) = {p} and {label} = {y}"))
    out = df.groupBy(*keys).agg(
        F.count("*").alias("n"), hit("true", 1).alias("tp"), hit("true", 0).alias("fp"),
        hit("false", 1).alias("fn"), hit("false", 0).alias("tn"),
    )
    return out.selectExpr(
        "*", "(tp + tn) / n as accuracy", "if(2 * tp + fp + fn = 0, 0.0D, 2 * tp / (2 * tp + fp + fn)) as f1_writing"
    )


def metrics(df: DataFrame, keys: Sequence[str], proba: str, label: str = "label") -> DataFrame:
    c = confusion(df, keys, proba, label)
    a = auc(df, keys, proba, label, "roc_auc")
    return c.join(a, list(keys), "left") if keys else c.crossJoin(a)


def roc_points(df: DataFrame, keys: Sequence[str], proba: str, label: str = "label", points: int = 40) -> DataFrame:
    """ROC corner points from high to low score, thinned to ``points`` at even positions.

    Collinear interior points are dropped first, as usual for such curves.
    """
    pos = F.expr(f"cast({label} = 1 as bigint)")
    rows = ranked(df, keys, proba, {"p": pos, "n": 1 - pos})
    from ..kernels.stats import value_bucket

    seq = Ordering(tuple(keys) or ("_one",), ("_neg",))
    src = rows.withColumn("_neg", -F.col(proba).cast("double"))
    src = (src if keys else src.withColumn("_one", F.lit(1))).withColumn(CHUNK, value_bucket(F.col("_neg")))
    src = src.withColumn("tps", F.col("p_all") - F.col("p_cum") + F.col("p")).withColumn(
        "fps", F.col("n_all") - F.col("n_cum") + F.col("n")
    )
    # A corner is a point where the step before and the step after differ in kind.
    near = scan(src, seq, nxt={"_nx": ["p", "n"]})
    corner = near.filter(
        "_nx is null or not ((p = 0 and _nx.p = 0) or (n = 0 and _nx.n = 0))"
    )
    held = list(seq.keys)
    origin = src.groupBy(*held).agg(F.max("p_all").alias("p_all"), F.max("n_all").alias("n_all")).withColumns(
        {"tps": F.lit(0).cast("long"), "fps": F.lit(0).cast("long"), "_neg": F.lit(float("-inf")),
         CHUNK: F.lit(-(1 << 60)).cast("long")}
    )
    cols = [*held, CHUNK, "_neg", "tps", "fps", "p_all", "n_all"]
    numbered = row_numbers(corner.select(*cols).unionByName(origin.select(*cols)), seq, "rn", total="n_rows")
    from .align import thin

    out = thin(numbered.filter("p_all > 0 and n_all > 0"), held, "rn", "n_rows", points)
    out = out.selectExpr(*held, "rn", "fps / n_all as fpr", "tps / p_all as tpr")
    return out if keys else out.drop("_one")


def reliability(df: DataFrame, keys: Sequence[str], proba: str, label: str = "label", bins: int = 10) -> DataFrame:
    """Mean probability, positive share and count per equal bin; the last bin is closed."""
    at = F.expr(f"cast(least(floor({proba} * {bins}), {bins - 1}) as int)")
    stats = df.withColumn("bin", at).groupBy(*keys, "bin").agg(
        F.avg(proba).alias("mean_p"), F.avg(label).alias("frac_pos"), F.count("*").alias("count")
    )
    groups = df.select(*keys).distinct() if keys else df.sparkSession.range(1).select()
    grid = groups.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return grid.join(stats, [*keys, "bin"], "left").withColumn("count", F.coalesce("count", F.lit(0).cast("long")))


def ece(df: DataFrame, keys: Sequence[str], proba: str, label: str = "label", bins: int = 10) -> DataFrame:
    r = reliability(df, keys, proba, label, bins)
    total = F.sum("count")
    return r.groupBy(*keys).agg((F.sum(F.col("count") * F.abs(F.col("frac_pos") - F.col("mean_p"))) / total).alias("ece"))


def brier(df: DataFrame, keys: Sequence[str], methods: Sequence[str], label: str = "label") -> DataFrame:
    return df.groupBy(*keys).agg(*[F.avg(F.pow(F.col(m) - F.col(label), 2)).alias(f"brier_{m}") for m in methods])


# ── time blocks and tasks ───────────────────────────────────────────────────

PCT = ("100.0D * avg(cast(proba_cal >= 0.5 as int))", "100.0D * avg(proba_cal)", "100.0D * avg(label)")


def block_percentages(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    pred, proba, true = (F.expr(e) for e in PCT)
    return df.groupBy(*keys).agg(
        F.count("*").alias("n_windows"), pred.alias("pred_pct"), proba.alias("pred_pct_proba"), true.alias("true_pct")
    )


def time_blocks(
    oof: DataFrame, pen_truth: DataFrame | None = None, scales: Sequence[float | None] = SCALES
) -> DataFrame:
    """Writing percent per (session, scale, block), all scales in one pass.

    Blocks start at the session's first window; scale 0 is the whole session.
    Pen truth counts earlier samples into block 0.
    """
    scale = F.explode(F.array(*[F.lit(float(s or 0)) for s in scales])).alias("scale")
    start = oof.groupBy("session_id").agg(F.min("t_center_ms").alias("_a"))
    cut = "if(scale = 0, 0L, cast(floor(({t} - _a) / (scale * 1000.0D)) as bigint))"
    rows = attach(oof, start, ["session_id"]).select("*", scale).withColumn("block", F.expr(cut.format(t="t_center_ms")))
    out = block_percentages(rows, ["session_id", "person_id", "scale", "block"]).withColumnRenamed("true_pct", "truth_closed_pct")
    out = out.join(start, "session_id").withColumn("block_start_ms", F.expr("_a + block * scale * 1000.0D")).drop("_a")
    if pen_truth is None:
        return out.withColumn("truth_pen_pct", F.lit(None).cast("double"))
    pen = attach(pen_truth.filter("ts is not null"), start, ["session_id"]).select("*", scale)
    pen = pen.withColumn("block", F.expr(f"greatest(0L, {cut.format(t='ts')})")).groupBy("session_id", "scale", "block").agg(
        (F.avg("label_writing") * 100.0).alias("truth_pen_pct")
    )
    return out.join(pen, ["session_id", "scale", "block"], "left")


def regression_metrics(blocks: DataFrame, keys: Sequence[str] = ("scale",)) -> DataFrame:
    """MAE, RMSE and bias in percentage points against both truths."""
    long = blocks.selectExpr(
        *keys, "pred_pct", "stack(2, 'closed', truth_closed_pct, 'pen', truth_pen_pct) as (truth, value)"
    ).filter("value is not null and pred_pct is not null")
    e = F.col("pred_pct") - F.col("value")
    return long.groupBy(*keys, "truth").agg(
        F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias")
    )


def engagement(assigned: DataFrame) -> DataFrame:
    """Writing percent per session and task block with its error."""
    keys = ["session_id", "person_id", "task_index", "task_id", "task_category"]
    out = block_percentages(assigned.filter("task_index is not null"), keys)
    return out.withColumn("error_pp", F.col("pred_pct") - F.col("true_pct"))


def person_task_matrix(eng: DataFrame, tasks: Sequence[str]) -> DataFrame:
    """Mean true and predicted percent per person and writing task, and the idle mean."""
    writing = eng.filter("task_category = 'writing'").groupBy("person_id").pivot("task_id", list(tasks)).agg(
        F.avg("true_pct").alias("true"), F.avg("pred_pct").alias("pred")
    )
    idle = eng.filter("task_category = 'idle'").groupBy("person_id").agg(F.avg("true_pct").alias("idle_true"))
    return writing.join(idle, "person_id", "full_outer")


def false_positive_rates(assigned: DataFrame, proba: str = "proba_cal", threshold: float = 0.5) -> DataFrame:
    """Idle windows called writing: per task, per person and task, and pooled, in one aggregate."""
    idle = assigned.filter("task_category = 'idle'").withColumn("_fp", (F.col(proba) >= threshold).cast("int"))
    out = idle.groupingSets([["task_id"], ["person_id", "task_id"], []], "person_id", "task_id").agg(
        F.grouping_id().alias("_g"), F.count("*").alias("n"), F.sum("_fp").alias("n_fp")
    )
    level = F.when(F.col("_g") == 0, "person_task").when(F.col("_g") == 2, "task").otherwise("all")
    return out.select(level.alias("level"), "person_id", "task_id", "n", "n_fp", (F.col("n_fp") / F.col("n")).alias("fpr"))


def pooled_rate(assigned: DataFrame, hard: Sequence[str], proba: str = "proba_cal", threshold: float = 0.5) -> DataFrame:
    """False-positive rate of hard-negative tasks against the other idle tasks."""
    idle = assigned.filter("task_category = 'idle'")
    kind = F.when(F.col("task_id").isin(*hard), "hard").otherwise("easy").alias("kind")
    return idle.groupBy(kind).agg(
        F.count("*").alias("n"), F.count_if(F.col(proba) >= threshold).alias("n_fp"),
        F.avg((F.col(proba) >= threshold).cast("int")).alias("fpr"),
    )


def task_errors(assigned: DataFrame, proba: str = "proba_raw", task: str = "task_id") -> DataFrame:
    """False positives and negatives per task, most errors first."""
    c = confusion(assigned, [task, "task_category"], proba)
    return c.selectExpr(
        task, "task_category", "n", "fp", "fn", "round(accuracy, 3) as acc", "round(fp / n, 3) as fp_rate", "round(fn / n, 3) as fn_rate"
    ).orderBy((F.col("fp") + F.col("fn")).desc(), task)


def with_error_type(df: DataFrame, proba: str, label: str = "label") -> DataFrame:
    return df.withColumn("pred", (F.col(proba) >= 0.5).cast("int")).withColumn(
        "error_type",
        F.expr(f"case when {label} = 1 then if(pred = 1, 'TP', 'FN') else if(pred = 1, 'FP', 'TN') end"),
    )


def error_analysis(df: DataFrame, proba: str, keys: Sequence[str]) -> DataFrame:
    """Shares, accuracy, confidence and error counts per group with the group's part of all errors."""
    rows = with_error_type(df, proba)
    ok = F.col("pred") == F.col("label")
    base = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg("label").alias("true_share"), F.avg("pred").alias("pred_share"),
        F.avg(ok.cast("int")).alias("acc"), F.avg(proba).alias("mean_proba"),
        *[F.count_if(F.col("error_type") == t).alias(t.lower()) for t in ("TP", "TN", "FP", "FN")],
        F.avg(F.when(ok, F.abs(F.col(proba) - 0.5))).alias("confidence_correct"),
        F.avg(F.when(~ok, F.abs(F.col(proba) - 0.5))).alias("confidence_wrong"),
    )
    # One row per group: the share of all errors is a window over groups.
    every = Window.partitionBy(F.lit(1))
    return base.withColumns({
        "fp_rate_of_idle": F.expr("case when fp + tn > 0 then fp / (fp + tn) end"),
        "fn_rate_of_writing": F.expr("case when fn + tp > 0 then fn / (fn + tp) end"),
        "fp_share": F.col("fp") / F.nullif(F.sum("fp").over(every), F.lit(0)),
        "fn_share": F.col("fn") / F.nullif(F.sum("fn").over(every), F.lit(0)),
    })


def error_streaks(df: DataFrame, proba: str, *, top: int = 12, width: int = SENSOR_CHUNK_MS) -> DataFrame:
    """Longest runs of one error type in time order; a correct window ends a run."""
    rows = in_time(with_error_type(df, proba), width)
    kind = F.when(F.col("error_type").isin("FP", "FN"), F.col("error_type")).otherwise(F.lit("ok"))
    rows = rows.withColumn("_k", kind)
    runs = islands(rows, TIME, ["_k"], lambda a, b: a["_k"] != b["_k"]).filter("_k <> 'ok'")
    out = runs.groupBy("session_id", "island").agg(
        F.first("_k").alias("error_type"), F.min("t_center_ms").alias("start_ms"), F.count("*").alias("length")
    )
    return out.drop("island").orderBy(F.desc("length"), "start_ms", "session_id").limit(top)


def boundary_distance(df: DataFrame, task: str = "task_id", *, width: int = SENSOR_CHUNK_MS) -> DataFrame:
    """Distance of each window to the nearest change of task."""
    rows = in_time(df, width)
    seen = scan(rows, TIME, prev={"_p": [task]})
    edges = seen.filter(F.col("_p").isNull() | ~F.col(f"_p.{task}").eqNullSafe(F.col(task)))
    out = nearest_asof(
        rows.drop(CHUNK), edges.select("session_id", "t_center_ms", "_ord"), ["session_id"], "t_center_ms", "_ord", [], width=width
    )
    return out.withColumnRenamed("delta", "boundary_ms").drop("r_t_center_ms", "r__ord")


BOUNDARY_BUCKETS = ((0, 2), (2, 5), (5, 15), (15, None))


def boundary_buckets(df: DataFrame, proba: str, unit_ms: float = 1000.0) -> DataFrame:
    """Accuracy and share of errors by distance to the nearest task change."""
    d = f"(boundary_ms / {unit_ms}D)"
    name = "case when {d} < 2 then '0-2s' when {d} < 5 then '2-5s' when {d} < 15 then '5-15s' else '>15s' end".format(d=d)
    rows = with_error_type(df, proba).withColumn("bucket", F.expr(name))
    wrong = F.col("pred") != F.col("label")
    out = rows.groupBy("bucket").agg(
        F.count("*").alias("n"), F.avg((~wrong).cast("int")).alias("accuracy"), F.count_if(wrong).alias("errors"),
        F.count_if(F.col("error_type") == "FN").alias("fn"), F.count_if(F.col("error_type") == "FP").alias("fp"),
    )
    every = Window.partitionBy(F.lit(1))  # four rows
    return out.withColumns({
        "share_of_errors": F.col("errors") / F.nullif(F.sum("errors").over(every), F.lit(0)),
        "share_of_windows": F.col("n") / F.sum("n").over(every),
    })


def block_accuracy(assigned: DataFrame, proba: str, blocks: Sequence[str]) -> DataFrame:
    """Accuracy person by block."""
    ok = ((F.col(proba) >= 0.5).cast("int") == F.col("label")).cast("int")
    return assigned.withColumn("_ok", ok).groupBy("person_id").pivot("block", list(blocks)).agg(F.avg("_ok"))


# ── smoothing over time ─────────────────────────────────────────────────────


def smoothed(
    oof: DataFrame, proba: str, scales: Sequence[float] = BURSTS, *, centred: bool = False, unit_ms: float = 1000.0,
    width: int = SENSOR_CHUNK_MS, max_rows: int | None = 1_000_000,
) -> DataFrame:
    """Trailing (or centred) mean over the scale's seconds, per session, for all scales at once.

    Rows per scale follow from the session's median step.
    """
    one = F.lit(1).cast("long")
    rows = scan(in_time(oof, width, max_rows), TIME, sums={"rn": one}, prev={"_p": ["t_center_ms"]}).selectExpr(
        *oof.drop(CHUNK).columns, "rn - 1 as rn", "t_center_ms - _p.t_center_ms as _dt"
    )
    step = quantiles(rows, ["session_id"], "_dt", {"_step": 0.5})
    sized = attach(rows.drop("_dt"), step, ["session_id"], "left").withColumn(
        "_step", F.expr(f"if(coalesce(_step, 0) = 0, {STRIDE_FALLBACK_MS}D, _step)")
    ).select("*", F.explode(F.array(*[F.lit(float(s)) for s in scales])).alias("scale"))
    sized = sized.withColumn("_n", F.expr(f"greatest(1, cast(bround(scale * {unit_ms}D / _step) as bigint))"))
    return rolling(
        sized, ["session_id", "scale"], "rn", "_n", {"smooth": f"avg({proba})"}, CENTRED if centred else TRAILING
    ).drop("_n", "_step", "rn")


def burst_metrics(oof: DataFrame, proba: str, keys: Sequence[str] = ("scale",), **options) -> DataFrame:
    return metrics(smoothed(oof, proba, **options), list(keys), "smooth")


def burst_sweep(fold_metrics: DataFrame) -> DataFrame:
    """Mean and spread of fold accuracy and AUC by scale."""
    return fold_metrics.groupBy("scale").agg(
        *[f(c).alias(f"{c}_{n}") for c in ("accuracy", "roc_auc") for f, n in ((F.avg, "mean"), (F.stddev_pop, "sd"))]
    )


# ── splits and scaling ──────────────────────────────────────────────────────


def temporal_split(
    df: DataFrame, *, test_share: float = SPLIT_TEST, buffer: int = SPLIT_BUFFER, width: int = SENSOR_CHUNK_MS
) -> DataFrame:
    """``role`` train or test by time; the rows just before the cut are dropped."""
    rows = row_numbers(in_time(df, width), TIME, "rn", total="n_rows")
    cut = f"cast(n_rows * (1.0D - {test_share}D) as bigint)"
    role = f"case when rn >= {cut} then 'test' when rn < greatest(0, {cut} - {buffer}) then 'train' end"
    return rows.withColumn("role", F.expr(role)).filter("role is not null").drop(CHUNK)


def calibration_prefix(df: DataFrame, *, width: int = SENSOR_CHUNK_MS) -> DataFrame:
    """``part``: calib for the first third of each session by time, else eval."""
    rows = row_numbers(in_time(df, width), TIME, "rn", total="n_rows")
    return rows.withColumn("part", F.expr("if(rn < n_rows div 3, 'calib', 'eval')")).drop(CHUNK)


def zscore_stats(df: DataFrame, keys: Sequence[str], cols: Sequence[str], sd: str = "stddev_samp") -> DataFrame:
    """Mean and deviation per column; a zero or missing deviation becomes 1."""
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"_m_{c}"), F.expr(f"coalesce(nullif({sd}({c}), 0), 1.0D)").alias(f"_s_{c}")]
    return df.groupBy(*keys).agg(*aggs)


def apply_zscore(df: DataFrame, stats: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    joined = attach(df, stats, keys) if keys else df.crossJoin(F.broadcast(stats))  # keyless statistics are one row
    return joined.select(
        *[((F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")).alias(c) if c in cols else F.col(c) for c in df.columns]
    )


def zscore_per_session(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return apply_zscore(df, zscore_stats(df, ["session_id"], cols), ["session_id"], cols)


def pooled_stats_by_fold(df: DataFrame, cols: Sequence[str], group: str = "person_id") -> DataFrame:
    """Training mean and deviation of every fold at once: all groups minus the held-out one.

    Counts, means and squared deviations are taken per group and then about the mean of all rows, so the
    difference keeps its digits when means are large against deviations.  The windows are read once
    whatever the number of folds.
    """
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"_a_{c}"), F.var_pop(c).alias(f"_v_{c}"), F.count(c).alias(f"_c_{c}")]
    own = df.groupBy(group).agg(*aggs)
    centre = own.agg(*[(F.sum(F.col(f"_c_{c}") * F.col(f"_a_{c}")) / F.sum(f"_c_{c}")).alias(f"_g_{c}") for c in cols])  # one row
    own = own.crossJoin(F.broadcast(centre))
    sums = []
    for c in cols:
        n, a, v, g = (F.col(f"_{x}_{c}") for x in ("c", "a", "v", "g"))
        sums += [n.alias(f"n_{c}"), (n * (a - g)).alias(f"x_{c}"), (n * (v + (a - g) * (a - g))).alias(f"q_{c}")]
    own = own.select(group, *[f"_g_{c}" for c in cols], *[F.coalesce(e, F.lit(0)).alias(nm) for e, nm in zip(sums, [f"{t}_{c}" for c in cols for t in "nxq"])])
    names = [f"{t}_{c}" for c in cols for t in "nxq"]
    total = own.agg(*[F.sum(c).alias(f"t_{c}") for c in names])  # one row
    rest = own.crossJoin(F.broadcast(total)).select(group, *[f"_g_{c}" for c in cols], *[(F.col(f"t_{c}") - F.col(c)).alias(c) for c in names])
    exprs = []
    for c in cols:
        var = f"((q_{c} - x_{c} * x_{c} / n_{c}) / (n_{c} - 1))"
        exprs += [f"_g_{c} + x_{c} / n_{c} as _m_{c}", f"coalesce(nullif(sqrt(greatest({var}, 0.0D)), 0), 1.0D) as _s_{c}"]
    return rest.selectExpr(group, *exprs)


def fold_sums(df: DataFrame, sums: Mapping[str, Column], group: str = "person_id") -> DataFrame:
    """Sums over the test group and over the training groups of every fold.

    Training sums are the total minus the group's own, so folds never pair up.
    """
    own = df.groupBy(group).agg(*[F.sum(e).alias(n) for n, e in sums.items()])
    total = own.agg(*[F.sum(n).alias(f"_{n}") for n in sums])  # one row
    both = own.crossJoin(F.broadcast(total))
    pair = lambda role, f: F.struct(F.lit(role).alias("role"), *[f(n).alias(n) for n in sums])
    roles = F.array(pair("test", F.col), pair("train", lambda n: F.col(f"_{n}") - F.col(n)))
    return both.select(F.col(group).alias("held_out"), F.inline(roles))


def ranked_groups(df: DataFrame, group: str, order: Column | None = None) -> DataFrame:
    """Distinct groups with their position in the given order, without sorting them in one task."""
    g = df.select(group).distinct().withColumn("_one", F.lit(1))
    key = order if order is not None else F.col(group)
    # Names that are no numbers share one key and are ordered by name.
    g = g.withColumn("_key", F.coalesce(key.try_cast("long"), F.lit(0).cast("long"))).withColumn(CHUNK, F.shiftright("_key", 40 if order is not None else 12))
    return row_numbers(g, Ordering(("_one",), ("_key", group)), "_i", total="_n").drop("_one", "_key", CHUNK)


def rotating_roles(df: DataFrame, group: str = "person_id") -> DataFrame:
    """Test group i, validation group i+1 (wrapping), the rest training; needs three groups.

    The result lists every group in every fold by definition.
    """
    numbered = ranked_groups(df, group).filter("_n >= 3")
    folds = numbered.selectExpr(f"{group} as held_out", "_i as _h", "_n as _m", "explode(sequence(0L, _n - 1)) as _i")
    return folds.join(numbered.select(group, "_i"), "_i").selectExpr(
        "held_out", group, "case when _i = _h then 'test' when _i = (_h + 1) % _m then 'validation' else 'train' end as role"
    )


def grouped_folds(df: DataFrame, k: int, group: str = "person_id", seed: int = 42) -> DataFrame:
    """Groups in shuffled order dealt round robin over ``k`` folds."""
    ranked_by_hash = ranked_groups(df, group, F.xxhash64(F.col(group), F.lit(seed)))
    return ranked_by_hash.selectExpr(group, f"cast(_i % {k} as int) as fold")


# ── paired tests and comparisons ────────────────────────────────────────────


def paired_folds(a: DataFrame, b: DataFrame, metric: str, key: str = "held_out") -> DataFrame:
    return a.select(key, F.col(metric).alias(f"{metric}_a")).join(b.select(key, F.col(metric).alias(f"{metric}_b")), key)


def wilcoxon(pairs: DataFrame, a: str, b: str, keys: Sequence[str] = (), alpha: float = 0.05, method: str = "auto") -> DataFrame:
    """Signed-rank test of paired values, zeros dropped.

    ``method`` "exact" counts rank subsets by sum (no value with ties or zeros), "approx" is the normal
    approximation with tie correction, "auto" the exact one for at most 50 pairs without ties or zeros, as
    is usual for this test.
    """
    use_exact = {"auto": "_z = 0 and _ties = 0 and _m <= 50", "exact": "_z = 0 and _ties = 0", "approx": "false"}[method]
    held = list(keys) or ["_one"]
    d = (pairs if keys else pairs.withColumn("_one", F.lit(1))).withColumn("_d", F.col(a) - F.col(b))
    med = quantiles(d, held, "_d", {"median_diff": 0.5})
    base = d.groupBy(*held).agg(
        F.count("*").alias("n"), F.avg("_d").alias("mean_diff"), F.count_if(F.col("_d") == 0).alias("_z")
    )
    nz = d.filter("_d <> 0").withColumn("_abs", F.abs("_d"))
    rk = average_rank(nz, held, "_abs", "_rk")
    side = nz.groupBy(*held, "_abs").agg(
        F.count_if(F.col("_d") > 0).alias("_up"), F.count_if(F.col("_d") < 0).alias("_down")
    ).join(rk, [*held, "_abs"])
    w = side.groupBy(*held).agg(
        F.sum(F.col("_up") * F.col("_rk")).alias("_wp"), F.sum(F.col("_down") * F.col("_rk")).alias("_wm"),
        F.sum(F.col("_up") + F.col("_down")).alias("_m"),
        F.sum(F.expr("pow(_rk_ties, 3) - _rk_ties")).alias("_ties"),
    ).withColumn("statistic", F.least("_wp", "_wm"))
    # counts[s] = number of subsets of {1..m} with sum s, built rank by rank.
    counts = (
        "aggregate(sequence(1, cast(_m as int)), array_append(array_repeat(0.0D, 0), 1.0D), (acc, r) -> "
        "transform(sequence(0, size(acc) + r - 1), s -> coalesce(get(acc, s), 0.0D) + if(s >= r, coalesce(get(acc, s - r), 0.0D), 0.0D)))"
    )
    exact = f"least(1.0D, 2 * aggregate(slice({counts}, 1, cast(statistic as int) + 1), 0.0D, (x, y) -> x + y) / pow(2.0D, _m))"
    se = "sqrt((_m * (_m + 1) * (2 * _m + 1) - _ties / 2) / 24)"
    z = f"abs((statistic - _m * (_m + 1) / 4) / {se})"
    # Upper normal tail through a rational approximation of erfc (error below 1.2e-7).
    t = f"(1.0D / (1.0D + 0.5D * {z} / sqrt(2.0D)))"
    poly = "-1.26551223 + {t}*(1.00002368 + {t}*(0.37409196 + {t}*(0.09678418 + {t}*(-0.18628806 + {t}*(0.27886807 + {t}*(-1.13520398 + {t}*(1.48851587 + {t}*(-0.82215223 + {t}*0.17087277))))))))".format(t="_t")
    out = base.join(med, held).join(w, held, "left").selectExpr("*", f"{t} as _t", f"{z} as _zz").selectExpr(
        *held, "n", "median_diff", "mean_diff", "statistic",
        f"case when _m is null then 1.0D when {use_exact} then {exact} "
        f"else {'null' if method == 'exact' else f'least(1.0D, _t * exp(-_zz * _zz / 2 + {poly}))'} end as p_value",
    ).withColumn("significant", F.col("p_value") < alpha)
    return out if keys else out.drop("_one")


def cv_summary(cv: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean and population deviation of fold metrics, and accuracy weighted by fold size."""
    aggs = [F.count("*").alias("folds")]
    for m in ("accuracy", "f1_writing", "roc_auc"):
        aggs += [F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_sd")]
    aggs.append((F.sum(F.col("accuracy") * F.col("n_test")) / F.sum("n_test")).alias("accuracy_weighted"))
    return cv.groupBy(*keys).agg(*aggs)


def leaderboard(results: DataFrame, keys: Sequence[str]) -> DataFrame:
    out = results.groupBy(*keys).agg(F.avg("accuracy").alias("mean_acc"), F.avg("roc_auc").alias("mean_auc"), F.count("*").alias("folds"))
    return out.orderBy(F.col("mean_acc").desc_nulls_last(), *keys)


def winners(trials: DataFrame, key: str = "model") -> DataFrame:
    """Best trial per model with flags for settings at the edge of their range, and failed trials."""
    cols = [c for c in trials.columns if c != key]
    best = trials.groupBy(key).agg(
        F.max_by(F.struct(*cols), F.when(F.col("accuracy").isNotNull(), F.struct(F.col("accuracy"), -F.col("trial")))).alias("_b"),
        F.count_if(F.col("accuracy").isNull()).alias("infeasible"),
    )
    return best.select(key, *[F.col(f"_b.{c}").alias(c) for c in cols], "infeasible").withColumn(
        "at_boundary", F.col("dropout").isin(0.0, 0.5) | F.col("batch_size").isin(32, 128)
    )


def seed_average(results: DataFrame, cols: Sequence[str] = ("accuracy", "roc_auc")) -> DataFrame:
    return results.groupBy("held_out").agg(*[F.avg(c).alias(c) for c in cols])


def diagnostic_correlation(df: DataFrame, pairs: Mapping[str, tuple[str, str]], keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.corr(a, b).alias(n) for n, (a, b) in pairs.items()])


def class_kinematics(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Mean of each feature per class and their ratio, in one aggregate."""
    parts = ", ".join(f"'{c}', cast({c} as double)" for c in features)
    long = df.selectExpr("label", f"stack({len(features)}, {parts}) as (feature, value)")
    out = long.groupBy("feature").agg(
        F.avg(F.when(F.col("label") == 1, F.col("value"))).alias("writing_mean"),
        F.avg(F.when(F.col("label") == 0, F.col("value"))).alias("idle_mean"),
    )
    return out.withColumn("ratio", F.expr("case when idle_mean <> 0 then writing_mean / idle_mean end"))


# Name patterns and groups, as they stand in reports; the first match wins.
GROUP_RULES = (
    ("jerk", "jerk"), ("zcr", "zcr"), ("corr", "correlation"), ("mag", "magnitude"), ("tilt|grav", "gravity"),
    ("dom_freq|spec_|band_", "spectral"),
)


#: The groups of the engineering report, which looks for correlations first and has no gravity.
ENGINEERING_RULES = (
    ("^corr_", "correlation"), ("_jerk_", "jerk"), ("_zcr$", "zcr"),
    ("(_dom_freq|_spec_centroid|_spec_entropy|_band_3_8)$", "spectral"), ("^(acc|gyro)_mag_", "magnitude"),
)


def feature_group(name: Column, rules: Sequence[tuple[str, str]] = GROUP_RULES) -> Column:
    out = F.when(F.lit(False), "")
    for pattern, group in rules:
        out = out.when(name.rlike(pattern), group)
    return out.otherwise("time_stats")


def importance_by_group(importances: DataFrame, rules: Sequence[tuple[str, str]] = GROUP_RULES) -> DataFrame:
    """importances(feature, importance) summed per feature group of either mapping."""
    return importances.groupBy(feature_group(F.col("feature"), rules).alias("group")).agg(
        F.sum("importance").alias("total"), F.count("*").alias("features"), F.avg("importance").alias("mean")
    ).orderBy(F.desc("total"), "group")


def weakest(df: DataFrame, keys: Sequence[str], k: int, metric: str = "accuracy") -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(metric).alias(metric)).orderBy(F.col(metric).asc_nulls_last(), *keys).limit(k)


def pool_statistics(sessions: DataFrame) -> DataFrame:
    return sessions.groupBy("pool").agg(
        F.countDistinct("person_id").alias("n_subjects"), F.countDistinct("session_id").alias("n_sessions")
    )


def fold_time_estimate(folds: DataFrame) -> DataFrame:
    """Median seconds per fold and number of runs by model and pool."""
    q = quantiles(folds, ["model", "pool"], "sec", {"per_fold_sec": 0.5})
    return q.join(folds.filter("sec is not null").groupBy("model", "pool").agg(F.countDistinct("run_id").alias("n_runs")), ["model", "pool"])


def run_history(runs: DataFrame, cv: DataFrame, timing: DataFrame) -> DataFrame:
    """Run settings with mean fold metrics and durations, newest first."""
    m = cv.groupBy("run_id").agg(F.avg("accuracy").alias("mean_acc"), F.avg("roc_auc").alias("mean_auc"), F.count("*").alias("folds"))
    t = timing.groupBy("run_id").agg(F.sum("sec").alias("total_sec"))
    return runs.join(m, "run_id", "left").join(t, "run_id", "left").orderBy(F.desc("run_id"))


def feature_agreement(a: DataFrame, b: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Largest difference and correlation of each feature of two tables."""
    parts = ", ".join(f"'{c}', a.{c}, b.{c}" for c in features)
    cond = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys]
    long = a.alias("a").join(b.alias("b"), cond).selectExpr(f"stack({len(features)}, {parts}) as (feature, x, y)")
    return long.groupBy("feature").agg(F.max(F.abs(F.col("x") - F.col("y"))).alias("max_abs_diff"), F.corr("x", "y").alias("corr"))


def residual_correlation(df: DataFrame, p1: str, p2: str, keys: Sequence[str] = (), label: str = "label") -> DataFrame:
    return df.groupBy(*keys).agg(F.corr(F.col(p1) - F.col(label), F.col(p2) - F.col(label)).alias("residual_corr"))


def window_comparison(cv: DataFrame) -> DataFrame:
    """Mean metrics per decision scale by model and input window, with the train/val/test gap."""
    scales = "stack(4, '1s', accuracy, roc_auc, '5s', acc_5s, auc_5s, '10s', acc_10s, auc_10s, '30s', acc_30s, auc_30s) as (scale, acc, auc)"
    per = cv.selectExpr("model", "window", scales).groupBy("model", "window", "scale").agg(
        F.avg("acc").alias("acc_mean"), F.avg("auc").alias("auc_mean"), F.stddev_samp("acc").alias("acc_sd")
    )
    gap = cv.groupBy("model", "window").agg(
        F.avg("train_acc").alias("train_acc"), F.avg("val_acc").alias("val_acc"),
        (F.avg("train_acc") - F.avg("accuracy")).alias("train_test_gap"), F.avg("best_epoch").alias("best_epoch"),
    )
    return per.join(gap, ["model", "window"])


def fold_agreement(a: DataFrame, b: DataFrame, metric: str = "roc_auc", key: str = "held_out", worst: int = 3) -> DataFrame:
    """Pearson and Spearman over common folds, shared weakest folds, wins and mean difference."""
    p = paired_folds(a, b, metric, key)
    x, y = f"{metric}_a", f"{metric}_b"
    r = p.join(average_rank(p, [], x, "_ra"), x).join(average_rank(p, [], y, "_rb"), y)
    low = lambda c, n: F.row_number().over(Window.orderBy(c, key)).alias(n)  # noqa: E731  one row per fold
    r = r.select("*", low(x, "_la"), low(y, "_lb"))
    out = r.agg(
        F.count("*").alias("folds"), F.corr(x, y).alias("pearson"), F.corr("_ra", "_rb").alias("spearman"),
        F.count_if((F.col("_la") <= worst) & (F.col("_lb") <= worst)).alias("shared_weakest"),
        F.count_if(F.col(y) > F.col(x)).alias("b_better"), F.avg(F.abs(F.col(y) - F.col(x))).alias("mean_abs_diff"),
    )
    return out.filter("folds >= 3")


def per_subject_threshold(oof: DataFrame, proba: str = "proba_raw", *, width: int = SENSOR_CHUNK_MS) -> DataFrame:
    """Best-F1 threshold on each session's first third, scored on the rest, with the oracle.

    Each window adds to the thresholds it passes through one histogram of its
    grid cell; 91 cells per session replace windows times thresholds.
    """
    rows = calibration_prefix(oof, width=width)
    grid = F.array(*[F.lit(t) for t in THRESHOLDS])
    # Number of thresholds at or below the probability.
    passed = F.expr(f"size(filter({_sql_array(THRESHOLDS)}, t -> {proba} >= t))")
    cells = rows.withColumn("_c", passed).groupBy("session_id", "person_id", "part", "_c").agg(
        F.count_if(F.col("label") == 1).alias("_pos"), F.count_if(F.col("label") == 0).alias("_neg")
    )
    idx = cells.groupBy("session_id", "person_id", "part").agg(
        F.sum("_pos").alias("_p_all"), F.sum("_neg").alias("_n_all")
    ).select(
        "*", F.posexplode(grid).alias("_i", "threshold")
    )
    hit = idx.join(cells.drop("person_id"), ["session_id", "part"]).groupBy("session_id", "person_id", "part", "_p_all", "_n_all", "_i", "threshold").agg(
        F.sum(F.when(F.col("_c") > F.col("_i"), F.col("_pos")).otherwise(0)).alias("_tp"),
        F.sum(F.when(F.col("_c") > F.col("_i"), F.col("_neg")).otherwise(0)).alias("_fp"),
    ).selectExpr(
        "*", "if(_tp + _p_all + _fp = 0, 0.0D, 2 * _tp / (_tp + _fp + _p_all)) as _f1", "(_tp + _n_all - _fp) / (_p_all + _n_all) as _acc"
    )
    # Ties go to the threshold closest to one half, then the lower one.
    pick = hit.groupBy("session_id", "person_id").agg(
        *[F.max_by("threshold", F.when(F.col("part") == p, F.expr("struct(round(_f1, 9), -abs(round(threshold - 0.5, 4)), -_i)"))).alias(n)
          for p, n in (("calib", "threshold_subj"), ("eval", "threshold_oracle"))]
    )
    score = hit.filter("part = 'eval'").join(pick, ["session_id", "person_id"])
    at = lambda t, c: F.max(F.when(F.col("threshold") == t, F.col(c)))
    return score.groupBy("session_id", "person_id").agg(
        F.max("threshold_subj").alias("threshold_subj"), F.max("threshold_oracle").alias("threshold_oracle"),
        at(F.lit(0.5), "_acc").alias("acc_base"), at(F.col("threshold_subj"), "_acc").alias("acc_subj"),
        at(F.col("threshold_oracle"), "_acc").alias("acc_oracle"), at(F.lit(0.5), "_f1").alias("f1_base"),
        at(F.col("threshold_subj"), "_f1").alias("f1_subj"), at(F.col("threshold_oracle"), "_f1").alias("f1_oracle"),
    )


def _sql_array(values: Sequence[float]) -> str:
    return "array(" + ", ".join(f"{v}D" for v in values) + ")"


def shuffled(df: DataFrame, keys: Sequence[str], order: Sequence[str], col: str, seed: int = 42) -> DataFrame:
    """Re-pair one column at random inside each key: a negative control."""
    return mixed_pairs(df, keys, order, [col], seed).withColumn(col, F.col("_v0")).drop("_v0")


def mixed_pairs(df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str], seed: int = 42) -> DataFrame:
    """Each row with the values ``_v0``, ``_v1`` .. of ``cols`` of another row of its key, drawn at random.

    Rows get two numbers, one in time and one by hash; values move from one to
    the other through an equi-join on (key, number).
    """
    by_time = row_numbers(df, Ordering(tuple(keys), tuple(order)), "_rn")
    h = F.xxhash64(F.col("_ord"), F.lit(seed))
    values = [f"_v{i}" for i in range(len(cols))]
    mixed = df.select(*keys, "_ord", *[F.col(c).alias(v) for c, v in zip(cols, values, strict=True)], h.alias("_h")).withColumn(
        CHUNK, F.shiftright(F.col("_h"), 50)
    )
    mixed = row_numbers(mixed, Ordering(tuple(keys), ("_h", "_ord")), "_rn").select(*keys, "_rn", *values)
    return by_time.join(mixed, [*keys, "_rn"]).drop("_rn")
