"""Prediction packs shared by the scoring, interval and audit queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from trajlytics.operators import scoring as G
from trajlytics.sources import adapters as A

METHODS = ["persistence", "prefix_sqrt", "prefix_linear"]
DAY_BUCKET = "FLOOR(elapsed_days)"


def observations(spark, sf_dir):
    return A.calendar_obs(spark, sf_dir)


def predictions(obs, p: int = 10, keep: tuple = ()):
    """Three prefix-only forecasts at every later check-up. Of the future only coordinates are used;
    ``keep`` carries further columns along for callers that score the same rows."""
    wide = forecasts(obs, p, {"_p": "capacity_retention_pct"}, keep)
    rest = [c for c in wide.columns if c != "_p"]
    entries = F.array(*[F.struct(F.lit(m).alias("method"), F.col("_p")[m].alias("predicted")) for m in METHODS])
    return wide.select(*rest, F.explode(entries).alias("m")).select(*rest, "m.*")


def forecasts(obs, p: int, outcomes: dict, keep: tuple = ()):
    """The same forecasts, one row per later check-up: for each name of ``outcomes`` a struct of the methods' forecasts that
    are fitted to that outcome column alone."""
    pre = obs.filter(F.col("checkup_index") < p)
    d = F.col("elapsed_days")
    aggs, structs = [], []
    for i, (name, outcome) in enumerate(outcomes.items()):
        y, last, k, b = F.col(outcome), F.col(f"_l{i}"), F.col(f"_k{i}"), F.col(f"_b{i}")
        aggs += [F.max_by(y, "checkup_index").alias(f"_l{i}"),
                 F.greatest(F.sum(F.sqrt(d) * (100.0 - y)) / F.nullif(F.sum(d), F.lit(0.0)), F.lit(0.0)).alias(f"_k{i}"),
                 F.least(F.regr_slope(y, d), F.lit(0.0)).alias(f"_b{i}")]
        values = [last, 100.0 - k * F.sqrt(d), last + b * (d - F.col("_d"))]
        structs.append(F.struct(*[v.alias(m) for m, v in zip(METHODS, values)]).alias(name))
    fit = pre.groupBy("condition_id").agg(F.max(d).alias("_d"), *aggs)
    coords = obs.filter(F.col("checkup_index") >= p).select("condition_id", "checkup_index", "temperature_c", "storage_soc_fraction", "elapsed_days", *keep)
    return coords.join(fit, "condition_id").select(*coords.columns, *structs)


def scored(spark, sf_dir, p: int = 10):
    return G.score_errors(with_error(spark, sf_dir, p), ["condition_id", "method"], "elapsed_days", "error", DAY_BUCKET)


def score_pack(pack, obs):
    return G.score_trajectories(pack, obs, entity=["condition_id"], method="method", time="elapsed_days",
                                predicted="predicted", observed="capacity_retention_pct", bucket=DAY_BUCKET)


def score_columns(errors, columns):
    return G.score_error_columns(errors, ["condition_id"], "elapsed_days", columns, DAY_BUCKET)


def with_error(spark, sf_dir, p: int = 10):
    pack = predictions(observations(spark, sf_dir), p, keep=("capacity_retention_pct",))
    return pack.withColumn("error", F.col("predicted") - F.col("capacity_retention_pct"))


def pred_sql(p: int = 10, name: str = "pred") -> str:
    """``name``: predictions with truth and error."""
    return f"""{name}_fit AS (SELECT condition_id, ARG_MAX(capacity_retention_pct, checkup_index) AS l, MAX(elapsed_days) AS d0,
        GREATEST(SUM(SQRT(elapsed_days) * (1e2 - capacity_retention_pct)) / NULLIF(SUM(elapsed_days), 0), 0) AS k,
        LEAST(REGR_SLOPE(capacity_retention_pct, elapsed_days), 0) AS b FROM calendar_obs WHERE checkup_index < {p} GROUP BY 1),
    {name} AS (SELECT *, predicted - capacity_retention_pct AS error FROM (SELECT o.*, UNNEST([{{'method': 'persistence', 'predicted': l}},
        {{'method': 'prefix_sqrt', 'predicted': 1e2 - k * SQRT(elapsed_days)}}, {{'method': 'prefix_linear', 'predicted': l + b * (elapsed_days - d0)}}], recursive := true)
        FROM calendar_obs o JOIN {name}_fit USING (condition_id) WHERE checkup_index >= {p}))"""


def score_sql(pred: str = "pred", name: str = "score", keys: str = "condition_id, method") -> str:
    return f"""{name} AS (SELECT {keys}, COUNT(*) AS n_points, SUM((ABS(error) + ABS(pe)) / 2 * (elapsed_days - pt)) / (MAX(elapsed_days) - MIN(elapsed_days)) AS iae,
        AVG(ABS(error)) AS mae, SQRT(AVG(error * error)) AS rmse, ARG_MAX(error, elapsed_days) AS final_error, ABS(ARG_MAX(error, elapsed_days)) AS final_abs_error
      FROM (SELECT *, LAG(error) OVER w AS pe, LAG(elapsed_days) OVER w AS pt FROM {pred} WINDOW w AS (PARTITION BY {keys} ORDER BY elapsed_days)) GROUP BY {keys})"""
