"""Predict log, responses, counters, histograms, quantiles, canary checks and the release scorecard."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from relyard import constants as c
from relyard.functions.histogram import bound_label, bucket_index, cumulative_counts
from relyard.functions.scoring import finite
from relyard.operators.routing import MODES


def predict_log(served: DataFrame, *more: Column) -> DataFrame:
    """The twelve log fields of each answered request, after the ``more`` columns asked for, such as its day."""
    return served.filter(F.col("status") == 200).select(
        *more,
        F.lit("predict").alias("event"),
        "request_id",
        "mode",
        "chosen",
        "status",
        (F.col("latency_s") * 1000).cast("bigint").alias("latency_ms"),
        "bucket",
        F.col("seed_source").alias("bucket_seed_source"),
        "canary_pct",
        "shadow_mae",
        "prod_version",
        "candidate_version",
    )


def predict_response(served: DataFrame) -> DataFrame:
    return served.filter(F.col("status") == 200).select(
        "request_id",
        "mode",
        F.size("proba").alias("n"),
        "proba",
        "chosen",
        "bucket",
        "canary_pct",
        F.col("seed_source").alias("bucket_seed_source"),
    )


def mode_label() -> Column:
    """Bounded mode label: '' off the predict endpoint or without a mode, 'invalid' when unknown."""
    mode = F.coalesce("mode", F.lit(""))
    return (
        F.when(F.col("endpoint") != "/predict", F.lit(""))
        .when(mode.isin("", *MODES), mode)
        .otherwise(F.lit("invalid"))
    )


def counted(requests: DataFrame) -> DataFrame:
    """Rows that the request counter counts, with its labels."""
    return requests.filter(F.col("endpoint") != "/metrics").withColumn("mode", mode_label())


def requests_total(requests: DataFrame) -> DataFrame:
    return counted(requests).groupBy("endpoint", "mode", "status").agg(F.count(F.lit(1)).alias("requests"))


def histogram(df: DataFrame, labels: Sequence[str], value: str, bounds: Sequence[float] = c.HISTOGRAM_BOUNDS) -> DataFrame:
    """Cumulative bucket counts per label set: labels, pos, le, cumulative_count.

    Rows collapse to (labels, bucket) before anything is shuffled; cumulating works on at most
    one row per bucket.
    """
    cells = (
        df.withColumn("bucket", bucket_index(F.col(value), bounds))
        .groupBy(*labels, "bucket")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return accumulate(cells, labels, bounds)


def accumulate(cells: DataFrame, labels: Sequence[str], bounds: Sequence[float] = c.HISTOGRAM_BOUNDS) -> DataFrame:
    """Per-bucket counts (labels, bucket, n) to cumulative counts."""
    return (
        cells.groupBy(*labels)
        .agg(cumulative_counts(bounds).alias("buckets"))
        .select(*labels, F.inline("buckets"))
    )


def observed_latency(served: DataFrame) -> DataFrame:
    """Requests whose handler was reached; rejected bodies and modes never get there."""
    return served.filter(F.col("status") != 422).select(
        "mode", "status", F.coalesce("chosen", F.lit("unknown")).alias("chosen"), "latency_s"
    )


def latency_histogram(served: DataFrame) -> DataFrame:
    return histogram(observed_latency(served), ["mode", "status", "chosen"], "latency_s")


def latency_sums(served: DataFrame) -> DataFrame:
    return (
        observed_latency(served)
        .groupBy("mode", "status", "chosen")
        .agg(F.count(F.lit(1)).alias("observations"), F.round(F.sum("latency_s"), 6).alias("latency_sum"))
    )


def shadow_mae_histogram(served: DataFrame) -> DataFrame:
    return histogram(served.filter(finite(F.col("shadow_mae"))), ["mode"], "shadow_mae")


def latency_quantiles(served: DataFrame, accuracy: int = 10000) -> DataFrame:
    """Approximate p50, p95 and p99 per mode; the sketch merges, so no group is collected."""
    points = F.percentile_approx("latency_s", [0.5, 0.95, 0.99], accuracy)
    return (
        observed_latency(served)
        .groupBy("mode")
        .agg(points.alias("q"))
        .select("mode", F.col("q")[0].alias("p50"), F.col("q")[1].alias("p95"), F.col("q")[2].alias("p99"))
    )


def histogram_quantile(
    buckets: DataFrame, labels: Sequence[str], quantile: float, bounds: Sequence[float] = c.HISTOGRAM_BOUNDS
) -> DataFrame:
    """Quantile by linear interpolation inside the bucket that reaches it; the open bucket gives its lower bound."""
    cell = F.sort_array(F.collect_list(F.struct("pos", "cumulative_count")))
    per_label = buckets.groupBy(*labels).agg(cell.alias("cells"))
    total = F.element_at("cells", -1)["cumulative_count"]
    rank = F.lit(quantile) * total
    first = F.filter("cells", lambda x: x["cumulative_count"] >= F.col("rank"))[0]
    uppers = F.array(*[F.lit(float(b)) for b in bounds])
    lowers = F.array(*[F.lit(float(b)) for b in (0.0, *bounds[:-1])])
    pos, here = F.col("hit.pos"), F.col("hit.cumulative_count")
    below = F.when(pos == 0, F.lit(0)).otherwise(F.get(F.col("cells"), pos - 1)["cumulative_count"])
    low, high = F.get(lowers, pos), F.get(uppers, pos)
    inside = low + (high - low) * (F.col("rank") - below) / (here - below)
    value = F.when(pos == len(bounds) - 1, low).otherwise(inside)
    return (
        per_label.withColumn("rank", rank)
        .withColumn("hit", first)
        .select(*labels, F.lit(quantile).alias("quantile"), F.round(value, 6).alias("value"))
    )


def canary_share(served: DataFrame) -> DataFrame:
    """Answered canary requests per day and choice, with the share of the day."""
    daily = (
        served.filter((F.col("mode") == c.CANARY) & F.col("chosen").isNotNull())
        .groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"))
        .agg(
            F.count(F.lit(1)).alias("requests"),
            F.count_if(F.col("chosen") == c.CANDIDATE).alias("to_candidate"),
            F.any_value("canary_pct").alias("canary_pct"),
        )
    )
    return daily.withColumn("share", F.round(F.col("to_candidate") / F.col("requests"), 6))


#: The 0.999 quantile of chi-squared with 99 degrees of freedom, in tenths; a day's 100 bucket counts are tested against it.
UNEVEN_TENTHS = 1482


def canary_buckets(served: DataFrame) -> DataFrame:
    """Canary requests per day and bucket: how many went to the candidate, whether all went where the bucket says, and whether the day's
    buckets are uneven.

    The day's test is exact: 100 * sum(n^2) - N^2 > 148.2 * N in whole numbers. Only 100 counts a day leave the first aggregation.
    """
    canary = served.filter((F.col("mode") == c.CANARY) & F.col("chosen").isNotNull())
    to_candidate = F.col("chosen") == c.CANDIDATE
    counts = canary.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "bucket").agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if(to_candidate).alias("to_candidate"),
        F.bool_and(to_candidate == (F.col("bucket") < F.col("canary_pct"))).alias("as_routed"),
    )
    day = Window.partitionBy("day")
    n = F.sum("requests").over(day).cast("decimal(18,0)")
    squares = F.sum(F.col("requests").cast("decimal(18,0)") * F.col("requests").cast("decimal(18,0)")).over(day)
    uneven = (squares * 100 - n * n) * 10 > n * UNEVEN_TENTHS
    return counts.withColumn("uneven_day", uneven)


def canary_stickiness(served: DataFrame) -> DataFrame:
    """Per client id: retries and whether all of them fell into one bucket and one choice."""
    return (
        served.filter((F.col("mode") == c.CANARY) & F.col("client_provided") & F.col("chosen").isNotNull())
        .groupBy("request_id")
        .agg(
            F.count(F.lit(1)).alias("requests"),
            F.min("bucket").alias("bucket"),
            ((F.min("bucket") == F.max("bucket")) & (F.min("chosen") == F.max("chosen"))).alias("sticky"),
        )
    )


def release_scorecard(served: DataFrame, decisions: DataFrame) -> DataFrame:
    """Per model: traffic split, error share, shadow difference and the policy decision."""
    traffic = served.groupBy("model_name").agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if((F.col("status") == 200) & (F.col("chosen") == c.PROD)).alias("prod_requests"),
        F.count_if((F.col("status") == 200) & (F.col("chosen") == c.CANDIDATE)).alias("candidate_requests"),
        F.count_if(F.col("status") >= 500).alias("errors"),
        F.avg("shadow_mae").alias("_mae"),
    )
    decided = decisions.select(
        "model_name", "allowed", F.concat_ws(",", F.transform("errors", lambda v: v["code"])).alias("error_codes")
    )
    return traffic.join(decided, "model_name", "left").select(
        "model_name",
        "requests",
        "prod_requests",
        "candidate_requests",
        F.round(F.col("errors") / F.col("requests"), 6).alias("error_share"),
        F.round("_mae", 6).alias("shadow_mae"),
        "allowed",
        "error_codes",
    )


def le_labels(bounds: Sequence[float] = c.HISTOGRAM_BOUNDS) -> list[str]:
    return [bound_label(b) for b in bounds]
