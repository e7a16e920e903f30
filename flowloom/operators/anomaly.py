"""Three-sigma detector over per-switch counters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.functions.numeric import INF, is_finite, ratio

# Counters every input needs, features derived from them, sampling sets of the
# strict mode and the width of the band.
COUNTERS = ("N_FI", "N_FO", "N_Pi", "N_PI", "N_PO")
STRICT_MIN_ROWS = 10_000
SIGMAS = 3.0

# Spark resolves names without letter case, so the two packet counters N_Pi and N_PI need
# distinct column names here.
COLUMNS = {"N_FI": "n_fi", "N_FO": "n_fo", "N_Pi": "n_packet_in_flows", "N_PI": "n_packets_in", "N_PO": "n_packets_out"}


def ratio_r_pi(n_fi: Column, n_pi: Column) -> Column:
    """Flows in per flow-request; +Infinity when there were no requests."""
    return ratio(n_fi, n_pi, INF)


def ratio_r_fi(n_fo: Column, n_fi: Column) -> Column:
    """Flows out per flow in; +Infinity when none came in."""
    return ratio(n_fo, n_fi, INF)


def delta_packets(n_in: Column, n_out: Column) -> Column:
    return F.abs(n_in.cast("double") - n_out.cast("double"))


def counter_features(df: DataFrame, columns: dict[str, str] | None = None) -> DataFrame:
    """Adds r_pi, r_fi and d_np. All five counters must be present."""
    names = {**COLUMNS, **(columns or {})}
    lacking = [k for k in COUNTERS if names[k] not in df.columns]
    if lacking:
        raise ValueError(f"missing counters: {lacking}")
    c = {k: F.col(names[k]) for k in COUNTERS}
    return df.withColumns(
        {
            "r_pi": ratio_r_pi(c["N_FI"], c["N_Pi"]),
            "r_fi": ratio_r_fi(c["N_FO"], c["N_FI"]),
            "d_np": delta_packets(c["N_PI"], c["N_PO"]),
        }
    )


@dataclass(frozen=True)
class Thresholds:
    r_pi: float
    r_fi: float
    d_np: float
    n_rows: int


def all_finite(*cols: str) -> Column:
    cond = is_finite(cols[0])
    for c in cols[1:]:
        cond = cond & is_finite(c)
    return cond


def sigma_thresholds(normal: DataFrame, k: float = SIGMAS, strict: bool = False) -> DataFrame:
    """Means, population deviations and thresholds over jointly finite normal rows: one row.

    Reading it fails below two rows, or below 10,000 in strict mode.
    """
    need = STRICT_MIN_ROWS if strict else 2
    fin = all_finite("r_pi", "r_fi", "d_np")
    feats = ("r_pi", "r_fi", "d_np")
    aggs = []
    for c in feats:
        x = F.when(fin, F.col(c))
        aggs += [F.avg(x).alias(f"{c}_mean"), F.stddev_pop(x).alias(f"{c}_std")]
    out = normal.agg(*aggs, F.count_if(fin).alias("n_rows"), F.count(F.lit(1)).alias("_all"))
    bad = (F.col("_all") < need) | (F.col("n_rows") < 1)
    out = out.filter(
        F.when(bad, F.raise_error(F.lit(f"need {need} normal rows with finite features")).cast("boolean")).otherwise(F.lit(True))
    ).drop("_all")
    return out.select(
        "*",
        (F.col("r_pi_mean") - k * F.col("r_pi_std")).alias("r_pi_threshold"),
        (F.col("r_fi_mean") - k * F.col("r_fi_std")).alias("r_fi_threshold"),
        (F.col("d_np_mean") + k * F.col("d_np_std")).alias("d_np_threshold"),
    )


def fit_thresholds(normal: DataFrame, k: float = SIGMAS, strict: bool = False) -> Thresholds:
    """Collects the one row of ``sigma_thresholds``."""
    r = sigma_thresholds(normal, k, strict).first()
    return Thresholds(r["r_pi_threshold"], r["r_fi_threshold"], r["d_np_threshold"], r["n_rows"])


def past_thresholds(th: Thresholds) -> tuple[Column, Column, Column]:
    return (
        F.col("r_pi") < F.lit(th.r_pi),
        F.col("r_fi") < F.lit(th.r_fi),
        F.col("d_np") > F.lit(th.d_np),
    )


def sigma_detect(features: DataFrame, th: Thresholds, out: str = "suspicious") -> DataFrame:
    """A row is suspicious when all three features are past their thresholds."""
    a, b, c = past_thresholds(th)
    return features.withColumn(out, a & b & c)


def sigma_explain(features: DataFrame, th: Thresholds) -> DataFrame:
    """Shares of rows past each threshold and past all three: one row."""
    a, b, c = past_thresholds(th)
    share = lambda x: F.avg(x.cast("double"))
    return features.agg(
        share(a).alias("r_pi_below"), share(b).alias("r_fi_below"), share(c).alias("d_np_above"),
        share(a & b & c).alias("all_three"),
    )


def windowed_counters(
    events: DataFrame, switch: str, ts: str, kind: str, value: str,
    length: str = "1 day", slide: str | None = None,
) -> DataFrame:
    """The five counters per switch and time window, from raw events.

    Flows in, flows out and requests are counts of view, click and error events; packets in and
    out are sums of the value of view and purchase events. The aggregate has a map-side part, so
    a switch with very many events costs one row per task and window.
    """
    win = F.window(ts, length, slide) if slide else F.window(ts, length)
    of = lambda k: F.col(kind) == k
    packets = lambda k: F.coalesce(F.sum(F.when(of(k), F.col(value))), F.lit(0.0))
    return (
        events.groupBy(F.col(switch).alias("switch"), win.alias("_w"))
        .agg(
            F.count_if(of("view")).alias("n_fi"),
            F.count_if(of("click")).alias("n_fo"),
            F.count_if(of("error")).alias("n_packet_in_flows"),
            packets("view").alias("n_packets_in"),
            packets("purchase").alias("n_packets_out"),
        )
        .select(
            "switch", F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"),
            "n_fi", "n_fo", "n_packet_in_flows", "n_packets_in", "n_packets_out",
        )
    )
