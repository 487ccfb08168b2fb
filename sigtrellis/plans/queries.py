"""Registered queries: every operator over the driver tables, with the SQL it is held against.

Mapping: ``embeddings`` is a recording of 64 channels (sample = vec_id), ``events`` a
signal per user (sample = event_id, value) and a set of spike trains (unit =
user_id, sample = microseconds), with purchases as stimuli and clicks as spikes.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigtrellis.catalog import register
from sigtrellis.functions import design, quality, stats, trains
from sigtrellis.operators import blocks, channels, clusters, detection, events, points, temporal, waveforms
from sigtrellis.plans import curation, pipeline, views

HOUR = 3_600_000_000
DAY = 24 * HOUR
#: The events' first microsecond (1 January 2024): trains count from there.
EPOCH = 1_704_067_200_000_000


def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def frames(spark: SparkSession, sf: str) -> DataFrame:
    return _read(spark, sf, "embeddings").select(F.col("vec_id").alias("s"), F.col("embedding").cast("array<double>").alias("v"))


def signal(spark: SparkSession, sf: str) -> DataFrame:
    return _read(spark, sf, "events").select(F.col("user_id").alias("ch"), F.col("event_id").alias("s"), F.col("value").alias("v"))


def train(spark: SparkSession, sf: str, kind: str | None = None) -> DataFrame:
    e = _read(spark, sf, "events")
    e = e if kind is None else e.where(F.col("event_type") == kind)
    return e.select(F.col("user_id").alias("unit"), (F.unix_micros(F.col("ts").cast("timestamp")) - EPOCH).alias("s"))


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    return _read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("x"))


def stimuli(spark: SparkSession, sf: str) -> DataFrame:
    e = _read(spark, sf, "events").where("event_type = 'purchase'")
    return e.select(F.col("event_id").alias("trial"), (F.unix_micros(F.col("ts").cast("timestamp")) - EPOCH).alias("t"))


# SQL of the same mappings
_SIGNAL = "(SELECT user_id AS ch, event_id AS s, value AS v FROM events)"
_LONG = "(SELECT vec_id AS s, CAST(generate_subscripts(embedding, 1) - 1 AS INT) AS ch, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"
_TRAIN = f"(SELECT user_id AS unit, epoch_us(ts) - {EPOCH} AS s, event_type AS kind, event_id FROM events)"
_ORDER = "(PARTITION BY ch ORDER BY s)"


def _pointwise(name: str, f, sql: str) -> None:
    @register(name, f"SELECT ch, s, round({sql}, 6) AS v FROM {_SIGNAL}")
    def query(spark: SparkSession, sf: str) -> DataFrame:
        return signal(spark, sf).select("ch", "s", F.round(f(F.col("v")), 6).alias("v"))


_pointwise("scale", lambda v: channels.scale(v, 2.5, -1.0), "v * 2.5::DOUBLE - 1.0::DOUBLE")
_pointwise("subtract_baseline", lambda v: channels.subtract_baseline(v, 50.0), "v - 50.0::DOUBLE")
_pointwise("clamp", lambda v: channels.clamp(v, 20.0, 80.0), "greatest(least(v, 80.0::DOUBLE), 20.0::DOUBLE)")
_pointwise("rectify", lambda v: channels.rectify(v - 50.0), "abs(v - 50.0::DOUBLE)")
_pointwise("square", channels.square, "v * v")
_pointwise("sqrt", lambda v: channels.sqrt(v - 50.0), "sqrt(greatest(v - 50.0::DOUBLE, 0.0::DOUBLE))")
_pointwise("log10", channels.log10, "log10(greatest(abs(v), 1e-12::DOUBLE))")
_pointwise("decode_stored", lambda v: channels.decode(F.floor(v), 0.195, 3.0), "floor(v) * 0.195::DOUBLE + 3.0::DOUBLE")


def _framewise(name: str, f, sql: str) -> None:
    @register(name, sql)
    def query(spark: SparkSession, sf: str) -> DataFrame:
        return channels.to_long(frames(spark, sf).withColumn("v", f(F.col("v")))).select("s", "ch", F.round("v", 6).alias("v"))


_framewise("common_average_reference", channels.average_reference, f"SELECT s, ch, round(v - avg(v) OVER (PARTITION BY s), 6) AS v FROM {_LONG}")
_framewise("common_median_reference", channels.median_reference, f"SELECT s, ch, round(v - median(v) OVER (PARTITION BY s), 6) AS v FROM {_LONG}")
_framewise(
    "surface_laplacian",
    lambda v: channels.laplacian(v, 8, 8),
    f"WITH x AS (SELECT * FROM {_LONG}), n AS (SELECT a.s, a.ch, a.v, avg(b.v) AS m FROM x a JOIN x b ON a.s = b.s AND abs(a.ch // 8 - b.ch // 8) + abs(a.ch % 8 - b.ch % 8) = 1 GROUP BY ALL) SELECT s, ch, round(v - m, 6) AS v FROM n",
)
_framewise("reorder_channels", lambda v: channels.reorder(v, [5, 3, 60]), f"SELECT s, CAST(CASE ch WHEN 5 THEN 0 WHEN 3 THEN 1 ELSE 2 END AS INT) AS ch, round(v, 6) AS v FROM {_LONG} WHERE ch IN (3, 5, 60)")
_framewise("crop_channels", lambda v: channels.crop(v, 8, 4), f"SELECT s, CAST(ch - 8 AS INT) AS ch, round(v, 6) AS v FROM {_LONG} WHERE ch BETWEEN 8 AND 11")
_framewise(
    "sparse_spatial_matrix",
    lambda v: channels.spatial(v, [[1.0 if j == i else -0.5 if j in (i - 1, i + 1) else 0.0 for j in range(64)] for i in range(3)]),
    f"WITH x AS (SELECT * FROM {_LONG}) SELECT a.s, a.ch, round(a.v - 0.5 * coalesce(b.v, 0) - 0.5 * coalesce(c.v, 0), 6) AS v FROM x a LEFT JOIN x b ON b.s = a.s AND b.ch = a.ch - 1 LEFT JOIN x c ON c.s = a.s AND c.ch = a.ch + 1 WHERE a.ch < 3",
)


@register("remap_channels", f"SELECT CAST(CASE ch WHEN 4 THEN 0 WHEN 9 THEN 1 ELSE 2 END AS BIGINT) AS ch, s, v FROM {_SIGNAL} WHERE ch IN (4, 9, 17)")
def remap_channels(spark: SparkSession, sf: str) -> DataFrame:
    return channels.remap(signal(spark, sf), [(4, 0), (9, 1), (17, 2)]).select(F.col("ch").cast("long").alias("ch"), "s", "v")


@register("merge_recordings", f"SELECT CAST(ch AS INT) AS ch, s, round(v, 6) AS v FROM {_LONG} UNION ALL SELECT CAST(ch + 64 AS INT), s, round(-v, 6) FROM {_LONG}")
def merge_recordings(spark: SparkSession, sf: str) -> DataFrame:
    one = channels.to_long(frames(spark, sf))
    return channels.merge([(one, 64), (one.withColumn("v", -F.col("v")), 64)]).select(F.col("ch").cast("int").alias("ch"), "s", F.round("v", 6).alias("v"))


@register("slice_source", f"SELECT s, ch, round(v, 6) AS v FROM {_LONG} WHERE ch IN (1, 7) AND s >= 100 AND s < 300")
def slice_source(spark: SparkSession, sf: str) -> DataFrame:
    return channels.to_long(frames(spark, sf).where("s >= 100 and s < 300")).where("ch in (1, 7)").select("s", "ch", F.round("v", 6).alias("v"))


def _timewise(name: str, f, sql: str) -> None:
    @register(name, sql)
    def query(spark: SparkSession, sf: str) -> DataFrame:
        return signal(spark, sf).select("ch", "s", F.round(f(F.col("v"), temporal.over()), 5).alias("v"))


_LAGS = "coalesce(lag(v, {k}) OVER (PARTITION BY ch ORDER BY s), 0)"
_timewise("fir_causal", lambda v, w: temporal.fir(v, [0.5, 0.3, 0.2], w), f"SELECT ch, s, round(0.5 * v + 0.3 * {_LAGS.format(k=1)} + 0.2 * {_LAGS.format(k=2)}, 5) AS v FROM {_SIGNAL}")
_timewise("fir_centred", lambda v, w: temporal.fir(v, [0.25, 0.5, 0.25], w, True), f"SELECT ch, s, round(0.25 * coalesce(lead(v) OVER {_ORDER}, 0) + 0.5 * v + 0.25 * coalesce(lag(v) OVER {_ORDER}, 0), 5) AS v FROM {_SIGNAL}")
_timewise("teager_kaiser", temporal.teager_kaiser, f"SELECT ch, s, round(v * v - coalesce(lag(v) OVER {_ORDER}, v) * coalesce(lead(v) OVER {_ORDER}, v), 5) AS v FROM {_SIGNAL}")
_timewise(
    "running_median",
    lambda v, w: temporal.running_median(v, 5, w),
    "SELECT ch, s, round(list_sort([{}])[3], 5) AS v FROM {}".format(", ".join(f"coalesce({f}(v, {k}) OVER {_ORDER}, 0)" for f, k in (("lag", 2), ("lag", 1), ("lag", 0), ("lead", 1), ("lead", 2))), _SIGNAL),
)
_KERNEL = temporal.gaussian_kernel(1.0)
_timewise(
    "gaussian_smooth",
    lambda v, w: temporal.gaussian(v, 1.0, w),
    f"WITH x AS (SELECT ch, s, v, row_number() OVER {_ORDER} - 1 AS i, count(*) OVER (PARTITION BY ch) AS n FROM {_SIGNAL}), k AS (SELECT unnest(range(9)) - 4 AS d, unnest({[float(t) for t in _KERNEL]}) AS w), "
    "p AS (SELECT x.ch, x.s, n, w, ((i + d) % (2 * n) + 2 * n) % (2 * n) AS q FROM x, k), g AS (SELECT ch, s, w, CASE WHEN q < n THEN q ELSE 2 * n - 1 - q END AS j FROM p) "
    "SELECT g.ch, g.s, round(sum(g.w * x.v), 5) AS v FROM g JOIN x ON x.ch = g.ch AND x.i = g.j GROUP BY g.ch, g.s",
)


@register(
    "nonlinear_energy",
    f"WITH x AS (SELECT ch, s, greatest(v * v - lag(v) OVER w * lead(v) OVER w, 0) AS e, lag(v) OVER w AS p, lead(v) OVER w AS n FROM {_SIGNAL} WINDOW w AS {_ORDER}) "
    f"SELECT ch, s, round(CASE WHEN p IS NULL AND n IS NULL THEN 0 WHEN p IS NULL THEN coalesce(lead(CASE WHEN p IS NOT NULL AND n IS NOT NULL THEN e END) OVER {_ORDER}, 0) WHEN n IS NULL THEN coalesce(lag(CASE WHEN p IS NOT NULL AND n IS NOT NULL THEN e END) OVER {_ORDER}, 0) ELSE e END, 5) AS v FROM x",
)
def nonlinear_energy(spark: SparkSession, sf: str) -> DataFrame:
    return signal(spark, sf).select("ch", "s", F.round(temporal.nonlinear_energy(F.col("v"), temporal.over()), 5).alias("v"))


@register("blank_artifacts", f"WITH x AS (SELECT * FROM {_LONG}), h AS (SELECT DISTINCT s // 16 AS c FROM x WHERE abs(v) >= 3) SELECT ch, s, round(CASE WHEN s // 16 IN (SELECT c FROM h) THEN 0 ELSE v END, 6) AS v FROM x")
def blank_artifacts(spark: SparkSession, sf: str) -> DataFrame:
    return temporal.blank(channels.to_long(frames(spark, sf)), 3.0, 16).select("ch", "s", F.round("v", 6).alias("v"))


@register("channel_delays", f"SELECT ch, s, round(coalesce(CASE ch WHEN 1 THEN lead(v, 2) OVER {_ORDER} WHEN 2 THEN lag(v, 3) OVER {_ORDER} ELSE v END, 0), 6) AS v FROM {_LONG}")
def channel_delays(spark: SparkSession, sf: str) -> DataFrame:
    return temporal.delay(channels.to_long(frames(spark, sf)), {1: 2, 2: -3}).select("ch", "s", F.round("v", 6).alias("v"))


_FLAGS = (
    f"x AS (SELECT *, lag(v) OVER {_ORDER} AS p FROM {_SIGNAL}), k AS (SELECT *, CASE WHEN p < 60 AND v >= 60 THEN 1 WHEN p >= 30 AND v < 30 THEN 0 END AS k FROM x), "
    "h AS (SELECT *, coalesce(last_value(k IGNORE NULLS) OVER (PARTITION BY ch ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS h FROM k), "
    f"i AS (SELECT *, sum(CASE WHEN k = 1 AND h = 0 THEN 1 ELSE 0 END) OVER {_ORDER} AS i FROM h), "
    "e AS (SELECT ch, min(s) AS onset, min(CASE WHEN k = 0 AND h = 1 THEN s END) AS \"offset\", max(CASE WHEN k IS DISTINCT FROM 0 OR h = 0 THEN v END) AS peak_value FROM i WHERE i > 0 AND (h = 1 OR k = 1) GROUP BY ch, i)"
)


@register("crossings", f'WITH {_FLAGS} SELECT e.ch, onset, "offset", min(x.s) AS peak_sample, peak_value FROM e JOIN x ON x.ch = e.ch AND x.v = e.peak_value AND x.s >= onset AND ("offset" IS NULL OR x.s < "offset") GROUP BY ALL')
def crossings(spark: SparkSession, sf: str) -> DataFrame:
    return events.crossings(signal(spark, sf), 60.0, 30.0)


@register(
    "crossings_refractory",
    f"""WITH RECURSIVE x AS (SELECT *, lag(v) OVER {_ORDER} AS p FROM {_SIGNAL}),
    f AS (SELECT ch, s, p < 60 AND v >= 60 AS up, row_number() OVER {_ORDER} AS k FROM x WHERE (p < 60 AND v >= 60) OR (p >= 30 AND v < 30)),
    st AS (SELECT ch, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS onset, CAST(-1000000 AS BIGINT) AS ready, CAST(NULL AS BIGINT) AS o, CAST(NULL AS BIGINT) AS e FROM (SELECT DISTINCT ch FROM f)
        UNION ALL SELECT f.ch, f.k, CASE WHEN up AND onset IS NULL THEN CASE WHEN s >= ready THEN s END WHEN up THEN onset END,
            CASE WHEN NOT up AND s - onset >= 100 THEN s + 500 ELSE ready END, CASE WHEN NOT up AND s - onset >= 100 THEN onset END, CASE WHEN NOT up AND s - onset >= 100 THEN s END
        FROM st JOIN f ON f.ch = st.ch AND f.k = st.k + 1),
    e AS (SELECT ch, o AS onset, e AS "offset" FROM st WHERE o IS NOT NULL UNION ALL SELECT ch, onset, NULL FROM (SELECT * FROM st QUALIFY row_number() OVER (PARTITION BY ch ORDER BY k DESC) = 1) WHERE onset IS NOT NULL),
    m AS (SELECT e.ch, onset, "offset", max(v) AS peak_value FROM e JOIN x ON x.ch = e.ch AND x.s >= onset AND ("offset" IS NULL OR x.s < "offset") GROUP BY ALL)
    SELECT m.ch, onset, "offset", min(x.s) AS peak_sample, peak_value FROM m JOIN x ON x.ch = m.ch AND x.v = m.peak_value AND x.s >= onset AND ("offset" IS NULL OR x.s < "offset") GROUP BY ALL""",
)
def crossings_refractory(spark: SparkSession, sf: str) -> DataFrame:
    return events.crossings(signal(spark, sf), 60.0, 30.0, min_duration=100, refractory=500)


@register("peak_candidates", f"SELECT ch, s, v FROM (SELECT *, lag(v) OVER {_ORDER} AS p, lead(v) OVER {_ORDER} AS n FROM {_SIGNAL}) WHERE p < v AND v >= n AND v >= 80")
def peak_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return events.peak_candidates(signal(spark, sf), 80.0)


_ROUNDED = "(SELECT user_id AS ch, event_id AS s, round(value / 20) AS v FROM events)"


@register(
    "local_maxima",
    f"WITH a AS (SELECT *, row_number() OVER {_ORDER} AS nr, coalesce(CAST(v <> lag(v) OVER {_ORDER} AS INT), 1) AS new FROM {_ROUNDED}), b AS (SELECT *, sum(new) OVER {_ORDER} AS run FROM a), c AS (SELECT ch, run, min(nr) AS a, max(nr) AS b, min(v) AS v FROM b GROUP BY ALL), "
    "d AS (SELECT *, lag(v) OVER w AS p, lead(v) OVER w AS n FROM c WINDOW w AS (PARTITION BY ch ORDER BY run)) SELECT d.ch, b.s, b.v FROM d JOIN b ON b.ch = d.ch AND b.nr = (d.a + d.b) // 2 WHERE p < d.v AND n < d.v",
)
def local_maxima(spark: SparkSession, sf: str) -> DataFrame:
    return events.local_maxima(signal(spark, sf).withColumn("v", F.round(F.col("v") / 20)))


_PEAKS = f"(SELECT ch, s, v FROM (SELECT *, lag(v) OVER {_ORDER} AS p, lead(v) OVER {_ORDER} AS n FROM {_SIGNAL}) WHERE p < v AND v >= n AND v >= 40)"


@register("locally_exclusive_peaks", f"WITH x AS (SELECT * FROM {_PEAKS}) SELECT ch, s, v FROM x a WHERE NOT EXISTS (SELECT 1 FROM x b WHERE b.ch = a.ch AND b.s <> a.s AND abs(b.s - a.s) < 400 AND (b.v > a.v OR (b.v = a.v AND b.s < a.s)))")
def locally_exclusive_peaks(spark: SparkSession, sf: str) -> DataFrame:
    return events.locally_exclusive(events.peak_candidates(signal(spark, sf), 40.0), 400)


_NOISE = f"SELECT ch, list_sort(list(abs(v)))[CAST(count(*) // 2 + 1 AS BIGINT)] / {stats.NORMAL_QUARTILE}::DOUBLE AS sigma FROM {_LONG} GROUP BY ch"


@register(
    "threshold_spikes",
    f"WITH n AS ({_NOISE}), p AS (SELECT *, lag(v) OVER {_ORDER} AS a, lead(v) OVER {_ORDER} AS b FROM {_LONG}), x AS (SELECT p.ch, s, v FROM p JOIN n USING (ch) WHERE -a < -v AND -v >= -b AND sigma > 0 AND -v >= sigma * 1.5) "
    "SELECT ch, s, round(v, 6) AS v FROM x a WHERE NOT EXISTS (SELECT 1 FROM x b WHERE b.ch = a.ch AND b.s <> a.s AND abs(b.s - a.s) < 11 AND (-b.v > -a.v OR (b.v = a.v AND b.s < a.s)))",
)
def threshold_spikes(spark: SparkSession, sf: str) -> DataFrame:
    x = channels.to_long(frames(spark, sf))
    sigma = x.groupBy("ch").agg(stats.noise(F.col("v")).alias("sigma"))
    return events.threshold_spikes(x, sigma, 1.5, 10).select("ch", "s", F.round("v", 6).alias("v"))


@register(
    "spatial_dedup",
    f"WITH e AS (SELECT ch, s, v FROM {_LONG} WHERE abs(v) >= 0.35), m AS (SELECT a.ch, a.s, a.v, b.ch AS other, (abs(b.v) > abs(a.v)) OR (abs(b.v) = abs(a.v) AND (b.s < a.s OR (b.s = a.s AND b.ch < a.ch))) AS beaten "
    "FROM e a JOIN e b ON abs(a.s - b.s) <= 2 AND (a.ch // 8 - b.ch // 8) ** 2 + (a.ch % 8 - b.ch % 8) ** 2 <= 2) SELECT ch, s, round(v, 6) AS v, array_to_string(list_sort(list(DISTINCT other)), ',') AS channels FROM m GROUP BY ch, s, v HAVING NOT bool_or(beaten)",
)
def spatial_dedup(spark: SparkSession, sf: str) -> DataFrame:
    e = channels.to_long(frames(spark, sf)).where(F.abs("v") >= 0.35)
    sites = spark.range(64).select(F.col("id").cast("int").alias("ch"), F.floor(F.col("id") / 8).cast("double").alias("x"), (F.col("id") % 8).cast("double").alias("y"), F.lit(0.0).alias("z"))
    out = events.spatial_dedup(e, sites, 1.4143, 2)
    return out.select("ch", "s", F.round("v", 6).alias("v"), F.array_join("channels", ",").alias("channels"))


# statistics

@register("channel_summary", f"SELECT ch, count(v) AS n, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(max(v) - min(v), 6) AS peak_to_peak, round(stddev_samp(v) / sqrt(count(v)), 6) AS standard_error FROM {_SIGNAL} GROUP BY ch")
def channel_summary(spark: SparkSession, sf: str) -> DataFrame:
    return stats.summary(signal(spark, sf)).select("ch", "n", *[F.round(c, 6).alias(c) for c in ("mean", "std", "peak_to_peak", "standard_error")])


@register(
    "order_statistics",
    f"WITH g AS (SELECT ch, count(*) AS n, list_sort(list(v)) AS a, list_sort(list(abs(v))) AS b, quantile_cont(v, 0.5) AS m FROM {_SIGNAL} GROUP BY ch) SELECT ch, round(b[n // 2 + 1] / {stats.NORMAL_QUARTILE}::DOUBLE, 6) AS noise, round(a[n * 3 // 4 + 1] - a[n // 4 + 1], 6) AS iqr, "
    "round(a[CAST(round((n - 1) * 0.9::DOUBLE) AS BIGINT) + 1], 6) AS p90, round(m, 6) AS median FROM g",
)
def order_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return stats.order_statistics(signal(spark, sf)).select("ch", *[F.round(c, 6).alias(c) for c in ("noise", "iqr", "p90", "median")])


@register("kth_value", f"SELECT ch, v FROM (SELECT *, row_number() OVER (PARTITION BY ch ORDER BY v, s) AS r FROM {_SIGNAL}) WHERE r = 4")
def kth_value(spark: SparkSession, sf: str) -> DataFrame:
    return stats.kth(signal(spark, sf), 3)


@register("median_deviation", f"WITH m AS (SELECT ch, quantile_cont(v, 0.5) AS m FROM {_SIGNAL} GROUP BY ch) SELECT ch, round(quantile_cont(abs(v - m), 0.5), 6) AS mad FROM {_SIGNAL} JOIN m USING (ch) GROUP BY ch")
def median_deviation(spark: SparkSession, sf: str) -> DataFrame:
    return stats.mad(signal(spark, sf)).select("ch", F.round("mad", 6).alias("mad"))


@register("trimmed_deviation")
def trimmed_deviation(spark: SparkSession, sf: str) -> DataFrame:
    return stats.trimmed_deviation(channels.to_long(frames(spark, sf)), 2.5, tolerance=1e-3)


@register(
    "histogram",
    f"WITH c AS (SELECT ch, CAST(least(floor((v - 10) * 8 / (90 - 10)), 7) AS INT) AS bin, count(*) AS n FROM {_SIGNAL} WHERE v BETWEEN 10 AND 90 GROUP BY ALL) SELECT u.ch, u.bin, coalesce(n, 0) AS n FROM (SELECT DISTINCT ch, b.bin FROM {_SIGNAL}, (SELECT CAST(unnest(range(8)) AS INT) AS bin) b) u LEFT JOIN c USING (ch, bin)",
)
def histogram(spark: SparkSession, sf: str) -> DataFrame:
    return stats.histogram(signal(spark, sf), 10.0, 90.0, 8)


@register("cross_correlation", "SELECT CAST(l.lag AS INT) AS lag, round(sum(CAST(a.embedding[1] AS DOUBLE) * b.embedding[3]), 5) AS r FROM embeddings a, (SELECT unnest(range(-5, 6)) AS lag) l, embeddings b WHERE b.vec_id = a.vec_id + l.lag GROUP BY 1")
def cross_correlation(spark: SparkSession, sf: str) -> DataFrame:
    return stats.cross_correlation(frames(spark, sf), 0, 2, 5).select("lag", F.round("r", 5).alias("r"))


@register("covariance", f"WITH x AS (SELECT * FROM {_LONG}) SELECT CAST(a.ch AS INT) AS i, CAST(b.ch AS INT) AS j, round(covar_pop(a.v, b.v), 7) AS c FROM x a JOIN x b ON a.s = b.s AND a.ch <= b.ch GROUP BY ALL")
def covariance(spark: SparkSession, sf: str) -> DataFrame:
    return stats.covariance(frames(spark, sf), 64).select("i", "j", F.round("c", 7).alias("c"))


@register("template_moments", "WITH x AS (SELECT label, CAST(generate_subscripts(embedding, 1) - 1 AS INT) AS place, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) SELECT label, place, count(*) AS n, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, round(stddev_samp(x) / sqrt(count(*)), 6) AS se FROM x GROUP BY ALL")
def template_moments(spark: SparkSession, sf: str) -> DataFrame:
    out = stats.element_moments(labelled(spark, sf), "label", "x")
    return out.select("label", "place", "n", *[F.round(c, 6).alias(c) for c in ("mean", "std", "se")])


# point processes

_TOTAL = 30 * DAY


@register("isi_violations", f"WITH d AS (SELECT unit, s / 1e6::DOUBLE - lag(s / 1e6::DOUBLE) OVER (PARTITION BY unit ORDER BY s) AS d FROM {_TRAIN}) SELECT unit, count(*) AS n, count(*) FILTER (WHERE d < 3600) AS violations, round(count(*) FILTER (WHERE d < 3600) / (2 * count(*) * 3600.0::DOUBLE) / (count(*) / 2592000.0::DOUBLE), 6) AS ratio FROM d GROUP BY unit")
def isi_violations(spark: SparkSession, sf: str) -> DataFrame:
    return trains.isi_violations(train(spark, sf), 1e6, 2592000.0, 3600.0).withColumn("ratio", F.round("ratio", 6))


@register("isi_histogram", f"WITH d AS (SELECT unit, (s - lag(s) OVER (PARTITION BY unit ORDER BY s)) / 1e6::DOUBLE AS d FROM {_TRAIN}) SELECT unit, CAST(floor(d / 7200) AS INT) AS bin, count(*) AS n FROM d WHERE d < 86400 GROUP BY ALL")
def isi_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return trains.isi_histogram(train(spark, sf), 1e6, 7200.0, 86400.0)


@register("presence_ratio", f"WITH b AS (SELECT DISTINCT unit, s // {DAY} AS b FROM {_TRAIN} WHERE s >= 0 AND s < {_TOTAL}) SELECT u.unit, count(b.b) / 30.0::DOUBLE AS presence FROM (SELECT DISTINCT unit FROM {_TRAIN}) u LEFT JOIN b USING (unit) GROUP BY ALL")
def presence_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return trains.presence(train(spark, sf).where(f"s < {_TOTAL}"), DAY, _TOTAL).unionByName(train(spark, sf).select("unit").distinct().join(train(spark, sf).where(f"s < {_TOTAL}"), "unit", "left_anti").select("unit", F.lit(0.0).alias("presence")))


@register("refractory_pairs", f"WITH x AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY s) AS i FROM {_TRAIN}) SELECT a.unit, count(b.i) AS pairs FROM x a LEFT JOIN x b ON a.unit = b.unit AND a.i < b.i AND b.s - a.s <= {HOUR} GROUP BY a.unit")
def refractory_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return trains.refractory_pairs(train(spark, sf), HOUR)


@register(
    "contamination",
    f"WITH x AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY s) AS i FROM {_TRAIN}), p AS (SELECT a.unit, count(b.i) AS p FROM x a LEFT JOIN x b ON a.unit = b.unit AND a.i < b.i AND b.s - a.s <= {HOUR} GROUP BY a.unit), n AS (SELECT unit, count(*) AS n FROM x GROUP BY unit), "
    f"q AS (SELECT unit, 1 - p * ({_TOTAL}.0::DOUBLE) / (n * n * {HOUR}.0::DOUBLE) AS q FROM p JOIN n USING (unit)) SELECT unit, round(CASE WHEN q < 0 THEN 1.0 ELSE 1 - sqrt(greatest(q, 0)) END, 6) AS contamination FROM q",
)
def contamination(spark: SparkSession, sf: str) -> DataFrame:
    return trains.contamination(train(spark, sf), _TOTAL, HOUR).withColumn("contamination", F.round("contamination", 6))


_BIN, _HALF = HOUR, 12


_PAIRS = (
    f"WITH x AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY s) AS i FROM {_TRAIN}), p AS (SELECT a.unit, CAST(least(floor((b.s - a.s) / {_BIN}::DOUBLE + 0.5), {_HALF}) AS INT) AS lag FROM x a JOIN x b ON a.unit = b.unit AND a.i < b.i AND b.s - a.s < {int((_HALF + 0.5) * _BIN)}) "
    "SELECT unit, lag, count(*) AS n FROM (SELECT unit, lag FROM p UNION ALL SELECT unit, -lag FROM p) GROUP BY ALL"
)


@register("autocorrelogram", _PAIRS)
def autocorrelogram(spark: SparkSession, sf: str) -> DataFrame:
    return trains.autocorrelogram(train(spark, sf), _BIN, _HALF)


_SHOULDER = _HALF // 2


@register(
    "refractory_stats",
    f"WITH c AS ({_PAIRS}), b AS (SELECT unit, greatest(coalesce(sum(n) FILTER (lag <= -{_SHOULDER}), 0), coalesce(sum(n) FILTER (lag >= {_SHOULDER}), 0)) / {_HALF - _SHOULDER + 1}::DOUBLE AS baseline FROM c GROUP BY unit), "
    f"p AS (SELECT b.unit, baseline, k, 2 * k * baseline AS l, coalesce((SELECT sum(n) FROM c WHERE c.unit = b.unit AND abs(lag) BETWEEN 1 AND k), 0)::DOUBLE AS n FROM b, (SELECT unnest(range(1, {max(min(10, _HALF - 1), 1) + 1})) AS k)), "
    "z AS (SELECT *, (n - l) / sqrt(1e-10 + 2 * l) AS z FROM p), t AS (SELECT *, 1 / (1 + abs(z) * 0.3275911) AS t FROM z), "
    "q AS (SELECT *, 0.5 * (1 + sign(z) * (1 - ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * exp(-z * z))) AS p FROM t) "
    "SELECT unit, round(baseline, 6) AS baseline, CASE WHEN baseline > 0 THEN round(min(n / l), 6) ELSE 'inf'::DOUBLE END AS ratio, CASE WHEN baseline > 0 THEN round(least(min(p), 1), 6) ELSE 1 END AS probability FROM q GROUP BY unit, baseline",
)
def refractory_stats(spark: SparkSession, sf: str) -> DataFrame:
    got = quality.refractory_stats(autocorrelogram(spark, sf), _HALF, _SHOULDER)
    return got.select("unit", *[F.round(c, 6).alias(c) for c in ("baseline", "ratio", "probability")])


_CUT = 10


def _cutoff_sql() -> str:
    w = [float(np.exp(-0.5 * k * k / 4)) for k in range(9)]
    w = [x / (w[0] + 2 * sum(w[1:])) for x in w]
    return (
        "WITH x AS (SELECT user_id AS unit, abs(value)::DOUBLE AS x FROM events WHERE value IS NOT NULL), r AS (SELECT unit, count(*) AS n, min(x) AS a, max(x) AS b FROM x GROUP BY unit), "
        "e AS (SELECT unit, n, CASE WHEN a = b THEN a - 0.5 ELSE a END AS a, CASE WHEN a = b THEN b + 0.5 ELSE b END AS b FROM r), "
        f"c AS (SELECT x.unit, len(list_filter(range(0, {_CUT}), lambda i: a + (b - a) * i / {_CUT} <= x)) - 1 AS bin, count(*) AS c FROM x JOIN e USING (unit) GROUP BY ALL), "
        f"h AS (SELECT e.unit, e.n, list(coalesce(c, 0)::DOUBLE ORDER BY i) AS h FROM e CROSS JOIN (SELECT unnest(range(0, {_CUT})) AS i) LEFT JOIN c ON c.unit = e.unit AND c.bin = i GROUP BY ALL), "
        f"p AS (SELECT unit, n, list_transform(range(0, {_CUT}), lambda k: floor(list_reduce(list_concat([h[k + 1] * {w[0]!r}::DOUBLE], list_transform(range(1, 9), lambda j: (h[least(k + j, {_CUT - 1}) + 1] + h[greatest(k - j, 0) + 1]) * ({w[1:]!r}::DOUBLE[])[j])), lambda s, v: s + v))) AS p FROM h), "
        f"g AS (SELECT unit, n, p, list_max(list_filter(range(1, {_CUT + 1}), lambda k: p[k] >= p[1])) AS g FROM p), m AS (SELECT unit, n, coalesce(list_sum(p[g + 1:]), 0) AS missed FROM g) "
        f"SELECT unit, CASE WHEN n / {_CUT}.0 < 1 THEN NULL ELSE round(least(missed / (n + missed), 0.5), 9) END AS cutoff FROM m"
    )


@register("amplitude_cutoff", _cutoff_sql())
def amplitude_cutoff(spark: SparkSession, sf: str) -> DataFrame:
    spikes = _read(spark, sf, "events").select(F.col("user_id").alias("unit"), F.col("value").alias("amp"))
    got = quality.amplitude_cutoff(spikes, _CUT, 2.0, 1.0)
    return got.select("unit", F.when(~F.isnan("cutoff"), F.round("cutoff", 9)).alias("cutoff"))


_CBIN = 60_000_000


@register(
    "crosscorrelogram",
    f"WITH a AS (SELECT s FROM {_TRAIN} WHERE kind = 'purchase'), b AS (SELECT s FROM {_TRAIN} WHERE kind = 'click') SELECT CAST(greatest(least(sign(b.s - a.s) * floor(abs(b.s - a.s) / {_CBIN}::DOUBLE + 0.5), 10), -10) AS INT) AS lag, count(*) AS n FROM a JOIN b ON b.s - a.s BETWEEN -{int(10.5 * _CBIN) - 1} AND {int(10.5 * _CBIN) - 1} GROUP BY 1",
)
def crosscorrelogram(spark: SparkSession, sf: str) -> DataFrame:
    return trains.crosscorrelogram(train(spark, sf, "purchase"), train(spark, sf, "click"), _CBIN, 10)


_RATES = f"(SELECT u.unit, u.bin, coalesce(n, 0) / 24.0::DOUBLE AS rate FROM (SELECT DISTINCT unit, b.bin FROM {_TRAIN}, (SELECT CAST(unnest(range(30)) AS INT) AS bin) b) u LEFT JOIN (SELECT unit, CAST(s // {DAY} AS INT) AS bin, count(*) AS n FROM {_TRAIN} GROUP BY ALL) c USING (unit, bin))"


@register("firing_rate", f"SELECT unit, bin, round(rate, 6) AS rate FROM {_RATES}")
def firing_rate(spark: SparkSession, sf: str) -> DataFrame:
    return trains.firing_rate(train(spark, sf), DAY, _TOTAL, HOUR).withColumn("rate", F.round("rate", 6))


@register("firing_range", f"SELECT unit, round(quantile_cont(rate, 0.95) - quantile_cont(rate, 0.05), 6) AS firing_range FROM {_RATES} GROUP BY unit")
def firing_range(spark: SparkSession, sf: str) -> DataFrame:
    return trains.firing_range(trains.firing_rate(train(spark, sf), DAY, _TOTAL, HOUR)).withColumn("firing_range", F.round("firing_range", 6))


@register("bursts", f"WITH h AS (SELECT *, bin - row_number() OVER (PARTITION BY unit ORDER BY bin) AS run FROM {_RATES} WHERE rate >= 0.08) SELECT unit, CAST(min(bin) AS INT) AS first_bin, CAST(max(bin) AS INT) AS last_bin, round(max(rate), 6) AS top FROM h GROUP BY unit, run HAVING max(bin) - min(bin) + 1 >= 3")
def burst_epochs(spark: SparkSession, sf: str) -> DataFrame:
    return events.bursts(trains.firing_rate(train(spark, sf), DAY, _TOTAL, HOUR), 0.08, 3).withColumn("top", F.round("top", 6))


_WINDOW = 300_000_000
_NEAR = f"(SELECT c.unit, p.event_id AS trial, c.s - p.s AS d FROM (SELECT * FROM {_TRAIN} WHERE kind = 'purchase') p JOIN (SELECT * FROM {_TRAIN} WHERE kind = 'click') c ON c.s - p.s >= -{_WINDOW} AND c.s - p.s < {2 * _WINDOW})"


@register("aligned_raster", f'SELECT unit, trial, d AS "offset" FROM {_NEAR}')
def aligned_raster(spark: SparkSession, sf: str) -> DataFrame:
    return trains.raster(train(spark, sf, "click"), stimuli(spark, sf), _WINDOW, 2 * _WINDOW)


@register(
    "psth",
    f"WITH c AS (SELECT trial, CAST(least(floor((d + {_WINDOW}) / {3 * _WINDOW / 9}::DOUBLE), 8) AS INT) AS bin, count(*) AS n FROM {_NEAR} GROUP BY ALL), k AS (SELECT count(*) AS k FROM events WHERE event_type = 'purchase') "
    f"SELECT CAST(0 AS BIGINT) AS unit, bin, round(sum(n) / k * {1e6 / (3 * _WINDOW / 9)}, 8) AS mean, round(sqrt((sum(n * n) - sum(n) * sum(n) / k::DOUBLE) / (k - 1) / k) * {1e6 / (3 * _WINDOW / 9)}, 8) AS se FROM c, k GROUP BY bin, k",
)
def psth(spark: SparkSession, sf: str) -> DataFrame:
    clicks = train(spark, sf, "click").withColumn("unit", F.lit(0).cast("long"))
    return trains.psth(clicks, stimuli(spark, sf), _WINDOW, 2 * _WINDOW, 9, 1e6).select("unit", "bin", F.round("mean", 8).alias("mean"), F.round("se", 8).alias("se"))


#: Rising crossings of each channel, which stand for events of the recording.
_RISES = f"(SELECT ch, s AS t FROM (SELECT ch, s, v, lag(v) OVER (PARTITION BY ch ORDER BY s) AS p FROM {_LONG}) WHERE p < 0.2 AND v >= 0.2)"


def _rises(spark: SparkSession, sf: str) -> DataFrame:
    return events.crossings(channels.to_long(frames(spark, sf)), 0.2).select("ch", F.col("onset").alias("s"))


@register("triggered_average", f"WITH e AS (SELECT t FROM {_RISES} WHERE ch = 0), x AS (SELECT ch, e.t, s - e.t AS d, v FROM {_LONG} JOIN e ON s - e.t >= -3 AND s - e.t < 6), f AS (SELECT ch, t FROM x GROUP BY ALL HAVING count(*) = 9) SELECT ch, d AS \"offset\", count(*) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, round(stddev_samp(v) / sqrt(count(*)), 6) AS se FROM x JOIN f USING (ch, t) GROUP BY ALL")
def triggered_average(spark: SparkSession, sf: str) -> DataFrame:
    """All channels around the rises of channel 0, the trigger line."""
    at = _rises(spark, sf).where("ch = 0").select(F.col("s").alias("trial"), F.col("s").alias("t"))
    return trains.triggered_average(channels.to_long(frames(spark, sf)), at, 3, 6).select("ch", "offset", "n", *[F.round(c, 6).alias(c) for c in ("mean", "std", "se")])


@register("snippets", f"SELECT CAST(1 AS BIGINT) AS unit, x.ch, e.t AS s, round(sum(v), 5) AS area, count(*) AS n FROM {_LONG} x JOIN {_RISES} e ON x.ch = e.ch AND s >= e.t - 5 AND s < e.t + 8 GROUP BY ALL HAVING count(*) = 13")
def snippets(spark: SparkSession, sf: str) -> DataFrame:
    x = channels.to_long(frames(spark, sf))
    at = _rises(spark, sf).select(F.lit(1).cast("long").alias("unit"), "ch", "s")
    out = events.snippets(x, at, 5, 8)
    return out.select("unit", "ch", "s", F.round(channels.total(F.col("w")), 5).alias("area"), F.size("w").cast("long").alias("n"))


_UNITS = f"(SELECT unit AS \"index\", count(*) AS n, avg(v) / (stddev_samp(v) + 1) * 4 AS snr, min(d) / 1e9 AS isi FROM (SELECT user_id AS unit, value AS v, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS d FROM events) GROUP BY unit)"


def units(spark: SparkSession, sf: str) -> DataFrame:
    e = _read(spark, sf, "events").select(F.col("user_id").alias("unit"), F.col("value").alias("v"), F.unix_micros(F.col("ts").cast("timestamp")).alias("s"))
    gaps = trains.intervals(e.select("unit", "s")).groupBy("unit").agg((F.min("isi") / 1e9).alias("isi"))
    base = e.groupBy("unit").agg(F.count("v").alias("n"), (F.avg("v") / (F.stddev_samp("v") + 1) * 4).alias("snr"))
    return base.join(gaps, "unit", "left").withColumnRenamed("unit", "index")


@register("quality_labels", f"SELECT \"index\", n, CASE WHEN n < 3 THEN 'noise' WHEN snr IS NULL THEN 'unsorted' WHEN snr < 1.5 THEN 'noise' WHEN (isi IS NULL OR isi < 0.5) AND snr >= 3 THEN 'good' ELSE 'mua' END AS label FROM {_UNITS}")
def quality_labels(spark: SparkSession, sf: str) -> DataFrame:
    return units(spark, sf).select("index", "n", trains.quality(F.col("n"), F.col("snr"), F.col("isi")).alias("label"))


@register("unit_table_order", f"SELECT \"index\", n, row_number() OVER (ORDER BY isi DESC NULLS LAST, \"index\") AS place FROM {_UNITS}")
def unit_table_order(spark: SparkSession, sf: str) -> DataFrame:
    # a unit table is a table of clusters: one order over it is a small sort
    ordered = trains.unit_order(units(spark, sf), "isi", descending=True)
    return ordered.select("index", "n", F.row_number().over(Window.orderBy(F.col("isi").desc_nulls_last(), "index")).cast("long").alias("place"))


@register("duplicate_spikes")
def duplicate_spikes(spark: SparkSession, sf: str) -> DataFrame:
    return trains.duplicate_spikes(train(spark, sf), HOUR)


@register("match_trains")
def match_trains(spark: SparkSession, sf: str) -> DataFrame:
    pick = lambda kind: train(spark, sf, kind).withColumn("unit", F.col("unit") % 10)
    return trains.match_trains(pick("click"), pick("view"), 600_000_000)


@register("match_units")
def match_units(spark: SparkSession, sf: str) -> DataFrame:
    return trains.greedy_units(match_trains(spark, sf))


# points

@register("nearest_neighbours", "WITH q AS (SELECT vec_id AS query, embedding AS e FROM embeddings WHERE vec_id % 50 = 0), d AS (SELECT query, vec_id AS id, list_sum(list_transform(list_zip(e, embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) ** 2)) AS d2 FROM q, embeddings WHERE vec_id <> query), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY d2, id) AS rank FROM d) SELECT query, id, round(d2, 5) AS d2, CAST(rank AS INT) AS rank FROM r WHERE rank <= 3")
def nearest_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    p = labelled(spark, sf).select("id", "x")
    return points.nearest(p.where("id % 50 = 0"), p, 3, blocks=8).select("query", "id", F.round("d2", 5).alias("d2"), "rank")


_MEANS = "(SELECT label, i, avg(x) AS m, count(*) AS n FROM (SELECT label, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY ALL)"


@register("centroid_similarity", f"WITH c AS (SELECT * FROM {_MEANS}) SELECT a.label AS a, b.label AS b, round(sum(a.m * b.m) / sqrt(sum(a.m * a.m) * sum(b.m * b.m)), 6) AS cosine FROM c a JOIN c b ON a.i = b.i AND a.label < b.label GROUP BY ALL")
def centroid_similarity(spark: SparkSession, sf: str) -> DataFrame:
    return points.centroid_similarity(labelled(spark, sf)).select("a", "b", F.round("cosine", 6).alias("cosine"))


@register(
    "silhouette",
    f"WITH c AS (SELECT * FROM {_MEANS}), x AS (SELECT vec_id AS id, label, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings), d AS (SELECT x.id, x.label, c.label AS other, sqrt(sum((v - m) ** 2)) AS d FROM x JOIN c ON x.i = c.i GROUP BY ALL), "
    "g AS (SELECT id, label, min(d) FILTER (WHERE other = label) AS a, min(d) FILTER (WHERE other <> label) AS b FROM d GROUP BY ALL) SELECT id, label, round((b - a) / greatest(a, b), 6) AS s FROM g",
)
def silhouette(spark: SparkSession, sf: str) -> DataFrame:
    return points.silhouette(labelled(spark, sf)).select("id", "label", F.round("s", 6).alias("s"))


@register(
    "isolation_distance",
    "WITH x AS (SELECT vec_id AS id, label, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings), m AS (SELECT i, avg(v) AS m, var_samp(v) AS s FROM x WHERE label = 3 GROUP BY i), d AS (SELECT id, sum((v - m) ** 2 / greatest(s, 1e-12)) AS d2 FROM x JOIN m USING (i) WHERE label <> 3 GROUP BY id), "
    "r AS (SELECT d2, row_number() OVER (ORDER BY d2) AS r FROM d) SELECT round(max(d2), 5) AS isolation_distance FROM r WHERE r <= (SELECT count(*) FROM embeddings WHERE label = 3)",
)
def isolation_distance(spark: SparkSession, sf: str) -> DataFrame:
    return points.isolation_distance(labelled(spark, sf), 3).select(F.round("isolation_distance", 5).alias("isolation_distance"))


@register(
    "d_prime",
    "WITH x AS (SELECT vec_id AS id, label = 3 AS mine, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings), m AS (SELECT i, (avg(v) FILTER (WHERE mine) - avg(v) FILTER (WHERE NOT mine)) / ((var_pop(v) FILTER (WHERE mine) + var_pop(v) FILTER (WHERE NOT mine)) / 2 + 1e-12) AS w FROM x GROUP BY i), "
    "y AS (SELECT id, mine, sum(v * w) AS y FROM x JOIN m USING (i) GROUP BY ALL) SELECT round((avg(y) FILTER (WHERE mine) - avg(y) FILTER (WHERE NOT mine)) / sqrt((var_pop(y) FILTER (WHERE mine) + var_pop(y) FILTER (WHERE NOT mine)) / 2), 5) AS d_prime FROM y",
)
def d_prime(spark: SparkSession, sf: str) -> DataFrame:
    return points.d_prime(labelled(spark, sf), 3).select(F.round("d_prime", 5).alias("d_prime"))


@register(
    "density_peaks",
    f"WITH c AS (SELECT * FROM {_MEANS}), d AS (SELECT a.label AS id, b.label AS j, sum((a.m - b.m) ** 2) AS d2 FROM c a JOIN c b ON a.i = b.i AND a.label <> b.label GROUP BY ALL), r AS (SELECT id, sum(exp(-d2 / 0.25)) AS rho FROM d GROUP BY id), "
    "e AS (SELECT d.id, r.rho, sqrt(min(d2) FILTER (WHERE q.rho > r.rho OR (q.rho = r.rho AND d.j < d.id))) AS delta FROM d JOIN r ON r.id = d.id JOIN r q ON q.id = d.j GROUP BY ALL), f AS (SELECT id, rho, coalesce(delta, 1.1 * greatest((SELECT max(delta) FROM e), 1e-4)) AS delta FROM e) "
    "SELECT id, round(rho, 6) AS rho, round(delta, 6) AS delta, row_number() OVER (ORDER BY rho * delta DESC, id) <= 3 AS centre FROM f",
)
def density_peaks(spark: SparkSession, sf: str) -> DataFrame:
    c = points.centroids(labelled(spark, sf)).select(F.col("label").alias("id"), F.col("c").alias("x"))
    return points.density_peaks(c, 0.5, 3).select("id", F.round("rho", 6).alias("rho"), F.round("delta", 6).alias("delta"), "centre")


@register("cluster_sums", "WITH x AS (SELECT label, CAST(generate_subscripts(embedding, 1) - 1 AS INT) AS place, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings) SELECT label, place, count(*) AS n, round(sum(v), 5) AS sum FROM x GROUP BY ALL")
def cluster_sums(spark: SparkSession, sf: str) -> DataFrame:
    return points.cluster_sums(labelled(spark, sf)).withColumn("sum", F.round("sum", 5))


_HAAR = "list_transform(range(0, 32), lambda i: (CAST(embedding[2 * i + 1] AS DOUBLE) {o} CAST(embedding[2 * i + 2] AS DOUBLE)) * sqrt(0.5))"


@register("haar_transform", f"SELECT id, CAST(generate_subscripts(x, 1) - 1 AS INT) AS place, round(unnest(x), 6) AS v FROM (SELECT vec_id AS id, list_concat({_HAAR.format(o='+')}, {_HAAR.format(o='-')}) AS x FROM embeddings)")
def haar_transform(spark: SparkSession, sf: str) -> DataFrame:
    out = labelled(spark, sf).select("id", F.posexplode(points.haar(F.col("x"), 1, 64)).alias("place", "v"))
    return out.select("id", "place", F.round("v", 6).alias("v"))


@register("select_by_iqr", "WITH x AS (SELECT CAST(generate_subscripts(embedding, 1) - 1 AS INT) AS place, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings) SELECT place, round(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 6) AS iqr FROM x GROUP BY place ORDER BY quantile_cont(v, 0.75) - quantile_cont(v, 0.25) DESC, place LIMIT 10")
def select_by_iqr(spark: SparkSession, sf: str) -> DataFrame:
    return points.select_by_iqr(labelled(spark, sf), 10).withColumn("iqr", F.round("iqr", 6))


@register("centre_of_mass", f"WITH a AS (SELECT label AS unit, CAST(i - 1 AS INT) AS ch, abs(m) AS w FROM {_MEANS}) SELECT unit, round(sum(w * (ch // 8)) / sum(w), 6) AS x, round(sum(w * (ch % 8)) / sum(w), 6) AS y, 0.0::DOUBLE AS z FROM a GROUP BY unit")
def centre_of_mass(spark: SparkSession, sf: str) -> DataFrame:
    amp = points.centroids(labelled(spark, sf)).select(F.col("label").alias("unit"), F.posexplode("c").alias("ch", "amp"))
    sites = spark.range(64).select(F.col("id").cast("int").alias("ch"), F.floor(F.col("id") / 8).cast("double").alias("x"), (F.col("id") % 8).cast("double").alias("y"), F.lit(0.0).alias("z"))
    return points.centre_of_mass(amp, sites).select("unit", *[F.round(c, 6).alias(c) for c in "xyz"])


@register("pca_project")
def pca_project(spark: SparkSession, sf: str) -> DataFrame:
    p = labelled(spark, sf)
    mean, components, _ = points.pca(p, 3)
    return points.project(p, mean, components).select("id", "y")


@register("zca_whiten")
def zca_whiten(spark: SparkSession, sf: str) -> DataFrame:
    f = frames(spark, sf)
    _, _, cov = points.moments(f.select(F.col("s").alias("id"), F.col("v").alias("x")))
    return channels.to_long(f.withColumn("v", channels.spatial(F.col("v"), points.zca(cov).tolist())))


@register("kmeans")
def kmeans(spark: SparkSession, sf: str) -> DataFrame:
    p = labelled(spark, sf).select("id", "x")
    return points.kmeans(p, points.seeds(p, 5), rounds=8)[0].select("id", "label", "d2")


@register("gmm")
def gmm(spark: SparkSession, sf: str) -> DataFrame:
    p = labelled(spark, sf).select("id", "x")
    w, _, _, bic = points.gmm(p, points.seeds(p, 3), rounds=5)
    return spark.createDataFrame([(i, float(x), bic) for i, x in enumerate(w)], "component int, weight double, bic double")


@register("subsample", None)
def subsample(spark: SparkSession, sf: str) -> DataFrame:
    return points.subsample(labelled(spark, sf), 20, seed=1, per="label").select("id", "label")


@register("drift")
def drift(spark: SparkSession, sf: str) -> DataFrame:
    e = signal(spark, sf).select("s", (F.col("ch") % 40).cast("double").alias("depth"), F.col("v").alias("amp"))
    return points.drift(e, 2.0, 20, 5, e.agg(F.max("s")).first()[0] + 1)


# window kernels, views, pipelines, curation

def _samples(spark: SparkSession, sf: str) -> int:
    """The length of the recording."""
    return (frames(spark, sf).agg(F.max("s")).first()[0] or 0) + 1


def _dense(spark: SparkSession, sf: str) -> DataFrame:
    return channels.to_long(frames(spark, sf))


@register("iir_bandpass_zero_phase")
def iir_bandpass(spark: SparkSession, sf: str) -> DataFrame:
    return blocks.run(_dense(spark, sf), [blocks.iir(design.iir("butterworth", 3, "bandpass", [50.0, 200.0], 1000.0), zero_phase=True)])


@register("iir_causal_exact")
def iir_causal_exact(spark: SparkSession, sf: str) -> DataFrame:
    return blocks.iir_exact(_dense(spark, sf), design.iir("butterworth", 4, "lowpass", [80.0], 1000.0), 256)


@register("notch")
def notch(spark: SparkSession, sf: str) -> DataFrame:
    return blocks.run(_dense(spark, sf), [blocks.iir(design.notch(60.0, 30.0, 1000.0))])


@register("fir_long")
def fir_long(spark: SparkSession, sf: str) -> DataFrame:
    return blocks.run(_dense(spark, sf), [blocks.fir(design.firwin(101, 0.2), centred=True)])


@register("filter_chain")
def filter_chain(spark: SparkSession, sf: str) -> DataFrame:
    spec = {
        "version": 1,
        "nodes": {"in": {"op": "table", "name": "x"}, "bp": {"op": "iir", "band": "bandpass", "freqs": [50.0, 200.0], "order": 2}, "g": {"op": "gaussian", "sigma": 1.5}, "car": {"op": "car"}, "ev": {"op": "crossings", "level": 0.1}},
        "edges": [["in", "bp"], ["bp", "g"], ["g", "car"], ["car", "ev"]],
        "execution": {"rate": 1000.0},
    }
    return pipeline.run(spark, spec, {"x": _dense(spark, sf)})["ev"]


@register("resample_1_3")
def resample(spark: SparkSession, sf: str) -> DataFrame:
    return blocks.resample(_dense(spark, sf), 1, 3)


@register("decimate")
def decimate(spark: SparkSession, sf: str) -> DataFrame:
    return blocks.decimate(_dense(spark, sf), 4, 1000.0)


@register("fractional_delay")
def fractional_delay(spark: SparkSession, sf: str) -> DataFrame:
    return blocks.run(_dense(spark, sf), [blocks.fractional_delay(0.3)])


@register("window_measure")
def window_measure(spark: SparkSession, sf: str) -> DataFrame:
    return blocks.measure(frames(spark, sf), 128, lambda x: {"rms": float(np.sqrt((x * x).mean())), "top": float(np.abs(x).max())}, "rms double, top double", 1000.0)


@register("envelope_pyramid", f"SELECT ch, CAST(l.level AS INT) AS level, s // (32 * l.w) AS bucket, min(v) AS lo, max(v) AS hi FROM {_SIGNAL}, (SELECT unnest([0, 1, 2]) AS level, unnest([1, 2, 4]) AS w) l GROUP BY ALL")
def envelope_pyramid(spark: SparkSession, sf: str) -> DataFrame:
    return views.pyramid(signal(spark, sf), 32, 3)


@register("view_columns", f"SELECT ch, CAST(((s - 500 + 1) * 40 - 1) // 2000 AS INT) AS col, min(v) AS lo, max(v) AS hi FROM {_SIGNAL} WHERE s >= 500 AND s < 2500 GROUP BY ALL")
def view_columns(spark: SparkSession, sf: str) -> DataFrame:
    return views.columns(signal(spark, sf), 500, 2000, 40)


@register("mean_range", f"SELECT ch, round(avg(hi - lo), 6) AS mean_range FROM (SELECT ch, s // 64 AS b, min(v) AS lo, max(v) AS hi FROM {_SIGNAL} GROUP BY ALL) GROUP BY ch")
def mean_range(spark: SparkSession, sf: str) -> DataFrame:
    return views.mean_range(views.envelope(signal(spark, sf), 64)).withColumn("mean_range", F.round("mean_range", 6))


@register("curation_replay", f"WITH u AS (SELECT max(unit) AS m FROM {_TRAIN}) SELECT CASE WHEN unit IN (1, 2, 3) THEN (SELECT m FROM u) + 1 ELSE unit END AS unit, count(*) AS n FROM {_TRAIN} GROUP BY 1")
def curation_replay(spark: SparkSession, sf: str) -> DataFrame:
    t = train(spark, sf)
    log = curation.Log().push("label", unit=4, name="SU").push("merge", units=[1, 2, 3])
    _, spikes = curation.replay(t.select("unit").distinct().withColumn("label", F.lit("unsorted")), t, log)
    return spikes.groupBy("unit").agg(F.count(F.lit(1)).alias("n"))


@register("polygon_split", "SELECT vec_id AS id FROM embeddings WHERE CAST(embedding[1] AS DOUBLE) BETWEEN -0.1 AND 0.1 AND CAST(embedding[2] AS DOUBLE) BETWEEN -0.1 AND 0.2")
def polygon_split(spark: SparkSession, sf: str) -> DataFrame:
    p = labelled(spark, sf).select("id", F.get("x", 0).alias("a"), F.get("x", 1).alias("b"))
    return curation.in_polygon(p, "a", "b", [(-0.1, -0.1), (0.1, -0.1), (0.1, 0.2), (-0.1, 0.2)]).select("id")


# detectors, waveforms, clusters

def _long(spark: SparkSession, sf: str) -> DataFrame:
    return channels.to_long(frames(spark, sf)).select(F.col("ch").cast("long").alias("ch"), "s", "v")


@register("find_peaks")
def find_peaks(spark: SparkSession, sf: str) -> DataFrame:
    return detection.find_peaks(signal(spark, sf), height=30.0, distance=3, prominence=20.0, width=0.5)


@register("energy_spikes")
def energy_spikes(spark: SparkSession, sf: str) -> DataFrame:
    return detection.energy_spikes(_long(spark, sf), 3.0, 10)


@register("adaptive_spikes")
def adaptive_spikes(spark: SparkSession, sf: str) -> DataFrame:
    return detection.adaptive_spikes(_long(spark, sf), 100, 0.2, 1.5, 10)


@register("matched_spikes")
def matched_spikes(spark: SparkSession, sf: str) -> DataFrame:
    return detection.matched_spikes(_dense(spark, sf), detection.prototype(20, 20000.0), 2.0, 10)


@register(
    "noise_levels",
    f"WITH k AS (SELECT k, CAST(round_even(k * greatest(0, (SELECT max(vec_id) + 1 FROM embeddings) - 100) / 2.0, 0) AS BIGINT) AS a FROM range(3) t(k)), n AS (SELECT ch, k, list_sort(list(abs(v)))[CAST(count(*) // 2 + 1 AS BIGINT)] / {stats.NORMAL_QUARTILE}::DOUBLE AS sigma FROM {_LONG} JOIN k ON s >= a AND s < a + 100 GROUP BY ch, k) SELECT CAST(ch AS BIGINT) AS ch, round(quantile_cont(sigma, 0.5), 6) AS sigma FROM n GROUP BY ch",
)
def noise_levels(spark: SparkSession, sf: str) -> DataFrame:
    return detection.noise_levels(_long(spark, sf), 100, 3, _samples(spark, sf)).select("ch", F.round("sigma", 6).alias("sigma"))


@register("detection_pipeline")
def detection_pipeline(spark: SparkSession, sf: str) -> DataFrame:
    sites = spark.range(64).select("id", F.floor(F.col("id") / 8).cast("double").alias("x"), (F.col("id") % 8).cast("double").alias("y"), F.lit(0.0).alias("z")).withColumnRenamed("id", "ch")
    return detection.detect(_long(spark, sf), sites, _samples(spark, sf), 1000.0, factor=2.0, radius=1.5, before=5, after=10, chunk_s=0.1)["templates"]


def _templates(spark: SparkSession, sf: str) -> DataFrame:
    """Mean vectors of the labels as waveforms of 16 samples on 4 channels."""
    cut = points.centroids(labelled(spark, sf)).select(F.col("label").alias("unit"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("ch"), "c")
    return cut.select("unit", "ch", F.slice("c", F.col("ch") * 16 + 1, F.lit(16)).alias("w"))


@register("template_similarity")
def template_similarity(spark: SparkSession, sf: str) -> DataFrame:
    return waveforms.similarity(_templates(spark, sf), 2)


@register("top_channels", f"WITH p AS (SELECT label AS unit, CAST((i - 1) // 16 AS INT) AS ch, max(m) - min(m) AS ptp FROM {_MEANS} GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY ptp DESC, ch) AS r FROM p) SELECT unit, ch, round(ptp, 6) AS ptp FROM r WHERE r <= 2")
def top_channels(spark: SparkSession, sf: str) -> DataFrame:
    return waveforms.top_channels(_templates(spark, sf), 2).select("unit", "ch", F.round(waveforms.peak_to_peak(F.col("w")), 6).alias("ptp"))


@register("morphology")
def morphology(spark: SparkSession, sf: str) -> DataFrame:
    return _templates(spark, sf).select("unit", "ch", waveforms.morphology(F.col("w")).alias("m")).select("unit", "ch", "m.*")


@register("matching_pursuit")
def matching_pursuit(spark: SparkSession, sf: str) -> DataFrame:
    return waveforms.matching_pursuit(_long(spark, sf), {1: detection.prototype(20, 20000.0).tolist()}, 0, 0.3, 128)


@register("monopolar_triangulation")
def monopolar_triangulation(spark: SparkSession, sf: str) -> DataFrame:
    amp = points.centroids(labelled(spark, sf)).select(F.col("label").alias("unit"), F.posexplode("c").alias("ch", "amp"))
    return waveforms.monopoles(amp, {i: (20.0 * (i // 8), 20.0 * (i % 8)) for i in range(64)})


@register("hdbscan")
def hdbscan(spark: SparkSession, sf: str) -> DataFrame:
    mean, components, _ = points.pca(labelled(spark, sf), 3)
    flat = points.project(labelled(spark, sf), mean, components).select("id", F.col("y").alias("x"))
    return clusters.hdbscan(flat, 5).select("id", "label")


@register("graph_clustering")
def graph_clustering(spark: SparkSession, sf: str) -> DataFrame:
    return clusters.label_propagation(labelled(spark, sf).select("id", "x"), 8).select("id", "label")


@register("fast_ica")
def fast_ica(spark: SparkSession, sf: str) -> DataFrame:
    p = labelled(spark, sf)
    w = clusters.fast_ica(p, 3)
    return points.project(p, np.zeros(w.shape[1]), w).select("id", "y")


@register("crossings_falling", f"WITH x AS (SELECT *, lag(v) OVER {_ORDER} AS p FROM {_SIGNAL}) SELECT ch, s AS onset FROM x WHERE p > 20 AND v <= 20")
def crossings_falling(spark: SparkSession, sf: str) -> DataFrame:
    return events.crossings(signal(spark, sf), 20.0, direction="falling").select("ch", "onset")


@register("as_of_lookup", f"SELECT c.unit, c.s, c.event_id, p.value FROM (SELECT * FROM {_TRAIN} WHERE kind = 'click') c ASOF LEFT JOIN (SELECT user_id AS unit, epoch_us(ts) - {EPOCH} AS s, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY ALL) p ON c.unit = p.unit AND c.s >= p.s")
def as_of_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """The user's last purchase at each click."""
    e = _read(spark, sf, "events").select(F.col("user_id").alias("unit"), (F.unix_micros(F.col("ts").cast("timestamp")) - EPOCH).alias("s"), "event_id", "value", "event_type")
    return trains.as_of(e.where("event_type = 'click'").select("unit", "s", "event_id"), e.where("event_type = 'purchase'").select("unit", "s", "value"), "value")


@register("amplitude_histogram", "SELECT user_id AS unit, CAST(CASE WHEN value = 100 THEN 9 ELSE floor(value / 10) END AS INT) AS bin, count(*) AS n FROM events WHERE value BETWEEN 0 AND 100 GROUP BY ALL")
def amplitude_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return trains.amplitude_histogram(_read(spark, sf, "events").select(F.col("user_id").alias("unit"), F.col("value").alias("amp")), 0.0, 100.0, 10)


@register("remove_small_clusters", "SELECT vec_id AS id, label FROM embeddings WHERE label IN (SELECT label FROM embeddings GROUP BY label HAVING count(*) >= 50)")
def remove_small_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return trains.without_small(labelled(spark, sf).select("id", "label"), 50).select("id", "label")


@register("subset_stride", "SELECT user_id AS unit, event_id AS s FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events) WHERE (r - 1) % 7 = 0")
def subset_stride(spark: SparkSession, sf: str) -> DataFrame:
    return trains.stride(signal(spark, sf).select(F.col("ch").alias("unit"), "s"), 7)


@register(
    "peak_lag",
    "WITH c AS (SELECT CAST(l.lag AS INT) AS lag, sum(CAST(a.embedding[1] AS DOUBLE) * b.embedding[3]) AS r FROM embeddings a, (SELECT unnest(range(-5, 6)) AS lag) l, embeddings b WHERE b.vec_id = a.vec_id + l.lag GROUP BY 1), "
    "n AS (SELECT *, lag(r) OVER (ORDER BY lag) AS a, lead(r) OVER (ORDER BY lag) AS b FROM c) SELECT lag, round(r, 5) AS r, round(coalesce(lag + (a - b) / (2 * (a - 2 * r + b)), lag), 4) AS exact FROM n ORDER BY n.r DESC, lag LIMIT 1",
)
def peak_lag(spark: SparkSession, sf: str) -> DataFrame:
    return stats.peak_lag(stats.cross_correlation(frames(spark, sf), 0, 2, 5)).select("lag", F.round("r", 5).alias("r"), F.round("exact", 4).alias("exact"))
