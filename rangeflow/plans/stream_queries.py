"""Queries over frames: runs, resets, segments, jitter, gap filling, labels, folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import BANDS, band_label
from ..operators import islands as isl
from ..operators.match import as_of_nearest, interval_label
from ..session import read_table
from .views import FR, band_sql, frames

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def bands_of(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f"{a}-{b}",) for a, b in BANDS], "band string")


@query(f"""WITH {FR}, g AS (SELECT *, {band_sql("dist")} AS band, status = 'detected' AS hit FROM fr),
f AS (SELECT bag, band, min(i) FILTER (hit) AS first_i, count(*) AS n, count(*) FILTER (hit) AS hits FROM g WHERE band IS NOT NULL GROUP BY ALL),
b AS (SELECT unnest(['0-20','20-50','50-100','100-150','150-200','200-300']) AS band)
SELECT b.band, coalesce(sum(n), 0)::BIGINT AS objects, coalesce(sum(hits), 0)::BIGINT AS hits, coalesce(round(sum(hits) / nullif(sum(n), 0)::DOUBLE, 6), 0e0) AS recall,
  count(first_i) AS bags_with_hit, coalesce(min(first_i), -1) AS earliest_first, coalesce(max(first_i), -1) AS latest_first
FROM b LEFT JOIN f USING (band) GROUP BY b.band""")
def flagship_banded_first_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall by distance band, empty bands included, and when each recording first has a hit there."""
    g = frames(spark, sf_dir).select("bag", "i", band_label(F.col("dist")).alias("band"), (F.col("status") == "detected").alias("hit")).where("band is not null")
    f = g.groupBy("bag", "band").agg(F.min(F.when(F.col("hit"), F.col("i"))).alias("first_i"), F.count(F.lit(1)).alias("n"), F.count_if("hit").alias("hits"))
    out = f.groupBy("band").agg(
        F.sum("n").alias("objects"), F.sum("hits").alias("hits"), F.round(F.sum("hits") / F.sum("n"), 6).alias("recall"),
        F.count("first_i").alias("bags_with_hit"), F.min("first_i").alias("earliest_first"), F.max("first_i").alias("latest_first"),
    )
    return bands_of(spark).join(out, "band", "left").fillna(0, ["objects", "hits", "bags_with_hit", "recall"]).fillna(-1, ["earliest_first", "latest_first"])


def _run_sql(gap: int, where: str, position: str = "i") -> str:
    return f"""WITH {FR}, x AS (SELECT * FROM fr WHERE {where}),
y AS (SELECT *, CASE WHEN {position} - lag({position}) OVER (PARTITION BY bag ORDER BY {position}) <= {gap} THEN 0 ELSE 1 END AS new FROM x),
z AS (SELECT *, sum(new) OVER (PARTITION BY bag ORDER BY {position}) AS run FROM y)
SELECT bag, run::BIGINT AS run, min({position}) AS first_i, max({position}) AS last_i, count(*) AS n FROM z GROUP BY ALL"""


def _runs(df: DataFrame, gap: int) -> DataFrame:
    out = isl.islands(df, ["bag"], "i", gap)
    return out.groupBy("bag", F.col("run").cast("long").alias("run")).agg(F.min("i").alias("first_i"), F.max("i").alias("last_i"), F.count(F.lit(1)).alias("n"))


@query(_run_sql(2, "status = 'detected'"))
def alarm_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of detected frames; one other frame between is bridged."""
    return _runs(frames(spark, sf_dir).where("status = 'detected'"), 2)


@query(_run_sql(3, "status = 'detected'"))
def episodes_gap3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _runs(frames(spark, sf_dir).where("status = 'detected'"), 3)


@query(_run_sql(1, "k % 2 = 0"))
def int_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of consecutive numbers."""
    return _runs(frames(spark, sf_dir).where("k % 2 = 0"), 1)


@query(f"""WITH {FR}, y AS (SELECT *, CASE WHEN status = lag(status) OVER w THEN 0 ELSE 1 END AS new FROM fr WINDOW w AS (PARTITION BY bag ORDER BY i)),
z AS (SELECT *, sum(new) OVER (PARTITION BY bag ORDER BY i) AS seg FROM y)
SELECT bag, seg::BIGINT AS seg, min(t) AS t_first, max(t) AS t_last, min(dist) AS d_min, max(dist) AS d_max, arg_min(dist, i) AS d_first, arg_max(dist, i) AS d_last
FROM z WHERE status = 'detected' GROUP BY ALL""")
def segments_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detected segments with their times and distances."""
    w = isl.by(["bag"], ["i"])
    new = F.coalesce((F.col("status") != F.lag("status").over(w)).cast("long"), F.lit(1).cast("long"))
    z = frames(spark, sf_dir).withColumn("seg", F.sum(new).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return z.where("status = 'detected'").groupBy("bag", "seg").agg(
        F.min("t").alias("t_first"), F.max("t").alias("t_last"), F.min("dist").alias("d_min"), F.max("dist").alias("d_max"),
        F.min_by("dist", "i").alias("d_first"), F.max_by("dist", "i").alias("d_last"),
    )


_STAMP = "CASE WHEN k % 11 = 0 THEN NULL WHEN k % 13 = 0 THEN t - 90000000000 ELSE t END"


@query(f"""WITH {FR}, s AS (SELECT bag, i, {_STAMP} AS stamp FROM fr),
l AS (SELECT *, last_value(stamp IGNORE NULLS) OVER (PARTITION BY bag ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM s),
r AS (SELECT *, coalesce(stamp - prev < -1000 OR stamp - prev > 43200000000, false) AS reset FROM l)
SELECT bag, i, reset, sum(reset::INT) OVER (PARTITION BY bag ORDER BY i)::BIGINT AS epoch FROM r""")
def reset_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequence resets: time going back, or ahead by over half a day; frames without time don't count."""
    stamp = F.when(F.col("k") % 11 == 0, F.lit(None)).when(F.col("k") % 13 == 0, F.col("t") - 90_000_000_000).otherwise(F.col("t"))
    s = frames(spark, sf_dir).select("bag", "i", stamp.alias("stamp"))
    return isl.reset_epochs(s, ["bag"], ["i"], "stamp", 1000, 43_200_000_000).select("bag", "i", "reset", "epoch")


@query(f"""WITH {FR}, y AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY bag ORDER BY i) <= 21600000000 THEN 0 ELSE 1 END AS new FROM fr),
z AS (SELECT *, sum(new) OVER (PARTITION BY bag ORDER BY i) AS session FROM y)
SELECT bag, session::BIGINT AS session, min(t) AS t_first, max(t) AS t_last, count(*) AS n, round(sum(dist), 4) AS total FROM z GROUP BY ALL""")
def sessions_by_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of frames that follow each other within six hours."""
    w = isl.by(["bag"], ["i"])
    new = F.coalesce((F.col("t") - F.lag("t").over(w) > 21_600_000_000).cast("long"), F.lit(1).cast("long"))
    z = frames(spark, sf_dir).withColumn("session", F.sum(new).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return z.groupBy("bag", "session").agg(F.min("t").alias("t_first"), F.max("t").alias("t_last"), F.count(F.lit(1)).alias("n"), F.round(F.sum("dist"), 4).alias("total"))


INTERVALS = [(0, 40, "clear", 1), (16, 62, "obstacle", 2), (63, 120, "uncertain", 3), (100, 400, "obstacle", 4), (350, 420, "clear", 5), (600, 1500, "clear", 6)]


@query(f"""WITH iv(lo, hi, label, seq) AS (VALUES {", ".join(f"({a * 2}, {b * 2}, '{c}', {s})" for a, b, c, s in INTERVALS)}),
o AS (SELECT o_orderkey, date_diff('day', DATE '1995-01-01', o_orderdate::DATE) AS day FROM orders),
m AS (SELECT o_orderkey, max({{'f': label = 'uncertain', 'seq': seq, 'label': label}}) AS m FROM o JOIN iv ON day BETWEEN lo AND hi GROUP BY ALL)
SELECT coalesce(m.label, 'unlabelled') AS label, count(*) AS n, min(day)::BIGINT AS first_day, max(day)::BIGINT AS last_day FROM o LEFT JOIN m USING (o_orderkey) GROUP BY 1""")
def interval_label_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label of each order's day by overlapping intervals: uncertain wins, else the last one."""
    o = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_id"), F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date")).alias("day"))
    iv = spark.createDataFrame([(a * 2, b * 2, c, s) for a, b, c, s in INTERVALS], "lo int, hi int, label string, seq int")
    got = interval_label(o, "day", iv, 200.0)
    return got.groupBy(F.coalesce("label", F.lit("unlabelled")).alias("label")).agg(
        F.count(F.lit(1)).alias("n"), F.min("day").cast("long").alias("first_day"), F.max("day").cast("long").alias("last_day")
    )


@query(f"""WITH {FR}, a AS (SELECT *, k % 4 <> 0 AS ok, lag(k % 4 <> 0) OVER w AS pok, lag(dist) OVER w AS pd, lag(i) OVER w AS pi FROM fr WINDOW w AS (PARTITION BY bag ORDER BY i)),
p AS (SELECT bag, abs(dist - pd) AS dv FROM a WHERE ok AND pok AND i = pi + 1)
SELECT bag, count(*) AS pairs, count(*) FILTER (dv > 100) AS jumps, round(avg(dv), 4) AS jitter, round(max(dv), 4) AS worst FROM p GROUP BY bag""")
def stability_jumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jumps between consecutive usable frames; an unusable frame between breaks the pair."""
    w = isl.by(["bag"], ["i"])
    ok = F.col("k") % 4 != 0
    a = frames(spark, sf_dir).withColumn("ok", ok).withColumn("pok", F.lag("ok").over(w)).withColumn("pd", F.lag("dist").over(w)).withColumn("pi", F.lag("i").over(w))
    p = a.where("ok and pok and i = pi + 1").select("bag", F.abs(F.col("dist") - F.col("pd")).alias("dv"))
    return p.groupBy("bag").agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("dv") > 100).alias("jumps"), F.round(F.avg("dv"), 4).alias("jitter"), F.round(F.max("dv"), 4).alias("worst"))


@query(f"""WITH {FR} SELECT bag, i, round(quantile_cont(dist, 0.5) OVER (PARTITION BY bag ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS med FROM fr""")
def rolling_median5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return isl.rolling_percentile(frames(spark, sf_dir), ["bag"], ["i"], "dist", 4, 0, "m").select("bag", "i", F.round("m", 6).alias("med"))


@query(f"""WITH {FR} SELECT bag, i, round(quantile_cont(dist, 0.5) OVER (PARTITION BY bag ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS med FROM fr""")
def centred_median5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return isl.rolling_percentile(frames(spark, sf_dir), ["bag"], ["i"], "dist", 2, 2, "m").select("bag", "i", F.round("m", 6).alias("med"))


@query(f"""WITH {FR}, v AS (SELECT bag, i, CASE WHEN k % 3 = 0 THEN dist END AS x FROM fr),
g AS (SELECT *, last_value(x IGNORE NULLS) OVER w AS y0, last_value(CASE WHEN x IS NOT NULL THEN i END IGNORE NULLS) OVER w AS x0,
  first_value(x IGNORE NULLS) OVER u AS y1, first_value(CASE WHEN x IS NOT NULL THEN i END IGNORE NULLS) OVER u AS x1 FROM v
  WINDOW w AS (PARTITION BY bag ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), u AS (PARTITION BY bag ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT bag, i, round(CASE WHEN x IS NOT NULL THEN x WHEN x0 IS NULL THEN y1 WHEN x1 IS NULL THEN y0 ELSE y0 + (y1 - y0) * (i - x0) / (x1 - x0) END, 7) AS filled FROM g""")
def gap_fill_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = frames(spark, sf_dir).select("bag", "i", F.when(F.col("k") % 3 == 0, F.col("dist")).alias("x"))
    return isl.fill_linear(v, ["bag"], "i", "x", "f").select("bag", "i", F.round("f", 7).alias("filled"))


@query(f"""WITH {FR} SELECT bag, i, dist AS h0, coalesce(lag(dist, 1) OVER w, first_value(dist) OVER w) AS h1, coalesce(lag(dist, 2) OVER w, first_value(dist) OVER w) AS h2
FROM fr WINDOW w AS (PARTITION BY bag ORDER BY i)""")
def history_stack3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest three values, padded with the oldest."""
    w = isl.by(["bag"], ["i"])
    oldest = F.first("dist").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return frames(spark, sf_dir).select("bag", "i", F.col("dist").alias("h0"), F.coalesce(F.lag("dist", 1).over(w), oldest).alias("h1"), F.coalesce(F.lag("dist", 2).over(w), oldest).alias("h2"))


@query(f"""WITH {FR} SELECT bag, i, last_value(CASE WHEN dist > 300 THEN dist END IGNORE NULLS) OVER (PARTITION BY bag ORDER BY i ROWS BETWEEN 30 PRECEDING AND CURRENT ROW) AS remembered FROM fr""")
def geometry_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last substantial value of at most 30 frames ago."""
    w = isl.by(["bag"], ["i"]).rowsBetween(-30, 0)
    return frames(spark, sf_dir).select("bag", "i", F.last(F.when(F.col("dist") > 300, F.col("dist")), ignorenulls=True).over(w).alias("remembered"))


@query(f"""WITH {FR}, f AS (SELECT bag, i, CASE WHEN i = 0 THEN lead(k) OVER w ELSE k END >= 20 AS still FROM fr WINDOW w AS (PARTITION BY bag ORDER BY i)),
x AS (SELECT * FROM f WHERE still), y AS (SELECT *, i - row_number() OVER (PARTITION BY bag ORDER BY i) AS g FROM x)
SELECT bag, min(i) AS first_i, max(i) AS last_i, count(*) AS n FROM y GROUP BY bag, g HAVING count(*) >= 5""")
def static_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of at least five still frames; the first frame takes the second's measure."""
    w = isl.by(["bag"], ["i"])
    f = frames(spark, sf_dir).select("bag", "i", (F.when(F.col("i") == 0, F.lead("k").over(w)).otherwise(F.col("k")) >= 20).alias("still"))
    return _runs(f.where("still"), 1).where("n >= 5").drop("run")


@query(f"""WITH {FR}, m AS (SELECT bag, i AS x, dist AS y FROM fr WHERE k % 7 = 0),
c AS (SELECT fr.bag, fr.i, m.x, m.y, row_number() OVER (PARTITION BY fr.bag, fr.i ORDER BY abs(fr.i - m.x), m.x) AS rn FROM fr LEFT JOIN m ON fr.bag = m.bag)
SELECT bag, i, x AS model_position, y AS model FROM c WHERE rn = 1""")
def asof_nearest_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model of the nearest frame that has one, the earlier of two as near."""
    fr = frames(spark, sf_dir)
    models = fr.where("k % 7 = 0").select("bag", "i", F.col("dist").alias("model"))
    return as_of_nearest(fr.select("bag", "i"), models, ["bag"], "i", "model")


@query(f"""WITH {FR}, g AS (SELECT bag, i, CASE WHEN status = 'detected' THEN 2e0 * greatest(0.3e0, least(1e0, dist / 400e0)) WHEN k % 5 = 0 THEN -1.5e0 ELSE -0.8e0 END AS gain FROM fr),
s AS (SELECT bag, list(gain ORDER BY i) AS gains, count(*) AS n FROM g GROUP BY bag)
SELECT bag, n, round(list_reduce(gains, lambda a, x: greatest(-2e0, least(6e0, a + x)), 0e0), 6) AS llr FROM s""")
def llr_clipped_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of a recording's frames in order, clipped to [-2, 6] at each step."""
    gain = F.when(F.col("status") == "detected", 2.0 * F.greatest(F.lit(0.3), F.least(F.lit(1.0), F.col("dist") / 400.0))).when(F.col("k") % 5 == 0, -1.5).otherwise(-0.8)
    s = frames(spark, sf_dir).select("bag", "i", gain.alias("gain"))
    return isl.clipped_sum(s, ["bag"], "i", "gain", -2.0, 6.0, "llr").withColumn("llr", F.round("llr", 6))


@query(f"""WITH {FR} SELECT bag, i, sum((status = 'detected')::INT) OVER (PARTITION BY bag ORDER BY i RANGE BETWEEN 4 PRECEDING AND CURRENT ROW)::BIGINT AS hits FROM fr""")
def hits_in_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return isl.trailing_count(frames(spark, sf_dir), ["bag"], "i", F.col("status") == "detected", 5, "hits").select("bag", "i", "hits")


@query(f"""WITH {FR}, g AS (SELECT bag, t, lead(t) OVER (PARTITION BY bag ORDER BY i) AS nxt FROM fr),
x AS (SELECT bag, t, unnest(range(1, 1 + ((nxt - t - 1) // 43200000000))) AS m FROM g WHERE nxt - t > 43200000000)
SELECT bag, t + m * 43200000000 AS tick, m AS missed FROM x""")
def stale_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tick for every half day that a recording stays silent."""
    half = 43_200_000_000
    g = frames(spark, sf_dir).withColumn("nxt", F.lead("t").over(isl.by(["bag"], ["i"]))).where(F.col("nxt") - F.col("t") > half)
    x = g.select("bag", "t", F.explode(F.sequence(F.lit(1).cast("long"), F.floor((F.col("nxt") - F.col("t") - 1) / half).cast("long"))).alias("missed"))
    return x.select("bag", (F.col("t") + F.col("missed") * half).alias("tick"), "missed")


@query(f"""WITH {FR}, a AS (SELECT *, min(CASE WHEN dist < 480 THEN 1 ELSE 0 END) OVER (PARTITION BY bag ORDER BY i) AS open FROM fr)
SELECT bag, count(*) AS frames_open, max(i) AS last_open, round(max(dist), 4) AS reach FROM a WHERE open = 1 GROUP BY bag""")
def sight_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each recording stays in sight: up to the first failing frame."""
    a = isl.until_first_failure(frames(spark, sf_dir), ["bag"], ["i"], F.col("dist") < 480).where("open")
    return a.groupBy("bag").agg(F.count(F.lit(1)).alias("frames_open"), F.max("i").alias("last_open"), F.round(F.max("dist"), 4).alias("reach"))


@query(f"""WITH {FR}, x AS (SELECT bag, i, k, k % 360 * 1e0 AS a FROM fr),
s AS (SELECT *, coalesce(a * 7 - lag(a * 7) OVER w, 0) AS step FROM x WINDOW w AS (PARTITION BY bag ORDER BY i)),
u AS (SELECT *, step - 360 * floor((step + 180) / 360) AS small FROM s)
SELECT bag, i, round(sum(small) OVER (PARTITION BY bag ORDER BY i), 4) AS unwrapped,
  CASE WHEN (a * 7 + 180) - 360 * floor((a * 7 + 180) / 360) - 180 = -180 THEN 180e0 ELSE (a * 7 + 180) - 360 * floor((a * 7 + 180) / 360) - 180 END AS wrapped FROM u""")
def angles_wrap_unwrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Angles wrapped to (-180, 180], and unwrapped along each recording."""
    from ..functions.columns import wrap_deg

    w = isl.by(["bag"], ["i"])
    x = frames(spark, sf_dir).select("bag", "i", ((F.col("k") % 360) * 7.0).alias("a"))
    s = x.withColumn("step", F.coalesce(F.col("a") - F.lag("a").over(w), F.lit(0.0)))
    small = F.col("step") - 360.0 * F.floor((F.col("step") + 180.0) / 360.0)
    return s.withColumn("small", small).select("bag", "i", F.round(F.sum("small").over(w.rowsBetween(Window.unboundedPreceding, 0)), 4).alias("unwrapped"), wrap_deg(F.col("a")).alias("wrapped"))


@query(f"""WITH {FR}, a AS (SELECT bag, i, t, k, row_number() OVER (PARTITION BY bag, t // 86400000000 ORDER BY t DESC, i DESC) AS rn FROM fr)
SELECT bag, i, t // 86400000000 AS day FROM a WHERE rn = 1""")
def freshest_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Load shedding: of each recording and day only the newest frame is served."""
    w = Window.partitionBy("bag", "day").orderBy(F.desc("t"), F.desc("i"))
    a = frames(spark, sf_dir).withColumn("day", F.floor(F.col("t") / 86_400_000_000).cast("long")).withColumn("rn", F.row_number().over(w))
    return a.where("rn = 1").select("bag", "i", "day")


@query(f"""WITH {FR}, x AS (SELECT bag, i, dist - 250e0 AS step FROM fr) SELECT bag, i, round(sum(step) OVER (PARTITION BY bag ORDER BY i), 4) AS position FROM x""")
def positions_from_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = isl.by(["bag"], ["i"]).rowsBetween(Window.unboundedPreceding, 0)
    return frames(spark, sf_dir).select("bag", "i", F.round(F.sum(F.col("dist") - 250.0).over(w), 4).alias("position"))


@query(f"""WITH {FR}, x AS (SELECT bag, i, max(CASE WHEN k % 10 = 0 THEN k // 10 * 128 ELSE 0 END) OVER (PARTITION BY bag ORDER BY i) AS offs, k FROM fr)
SELECT bag, i, offs, k % 10 = 0 AND k // 10 * 128 < offs AS violated FROM x""")
def monotone_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offsets that may only grow: smaller ones inherit the last, and are counted as violations."""
    given = F.when(F.col("k") % 10 == 0, F.floor(F.col("k") / 10).cast("long") * 128).otherwise(F.lit(0).cast("long"))
    w = isl.by(["bag"], ["i"]).rowsBetween(Window.unboundedPreceding, 0)
    x = frames(spark, sf_dir).withColumn("g", given).withColumn("offs", F.max("g").over(w))
    return x.select("bag", "i", "offs", ((F.col("k") % 10 == 0) & (F.col("g") < F.col("offs"))).alias("violated"))


@query(f"""WITH {FR}, x AS (SELECT bag, i, status, row_number() OVER (PARTITION BY bag ORDER BY i) AS p FROM fr WHERE status = 'detected'),
y AS (SELECT bag, i, i - p AS g FROM x), z AS (SELECT bag, g, min(i) AS a, max(i) AS b FROM y GROUP BY ALL)
SELECT bag, string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a::VARCHAR || '-' || b::VARCHAR END, ', ' ORDER BY a) AS ranges FROM z GROUP BY bag""")
def frame_range_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detected frames as text such as ``3-5, 9``."""
    z = _runs(frames(spark, sf_dir).where("status = 'detected'"), 1)
    a, b = F.col("first_i").cast("string"), F.col("last_i").cast("string")
    text = F.when(F.col("first_i") == F.col("last_i"), a).otherwise(F.concat(a, F.lit("-"), b))
    s = z.groupBy("bag").agg(F.array_sort(F.collect_list(F.struct("first_i", text.alias("x")))).alias("s"))
    return s.select("bag", F.array_join(F.transform("s", lambda v: v["x"]), ", ").alias("ranges"))
