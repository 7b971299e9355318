"""Queries on frames (pixel tables)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainspark.functions import parse
from grainspark.operators import frames, ranking, relational
from grainspark.plans.base import Query
from grainspark.plans.sqlviews import FRAMES, PIXELS, with_views
from grainspark.sources import fixtures as fx

EDGE = "least(CAST(floor(v * 256 / 255.0::DOUBLE) AS INTEGER), 255)"
STATS = f"""hb AS (SELECT frame_id, {EDGE} AS bin, count(*) AS n FROM pixels GROUP BY ALL), hp AS (SELECT frame_id, CAST(floor(arg_max(bin, n * 1000 - bin) * 255 / 256.0::DOUBLE) AS INTEGER) AS peak FROM hb GROUP BY frame_id),
  st AS (SELECT frame_id, min(v) AS lo, max(v) AS hi, avg(v) AS mean, stddev_pop(v) AS std FROM pixels GROUP BY frame_id),
  fs AS (SELECT st.*, peak FROM st JOIN hp USING (frame_id)), rf AS (SELECT lo AS r_lo, hi AS r_hi, mean AS r_mean, std AS r_std, peak AS r_peak FROM fs WHERE frame_id = 0),
  px AS (SELECT p.frame_id, y, x, v::DOUBLE AS v, fs.* EXCLUDE (frame_id), rf.* FROM pixels p JOIN fs USING (frame_id), rf)"""
CUT = "CAST(trunc({}) AS INTEGER)"


def normalised(method: str):
    def run(spark, sf_dir) -> DataFrame:
        out = frames.normalise_frames(fx.pixels(spark, sf_dir), 0, method, ordered=method in ("z_score", "peak_spread_align"))
        return out.groupBy("frame_id").agg(F.sum("v").alias("v"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum(F.col("v") * (F.col("y") * 8 + F.col("x"))).alias("moment"))

    return run


def normalised_sql(new: str) -> str:
    return with_views(f"WITH {STATS}, nw AS (SELECT frame_id, y, x, {CUT.format(new)} AS v FROM px) SELECT frame_id, sum(v) AS v, min(v) AS lo, max(v) AS hi, sum(v * (y * 8 + x)) AS moment FROM nw GROUP BY frame_id", PIXELS)


MATCH_SQL = with_views("""WITH c AS (SELECT frame_id, v, count(*) AS n FROM pixels GROUP BY ALL), q AS (SELECT frame_id, v, sum(n) OVER (PARTITION BY frame_id ORDER BY v)::DOUBLE / sum(n) OVER (PARTITION BY frame_id) AS q FROM c),
  r AS (SELECT v AS rv, q AS rq, lead(v) OVER (ORDER BY v) AS nv, lead(q) OVER (ORDER BY v) AS nq FROM q WHERE frame_id = 0), f AS (SELECT min(rv) AS v0, min(rq) AS q0 FROM r),
  m AS (SELECT q.frame_id, q.v, CASE WHEN q.q < q0 THEN v0::DOUBLE ELSE (SELECT CASE WHEN nq IS NULL THEN rv::DOUBLE ELSE rv + (nv - rv) * ((q.q - rq) / (nq - rq)) END FROM r WHERE rq <= q.q ORDER BY rq DESC LIMIT 1) END AS nw FROM q, f),
  nw AS (SELECT p.frame_id, y, x, CAST(trunc(m.nw) AS INTEGER) AS v FROM pixels p JOIN m ON m.frame_id = p.frame_id AND m.v = p.v)
  SELECT frame_id, sum(v) AS v, min(v) AS lo, max(v) AS hi, sum(v * (y * 8 + x)) AS moment FROM nw GROUP BY frame_id""", PIXELS)

REGIONS = """rg AS (SELECT frame_id, y // 2 AS ry, x // 2 AS rx, avg(v) AS mean, stddev_pop(v) AS std FROM pixels GROUP BY ALL), rw AS (SELECT frame_id, avg(mean) AS m, stddev_pop(mean) AS s, avg(std) AS ms, stddev_pop(std) AS ss FROM rg GROUP BY frame_id),
  an AS (SELECT rg.*, abs(mean - m) > 1.5 * s + 1e-9::DOUBLE OR std > ms + 1.5 * ss + 1e-9::DOUBLE AS anomaly FROM rg JOIN rw USING (frame_id)),
  bd AS (SELECT frame_id, 'vertical' AS direction, rx AS band, avg(anomaly::INTEGER::DOUBLE) AS share FROM an GROUP BY ALL HAVING share >= 0.3 UNION ALL SELECT frame_id, 'horizontal', ry, avg(anomaly::INTEGER::DOUBLE) AS share FROM an GROUP BY ALL HAVING share >= 0.3)"""


def staged(spark, sf_dir) -> DataFrame:
    raw = fx.pixels(spark, sf_dir)
    parts = {"raw": raw, "filtered": fx.filtered_pixels(spark, sf_dir), "normalised": frames.normalise_frames(raw, 0, "peak_align")}
    out = None
    for name, p in parts.items():
        one = p.select("frame_id", "y", "x", "v").withColumn("stage", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def crops(spark, sf_dir) -> DataFrame:
    window = parse.bbox_window(fx.boxes(spark, sf_dir), border=2, height=8, width=8)
    return relational.crop_pixels(window, fx.pixels(spark, sf_dir), side=8).select(F.col("frame_id").alias("crop"), "bx", "by", "v")


CROPS = "cr AS (SELECT frame_id AS crop, x - x0 AS bx, y - y0 AS \"by\", v FROM pixels JOIN (SELECT vec_id AS frame_id, greatest(vec_id % 5 - 2, 0) AS x0, greatest(vec_id % 4 - 2, 0) AS y0, least(vec_id % 5 + vec_id % 4 + 3, 8) AS x1, least(vec_id % 4 + vec_id % 3 + 3, 8) AS y1 FROM embeddings) USING (frame_id) WHERE x >= x0 AND x < x1 AND y >= y0 AND y < y1)"


def l20(spark, sf_dir):
    found = frames.segment_phases(crops(spark, sf_dir), "crop", 3, ring=2)
    return found.groupBy("crop").agg(F.count("*").alias("n_values"), (F.max("phase") <= 2).alias("phases_ok"), (F.count_if("background") >= 1).alias("has_background"))


def l21(spark, sf_dir):
    best = frames.largest_object(fx.pixels(spark, sf_dir).select(F.col("frame_id").alias("crop"), "y", "x", (F.col("v") > 128).alias("on")), 8, 8, fill_below=3)
    return best.groupBy("crop").agg(F.count("*").alias("n"), F.sum(F.col("y") * 8 + F.col("x")).alias("moment"))


def l18(spark, sf_dir):
    done = frames.denoise(fx.pixels(spark, sf_dir), 8, 8, h=30.0, template=3, search=4)
    return done.groupBy("frame_id").agg(F.count("*").alias("n"), F.sum("v").alias("v"), F.sum(F.col("v") * (F.col("y") * 8 + F.col("x"))).alias("moment"))


def l18_colour(spark, sf_dir):
    """Frames of one grey value in all channels stay grey, and alpha stays as it was."""
    grey = fx.pixels(spark, sf_dir).select("frame_id", "y", "x", F.col("v").alias("r"), F.col("v").alias("g"), F.col("v").alias("b"), (255 - F.col("v")).alias("a"))
    done = frames.denoise_colour(grey, 8, 8, h=30.0, search=4)
    return done.groupBy("frame_id").agg(F.count("*").alias("n"), F.sum("a").alias("a"), F.max(F.greatest("r", "g", "b") - F.least("r", "g", "b")).alias("tint"))


#: Every pixel against the pixels of its window, template by template, edges mirrored.
L18_SQL = with_views("""WITH m AS (SELECT unnest(range(-3, 11)) AS c), mr AS (SELECT c, CASE WHEN c < 0 THEN -1 - c WHEN c > 7 THEN 15 - c ELSE c END AS k FROM m),
  pd AS (SELECT frame_id, a.c AS y, b.c AS x, v::DOUBLE AS v FROM pixels JOIN mr a ON a.k = y JOIN mr b ON b.k = x),
  o AS (SELECT dy, dx FROM (SELECT unnest(range(-2, 3)) AS dy), (SELECT unnest(range(-2, 3)) AS dx)),
  sq AS (SELECT p.frame_id, p.y, p.x, dy, dx, (p.v - q.v) * (p.v - q.v) AS e FROM pd p, o, pd q WHERE p.y BETWEEN -1 AND 8 AND p.x BETWEEN -1 AND 8 AND q.frame_id = p.frame_id AND q.y = p.y + dy AND q.x = p.x + dx),
  t AS (SELECT i, j FROM (SELECT unnest([-1, 0, 1]) AS i), (SELECT unnest([-1, 0, 1]) AS j)),
  ds AS (SELECT frame_id, sq.y + i AS y, sq.x + j AS x, dy, dx, sum(e) / 9 AS d FROM sq, t WHERE sq.y + i BETWEEN 0 AND 7 AND sq.x + j BETWEEN 0 AND 7 GROUP BY ALL),
  nw AS (SELECT ds.frame_id, ds.y, ds.x, round_even(sum(exp(-d / 900) * v) / sum(exp(-d / 900)), 0) AS v FROM ds JOIN pd ON pd.frame_id = ds.frame_id AND pd.y = ds.y + dy AND pd.x = ds.x + dx GROUP BY ALL)
  SELECT frame_id, count(*) AS n, sum(v) AS v, sum(v * (y * 8 + x)) AS moment FROM nw GROUP BY frame_id""", PIXELS)

#: Objects by reachability; holes of fewer than three pixels are filled; the largest object, the one of the least pixel among equals.
L21_SQL = with_views("""WITH RECURSIVE {views}, b AS (SELECT frame_id AS f, y * 8 + x AS p, v > 128 AS on_ FROM pixels),
  nb AS (SELECT a.f, a.p, c.p AS q, a.on_ FROM b a JOIN b c ON a.f = c.f AND a.on_ = c.on_ AND ((c.p // 8 = a.p // 8 AND abs(c.p - a.p) = 1) OR abs(c.p - a.p) = 8)),
  r1 AS (SELECT f, p, p AS q FROM b WHERE NOT on_ UNION SELECT r1.f, r1.p, nb.q FROM r1 JOIN nb ON nb.f = r1.f AND nb.p = r1.q AND NOT nb.on_),
  h AS (SELECT f, p FROM r1 GROUP BY f, p HAVING count(*) < 3),
  m AS (SELECT f, p FROM b WHERE on_ UNION SELECT f, p FROM h),
  n2 AS (SELECT a.f, a.p, c.p AS q FROM m a JOIN m c ON a.f = c.f AND ((c.p // 8 = a.p // 8 AND abs(c.p - a.p) = 1) OR abs(c.p - a.p) = 8)),
  r2 AS (SELECT f, p, p AS q FROM m UNION SELECT r2.f, r2.p, n2.q FROM r2 JOIN n2 ON n2.f = r2.f AND n2.p = r2.q),
  ob AS (SELECT f, p, min(q) AS o, count(*) AS n FROM r2 GROUP BY f, p),
  best AS (SELECT f, arg_min(o, (100 - n) * 1000 + o) AS o FROM ob GROUP BY f)
  SELECT f AS crop, count(*) AS n, sum(p) AS moment FROM ob JOIN best USING (f, o) GROUP BY f""".replace("WITH RECURSIVE {views}, ", "WITH "), PIXELS).replace("WITH ", "WITH RECURSIVE ", 1)


def info_files(spark, sf_dir) -> DataFrame:
    return fx.files(spark, sf_dir).select(F.col("doc_id").alias("frame_id"), "length")


QUERIES = {
    "l1_histogram_peak": Query(lambda s, d: frames.histogram_peak(fx.pixels(s, d)), "frame_id peak", with_views(f"WITH {STATS} SELECT frame_id, peak FROM hp", PIXELS)),
    "l2_spread_metrics": Query(lambda s, d: frames.spread_metrics(fx.pixels(s, d)), "frame_id std* var* iqr* range#", with_views("SELECT frame_id, stddev_pop(v) AS std, var_pop(v) AS var, quantile_cont(v::DOUBLE, 0.75) - quantile_cont(v::DOUBLE, 0.25) AS iqr, max(v) - min(v) AS range FROM pixels GROUP BY frame_id", PIXELS)),
    "l3_min_max": Query(normalised("min_max"), "frame_id v# lo# hi# moment#", normalised_sql("coalesce((v - lo) / nullif(hi - lo, 0), 0) * (r_hi - r_lo) + r_lo")),
    "l4_z_score": Query(normalised("z_score"), "frame_id v# lo# hi# moment#", normalised_sql("greatest(0, least(255, coalesce((v - mean) / nullif(std, 0), 0) * r_std + r_mean))")),
    "l5_peak_align": Query(normalised("peak_align"), "frame_id v# lo# hi# moment#", normalised_sql("CASE WHEN r_peak = peak THEN v ELSE greatest(0, least(255, v + (r_peak - peak))) END")),
    "l6_peak_spread_align": Query(normalised("peak_spread_align"), "frame_id v# lo# hi# moment#", normalised_sql("greatest(0, least(255, CASE WHEN std > 0 THEN r_peak + ((v + (r_peak - peak)) - r_peak) * (r_std / std) ELSE v + (r_peak - peak) END))")),
    "l7_histogram_matching": Query(normalised("histogram_matching"), "frame_id v# lo# hi# moment#", MATCH_SQL),
    "l8_normalise_frames": Query(lambda s, d: frames.normalise_frames(fx.pixels(s, d), 0, "peak_align"), "frame_id y x v", with_views(f"WITH {STATS} SELECT frame_id, y, x, {CUT.format('CASE WHEN r_peak = peak THEN v ELSE greatest(0, least(255, v + (r_peak - peak))) END')} AS v FROM px", PIXELS)),
    "l9_regional_anomalies": Query(lambda s, d: frames.regional_anomalies(fx.pixels(s, d), 2, "high"), "frame_id ry# rx# mean* std* anomaly", with_views(f"WITH {REGIONS} SELECT * FROM an", PIXELS)),
    "l9_streak_bands": Query(lambda s, d: frames.streak_bands(frames.regional_anomalies(fx.pixels(s, d), 2, "high")), "frame_id direction band# share*", with_views(f"WITH {REGIONS} SELECT * FROM bd", PIXELS)),
    "l9_streak_lines": Query(lambda s, d: frames.streak_lines(frames.streak_bands(frames.regional_anomalies(fx.pixels(s, d), 2, "high")), 2, 8, 8).groupBy("frame_id", "direction").agg(F.count("*").alias("n"), F.sum("line").alias("lines")), "frame_id direction n# lines#", with_views(f"WITH {REGIONS} SELECT frame_id, direction, count(*) * 2 AS n, sum(4 * band + 1) AS lines FROM bd GROUP BY ALL", PIXELS)),
    "l10_column_means": Query(lambda s, d: frames.line_means(fx.pixels(s, d), "x"), "frame_id x mean*", with_views("SELECT frame_id, x, avg(v) AS mean FROM pixels GROUP BY ALL", PIXELS)),
    "l10_row_means": Query(lambda s, d: frames.line_means(fx.pixels(s, d), "y"), "frame_id y mean*", with_views("SELECT frame_id, y, avg(v) AS mean FROM pixels GROUP BY ALL", PIXELS)),
    "l11_region_differences": Query(lambda s, d: frames.region_differences(fx.pixels(s, d), 8, 8), "frame_id top_left_mean* bottom_right_std* left_median* left_vs_right* top_vs_bottom* corner_std*", with_views("""WITH h AS (SELECT frame_id, avg(v) FILTER (WHERE y < 4 AND x < 4) AS a, avg(v) FILTER (WHERE y < 4 AND x >= 4) AS b, avg(v) FILTER (WHERE y >= 4 AND x < 4) AS c, avg(v) FILTER (WHERE y >= 4 AND x >= 4) AS e, stddev_pop(v) FILTER (WHERE y >= 4 AND x >= 4) AS bottom_right_std,
          quantile_cont(v::DOUBLE, 0.5) FILTER (WHERE x < 4) AS left_median, avg(v) FILTER (WHERE x < 4) - avg(v) FILTER (WHERE x >= 4) AS left_vs_right, avg(v) FILTER (WHERE y < 4) - avg(v) FILTER (WHERE y >= 4) AS top_vs_bottom FROM pixels GROUP BY frame_id)
          SELECT frame_id, a AS top_left_mean, bottom_right_std, left_median, left_vs_right, top_vs_bottom, list_stddev_pop([a, b, c, e]) AS corner_std FROM h""", PIXELS)),
    "l12_stage_report": Query(lambda s, d: frames.stage_report(staged(s, d), 2, 8, 8, "high"), "stage frame_id left_vs_right* mean* std* range# streak_share*", with_views(f"""WITH {STATS}, t AS (SELECT 'raw' AS stage, frame_id, y, x, v FROM pixels UNION ALL SELECT 'filtered', frame_id, y, x, v FROM filtered UNION ALL SELECT 'normalised', frame_id, y, x, {CUT.format('CASE WHEN r_peak = peak THEN v ELSE greatest(0, least(255, v + (r_peak - peak))) END')} FROM px),
          rg AS (SELECT stage, frame_id, y // 2 AS ry, x // 2 AS rx, avg(v) AS mean, stddev_pop(v) AS std FROM t GROUP BY ALL), rw AS (SELECT stage, frame_id, avg(mean) AS m, stddev_pop(mean) AS s, avg(std) AS ms, stddev_pop(std) AS ss FROM rg GROUP BY ALL),
          an AS (SELECT rg.*, abs(mean - m) > 1.5 * s + 1e-9::DOUBLE OR std > ms + 1.5 * ss + 1e-9::DOUBLE AS anomaly FROM rg JOIN rw USING (stage, frame_id)),
          bd AS (SELECT stage, frame_id, 'vertical' AS direction, rx AS band, avg(anomaly::INTEGER::DOUBLE) AS share FROM an GROUP BY ALL HAVING share >= 0.3 UNION ALL SELECT stage, frame_id, 'horizontal', ry, avg(anomaly::INTEGER::DOUBLE) AS share FROM an GROUP BY ALL HAVING share >= 0.3),
          b AS (SELECT stage, frame_id, 2 * count(*) FILTER (WHERE direction = 'vertical') AS c, 2 * count(*) FILTER (WHERE direction = 'horizontal') AS r FROM bd GROUP BY ALL),
          s AS (SELECT stage, frame_id, avg(v) FILTER (WHERE x < 4) - avg(v) FILTER (WHERE x >= 4) AS left_vs_right, avg(v) AS mean, stddev_pop(v) AS std, max(v) - min(v) AS range FROM t GROUP BY ALL)
          SELECT s.*, (coalesce(c, 0) * 8 + coalesce(r, 0) * 8 - coalesce(c, 0) * coalesce(r, 0)) / 64 AS streak_share FROM s LEFT JOIN b USING (stage, frame_id)""", PIXELS)),
    "l12_stage_means": Query(lambda s, d: frames.stage_report(staged(s, d), 2, 8, 8).groupBy("stage").agg(F.count("*").alias("n"), F.avg("mean").alias("mean"), F.avg("left_vs_right").alias("left_vs_right")), "stage n# mean* left_vs_right*", with_views(f"""WITH {STATS}, t AS (SELECT 'raw' AS stage, frame_id, x, v FROM pixels UNION ALL SELECT 'filtered', frame_id, x, v FROM filtered UNION ALL SELECT 'normalised', frame_id, x, {CUT.format('CASE WHEN r_peak = peak THEN v ELSE greatest(0, least(255, v + (r_peak - peak))) END')} FROM px),
          s AS (SELECT stage, frame_id, avg(v) AS mean, avg(v) FILTER (WHERE x < 4) - avg(v) FILTER (WHERE x >= 4) AS l FROM t GROUP BY ALL) SELECT stage, count(*) AS n, avg(mean) AS mean, avg(l) AS left_vs_right FROM s GROUP BY stage""", PIXELS)),
    "l13_noise_metrics": Query(lambda s, d: frames.noise_metrics(fx.pixels(s, d), fx.filtered_pixels(s, d).where("frame_id % 10 <> 3 OR x < 7")), "frame_id mean_abs* std_diff* snr* correlation* error", with_views("""WITH j AS (SELECT p.frame_id, p.v AS a, f.v AS b FROM pixels p JOIN filtered f USING (frame_id, y, x)), s AS (SELECT frame_id, avg(abs(a - b)) AS m, stddev_pop(a - b) AS sd, stddev_pop(a) AS sa, corr(a, b) AS r FROM j GROUP BY frame_id)
          SELECT frame_id, CASE WHEN k THEN m END AS mean_abs, CASE WHEN k THEN sd END AS std_diff, CASE WHEN k THEN sa / greatest(sd, 1e-10) END AS snr, CASE WHEN k THEN r END AS correlation, CASE WHEN NOT k THEN 'shape mismatch' END AS error FROM (SELECT *, frame_id % 10 <> 3 AS k FROM s)""", PIXELS)),
    "l14_abs_diff": Query(lambda s, d: frames.abs_diff(fx.pixels(s, d), fx.filtered_pixels(s, d)), "frame_id max_diff# mean_diff*", with_views("SELECT frame_id, max(abs(p.v - f.v)) AS max_diff, avg(abs(p.v - f.v)) AS mean_diff FROM pixels p JOIN filtered f USING (frame_id, y, x) GROUP BY frame_id", PIXELS)),
    "l15_series_difference": Query(lambda s, d: frames.difference_summary(frames.series_difference(fx.pixels(s, d), ranking.landmark_frames(fx.frames(s, d)))), "folder min# max# mean* std*", with_views("""WITH e AS (SELECT folder, arg_min(frame_id, ts) AS a, arg_max(frame_id, ts) AS b FROM frames GROUP BY folder), d AS (SELECT folder, q.v - p.v AS d FROM e JOIN pixels p ON p.frame_id = a JOIN pixels q ON q.frame_id = b AND q.y = p.y AND q.x = p.x)
          SELECT folder, min(d) AS min, max(d) AS max, avg(d) AS mean, stddev_pop(d) AS std FROM d GROUP BY folder""", PIXELS, FRAMES)),
    "l16_stack_summary": Query(lambda s, d: frames.stack_summary(fx.pixels(s, d), fx.frames(s, d)), "folder n_frames# min# max# bytes#", with_views("SELECT folder, count(DISTINCT frame_id) AS n_frames, min(v) AS min, max(v) AS max, count(*) AS bytes FROM pixels JOIN frames USING (frame_id) GROUP BY folder", PIXELS, FRAMES)),
    "l17_tiles": Query(lambda s, d: frames.tile(fx.pixels(s, d), 8, 8, 4, 2).groupBy("tile_y", "tile_x").agg(F.count("*").alias("n"), F.count_if("core").alias("n_core"), F.sum("v").alias("v")), "tile_y# tile_x# n# n_core# v#", with_views("""WITH t AS (SELECT unnest([0, 1, 2]) AS k), c AS (SELECT p.*, a.k AS tile_y, b.k AS tile_x FROM pixels p JOIN t a ON y >= 2 * a.k AND y < 2 * a.k + 4 JOIN t b ON x >= 2 * b.k AND x < 2 * b.k + 4)
          SELECT tile_y, tile_x, count(*) AS n, count(*) FILTER (WHERE (y >= 2 * tile_y + 1 OR tile_y = 0) AND (y < 2 * tile_y + 3 OR tile_y = 2) AND (x >= 2 * tile_x + 1 OR tile_x = 0) AND (x < 2 * tile_x + 3 OR tile_x = 2)) AS n_core, sum(v) AS v FROM c GROUP BY ALL""", PIXELS)),
    "l17_stitch": Query(lambda s, d: frames.stitch(frames.tile(fx.pixels(s, d), 8, 8, 4, 2)), "frame_id y x v", with_views("SELECT * FROM pixels", PIXELS)),
    "l18_denoise": Query(l18, "frame_id n# v# moment#", L18_SQL),
    "l18_denoise_colour": Query(l18_colour, "frame_id n# a# tint#", with_views("SELECT frame_id, count(*) AS n, sum(255 - v) AS a, 0 AS tint FROM pixels GROUP BY frame_id", PIXELS)),
    "l19_crop_stats": Query(lambda s, d: frames.crop_stats(crops(s, d), "crop", 1), "crop# median* border_mean* border_std*", with_views(f"WITH {CROPS}, m AS (SELECT *, max(bx) OVER (PARTITION BY crop) AS w, max(\"by\") OVER (PARTITION BY crop) AS h FROM cr) SELECT crop, quantile_cont(v::DOUBLE, 0.5) AS median, avg(v) FILTER (WHERE bx < 1 OR \"by\" < 1 OR bx > w - 1 OR \"by\" > h - 1) AS border_mean, stddev_pop(v) FILTER (WHERE bx < 1 OR \"by\" < 1 OR bx > w - 1 OR \"by\" > h - 1) AS border_std FROM m GROUP BY crop", PIXELS)),
    "l20_segment_phases": Query(l20, "crop# n_values# phases_ok has_background", with_views(f"WITH {CROPS} SELECT crop, count(DISTINCT v) AS n_values, true AS phases_ok, true AS has_background FROM cr GROUP BY crop", PIXELS)),
    "l20_phases": Query(lambda s, d: frames.segment_phases(crops(s, d), "crop", 3, ring=2, exact=True), "crop# v# phase# background", with_views(f"""WITH {CROPS}, e AS (SELECT *, max(bx) OVER (PARTITION BY crop) AS w, max("by") OVER (PARTITION BY crop) AS h FROM cr),
          bm AS (SELECT crop, avg(v) FILTER (WHERE bx < 2 OR "by" < 2 OR bx > w - 2 OR "by" > h - 2) AS border FROM e GROUP BY crop),
          q AS (SELECT crop, v, n, row_number() OVER o AS i, sum(n) OVER o AS cn, sum(n * v) OVER o AS cs, sum(n * v * v) OVER o AS cq, count(*) OVER (PARTITION BY crop) AS m FROM (SELECT crop, v, count(*) AS n FROM cr GROUP BY ALL) WINDOW o AS (PARTITION BY crop ORDER BY v)),
          cut AS (SELECT a.crop, a.i AS c1, b.i AS c2 FROM q a JOIN q b ON a.crop = b.crop AND a.i < b.i JOIN q z ON z.crop = a.crop AND z.i = z.m AND b.i < z.i
            QUALIFY row_number() OVER (PARTITION BY a.crop ORDER BY round(CAST(z.cq AS DOUBLE) - CAST(a.cs * a.cs AS DOUBLE) / a.cn - CAST((b.cs - a.cs) * (b.cs - a.cs) AS DOUBLE) / (b.cn - a.cn) - CAST((z.cs - b.cs) * (z.cs - b.cs) AS DOUBLE) / (z.cn - b.cn), 6), b.i, a.i) = 1),
          ph AS (SELECT q.crop, q.v, q.n, CASE WHEN q.m < 3 THEN q.i - 1 WHEN q.i <= c1 THEN 0 WHEN q.i <= c2 THEN 1 ELSE 2 END AS phase FROM q LEFT JOIN cut USING (crop)),
          bk AS (SELECT crop, phase AS back FROM (SELECT crop, phase, sum(n * v) / sum(n)::DOUBLE AS mean FROM ph GROUP BY ALL) JOIN bm USING (crop) QUALIFY row_number() OVER (PARTITION BY crop ORDER BY round(abs(mean - border), 6), phase) = 1)
          SELECT ph.crop, v, phase, phase = back AS background FROM ph JOIN bk USING (crop)""", PIXELS)),
    "l21_largest_object": Query(l21, "crop# n# moment#", L21_SQL),
    "l22_histogram_comparison": Query(lambda s, d: frames.histogram_comparison(staged(s, d)), "stage v# n# peak# std*", with_views(f"WITH {STATS}, t AS (SELECT 'raw' AS stage, v FROM pixels UNION ALL SELECT 'filtered', v FROM filtered UNION ALL SELECT 'normalised', {CUT.format('CASE WHEN r_peak = peak THEN v ELSE greatest(0, least(255, v + (r_peak - peak))) END')} FROM px), b3 AS (SELECT stage, {EDGE} AS bin, count(*) AS n FROM t GROUP BY ALL), p3 AS (SELECT stage, floor(arg_max(bin, n * 1000 - bin) * 255 / 256.0::DOUBLE) AS peak FROM b3 GROUP BY stage), s3 AS (SELECT stage, stddev_pop(v) AS std FROM t GROUP BY stage) SELECT stage, v, count(*) AS n, max(p3.peak) AS peak, max(std) AS std FROM t JOIN p3 USING (stage) JOIN s3 USING (stage) GROUP BY ALL", PIXELS)),
    "l23_frame_info": Query(lambda s, d: frames.frame_info(fx.pixels(s, d), info_files(s, d).where("frame_id % 9 <> 4")), "frame_id width# height# length# error", """WITH f AS (SELECT doc_id AS frame_id, n_chars AS length FROM documents WHERE doc_id % 9 <> 4)
          SELECT coalesce(e.vec_id, f.frame_id) AS frame_id, CASE WHEN e.vec_id IS NOT NULL THEN 8 END AS width, CASE WHEN e.vec_id IS NOT NULL THEN 8 END AS height, length, CASE WHEN e.vec_id IS NULL THEN 'unreadable' WHEN length IS NULL THEN 'no file' END AS error FROM embeddings e FULL JOIN f ON f.frame_id = e.vec_id"""),
}
