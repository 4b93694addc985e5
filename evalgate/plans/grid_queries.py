"""Grid, patch, sampling and mining queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalgate import views
from evalgate.functions.columns import fixed_text, hash_order
from evalgate.operators import grid as C
from evalgate.operators import mining as J
from evalgate.operators import rules as B
from evalgate.operators import sampling as D
from evalgate.plans.fold_queries import SMALL_CAPS, _FS, compare_caps_ctes, fold_seed_caps
from evalgate.plans.metric_queries import rnd, sweep_ctes
from evalgate.plans.quality_queries import METRIC_VERDICT_CTE, run_verdicts
from evalgate.plans.registry import query, rounded
from evalgate.plans.rule_queries import patches
from evalgate.sources.catalogs import catalog_from_html, dataset_summary, merge_catalogs

SEG = ["segment"]


def big_pixels(spark, sf):
    return views.bigmap(spark, sf).select("segment", F.lit(0).alias("c"), "y", "x", F.col("prob").alias("v"))


def px(spark, sf):
    return views.px(spark, sf).select("vec_id", "segment", F.lit(0).alias("c"), "y", "x", "v")


# ---------------------------------------------------------------- volumes and catalogues


@query("a4_layer_selection", """
WITH r AS (SELECT vec_id, label AS segment_id, embedding AS d, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1)*4 AS z0 FROM embeddings),
dp AS (SELECT segment_id, max(z0)+4 AS depth FROM r GROUP BY 1),
w AS (SELECT segment_id, c, least(greatest(depth//2 + o, 0), depth-1) AS z FROM dp, (SELECT * FROM (VALUES (0, -5), (1, 0), (2, 9999)) v(c, o))),
h AS (SELECT r.segment_id, c, z, z0, unnest(d) AS v, unnest(range(64)) AS k FROM r JOIN w ON r.segment_id = w.segment_id AND z >= z0 AND z < z0+4)
SELECT segment_id, c, z, (k%16)//4 AS y, k%4 AS x, v FROM h WHERE k//16 = z - z0""")
def a4(spark, sf):
    e = views.table(spark, sf, "embeddings")
    from pyspark.sql import Window as W

    rank = F.row_number().over(W.partitionBy("label").orderBy("vec_id")) - 1
    chunks = e.select(F.col("label").alias("segment_id"), F.lit(0).alias("level"), (rank * 4).alias("z0"), F.lit(0).alias("y0"), F.lit(0).alias("x0"),
                      F.lit(4).alias("dz"), F.lit(4).alias("dy"), F.lit(4).alias("dx"), F.col("embedding").alias("data"))
    return C.select_layers(chunks, [-5, 0, 9999]).select("segment_id", "c", "z", "y", "x", "v")


_VOL, _LAB = 'href="/([A-Za-z]+)"', "<h1>([A-Za-z]+)"


@query("a5_catalog_ids", f"""SELECT DISTINCT unnest(regexp_extract_all(html, '{_VOL}', 1)) AS segment_id FROM pages INTERSECT SELECT DISTINCT unnest(regexp_extract_all(html, '{_LAB}', 1)) FROM pages""")
def a5(spark, sf):
    return catalog_from_html(views.table(spark, sf, "pages"), "html", _VOL, _LAB)


@query("a6_merged_catalog", """SELECT coalesce(b.id, a.id) AS segment_id, CASE WHEN b.id IS NOT NULL THEN b.u ELSE a.u END AS url, CASE WHEN b.id IS NOT NULL THEN b.s ELSE a.s END AS scroll_id
FROM (SELECT c_custkey AS id, c_name AS u, c_nationkey AS s FROM customer) a FULL JOIN (SELECT s_suppkey*20 AS id, s_name AS u, s_nationkey AS s FROM supplier) b ON a.id = b.id""")
def a6(spark, sf):
    a = views.table(spark, sf, "customer").selectExpr("c_custkey AS segment_id", "c_name AS url", "c_nationkey AS scroll_id")
    b = views.table(spark, sf, "supplier").selectExpr("s_suppkey*20 AS segment_id", "s_name AS url", "s_nationkey AS scroll_id")
    return merge_catalogs(a, b, "segment_id")


@query("a8_dataset_summary", """WITH f AS (SELECT r_name AS scroll_id, n_name AS energy, c_mktsegment AS resolution, c_custkey::VARCHAR AS seg FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT scroll_id, string_agg(DISTINCT energy, ',' ORDER BY energy) AS energies, string_agg(DISTINCT resolution, ',' ORDER BY resolution) AS resolutions, count(DISTINCT seg) AS segments,
 CASE WHEN (SELECT count(DISTINCT seg) FROM f) > 1 THEN 'cross-segment-available' ELSE 'spatial-same-segment' END AS mode FROM f GROUP BY 1""")
def a8(spark, sf):
    t = lambda n: views.table(spark, sf, n)
    flat = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    entry = lambda k, v: F.map_from_entries(F.collect_list(F.struct(F.col(k), F.col(v))))
    seg = flat.select("r_name", "n_name", "c_mktsegment", F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("url"))
    res = seg.groupBy("r_name", "n_name", "c_mktsegment").agg(entry("id", "url").alias("segments"))
    res = res.withColumn("entry", F.struct("segments")).groupBy("r_name", "n_name").agg(entry("c_mktsegment", "entry").alias("resolutions"))
    catalog = res.groupBy(F.col("r_name").alias("scroll_id")).agg(entry("n_name", "resolutions").alias("energies"))
    out = dataset_summary(catalog)
    return out.select("scroll_id", F.array_join("energies", ",").alias("energies"), F.array_join("resolutions", ",").alias("resolutions"), F.size("segments").alias("segments"), "mode")


# ---------------------------------------------------------------- origins and patches

_SZ = "sz AS (SELECT segment, max(y)+1 AS h, max(x)+1 AS w FROM V_BIGMAP GROUP BY 1)"
_ORIGINS = f"""{_SZ},
oy AS (SELECT segment, w, unnest(list_distinct(list_concat(range(0, h-10+1, 7), [h-10]))) AS y0 FROM sz),
og AS (SELECT segment, y0, unnest(list_distinct(list_concat(range(0, w-10+1, 7), [w-10]))) AS x0 FROM oy)"""


@query("c1_tile_origins", f"WITH {_ORIGINS} SELECT segment, y0, x0 FROM og")
def c1(spark, sf):
    return C.tile_origins(C.map_sizes(views.bigmap(spark, sf), SEG), SEG, 10, 7)


@query("c2_tiled_origins", f"""WITH {_SZ}, g AS (SELECT segment, y0, unnest(range(5, w-10+1, 7)) AS x0 FROM (SELECT segment, w, unnest(range(0, h-10+1, 7)) AS y0 FROM sz))
SELECT segment, y0, x0 FROM (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY md5(concat_ws('|', '3', segment, y0, x0))) AS rn FROM g) WHERE rn <= 20""")
def c2(spark, sf):
    s = C.map_sizes(views.bigmap(spark, sf), SEG).select("segment", "h", F.lit(5).alias("x_lo"), F.col("w").alias("x_hi"))
    return C.tiled_origins(s, SEG, 10, 7, 20, 3)


def _origins_sql(lo: str, hi: str) -> str:
    """Draws repeated from their hashes: patches of 8 in the columns lo .. hi - 1."""
    u = lambda tag, more="": f"((('0x' || substr(md5(concat_ws('|', '13:{tag}', d.segment, d.draw{more})), 1, 8))::BIGINT + 0.5)/4294967296.0)"
    return f"""WITH sz AS (SELECT segment, max(y)+1 AS h, max(x)+1 AS w, {lo} AS lo, least({hi}, max(x)+1) AS hi FROM V_BIGMAP GROUP BY 1),
ps AS (SELECT b.segment, y, x, row_number() OVER (PARTITION BY b.segment ORDER BY y, x) AS rank, count(*) OVER (PARTITION BY b.segment) AS n FROM V_BIGMAP b JOIN sz USING (segment) WHERE label > 0.5 AND x >= lo AND x < hi),
d AS (SELECT sz.*, unnest(range(50)) AS draw, coalesce(n, 0) AS n FROM sz LEFT JOIN (SELECT DISTINCT segment, n FROM ps) USING (segment)),
nr AS (SELECT d.*, ps.y, ps.x FROM d JOIN ps ON ps.segment = d.segment AND ps.rank = CAST(floor({u('pick')}*d.n) AS BIGINT)+1 WHERE d.n > 0 AND {u('kind')} < 0.5),
tr AS (SELECT d.*, a, CAST(floor({u('ty', ', a')}*(h-7)) AS INT) AS y0, lo+CAST(floor({u('tx', ', a')}*(hi-lo-7)) AS INT) AS x0 FROM d, (SELECT unnest(range(33)) AS a) WHERE NOT (d.n > 0 AND {u('kind')} < 0.5)),
rt AS (SELECT tr.segment, draw, a, y0, x0, avg(label) AS rate FROM tr JOIN V_BIGMAP b ON b.segment = tr.segment AND b.y BETWEEN y0 AND y0+7 AND b.x BETWEEN x0 AND x0+7 GROUP BY ALL)
SELECT segment, draw, CAST(greatest(0, least(y-floor({u('jy')}*8), h-8)) AS INT) AS y0, CAST(greatest(lo, least(x-floor({u('jx')}*8), hi-8)) AS INT) AS x0, 'positive' AS source FROM nr d
UNION ALL SELECT segment, draw, arg_min(y0, CASE WHEN rate <= 0.15 THEN a WHEN a = 32 THEN 33 END), arg_min(x0, CASE WHEN rate <= 0.15 THEN a WHEN a = 32 THEN 33 END), 'background' FROM rt GROUP BY 1, 2"""


@query("c3_sampled_origins", _origins_sql("0", "1000000"))
def c3(spark, sf):
    return C.sample_origins(views.bigmap(spark, sf), SEG, 50, 0.5, 8, 13, max_rate=0.15)


@query("c3_region_origins", _origins_sql("segment % 3 * 4", "segment % 3 * 4 + 14"))
def c3_region(spark, sf):
    m = views.bigmap(spark, sf)
    regions = m.select("segment").distinct().selectExpr("segment", "segment % 3 * 4 AS x_lo", "segment % 3 * 4 + 14 AS x_hi")
    return C.sample_origins(m, SEG, 50, 0.5, 8, 13, max_rate=0.15, regions=regions)


def _array_text(col: str, digits: int = 6):
    return F.array_join(F.transform(col, lambda v: fixed_text(v.cast("double"), digits)), ",").alias(col)


@query("c4_patches", f"""WITH {_ORIGINS} SELECT o.segment, y0, x0, string_agg(printf('%.6f', prob), ',' ORDER BY y, x) AS image FROM og o JOIN V_BIGMAP b ON b.segment = o.segment AND y BETWEEN y0 AND y0+9 AND x BETWEEN x0 AND x0+9 GROUP BY ALL""")
def c4(spark, sf):
    return C.extract_patches(big_pixels(spark, sf), SEG, 10, 7).select("segment", "y0", "x0", _array_text("image"))


@query("c4_patches_at_origins", """WITH o AS (SELECT segment, y AS y0, x AS x0 FROM V_BIGMAP b WHERE prob >= 0.62 AND x <= 24 AND y <= 80)
SELECT o.segment, y0, x0, round(sum(prob), 6) AS total, count(*) AS n FROM o JOIN V_BIGMAP b ON b.segment = o.segment AND y BETWEEN y0 AND y0+7 AND x BETWEEN x0 AND x0+7 GROUP BY ALL""")
def c4_at(spark, sf):
    o = views.bigmap(spark, sf).filter("prob >= 0.62 AND x <= 24 AND y <= 80").select("segment", F.col("y").alias("y0"), F.col("x").alias("x0"))
    out = C.pixels_at(big_pixels(spark, sf), o, SEG, 8).groupBy("segment", "y0", "x0").agg(F.sum("v").alias("total"), F.count(F.lit(1)).alias("n"))
    return rounded(out, 6)


_W = "greatest(0.5-0.5*cos((y-y0)*2*pi()/9), 0.05)*greatest(0.5-0.5*cos((x-x0)*2*pi()/9), 0.05)/pow(0.5-0.5*cos(4*2*pi()/9), 2)"
_STITCH = f"""WITH {_ORIGINS}, t AS (SELECT o.segment, y0, x0, y, x, prob*(1.0-0.01*(y0%5)) AS prob, {_W} AS wt FROM og o JOIN V_BIGMAP b ON b.segment = o.segment AND y BETWEEN y0 AND y0+9 AND x BETWEEN x0 AND x0+9),
s AS (SELECT segment, y, x, sum(prob*wt)/greatest(sum(wt), 1e-6) AS prob, sum(wt) AS weight, count(*) AS tiles FROM t GROUP BY ALL)"""


def tile_probs(spark, sf):
    m = views.bigmap(spark, sf).select("segment", "y", "x", "prob")
    return C.covering_tiles(m, SEG, C.map_sizes(m, SEG), 10, 7).withColumn("prob", F.expr("prob*(1.0D-0.01D*(y0%5))"))


@query("c5_blend_window", f"""WITH {_ORIGINS} SELECT o.segment, y0, x0, round(sum({_W}), 6) AS weight FROM og o JOIN V_BIGMAP b ON b.segment = o.segment AND y BETWEEN y0 AND y0+9 AND x BETWEEN x0 AND x0+9 GROUP BY ALL""")
def c5(spark, sf):
    w = C.blend_weight(F.col("y") - F.col("y0"), F.col("x") - F.col("x0"), 10)
    return rounded(tile_probs(spark, sf).groupBy("segment", "y0", "x0").agg(F.sum(w).alias("weight")), 6)


@query("c6_stitched_map", _STITCH + " SELECT segment, y, x, round(prob, 9) AS prob, round(weight, 9) AS weight, tiles FROM s")
def c6(spark, sf):
    return rounded(C.stitch(tile_probs(spark, sf), SEG, 10))


@query("c6_stitch_stats", _STITCH + " SELECT segment, patches, round(min(weight), 9) AS weight_min, round(max(weight), 9) AS weight_max FROM s JOIN (SELECT segment, count(*) AS patches FROM og GROUP BY 1) USING (segment) GROUP BY ALL")
def c6_stats(spark, sf):
    t = tile_probs(spark, sf)
    return rounded(C.stitch_stats(t, C.stitch(t, SEG, 10), SEG))


@query("c7_ensemble_mean", f"""WITH {_SZ}, p AS (SELECT b.segment, y, x, prob, unnest(['id', 'h', 'v', 'hv']) AS view, h, w FROM V_BIGMAP b JOIN sz USING (segment))
SELECT segment, CASE WHEN view IN ('v', 'hv') THEN h-1-y ELSE y END AS y, CASE WHEN view IN ('h', 'hv') THEN w-1-x ELSE x END AS x, round(avg(prob), 9) AS prob FROM p GROUP BY ALL""")
def c7(spark, sf):
    m = views.bigmap(spark, sf)
    p = m.join(C.map_sizes(m, SEG), "segment").withColumn("view", F.explode(F.array(*[F.lit(v) for v in ("id", "h", "v", "hv")])))
    return rounded(C.ensemble_mean(p, SEG))


@query("c8_patch_stats", """WITH r AS (SELECT segment, vec_id, avg(CASE WHEN v > 0.1::FLOAT THEN 1.0 ELSE 0.0 END) AS r FROM (SELECT vec_id, label AS segment, unnest(embedding) AS v FROM embeddings) GROUP BY ALL)
SELECT segment, count(*) AS samples, round(avg(r), 9) AS positive_rate, round(avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END), 9) AS positive_patch_fraction, round(min(r), 9) AS rate_q0, round(quantile_cont(r, 0.25), 9) AS rate_q1,
 round(quantile_cont(r, 0.5), 9) AS rate_q2, round(quantile_cont(r, 0.75), 9) AS rate_q3, round(max(r), 9) AS rate_q4 FROM r GROUP BY 1""")
def c8(spark, sf):
    return rounded(C.patch_stats(patches(spark, sf), SEG))


@query("c9_split_regions", f"""WITH {_SZ}, g AS (SELECT *, greatest(4, w//50) AS gap FROM sz), g2 AS (SELECT *, gap//2 AS half FROM g),
c AS (SELECT *, unnest(range(greatest(4+half, CAST(floor(w*0.15) AS BIGINT)), least(w-4-half, CAST(floor(w*0.85) AS BIGINT))+1, greatest(4, w//32))) AS sx FROM g2),
lr AS (SELECT segment, h, w, sx, 0 AS l0, greatest(4, sx-half) AS l1, least(w-4, sx+half) AS r0, w AS r1 FROM c),
b AS (SELECT segment, h, w, sx, 0 AS side, l0 AS t0, l1 AS t1, r0 AS v0, r1 AS v1 FROM lr UNION ALL SELECT segment, h, w, sx, 1, r0, r1, l0, l1 FROM lr),
pm AS (SELECT o.segment, o.y0, o.x0, avg(m.label) AS mean FROM (SELECT segment, y AS y0, x AS x0 FROM V_BIGMAP JOIN sz USING (segment) WHERE y <= h-4 AND x <= w-4 AND y % 2 = 0) o
  JOIN V_BIGMAP m ON m.segment = o.segment AND m.y BETWEEN y0 AND y0+3 AND m.x BETWEEN x0 AND x0+3 GROUP BY ALL),
ts AS (SELECT b.segment, sx, side, max(mean) AS s FROM b JOIN pm ON pm.segment = b.segment AND y0 % 4 = 0 AND x0 >= t0 AND x0 <= t1-4 AND (x0-t0) % 4 = 0 GROUP BY ALL),
vs AS (SELECT b.segment, sx, side, max(mean) AS s FROM b JOIN pm ON pm.segment = b.segment AND y0 % 2 = 0 AND x0 >= v0 AND x0 <= v1-4 AND (x0-v0) % 2 = 0 GROUP BY ALL),
k AS (SELECT b.*, coalesce(ts.s, 0) AS t, coalesce(vs.s, 0) AS v FROM b LEFT JOIN ts USING (segment, sx, side) LEFT JOIN vs USING (segment, sx, side)),
r AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY least(t, v) DESC, v DESC, t DESC, v1-v0 DESC, sx, side) AS rn FROM k WHERE least(t, v) > 0)
SELECT segment, t0 AS train_lo, t1 AS train_hi, v0 AS val_lo, v1 AS val_hi, false AS is_default, greatest(t0, v0) < least(t1, v1) AS overlap FROM r WHERE rn = 1""")
def c9(spark, sf):
    return C.split_regions(views.bigmap(spark, sf), SEG, 4, 2)


_FEAT = """
f0 AS (SELECT vec_id, segment, y, x, v, lag(v) OVER c AS u0, lead(v) OVER c AS d0, lag(v) OVER r AS l0, lead(v) OVER r AS r0 FROM V_PX WINDOW c AS (PARTITION BY vec_id, x ORDER BY y), r AS (PARTITION BY vec_id, y ORDER BY x)),
f1 AS (SELECT f0.*, coalesce(u0, b.v) AS u, coalesce(d0, t.v) AS d, coalesce(l0, e.v) AS l, coalesce(r0, s.v) AS r FROM f0 JOIN V_PX b ON b.vec_id = f0.vec_id AND b.x = f0.x AND b.y = 7 JOIN V_PX t ON t.vec_id = f0.vec_id AND t.x = f0.x AND t.y = 0
  JOIN V_PX e ON e.vec_id = f0.vec_id AND e.y = f0.y AND e.x = 7 JOIN V_PX s ON s.vec_id = f0.vec_id AND s.y = f0.y AND s.x = 0),
ft AS (SELECT vec_id, segment, y, x, v, (u+d+l+r)/4.0 AS mean4, v-(u+d+l+r)/4.0 AS residual, CASE WHEN l0 IS NULL THEN r0-v WHEN r0 IS NULL THEN v-l0 ELSE (r0-l0)/2.0 END AS gx,
  CASE WHEN u0 IS NULL THEN d0-v WHEN d0 IS NULL THEN v-u0 ELSE (d0-u0)/2.0 END AS gy, u+d+l+r-4.0*v AS laplacian FROM f1)"""


def flat_patches(spark, sf):
    """Embeddings as patches of one channel of 8 x 8 pixels."""
    e = views.table(spark, sf, "embeddings")
    return e.select("vec_id", F.col("embedding").cast("array<double>").alias("image"), F.lit(8).alias("h"), F.lit(8).alias("w"))


@query("c10_pixel_features", f"WITH {_FEAT} SELECT vec_id, y, x, {rnd('v, mean4, residual, gx, gy, laplacian')}, round(gx*gx+gy*gy, 9) AS grad2, 1.0 AS bias FROM ft")
def c10(spark, sf):
    return rounded(C.patch_features(flat_patches(spark, sf), ["vec_id"]).select("vec_id", "y", "x", "v", "mean4", "residual", "gx", "gy", "laplacian", "grad2", "bias"))


@query("c10_channel_features", """WITH p AS (SELECT vec_id, k//16 AS c, (k%16)//4 AS y, k%4 AS x, v FROM V_PX)
SELECT vec_id, c, y, x, round(avg(v) OVER w, 9) AS depth_mean, round(max(CASE WHEN c = 2 THEN v END) OVER w - avg(v) OVER w, 9) AS depth_center_diff, round(stddev_pop(v) OVER w, 9) AS depth_std,
 round(max(CASE WHEN c = 3 THEN v END) OVER w - max(CASE WHEN c = 0 THEN v END) OVER w, 9) AS depth_span FROM p WINDOW w AS (PARTITION BY vec_id, y, x)""")
def c10_channels(spark, sf):
    p = views.px(spark, sf).selectExpr("vec_id", "k div 16 AS c", "(k%16) div 4 AS y", "k%4 AS x", "v")
    return rounded(C.pixel_features(p, ["vec_id"], 2, True).select("vec_id", "c", "y", "x", "depth_mean", "depth_center_diff", "depth_std", "depth_span"))


@query("c11_standardized", f"WITH {_FEAT}, s AS (SELECT segment, avg(gx) AS m, greatest(stddev_pop(gx), 1e-6) AS d, avg(v) AS mv, greatest(stddev_pop(v), 1e-6) AS dv FROM ft GROUP BY 1) SELECT vec_id, y, x, round((gx-m)/d, 6) AS gx, round((v-mv)/dv, 6) AS v FROM ft JOIN s USING (segment)")
def c11(spark, sf):
    f = C.pixel_features(px(spark, sf), ["vec_id"], 3)
    return rounded(C.standardize(f, f, SEG, ["gx", "v"])[1].select("vec_id", "y", "x", "gx", "v"), 6)


@query("c12_augmented", """WITH f AS (SELECT vec_id, unnest(['id', 'h', 'v']) AS flip FROM embeddings), t AS (SELECT *, ('0x' || substr(md5(concat_ws('|', '5', vec_id, flip)), 1, 8))::BIGINT % 4 AS turns FROM f),
o AS (SELECT t.*, i // 8 AS y, i % 8 AS x, i FROM t, (SELECT unnest(range(64)) AS i)),
r AS (SELECT *, CASE turns WHEN 1 THEN x WHEN 2 THEN 7-y WHEN 3 THEN 7-x ELSE y END AS ty, CASE turns WHEN 1 THEN 7-y WHEN 2 THEN 7-x WHEN 3 THEN y ELSE x END AS tx FROM o),
s AS (SELECT *, (CASE flip WHEN 'v' THEN 7-ty ELSE ty END)*8 + CASE flip WHEN 'h' THEN 7-tx ELSE tx END AS k FROM r)
SELECT s.vec_id, flip, turns, string_agg(printf('%.6f', p.v), ',' ORDER BY i) AS image FROM s JOIN V_PX p ON p.vec_id = s.vec_id AND p.k = s.k GROUP BY ALL""")
def c12(spark, sf):
    return C.augment(patches(spark, sf), True, True, 5, ["vec_id"]).select("vec_id", "flip", "turns", _array_text("image"))


@query("c14_label_iou", """SELECT segment, i AS intersection, u AS union_pixels, nn AS new_not_ours, o AS ours_not_new, round(CASE WHEN u > 0 THEN i/u ELSE 1.0 END, 9) AS iou FROM (
 SELECT segment, count(*) FILTER (WHERE label = 1 AND prob > 0.62) AS i, count(*) FILTER (WHERE label = 1 OR prob > 0.62 ) AS u, count(*) FILTER (WHERE prob > 0.62 AND label = 0) AS nn, count(*) FILTER (WHERE label = 1 AND prob <= 0.62) AS o
 FROM V_BIGMAP GROUP BY 1)""")
def c14(spark, sf):
    m = views.bigmap(spark, sf)
    new = m.select("segment", "y", "x", F.when(F.col("prob") > 0.62, 1).otherwise(0).alias("label"))
    return rounded(C.label_iou(m.select("segment", "y", "x", "label"), new, SEG, ["y", "x"]))


@query("c15_relabeled", f"""WITH {_ORIGINS} SELECT o.segment, y0, x0, count(*) FILTER (WHERE label = 1 AND prob > 0.62) AS intersection, count(*) FILTER (WHERE label = 1 OR prob > 0.62) AS union_pixels,
 count(*) FILTER (WHERE prob > 0.62) AS positives FROM og o JOIN V_BIGMAP b ON b.segment = o.segment AND y BETWEEN y0 AND y0+9 AND x BETWEEN x0 AND x0+9 GROUP BY ALL""")
def c15(spark, sf):
    m = views.bigmap(spark, sf)
    old = m.select("segment", F.lit(0).alias("c"), "y", "x", F.col("label").cast("double").alias("v"))
    p = C.extract_patches(old, SEG, 10, 7).withColumnRenamed("image", "label")
    new = m.select("segment", "y", "x", F.when(F.col("prob") > 0.62, 1).otherwise(0).alias("label"))
    out = C.relabel(p, new, SEG, 10)
    return out.select("segment", "y0", "x0", "intersection", "union_pixels", F.size(F.filter("new_label", lambda v: v > 0.5)).alias("positives"))


@query("c16_combined_sets", """SELECT s AS source, count(*) AS samples, string_agg(DISTINCT label::VARCHAR, ',' ORDER BY label::VARCHAR) AS source_segments, 8 AS patch_size FROM (SELECT label, 'a' AS s FROM embeddings UNION ALL SELECT (label+3)%10, 'b' FROM embeddings) GROUP BY 1""")
def c16(spark, sf):
    p = patches(spark, sf).withColumn("segment", F.col("segment").cast("string"))
    other = p.withColumn("segment", F.expr("CAST((segment+3)%10 AS BIGINT)").cast("string")).withColumn("source", F.lit("b"))
    _, inputs = C.combine([p.withColumn("source", F.lit("a")), other])
    return inputs.withColumn("source_segments", F.array_join("source_segments", ","))


@query("c17_texture", f"WITH {_FEAT} SELECT vec_id, round(avg(gx*gx+gy*gy), 9) AS texture FROM ft GROUP BY 1")
def c17(spark, sf):
    return rounded(C.patch_texture(flat_patches(spark, sf), ["vec_id"]))


# ---------------------------------------------------------------- sampling


@query("d1_uniform_sample", "SELECT vec_id, segment, y, x FROM (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY md5(concat_ws('|', '7', vec_id, y, x))) AS rn FROM V_PX) WHERE rn <= 100")
def d1(spark, sf):
    return D.sample_n(px(spark, sf), 100, 7, ["vec_id", "y", "x"], SEG).select("vec_id", "segment", "y", "x")


def ink_patches(spark, sf):
    p = patches(spark, sf).select("vec_id", "segment", C.positive_rate().alias("ink_fraction"))
    return p.join(C.patch_texture(flat_patches(spark, sf), ["vec_id"]), "vec_id")


@query("d2_hard_mining_sample", f"""WITH {_FEAT}, ink AS (SELECT vec_id, segment, avg(CASE WHEN v > 0.1::FLOAT THEN 1.0 ELSE 0.0 END) AS ink_fraction FROM (SELECT vec_id, label AS segment, unnest(embedding) AS v FROM embeddings) GROUP BY ALL),
p AS (SELECT vec_id, segment, ink_fraction, texture, {", ".join(f"('0x' || substr(md5(concat('11:{n}|', vec_id)), 1, 15))::BIGINT AS h_{n}" for n in ("random", "fill"))}, md5(concat('11:hard|', vec_id)) AS h_hard,
  -ln((('0x' || substr(md5(concat('11:positive|', vec_id)), 1, 8))::BIGINT + 0.5)/4294967296.0)/ink_fraction AS w FROM ink JOIN (SELECT vec_id, avg(gx*gx+gy*gy) AS texture FROM ft GROUP BY 1) USING (vec_id)),
k AS (SELECT *, 120-tp AS tn, least(nn, CAST(round_even((120-tp)*0.6, 0) AS BIGINT)) AS th FROM (SELECT count(*) AS al, least(count(*) FILTER (WHERE ink_fraction > 0.2), 54) AS tp, count(*) FILTER (WHERE ink_fraction <= 0.15) AS nn FROM p)),
po AS (SELECT vec_id, 'positive' AS stage FROM (SELECT vec_id, row_number() OVER (ORDER BY w, vec_id) AS r FROM p WHERE ink_fraction > 0.2), k WHERE r <= tp),
ha AS (SELECT vec_id, 'hard_negative' AS stage FROM (SELECT vec_id, row_number() OVER (ORDER BY h_hard, vec_id) AS r FROM (SELECT *, row_number() OVER (ORDER BY texture DESC, vec_id) AS t FROM p WHERE ink_fraction <= 0.15), k WHERE t <= 3*th), k WHERE r <= th),
ra AS (SELECT vec_id, 'random_negative' AS stage FROM (SELECT vec_id, row_number() OVER (ORDER BY h_random, vec_id) AS r FROM p WHERE ink_fraction <= 0.15 AND vec_id NOT IN (SELECT vec_id FROM ha)), k WHERE r <= tn-th),
c AS (SELECT * FROM po UNION ALL SELECT * FROM ha UNION ALL SELECT * FROM ra),
b AS (SELECT vec_id, 'fill' AS stage FROM (SELECT vec_id, row_number() OVER (ORDER BY h_fill, vec_id) AS r FROM p WHERE vec_id NOT IN (SELECT vec_id FROM c)) WHERE r <= 120-(SELECT count(*) FROM c))
SELECT vec_id, segment, round(ink_fraction, 9) AS ink_fraction, round(texture, 9) AS texture, 'all' AS scope, CASE WHEN al <= 120 THEN 'all' ELSE stage END AS stage FROM p JOIN (SELECT * FROM c UNION ALL SELECT * FROM b) USING (vec_id), k""")
def d2(spark, sf):
    p = ink_patches(spark, sf).withColumn("scope", F.lit("all"))
    return rounded(D.hard_mining_sample(p, 120, 11, ["vec_id"], ["scope"], 0.45, 0.6, 0.2, 0.15))


@query("d3_curriculum", """WITH c AS (SELECT o_custkey % 200 AS k, max(CASE o_custkey%200%4 WHEN 0 THEN 'warmup_then_hard' WHEN 1 THEN 'uniform_to_hard_mining' WHEN 2 THEN 'random' END) AS cur, max(CASE WHEN o_custkey%200%4 = 3 THEN o_custkey%3 END) AS sw, max(o_custkey%200%7+1) AS ep FROM orders GROUP BY 1)
SELECT k, e AS epoch, CASE WHEN cur = 'random' THEN 'random' WHEN e < coalesce(CASE WHEN cur IS NULL THEN sw END, greatest(1, ep//2)) THEN 'random' ELSE 'hard_mining' END AS strategy FROM (SELECT *, unnest(range(ep)) AS e FROM c)""")
def d3(spark, sf):
    c = views.table(spark, sf, "orders").selectExpr("o_custkey % 200 AS k", "o_custkey AS u").groupBy("k").agg(
        F.expr("max(CASE k%4 WHEN 0 THEN 'warmup_then_hard' WHEN 1 THEN 'uniform_to_hard_mining' WHEN 2 THEN 'random' END)").alias("curriculum"),
        F.expr("max(CASE WHEN k%4 = 3 THEN u%3 END)").alias("switch_epoch"), F.expr("max(k%7+1)").alias("epochs"))
    c = c.withColumns({"initial": F.lit(None).cast("string"), "final": F.lit(None).cast("string")})
    return D.curriculum(c, ["k"])


@query("d4_stratified_batches", """WITH e AS (SELECT vec_id, CASE WHEN label < 1 THEN 0 WHEN label < 4 THEN 1 ELSE 2 END AS g FROM embeddings), n AS (SELECT g, count(*) AS n, (SELECT count(*)//30 FROM e)*10 AS need FROM e GROUP BY 1),
c AS (SELECT e.*, n, need, unnest(range(greatest(CAST(ceil(need/n) AS BIGINT), 1))) AS cycle FROM e JOIN n USING (g)),
r AS (SELECT *, cycle*n + row_number() OVER (PARTITION BY g, cycle ORDER BY md5(concat_ws('|', '5', cycle, vec_id))) AS p FROM c)
SELECT vec_id, g, cycle, (p-1)//10 AS batch FROM r WHERE p <= need""")
def d4(spark, sf):
    e = views.table(spark, sf, "embeddings").selectExpr("vec_id", "CASE WHEN label < 1 THEN 0 WHEN label < 4 THEN 1 ELSE 2 END AS g")
    return D.stratified_batches(e, "g", 30, 5, ["vec_id"], 3)


@query("d5_cursor_batches", """WITH r AS (SELECT vec_id, row_number() OVER (ORDER BY md5(concat_ws('|', '9', vec_id))) - 1 AS p, count(*) OVER () AS n FROM embeddings), s AS (SELECT unnest(range(3*300)) AS slot)
SELECT vec_id, slot//300 AS epoch, slot%300 AS position, (slot%300)//16 AS batch FROM s JOIN r ON r.p = slot % n""")
def d5(spark, sf):
    return D.cursor_batches(views.table(spark, sf, "embeddings").select("vec_id"), 16, 9, ["vec_id"], 3, 300)


@query("d6_balanced_pixels", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY fold, label ORDER BY md5(concat_ws('|', '2', l_orderkey, fold, l_partkey, run_id)), l_orderkey) AS rn, count(*) FILTER (WHERE label = 1) OVER (PARTITION BY fold) AS np FROM V_SCORES)
SELECT fold, l_orderkey, l_partkey, run_id, label FROM r WHERE rn <= CASE WHEN label = 1 THEN least(np, 250) ELSE 1000 - least(np, 250) END""")
def d6(spark, sf):
    s = D.balanced_sample(views.scores(spark, sf), 1000, 0.25, 2, ["l_orderkey", "fold", "l_partkey", "run_id"], ["fold"])
    return s.select("fold", "l_orderkey", "l_partkey", "run_id", "label")


@query("d8_segment_groups", """WITH i AS (SELECT l_orderkey AS k, l_partkey*1000+l_linenumber AS position, l_returnflag AS segment, CAST(l_quantity AS BIGINT) AS samples FROM lineitem),
t AS (SELECT *, sum(samples) OVER (PARTITION BY k) AS total, coalesce(sum(samples) OVER (PARTITION BY k ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS fi, min(position) OVER (PARTITION BY k, segment) AS seen FROM i)
SELECT k, position, segment, samples, fi AS first_index, dense_rank() OVER (PARTITION BY k ORDER BY seen) - 1 AS group_index FROM t WHERE total >= 30 AND total = CASE WHEN total % 2 = 0 THEN total ELSE 0 END""")
def d8(spark, sf):
    # rows of one position stay in the order of the table
    i = views.table(spark, sf, "lineitem").selectExpr("l_orderkey AS k", "l_partkey*1000+l_linenumber AS position", "l_returnflag AS segment", "CAST(l_quantity AS BIGINT) AS samples",
                                                      "_metadata.file_path AS file", "_metadata.row_index AS place")
    n = i.groupBy("k").agg(F.sum("samples").alias("t")).selectExpr("k", "CASE WHEN t % 2 = 0 AND t >= 30 THEN t ELSE -1 END AS sample_count")
    return D.segment_groups(i.join(n, "k"), ["k"], "sample_count", ["file", "place"])


# ---------------------------------------------------------------- mining

_MINE = f"""WITH {_ORIGINS}, sc AS (SELECT segment, y, x, prob, CASE WHEN prob > 0.85 THEN 1 ELSE 0 END AS label FROM V_BIGMAP),
t AS (SELECT o.segment, y0, x0, avg(label) AS label_rate, avg(CASE WHEN prob >= 0.6 AND label = 0 THEN 1.0 ELSE 0.0 END) AS fp_rate, avg(prob) AS prob_mean FROM og o JOIN sc b ON b.segment = o.segment AND y BETWEEN y0 AND y0+9 AND x BETWEEN x0 AND x0+9 GROUP BY ALL),
m AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY round(fp_rate, 12) DESC, round(prob_mean, 12) DESC, y0 DESC, x0 DESC) AS mine_rank FROM t WHERE label_rate <= 0.01 AND fp_rate > 0)"""


def mined(spark, sf):
    s = views.bigmap(spark, sf).withColumn("label", F.when(F.col("prob") > 0.85, 1).otherwise(0))
    return J.mine_tiles(s, SEG, 10, 7, 0.6, 12, 0.01)


@query("j1_mined_tiles", _MINE + f" SELECT segment, y0, x0, mine_rank, {rnd('label_rate, fp_rate, prob_mean')} FROM m WHERE mine_rank <= 12")
def j1(spark, sf):
    return rounded(mined(spark, sf))


@query("j1_mining_statistics", _MINE + """, a AS (SELECT segment, count(*) AS c, count(*) FILTER (WHERE mine_rank <= 12) AS n, avg(label_rate) FILTER (WHERE mine_rank <= 12) AS lr, max(fp_rate) FILTER (WHERE mine_rank <= 12) AS fp,
  avg(prob_mean) FILTER (WHERE mine_rank <= 12) AS pm FROM m GROUP BY 1)
SELECT segment, 10 AS patch_size, 7 AS stride, 12 AS max_patches, 0.6::DOUBLE AS threshold, 0.01::DOUBLE AS max_label_positive_rate, coalesce(c, 0) AS candidate_patches, coalesce(n, 0) AS samples,
 round(coalesce(lr, 0), 9) AS positive_rate, round(coalesce(fp, 0), 9) AS max_fp_rate, round(coalesce(pm, 0), 9) AS mean_probability FROM (SELECT DISTINCT segment FROM V_BIGMAP) LEFT JOIN a USING (segment)""")
def j1_statistics(spark, sf):
    s = views.bigmap(spark, sf).withColumn("label", F.when(F.col("prob") > 0.85, 1).otherwise(0))
    return rounded(J.mining_statistics(s, SEG, 10, 7, 0.6, 12, 0.01))


@query("j1_mined_patches", _MINE + " SELECT m.segment, y0, x0, string_agg(printf('%.6f', prob), ',' ORDER BY y, x) AS image FROM m JOIN V_BIGMAP b ON b.segment = m.segment AND y BETWEEN y0 AND y0+9 AND x BETWEEN x0 AND x0+9 WHERE mine_rank <= 12 GROUP BY ALL")
def j1_patches(spark, sf):
    return J.mined_patches(big_pixels(spark, sf), mined(spark, sf), SEG, 10).select("segment", "y0", "x0", _array_text("image"))


_INV = """
iv0 AS (SELECT vec_id//10 AS set_id, count(*) AS samples, avg(CASE WHEN v > 0.4::FLOAT THEN 1.0 ELSE 0.0 END) AS ppr FROM (SELECT vec_id, unnest(embedding) AS v FROM embeddings) GROUP BY 1),
pr AS (SELECT vec_id//10 AS set_id, list_sort(list(DISTINCT label::VARCHAR)) AS provenance FROM embeddings WHERE vec_id//10 % 7 > 0 GROUP BY 1),
iv AS (SELECT set_id, samples/64 AS samples, ppr, coalesce(provenance, []) AS provenance, set_id % 5 > 0 AS hm, set_id % 11 = 0 AS me FROM iv0 LEFT JOIN pr USING (set_id)),
inv AS (SELECT *, list_filter([CASE WHEN NOT hm THEN 'missing_metadata' END, CASE WHEN me THEN 'metadata_parse_error' END, CASE WHEN len(provenance) = 0 THEN 'missing_provenance_segment' END, CASE WHEN ppr > 0.001 THEN 'positive_contaminated' END], lambda w: w IS NOT NULL) AS warnings FROM iv),
ivs AS (SELECT *, CASE WHEN len(warnings) = 0 THEN 'eligible' WHEN me OR len(provenance) = 0 THEN 'reject' ELSE 'review' END AS status FROM inv)"""


def inventory(spark, sf):
    e = views.table(spark, sf, "embeddings").withColumn("set_id", F.expr("vec_id div 10"))
    label = F.transform("embedding", lambda v: F.when(v > F.lit(0.4).cast("float"), 1.0).otherwise(0.0))
    sets = e.groupBy("set_id").agg(F.sort_array(F.collect_set(F.col("label").cast("string"))).alias("p")).select(
        "set_id", F.when(F.col("set_id") % 7 > 0, F.col("p")).otherwise(F.array().cast("array<string>")).alias("provenance"),
        (F.col("set_id") % 5 > 0).alias("has_metadata"), (F.col("set_id") % 11 == 0).alias("metadata_error"))
    return J.mined_inventory(sets, e.select("set_id", label.alias("label")), "set_id")


@query("j2_mined_inventory", f"WITH {_INV} SELECT set_id, samples, round(ppr, 9) AS pixel_positive_rate, coalesce(list_aggregate(warnings, 'string_agg', ','), '') AS warnings, status FROM ivs")
def j2(spark, sf):
    return rounded(inventory(spark, sf).select("set_id", "samples", "pixel_positive_rate", F.array_join("warnings", ",").alias("warnings"), "status"))


def eligibility(spark, sf):
    folds = views.table(spark, sf, "embeddings").select(F.col("label").cast("string").alias("heldout_segment"))
    return J.fold_eligibility(inventory(spark, sf), folds, "set_id")


@query("j3_fold_eligibility", f"""WITH {_INV}, h AS (SELECT DISTINCT label::VARCHAR AS heldout_segment FROM embeddings)
SELECT set_id, heldout_segment, status = 'eligible' AND NOT list_contains(provenance, heldout_segment) AS eligible, CASE WHEN status <> 'eligible' THEN status WHEN list_contains(provenance, heldout_segment) THEN 'provenance_includes_heldout_segment' END AS reason FROM ivs, h""")
def j3(spark, sf):
    return eligibility(spark, sf)


def fold_sets(spark, sf):
    folds = views.table(spark, sf, "embeddings").select(F.col("label").cast("string").alias("heldout_segment"))
    return J.fold_sets(inventory(spark, sf), folds, "set_id")


@query("j3_fold_sets", f"""WITH {_INV}, h AS (SELECT DISTINCT label::VARCHAR AS heldout_segment FROM embeddings)
SELECT heldout_segment, count(*) FILTER (WHERE status = 'eligible' AND NOT list_contains(provenance, heldout_segment)) AS eligible_sets, count(*) FILTER (WHERE status = 'eligible' AND list_contains(provenance, heldout_segment)) AS own_sets,
 count(*) FILTER (WHERE status <> 'eligible') AS rejected_sets, min(set_id) FILTER (WHERE status = 'eligible' AND NOT list_contains(provenance, heldout_segment)) AS first_set FROM ivs, h GROUP BY 1""")
def j3_sets(spark, sf):
    return fold_sets(spark, sf)


@query("j7_rejected_sets", f"""WITH {_INV}, h AS (SELECT DISTINCT label::VARCHAR AS heldout_segment FROM embeddings)
SELECT set_id, NULL::VARCHAR AS heldout_segment, status AS reason FROM ivs WHERE status <> 'eligible'
UNION ALL SELECT set_id, heldout_segment, 'provenance_includes_heldout_segment' FROM ivs, h WHERE status = 'eligible' AND list_contains(provenance, heldout_segment)""")
def j7_rejected(spark, sf):
    folds = views.table(spark, sf, "embeddings").select(F.col("label").cast("string").alias("heldout_segment"))
    return J.rejected_sets(inventory(spark, sf), folds, "set_id")


@query("j7_preconditions", f"""WITH {_INV}, h AS (SELECT DISTINCT label::VARCHAR AS heldout_segment FROM embeddings), fs AS (SELECT DISTINCT unnest(provenance) AS s FROM ivs)
SELECT heldout_segment, heldout_segment IN (SELECT s FROM fs) AS in_forbidden_segments, heldout_segment NOT IN (SELECT s FROM fs) AS precondition_holds FROM h""")
def j7_preconditions(spark, sf):
    folds = views.table(spark, sf, "embeddings").select(F.col("label").cast("string").alias("heldout_segment"))
    return J.plan_preconditions(inventory(spark, sf), folds)


_RISK_SPARK = """CASE WHEN run_id%10 > 0 THEN named_struct('selected_f1', CASE WHEN run_id%13 > 0 THEN val_f1 END, 'selected_f05', val_f05, 'selected_ratio', pred_positive_rate/val_positive_rate, 'cap_binding', run_id%17 = 0,
 'f1_2', val_f1*(0.9D+0.01D*(run_id%11)), 'f05_2', val_f05*(0.9D+0.01D*(run_id%12)), 'f1_25', val_f1*(0.92D+0.01D*(run_id%9)), 'f05_25', CASE WHEN run_id%4 > 0 THEN val_f05*0.96D END, 'f1_3', val_f1*0.97D, 'f05_3', val_f05*(0.93D+0.01D*(run_id%5))) END"""
_TILE_CTE = """
tt AS (SELECT *, run_id AS ordinal, train_segment AS segment_id, signature AS artifact_dir, run_id%10 > 0 AS has_risk, run_id%10 > 0 AS hr, CASE WHEN run_id%13 > 0 THEN val_f1 END AS sf1, val_f05 AS sf05, pred_positive_rate/nullif(val_positive_rate, 0) AS sr, run_id%17 = 0 AS cb,
  val_f1*(0.9::DOUBLE+0.01::DOUBLE*(run_id%11)) AS a2, val_f05*(0.9::DOUBLE+0.01::DOUBLE*(run_id%12)) AS b2, val_f1*(0.92::DOUBLE+0.01::DOUBLE*(run_id%9)) AS a25, CASE WHEN run_id%4 > 0 THEN val_f05*0.96 END AS b25, val_f1*0.97 AS a3, val_f05*(0.93::DOUBLE+0.01::DOUBLE*(run_id%5)) AS b3 FROM mv),
td AS (SELECT *, CASE WHEN abs(val_positive_rate) >= 1e-9 THEN pred_positive_rate/val_positive_rate END AS rt FROM tt),
rd AS (SELECT *, CASE WHEN NOT hr OR coalesce(nullif(sf1, 0), val_f1) <= 0 THEN 0 WHEN sf1 IS NULL THEN 1 WHEN a2/greatest(sf1, 1e-12) >= 0.95 AND b2/greatest(sf05, 1e-12) >= 0.95 THEN 2 WHEN a25/greatest(sf1, 1e-12) >= 0.95 AND (b25 IS NULL OR b25/greatest(sf05, 1e-12) >= 0.95) THEN 3
  WHEN a3/greatest(sf1, 1e-12) >= 0.95 AND b3/greatest(sf05, 1e-12) >= 0.95 THEN 4 WHEN cb OR coalesce(nullif(CASE WHEN hr THEN sr END, 0), rt) >= 2 THEN 5 ELSE 6 END AS dk FROM td)"""
_DEC = "CASE WHEN dk <= 1 THEN 'run_cap_comparison' WHEN dk <= 4 THEN 'tighten_positive_rate_cap' WHEN dk = 5 THEN 'mine_hard_negatives' ELSE 'review_threshold_risk' END"


def tile_rows(spark, sf):
    v = run_verdicts(spark, sf)
    return v.withColumns({"ordinal": F.col("run_id"), "segment_id": F.col("train_segment"), "artifact_dir": F.col("signature"), "has_risk": F.expr("run_id%10 > 0"),
                          "risk": F.expr(_RISK_SPARK.replace("/val_positive_rate", "/nullif(val_positive_rate, 0)"))}).drop("train_segment", "signature")


@query("j4_candidate_tiles", f"WITH {METRIC_VERDICT_CTE}, {_TILE_CTE} SELECT research_scope, artifact_dir, segment_id, run_id, first_seen FROM (SELECT *, row_number() OVER (PARTITION BY research_scope, artifact_dir, segment_id ORDER BY CASE WHEN has_risk THEN 0 ELSE 1 END, ordinal) AS rn, min(ordinal) OVER (PARTITION BY research_scope, artifact_dir, segment_id) AS first_seen FROM tt) WHERE rn = 1")
def j4(spark, sf):
    return J.candidate_tiles(tile_rows(spark, sf), ["research_scope"]).select("research_scope", "artifact_dir", "segment_id", "run_id", "first_seen")


_NEEDS = "coalesce(rt >= 2.0 AND (coalesce(fixed_threshold_status IN ('weak', 'failed', 'zero_f1'), false) OR list_contains(reasons, 'fixed_threshold_weak') OR coalesce(fx, 0) <= 0), false)"


@query("j5_needs_mining", f"WITH {METRIC_VERDICT_CTE}, {_TILE_CTE} SELECT run_id, {_NEEDS} AS needs FROM td")
def j5(spark, sf):
    t = tile_rows(spark, sf)
    return t.select("run_id", J.needs_mining(t).alias("needs"))


@query("j6_risk_decisions", f"WITH {METRIC_VERDICT_CTE}, {_TILE_CTE} SELECT run_id, {_DEC} AS decision, CASE dk WHEN 2 THEN 2.0 WHEN 3 THEN 2.5 WHEN 4 THEN 3.0 END AS target_cap FROM rd")
def j6(spark, sf):
    return J.risk_decision(tile_rows(spark, sf)).select("run_id", "decision", "target_cap")


@query("j7_mining_plan", f"""WITH {METRIC_VERDICT_CTE}, {_TILE_CTE}, c AS (SELECT *, row_number() OVER (PARTITION BY research_scope, artifact_dir, segment_id ORDER BY CASE WHEN has_risk THEN 0 ELSE 1 END, ordinal) AS rn,
  min(ordinal) OVER (PARTITION BY research_scope, artifact_dir, segment_id) AS first_seen FROM rd),
m AS (SELECT *, row_number() OVER (PARTITION BY research_scope ORDER BY first_seen, artifact_dir, segment_id) AS mine_order FROM c WHERE rn = 1 AND {_NEEDS} AND NOT dk IN (2, 3, 4))
SELECT research_scope, mine_order, artifact_dir, segment_id, {_DEC} AS decision FROM m WHERE mine_order <= 6""")
def j7(spark, sf):
    plan, _ = J.mining_plan(tile_rows(spark, sf), fold_sets(spark, sf), ["research_scope"], 6)
    return plan.select("research_scope", "mine_order", "artifact_dir", "segment_id", "decision")


@query("j7_eligible_sets", f"""WITH {_INV}, h AS (SELECT DISTINCT label::VARCHAR AS heldout_segment FROM embeddings)
SELECT heldout_segment, count(*) AS eligible_sets, min(set_id) AS first_set FROM ivs, h WHERE status = 'eligible' AND NOT list_contains(provenance, heldout_segment) GROUP BY 1""")
def j7_sets(spark, sf):
    return J.mining_plan(tile_rows(spark, sf), fold_sets(spark, sf), ["research_scope"], 6)[1]


@query("j8_cap_blockers", f"""WITH {sweep_ctes('V_SCORES', _FS)}, {compare_caps_ctes(_FS)}, r AS (SELECT fold, seed, min(cap) FILTER (WHERE r1 >= 0.9 AND r05 >= 0.9) AS rc FROM cmp GROUP BY ALL)
SELECT fold, seed, CASE WHEN fold % 3 = 0 THEN 'cap_comparison_error' ELSE 'no_cap_preserves_retention' END AS reason, CASE WHEN fold % 3 = 0 THEN 'no metrics' END AS error FROM r WHERE rc IS NULL OR fold % 3 = 0""")
def j8_blockers(spark, sf):
    """Comparisons of every third fold count as failed, as their reports would say."""
    from evalgate.operators.caps import recommended_cap

    found = recommended_cap(fold_seed_caps(spark, sf), ["fold", "seed"])
    return J.cap_blockers(found.withColumn("error", F.expr("CASE WHEN fold % 3 = 0 THEN 'no metrics' END")), ["fold", "seed"])


@query("j8_cap_recommendation", f"""WITH {sweep_ctes('V_SCORES', _FS)}, {compare_caps_ctes(_FS)}, r AS (SELECT fold, seed, min(cap) FILTER (WHERE r1 >= 0.9 AND r05 >= 0.9) AS rc FROM cmp GROUP BY ALL)
SELECT fold, count(*) AS artifacts, count(*) FILTER (WHERE rc IS NULL) AS blockers, CASE WHEN count(*) FILTER (WHERE rc IS NULL) = 0 THEN max(rc) END AS target_cap FROM r GROUP BY 1""")
def j8(spark, sf):
    from evalgate.operators.caps import recommended_cap

    return J.cap_recommendation(recommended_cap(fold_seed_caps(spark, sf), ["fold", "seed"]), ["fold"])
