"""Training, predictor and stream queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from evalgate import views
from evalgate.operators import grid as C
from evalgate.operators import predictors as P
from evalgate.operators import training as T
from evalgate.operators.metrics import EvalConfig
from evalgate.plans.registry import query, rounded
from evalgate.session import shared_folder
from evalgate.streaming import states as K


def _stream_table(df, name: str, mode: str):
    """Run a stream over the files present and return its final table.

    State and progress log go below the shared folder of the session.
    """
    spark = df.sparkSession
    where = f"{shared_folder(spark)}/{name}_{uuid.uuid4().hex[:8]}"
    K.run_to_table(df, f"{where}/table", mode, f"{where}/log").awaitTermination()
    out = spark.read.parquet(f"{where}/table/state" if mode == "complete" else f"{where}/table")
    return out.select(*df.columns)


def read_stream(spark, sf, name: str):
    path = f"{sf}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf)


def training_pixels(spark, sf):
    m = views.maps(spark, sf).select("map_id", F.lit(0).alias("c"), "y", "x", F.col("prob").alias("v"), "label")
    return C.pixel_features(m, ["map_id"], 2).withColumn("segment", (F.col("map_id") % 5).cast("int"))


_FEATURES = """f AS (SELECT map_id % 5 AS segment, map_id, y, x, label, prob AS v, (up+down+lf+rt)/4.0 AS mean4 FROM (SELECT a.*, u.prob AS up, d.prob AS down, l.prob AS lf, r.prob AS rt FROM V_MAP a
  JOIN V_MAP u ON u.map_id = a.map_id AND u.x = a.x AND u.y = (a.y+7)%8 JOIN V_MAP d ON d.map_id = a.map_id AND d.x = a.x AND d.y = (a.y+1)%8
  JOIN V_MAP l ON l.map_id = a.map_id AND l.y = a.y AND l.x = (a.x+7)%8 JOIN V_MAP r ON r.map_id = a.map_id AND r.y = a.y AND r.x = (a.x+1)%8)),
t AS (SELECT *, [v, 1.0, mean4, v-mean4] AS xs FROM f)"""


def descent_sql(rows: str, key: str, features: int, bias: int, epochs: int, leave_out: bool = False) -> str:
    """Gradient descent unrolled: tables m0.. hold the weights `w` of every model; `rows` has (segment, label, xs)."""
    on = f"{rows}.segment <> m.{key}" if leave_out else f"{rows}.segment = m.{key}"
    pairs = f"{rows} JOIN (SELECT DISTINCT segment AS {key} FROM {rows}) m ON {on}"
    steps = [f"""m0 AS (SELECT {key}, n, NULL::DOUBLE AS loss, list_transform(range({features}), lambda i: CASE WHEN i = {bias} THEN ln(p/(1-p)) ELSE 0.0 END) AS w
      FROM (SELECT m.{key}, count(*) AS n, least(greatest(avg(CAST(label > 0.5 AS INT)), 1e-4), 1-1e-4) AS p FROM {pairs} GROUP BY 1))"""]
    for k in range(epochs):
        steps += [f"""p{k} AS (SELECT m.{key}, m.n, m.w, {rows}.xs, CAST(label > 0.5 AS INT) AS yy, CASE WHEN label > 0.5 THEN 2.0 ELSE 1.0 END AS sw,
          1/(1+exp(-least(greatest(list_dot_product({rows}.xs, m.w), -30.0), 30.0))) AS p FROM {rows} JOIN m{k} m ON {on})""",
          f"""g{k} AS (SELECT {key}, i, sum((p-yy)*sw*xs[i+1]) AS g, any_value(w[i+1]) AS old, any_value(n) AS n FROM p{k}, (SELECT unnest(range({features})) AS i) GROUP BY ALL)""",
          f"""m{k + 1} AS (SELECT {key}, any_value(n) AS n, any_value(loss) AS loss, list(old-0.2*g/n ORDER BY i) AS w FROM g{k} JOIN
          (SELECT {key}, -avg(sw*(yy*ln(p+1e-7)+(1-yy)*ln(1-p+1e-7))) AS loss FROM p{k} GROUP BY 1) USING ({key}) GROUP BY 1)"""]
    return ",\n".join(steps)


_SCORED = "1/(1+exp(-least(greatest(list_dot_product(t.xs, m.w), -30.0), 30.0)))"


@query("e16_logreg_scores", f"WITH {_FEATURES}, {descent_sql('t', 'grp', 4, 1, 4)} SELECT segment, map_id, y, x, label, round({_SCORED}, 9) AS prob FROM t JOIN m4 m ON t.segment = m.grp")
def e16(spark, sf):
    data = T.checkpointed(training_pixels(spark, sf))
    model = T.train_logreg(data, ["segment"])
    return rounded(T.score_logreg(data, model, ["segment"]).select("segment", "map_id", "y", "x", "label", "prob"))


def channel_patches(spark, sf):
    """Embeddings as patches of four channels of 4 x 4 pixels, with a label per pixel and a segment."""
    e = views.table(spark, sf, "embeddings").select("vec_id", F.col("label").alias("segment"), F.col("embedding").cast("array<double>").alias("image"), F.lit(4).alias("h"), F.lit(4).alias("w"))
    features = C.patch_features(e, ["vec_id", "segment"], 4, 2)
    return features.withColumn("label", (F.col("v_2") + F.col("v_1") > 0.02).cast("int"))


_CHANNELS = """e AS (SELECT vec_id, label AS segment, CAST(embedding AS DOUBLE[]) AS a, y, x FROM embeddings, (SELECT unnest(range(4)) AS y), (SELECT unnest(range(4)) AS x)),
c AS (SELECT *, list_transform(range(4), lambda c: a[c*16+y*4+x+1]) AS v, list_transform(range(4), lambda c: (a[c*16+((y+3)%4)*4+x+1]+a[c*16+((y+1)%4)*4+x+1]+a[c*16+y*4+(x+3)%4+1]+a[c*16+y*4+(x+1)%4+1])/4.0) AS m FROM e),
t AS (SELECT vec_id, segment, y, x, CAST(v[3]+v[2] > 0.02 AS INT) AS label, list_concat([1.0], list_concat(flatten(list_transform(range(4), lambda c: [v[c+1], m[c+1], v[c+1]-m[c+1]])),
  [list_avg(v), v[3]-list_avg(v), list_stddev_pop(v), v[4]-v[1]])) AS xs FROM c)"""


@query("c10_channel_patches", f"WITH {_CHANNELS} SELECT vec_id, y, x, label, round(list_sum(list_transform(xs, lambda q, i: q*i)), 9) AS weighed, round(xs[15], 9) AS depth_center_diff, round(xs[16], 9) AS depth_std FROM t")
def c10_patches(spark, sf):
    weighed = sum((F.col(n) * (i + 1.0) for i, n in enumerate(C.feature_names(4, 2))), F.lit(0.0))
    return rounded(channel_patches(spark, sf).select("vec_id", "y", "x", "label", weighed.alias("weighed"), "depth_center_diff", "depth_std"))


@query("e16_channel_models", f"WITH {_CHANNELS}, {descent_sql('t', 'grp', 17, 0, 2)} SELECT grp AS segment, n, round(loss, 7) AS train_loss, i AS feature, round(w[i+1], 7) AS weight FROM m2, (SELECT unnest(range(17)) AS i)")
def e16_channels(spark, sf):
    names = C.feature_names(4, 2)
    model = T.train_logreg(T.checkpointed(channel_patches(spark, sf)), ["segment"], T.LogregConfig(features=names, epochs=2))
    weights = F.posexplode(F.array(*[f"w_{n}" for n in names])).alias("feature", "weight")
    return rounded(model.select("segment", "n", "train_loss", weights), 7)


@query("g5_loo_models", f"WITH {_CHANNELS}, {descent_sql('t', 'held', 17, 0, 2, True)} SELECT held AS heldout_segment, n, round(loss, 7) AS train_loss, i AS feature, round(w[i+1], 7) AS weight FROM m2, (SELECT unnest(range(17)) AS i)")
def g5_models(spark, sf):
    names = C.feature_names(4, 2)
    model = T.train_leave_out(T.checkpointed(channel_patches(spark, sf)), "segment", T.LogregConfig(features=names, epochs=2))
    weights = F.posexplode(F.array(*[f"w_{n}" for n in names])).alias("feature", "weight")
    return rounded(model.select("heldout_segment", "n", "train_loss", weights), 7)


@query("e16_logreg_one_step", """
WITH f AS (SELECT map_id % 5 AS segment, prob AS v, label FROM V_MAP), pr AS (SELECT segment, count(*) AS n, least(greatest(avg(label), 1e-4), 1-1e-4) AS p, sum(label) AS pos FROM f GROUP BY 1),
g AS (SELECT segment, sum((p-label)*CASE WHEN label = 1 THEN 2.0 ELSE 1.0 END*v) AS gv, sum((p-label)*CASE WHEN label = 1 THEN 2.0 ELSE 1.0 END) AS gb,
  -avg(CASE WHEN label = 1 THEN 2.0 ELSE 1.0 END*(label*ln(p+1e-7)+(1-label)*ln(1-p+1e-7))) AS loss FROM f JOIN pr USING (segment) GROUP BY 1)
SELECT segment, n, round(-0.2*gv/n, 6) AS w_v, round(ln(p/(1-p))-0.2*gb/n, 6) AS w_bias, round(loss, 6) AS train_loss FROM g JOIN pr USING (segment)""")
def e16_step(spark, sf):
    cfg = T.LogregConfig(features=["v", "bias"], epochs=1)
    data = views.maps(spark, sf).select((F.col("map_id") % 5).cast("int").alias("segment"), F.col("prob").alias("v"), F.lit(1.0).alias("bias"), "label")
    return rounded(T.train_logreg(data, ["segment"], cfg).select("segment", "n", "w_v", "w_bias", "train_loss"), 6)


@query("g5_loo_evaluation")
def g5(spark, sf):
    out = T.loo_evaluate(training_pixels(spark, sf), "segment", [11001, 11018], ["map_id", "y", "x"], T.LogregConfig(epochs=2), EvalConfig(max_ratio=2.5))
    return rounded(out)


@query("l1_predicted_map", """SELECT segment, y, x, CASE WHEN prob >= 0.55 THEN 1.0 ELSE 0.0 END AS prob FROM V_BIGMAP""")
def l1(spark, sf):
    px = views.bigmap(spark, sf).select("segment", F.lit(0).alias("c"), "y", "x", F.col("prob").alias("v"))
    patches = C.extract_patches(px, ["segment"], 16, 8)
    tiles = P.predict(patches, lambda: lambda images: images[:, 0] >= 0.55, ["segment"], 1, 16)
    return rounded(C.stitch(P.tile_pixels(tiles, ["segment"], 16), ["segment"], 16).select("segment", "y", "x", "prob"), 6)


_DICE = """SELECT run_id, fold, round(2.0*tp/(2.0*tp+fp+fn+1e-12), 9) AS dice FROM (SELECT run_id, fold, count(*) FILTER (WHERE prob >= 0.5 AND label >= 0.5) AS tp,
 count(*) FILTER (WHERE prob >= 0.5 AND label < 0.5) AS fp, count(*) FILTER (WHERE prob < 0.5 AND label >= 0.5) AS fn FROM V_SCORES GROUP BY ALL)"""


@query("l2_dice_aggregate", _DICE)
def l2(spark, sf):
    s = views.scores(spark, sf)
    return rounded(s.groupBy("run_id", "fold").agg(P.dice_udaf(F.col("prob"), F.col("label")).alias("dice")))


@query("k1_streaming_dice", _DICE)
def k1(spark, sf):
    lines = read_stream(spark, sf, "lineitem")
    scores = lines.selectExpr(
        "l_suppkey AS run_id", "l_linenumber AS fold", "(l_quantity/50.0)*0.6 + l_discount*4.0 AS prob",
        "CASE WHEN l_quantity + l_discount*100.0 + l_tax*100.0 >= 52.0 THEN 1 ELSE 0 END AS label")
    where = f"{shared_folder(spark)}/dice_{uuid.uuid4().hex[:8]}"
    state = K.DiceState(f"{where}/state", 0.5, ["run_id", "fold"])
    state.follow(scores, f"{where}/log").awaitTermination()
    return rounded(state.read(spark).select("run_id", "fold", "dice"))


_CODE = """CASE WHEN line LIKE '%NO_PROGRESS_CAUSE code=mem_guard%' THEN 'mem_guard' WHEN line LIKE '%SKIP load_guard%' THEN 'load_guard' WHEN line LIKE '%deduped%' THEN 'deduped_existing_run' WHEN line LIKE '%exit_code=124%' THEN 'timeout' END"""


@query("k2_log_causes", f"SELECT event_id, {_CODE} AS code, substr(line, 2, 19) AS timestamp FROM V_LOG WHERE {_CODE} IS NOT NULL")
def k2(spark, sf):
    return K.classify_log(views.log_lines(spark, sf)).select("event_id", "code", "timestamp")


@query("k2_streaming_cause_counts", f"SELECT {_CODE} AS code, count(*) AS lines, max(substr(line, 2, 19)) AS latest FROM V_LOG WHERE {_CODE} IS NOT NULL GROUP BY 1")
def k2_stream(spark, sf):
    lines = read_stream(spark, sf, "events").selectExpr(
        """concat('[2026-05-29T', lpad(CAST(event_id%24 AS STRING),2,'0'), ':00:00] ', CASE event_type WHEN 'error' THEN 'SKIP load_guard load1=9' WHEN 'view' THEN 'NO_PROGRESS_CAUSE code=mem_guard x'
        WHEN 'signup' THEN 'run deduped_existing_run' WHEN 'click' THEN 'job exit_code=124' ELSE 'ok' END) AS line""")
    return _stream_table(K.cause_counts(K.classify_log(lines)), "causes", "complete")


@query("k3_streaming_loo_progress", """SELECT l_suppkey AS label, count(*) AS completed, count(*) FILTER (WHERE l_tax > 0.07) AS failed, 1000 AS total, 1000 - count(*) AS remaining FROM lineitem GROUP BY 1""")
def k3(spark, sf):
    rows = read_stream(spark, sf, "lineitem").selectExpr("l_suppkey AS label", "CASE WHEN l_tax > 0.07 THEN 1 ELSE 0 END AS returncode")
    return _stream_table(K.loo_progress(rows, ["label"], 1000), "progress", "complete")


_EVENTS = """SELECT user_id AS job_id, event_id, ts AS event_at, CASE event_type WHEN 'view' THEN 'queued' WHEN 'click' THEN 'leased' WHEN 'signup' THEN 'succeeded' ELSE 'failed' END AS status"""


@query("k4_job_states", """WITH e AS (SELECT user_id AS job_id, event_id, ts, CASE event_type WHEN 'view' THEN 'queued' WHEN 'click' THEN 'leased' WHEN 'signup' THEN 'succeeded' ELSE 'failed' END AS status FROM events),
l AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, event_id DESC) AS rn FROM e), a AS (SELECT job_id, min(ts) AS created_at, count(*) FILTER (WHERE status = 'leased') AS attempts FROM e GROUP BY 1)
SELECT l.job_id, created_at, attempts, status, status = 'queued' OR (status = 'leased' AND ts + INTERVAL 1 HOUR <= TIMESTAMP '2024-01-20 00:00:00') AS leasable FROM l JOIN a USING (job_id) WHERE rn = 1""")
def k4(spark, sf):
    e = views.table(spark, sf, "events").selectExpr(
        "user_id AS job_id", "event_id", "ts AS event_at", "ts AS created_at", "'w' AS worker_id",
        "CASE event_type WHEN 'view' THEN 'queued' WHEN 'click' THEN 'leased' WHEN 'signup' THEN 'succeeded' ELSE 'failed' END AS status", "ts + INTERVAL 1 HOUR AS lease_expires_at")
    return K.job_state(e, F.expr("TIMESTAMP '2024-01-20 00:00:00'")).select("job_id", "created_at", "attempts", "status", "leasable")


@query("k5_streaming_dedupe_keys", "SELECT DISTINCT concat(event_type, '_', user_id) AS dedupe_key FROM events")
def k5(spark, sf):
    s = read_stream(spark, sf, "events").selectExpr("concat(event_type, '_', user_id) AS dedupe_key", "CAST(ts AS TIMESTAMP) AS ts")
    return _stream_table(K.stream_dedupe(s, "dedupe_key", "ts", "3650 days"), "dedupe", "append").select("dedupe_key")


@query("k5_deduped_configs", "SELECT concat(event_type, '_', user_id) AS dedupe_key, arg_min(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1")
def k5_batch(spark, sf):
    e = views.table(spark, sf, "events").selectExpr("concat(event_type, '_', user_id) AS dedupe_key", "event_id", "ts")
    return K.dedupe_batch(e, "dedupe_key", "ts", "event_id").select("dedupe_key", "event_id")
