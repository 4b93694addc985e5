"""Rule columns over configurations, metadata and patch sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalgate.functions.columns import first_reason, reasons
from evalgate.functions.tables import (
    COST_RANK,
    FOLD_PATHS,
    MUTATION_FAMILIES,
    OPTIONAL_METRICS,
    PARAM_BOUNDS,
    PLANNER_SECTION,
    RANGE_RULES,
    REQUIRED_METRICS,
    SEARCH_DEFAULTS,
    VOLATILE_KEYS,
)


def lookup(values: dict, key: Column) -> Column:
    """Value of a small fixed table, as a literal map inside the projection."""
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[key]


# ---------------------------------------------------------------- documents


def kind(v: Column) -> Column:
    """number, string, boolean, object, array or null of a variant value."""
    return _kind_of(F.schema_of_variant(v))


def _kind_of(s: Column) -> Column:
    return (F.when(s.startswith("OBJECT"), "object").when(s.startswith("ARRAY"), "array").when(s == "BOOLEAN", "boolean")
            .when(s == "STRING", "string").when(s == "VOID", "null").when(s.isNotNull(), "number"))


def cfg(doc: Column, path: str, kind_name: str = "string", default=None) -> Column:
    """Nested value of a configuration with a default."""
    value = F.try_variant_get(doc, f"$.{path}", kind_name)
    return value if default is None else F.coalesce(value, F.lit(default))


def nesting(doc: Column) -> Column:
    """Levels of braces in a document, an upper bound of its nested objects."""
    braces = F.regexp_replace(F.to_json(doc), "[^{}]", "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(level: Column, brace: Column) -> Column:
        now = level["now"] + F.when(brace == "{", 1).otherwise(-1)
        return F.struct(now.alias("now"), F.greatest(level["most"], now).alias("most"))

    return F.aggregate(F.split(braces, "(?!^)"), start, step, lambda level: level["most"])


def config_kv(df: DataFrame, key: str, doc: str, depth: int | None = None) -> DataFrame:
    """One row per leaf (dotted path, variant value, kind); lists are leaves.

    The levels are chained lateral explodes in one pass: a leaf stays as it is while nested
    objects open further. There are as many levels as the deepest document has, unless a
    depth is given.
    """
    if depth is None:
        depth = df.select(F.max(nesting(F.col(doc))).alias("n")).first()["n"] or 0
    out = df.select(key, F.lit("").alias("path"), F.col(doc).alias("v"))
    tvf = df.sparkSession.tvf
    for _ in range(depth):
        opened = F.when(F.schema_of_variant("v").startswith("OBJECT"), F.col("v"))
        out = out.select(key, "path", "v", opened.alias("_o"))
        out = out.lateralJoin(tvf.variant_explode_outer(F.col("_o").outer()).toDF("_pos", "_key", "_value"))
        path = F.when(F.col("_key").isNull(), F.col("path")).when(F.col("path") == "", F.col("_key")).otherwise(
            F.concat_ws(".", "path", "_key"))
        out = out.select(key, path.alias("path"), F.when(F.col("_key").isNull(), F.col("v")).otherwise(F.col("_value")).alias("v"))
    return out.filter("path <> ''").withColumn("_schema", F.schema_of_variant("v")).withColumn("kind", _kind_of(F.col("_schema"))).drop("_schema")


def leaf_text(v: Column, k: Column) -> Column:
    """Canonical text of a leaf of kind ``k``: numbers as rounded doubles, lists as JSON."""
    number = F.round(F.try_variant_get(v, "$", "double"), 10).cast("string")
    return F.when(k == "null", "null").when(k == "number", number).when(k.isin("array", "object"), F.to_json(v)).otherwise(
        F.try_variant_get(v, "$", "string"))


def config_signature(kv: DataFrame, key: str) -> DataFrame:
    """sha256 of the sorted leaves without volatile keys at any level; one config per group."""
    parts = F.split("path", r"\.")
    keep = kv.filter(~F.arrays_overlap(parts, F.array(*[F.lit(k) for k in VOLATILE_KEYS])))
    typed = F.struct("path", F.concat("kind", F.lit(":"), leaf_text(F.col("v"), F.col("kind"))).alias("value"))
    text = F.to_json(F.sort_array(F.collect_list(typed)))
    return keep.groupBy(key).agg(F.sha2(text, 256).alias("config_signature"))


def search_signature(kv: DataFrame, key: str) -> DataFrame:
    """sha256 over the searched paths with defaults; depth above 3 counts as 3.

    Needs leaves opened two levels deep (``config_kv(..., depth=2)``); a config contributes
    at most one entry per searched path.
    """
    text = leaf_text(F.col("v"), F.col("kind"))
    deep = (F.col("path") == "model.depth") & (F.col("kind") == "number") & (F.try_variant_get("v", "$", "double") > 3)
    searched = F.col("path").isin(list(SEARCH_DEFAULTS))
    kv = kv.select(key, F.when(searched, F.struct("path", F.when(deep, "3.0").otherwise(F.coalesce(text, F.lit("null"))))).alias("_e"))
    found = F.map_from_entries(F.collect_list("_e"))
    wanted = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(d).alias("d")) for p, d in SEARCH_DEFAULTS.items()])
    canonical = F.array_join(F.transform(wanted, lambda w: F.coalesce(F.element_at(found, w["p"]), w["d"])), "|")
    return kv.groupBy(key).agg(F.sha2(canonical, 256).alias("search_signature"))


def search_key(doc: Column) -> Column:
    """`search_signature` of a document as a projection: the searched paths are fixed, so nothing is opened or grouped."""
    found = F.array(*[F.struct(F.try_variant_get(doc, f"$.{p}", "variant").alias("v"), F.lit(d).alias("d"), F.lit(p == "model.depth").alias("cut")) for p, d in SEARCH_DEFAULTS.items()])
    # a step each for schema and kind: inside a lambda a repeated expression is worked out again
    schemas = F.transform(found, lambda e: F.struct(e["v"].alias("v"), e["d"].alias("d"), e["cut"].alias("cut"), F.schema_of_variant(e["v"]).alias("s")))
    kinds = F.transform(schemas, lambda e: F.struct(e["v"].alias("v"), e["d"].alias("d"), e["cut"].alias("cut"), _kind_of(e["s"]).alias("k")))

    def part(e: Column) -> Column:
        deep = e["cut"] & (e["k"] == "number") & (F.try_variant_get(e["v"], "$", "double") > 3)
        return F.when(e["v"].isNull(), e["d"]).when(deep, "3.0").otherwise(F.coalesce(leaf_text(e["v"], e["k"]), F.lit("null")))

    return F.sha2(F.array_join(F.transform(kinds, part), "|"), 256)


def loo_signature(kv: DataFrame, key: str) -> DataFrame:
    """sha256 of the sorted leaves without what differs between the folds and seeds of one configuration; one per group.

    Needs leaves at any depth (``config_kv``). A cut path goes with all that is below it; other leaves count however deep.
    """
    cut = F.lit(False)
    for path in FOLD_PATHS:
        cut = cut | (F.col("path") == path) | F.startswith(F.col("path"), F.lit(f"{path}."))
    typed = F.struct("path", F.concat("kind", F.lit(":"), leaf_text(F.col("v"), F.col("kind"))).alias("value"))
    kept = F.sort_array(F.collect_list(F.when(~cut, typed)))
    return kv.groupBy(key).agg(F.sha2(F.to_json(kept), 256).alias("loo_signature"))


def profile_violations(doc: Column, max_epochs: int = 8, sample_cap: int = 1024, pixel_cap: int = 600000) -> dict[str, Column]:
    """Resolved run profile and the first limit it breaks."""
    explicit = F.nullif(cfg(doc, f"{PLANNER_SECTION}.run_profile"), F.lit(""))
    intent = cfg(doc, f"{PLANNER_SECTION}.intent", default="")
    exploring = ["cron_exploration", "promotion_action", "bounded_training_probe", "bounded_worst_fold_diagnostic"]
    promoting = ["promotion_validation", "seed_repeat_leave_one_out"]
    profile = F.coalesce(explicit, F.when(intent.isin(exploring), "exploration").when(intent.isin(promoting), "promotion"))
    torch = cfg(doc, "model.name", default="").contains("torch")
    epochs = cfg(doc, "training.epochs", "int", 0)
    seeds = F.size(F.coalesce(F.try_variant_get(doc, "$.training.seeds", "array<variant>"), F.array()))
    samples = cfg(doc, "training.max_train_samples", "int", 0)
    pixels = F.coalesce(F.nullif(cfg(doc, "training.max_train_pixels", "int"), F.lit(0)), F.lit(pixel_cap))
    heldout = cfg(doc, f"{PLANNER_SECTION}.heldout_segment", default="")
    explore = profile == "exploration"
    violation = first_reason(
        (explore & (epochs > max_epochs), "epochs_above_cap"),
        (explore & (seeds > 1), "seed_ensemble_not_allowed"),
        (explore & torch & ((samples <= 0) | (samples > sample_cap)), "train_samples_outside_cap"),
        (explore & ~torch & (pixels > pixel_cap), "train_pixels_above_cap"),
        ((profile == "promotion") & (heldout == ""), "heldout_segment_missing"),
    )
    return {"run_profile": profile, "violation": violation}


def cost_tier(doc: Column, sample_max: int = 2048, pixel_max: int = 600000, epoch_max: int = 8) -> Column:
    name = cfg(doc, "model.name", default="tiny_numpy_ink_logreg")
    epochs = F.coalesce(F.nullif(cfg(doc, "training.epochs", "int"), F.lit(0)), F.lit(5))
    samples = cfg(doc, "training.max_train_samples", "int", 0)
    pixels = F.coalesce(F.nullif(cfg(doc, "training.max_train_pixels", "int"), F.lit(0)), F.lit(600000))
    seeds = F.size(F.coalesce(F.try_variant_get(doc, "$.training.seeds", "array<variant>"), F.array(F.lit(None).cast("variant"))))
    tta = cfg(doc, "evaluation.tta_flips", "boolean", False)
    return first_reason(
        ((seeds > 1) | tta | (samples > sample_max) | (pixels > pixel_max) | (epochs > epoch_max), "expensive"),
        ((name == "tiny_numpy_ink_logreg") & (epochs <= 5), "cheap"),
        (name == "tiny_numpy_mlp", "normal"),
        (name.contains("torch"), "normal"),
        default="expensive",
    )


def cost_rank(tier: Column) -> Column:
    return F.coalesce(lookup(COST_RANK, tier), F.lit(2))


def mutation_family(path: Column) -> Column:
    return F.coalesce(lookup({p: f for f, paths in MUTATION_FAMILIES.items() for p in paths}, path), F.lit("other"))


def clamp_value(path: Column, value: Column, is_int: Column) -> Column:
    """Value inside its path's bounds; unknown paths keep it and whole numbers stay whole."""
    low, high = (lookup({p: b[i] for p, b in PARAM_BOUNDS.items()}, path) for i in (0, 1))
    out = F.coalesce(F.least(high, F.greatest(low, value)), value)
    return F.when(is_int, F.when(out < 0, F.ceil(out)).otherwise(F.floor(out)).cast("double")).otherwise(out)


def clamp(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Clamped candidates, first one per (keys, path, value); needs ordinal, path, value, is_int."""
    rest = [c for c in candidates.columns if c not in {*keys, "path", "value"}]
    out = candidates.withColumn("value", clamp_value(F.col("path"), F.col("value"), F.col("is_int")))
    return out.groupBy(*keys, "path", "value").agg(F.min_by(F.struct(*rest), "ordinal").alias("r")).select(
        *keys, "path", "value", "r.*")


def scope_priority(scope: Column, policy: Column) -> Column:
    label = F.concat_ws(" ", F.coalesce(scope, F.lit("")), F.coalesce(policy, F.lit("")))
    return (F.when(label.contains("multi_segment_robust_expanded_tta_ensemble"), 0)
            .when(label.contains("multi_segment_robust_expanded"), 1)
            .when(label.contains("expanded_multi_segment") | label.contains("expanded_leave_one_out"), 2)
            .when(label.contains("multi_segment"), 3).when(label.contains("focused_pair_residual_25d_cpu"), 4).otherwise(5))


def validation_priority(mode: Column) -> Column:
    return F.when(mode == "cross-scroll", 0).when(mode == "leave-one-segment-out", 1).when(mode == "cross-segment", 2).otherwise(3)


def is_robust(model: Column, scope: Column, policy: Column) -> Column:
    label = F.lower(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in (model, scope, policy)]))
    tokens = ["multi_segment_robust", "expanded_multi_segment", "expanded_leave_one_out", "focused_pair_residual_25d_cpu"]
    hit = F.lit(False)
    for t in tokens:
        hit = hit | label.contains(t)
    return label.contains("torch") & hit


def oversized(kv: DataFrame, key: str, limit: float = 64.0) -> DataFrame:
    """Keys whose config has a patch or window size leaf above the limit, alone or inside a list."""
    name = F.lower(F.element_at(F.split("path", r"\."), -1))
    scalar = F.when(F.col("kind") == "number", F.try_variant_get("v", "$", "double")) > limit
    listed = F.exists(F.coalesce(F.try_variant_get("v", "$", "array<variant>"), F.array()),
                      lambda x: F.coalesce(F.when(kind(x) == "number", F.try_variant_get(x, "$", "double")) > limit, F.lit(False)))
    named = kv.filter(name.isin("patch_size", "window_size", "patch_shape", "window_shape"))
    return named.filter(F.coalesce(scalar, F.lit(False)) | listed).select(key).distinct()


def config_violations(doc: Column) -> Column:
    """Array of broken range, word, pairing and ordering rules, in rule order."""
    checks = []
    for path, low, high, is_open, words in RANGE_RULES:
        v = F.try_variant_get(doc, f"$.{path}", "variant")
        k = kind(v)
        num = F.when(k == "number", F.try_variant_get(v, "$", "double"))
        bad = F.lit(False)
        if low is not None:
            bad = bad | ((num <= low) if is_open else (num < low))
        if high is not None:
            bad = bad | (num > high)
        if words:
            bad = bad | ((k == "string") & ~F.try_variant_get(v, "$", "string").isin(words))
        checks.append((F.coalesce(bad, F.lit(False)), path))

    def given(path: str) -> Column:
        return F.coalesce(cfg(doc, path), F.lit("")) != ""

    seeds = F.try_variant_get(doc, "$.training.seeds", "array<variant>")
    hi, lo = (cfg(doc, f"evaluation.{m}_pred_positive_rate_ratio", "double") for m in ("max", "min"))
    checks += [
        (given("dataset.train_npz") != given("dataset.val_npz"), "dataset.train_val_pair"),
        (F.coalesce(F.size(seeds) == 0, F.lit(False)), "training.seeds_empty"),
        (F.coalesce(lo > hi, F.lit(False)), "evaluation.ratio_order"),
    ]
    return reasons(*checks)


# ---------------------------------------------------------------- metric contract


def contract_error(doc: Column) -> Column:
    """First broken metric key of a run's metrics document, NULL when the contract holds."""
    words = {"number": "int or float", "string": "str", "object": "dict", "boolean": "bool"}
    pairs: list[tuple[Column, str]] = [(F.coalesce(kind(doc), F.lit("missing")) != "object", "metrics must be an object")]
    for name, want in REQUIRED_METRICS.items():
        v = F.try_variant_get(doc, f"$.{name}", "variant")
        pairs.append((v.isNull(), f"metrics missing required key: {name}"))
        pairs.append((kind(v) != want, f"metrics key {name} must be {words[want]}"))
    for name, want in OPTIONAL_METRICS.items():
        v = F.try_variant_get(doc, f"$.{name}", "variant")
        pairs.append((~kind(v).isin(want, "null"), f"metrics key {name} must be {words[want]}"))
    return first_reason(*pairs)


def validate_runs(runs: DataFrame, doc: str = "metrics") -> DataFrame:
    """Add ``contract_error`` and the two readiness flags with their defaults."""
    m = F.col(doc)
    return runs.withColumns({
        "contract_error": contract_error(m),
        "loo_promotion_ready": cfg(m, "loo_promotion_ready", "boolean", False),
        "full_tile_promotion_ready": cfg(m, "full_tile_promotion_ready", "boolean", False),
    })


# ---------------------------------------------------------------- metadata


def validation_setup(train_scroll: Column, val_scroll: Column, train_segment: Column, val_segment: Column,
                     train_segments: Column, heldout: Column) -> dict[str, Column]:
    """Validation mode and its warning from train and validation metadata."""

    def known(c: Column) -> Column:
        return F.coalesce(c.cast("string"), F.lit("?"))

    ts, vs, a, b, held = (known(c) for c in (train_scroll, val_scroll, train_segment, val_segment, heldout))
    members = F.coalesce(train_segments.cast("array<string>"), F.array().cast("array<string>"))
    listed = (F.size(members) > 0) & (b != "?")
    inside = F.array_contains(members, b)
    mode = first_reason(
        ((ts != "?") & (vs != "?") & (ts != vs), "cross-scroll"),
        (listed & ~inside & held.isin("?") | (listed & ~inside & (held == b)), "leave-one-segment-out"),
        (listed & ~inside, "cross-segment"),
        (listed & inside, "spatial-same-segment"),
        ((a != "?") & (b != "?") & (a != b), "cross-segment"),
        default="spatial-same-segment",
    )
    warning = F.when(mode != "spatial-same-segment", None).when(listed & inside, "validation_segment_in_train_segments").otherwise(
        "spatial_split_of_one_segment")
    return {"mode": mode, "warning": warning}


def promotion_checks(mode: Column, train_segment: Column, train_segments: Column, val_segment: Column, segment: Column) -> Column:
    """Warnings that make an inference segment ineligible, in order."""
    seg = segment.cast("string")
    train = F.coalesce(train_segment.cast("string"), F.lit(""))
    val = F.coalesce(val_segment.cast("string"), F.lit(""))
    members = F.coalesce(train_segments.cast("array<string>"), F.array().cast("array<string>"))
    training = ((train != "") & (train == seg)) | F.array_contains(members, seg)
    held = mode.isin("cross-segment", "cross-scroll", "leave-one-segment-out")
    return reasons(
        (training, "inference segment matches training segment; treat as diagnostic-only"),
        (~held, F.concat(F.lit("validation mode is "), mode, F.lit("; promotion requires held-out segment evidence"))),
        ((val != "") & (val != seg) & ((mode != "leave-one-segment-out") | training),
         "inference segment does not match recorded validation segment"),
    )


def provenance_segments(doc: Column, scalar_keys: list[str] | None = None, list_keys: list[str] | None = None) -> Column:
    """Sorted segment ids a metadata document mentions, without the unknown mark."""
    scalar_keys = scalar_keys or ["segment_id", "heldout_segment", "mined_segment_id", "source_segment_id"]
    list_keys = list_keys or ["train_segments", "segments", "source_segments", "forbidden_heldout_segments"]

    def both(path: str, t: str) -> Column:
        return F.coalesce(F.try_variant_get(doc, f"$.metadata.{path}", t), F.try_variant_get(doc, f"$.{path}", t))

    singles = F.array(*[both(k, "string") for k in scalar_keys], both("parent_full_tile.segment_id", "string"))
    lists = [F.coalesce(both(k, "array<string>"), F.array().cast("array<string>")) for k in list_keys]
    found = F.array_distinct(F.array_compact(F.concat(singles, *lists)))
    return F.sort_array(F.array_except(found, F.array(F.lit("?"), F.lit(""))))


def target_rate(raw: Column, train_rate: Column, val_rate: Column) -> Column:
    """Numeric target, ``auto``/``auto_val``/``val`` = validation rate, ``auto_train``/``train`` = clipped train rate."""
    word = F.lower(F.trim(raw))
    clipped = F.least(F.greatest(train_rate, F.lit(1e-6)), F.lit(0.5))
    number = raw.try_cast("double")
    return (F.when(raw.isNull(), None).when(word.isin("auto", "auto_val", "val"), val_rate)
            .when(word.isin("auto_train", "train"), clipped).when(number.isNotNull(), number)
            .otherwise(F.raise_error(F.concat(F.lit("bad positive-rate target: "), raw)).cast("double")))


# ---------------------------------------------------------------- patch sets


def validate_patches(patches: DataFrame, file: str, patch_size: int | None = None) -> DataFrame:
    """One row per file: sample count, label statistics and the first schema error.

    Patches carry ``image``/``label`` float arrays and ``channels, h, w, label_channels``.
    """

    def not_finite(arr: str) -> Column:
        return F.exists(arr, lambda v: F.isnan(v) | (F.abs(v) == float("inf")))

    positives = F.aggregate("label", F.lit(0).cast("long"), lambda acc, v: acc + F.when(v > 0.5, 1).otherwise(0))
    agg = patches.groupBy(file).agg(
        F.count(F.lit(1)).alias("samples"),
        F.count_if(F.col("image").isNull() | F.col("label").isNull()).alias("_missing"),
        F.count_if(F.col("channels") < 1).alias("_channels"), F.count_if(F.col("label_channels") != 1).alias("_label_channels"),
        F.count_if((F.size("image") != F.col("channels") * F.col("h") * F.col("w"))
                   | (F.size("label") != F.col("h") * F.col("w"))).alias("_shape"),
        (F.min(F.struct("channels", "h", "w")) != F.max(F.struct("channels", "h", "w"))).alias("_mixed"),
        F.max(F.greatest("h", "w")).alias("patch_size"), F.min(F.least("h", "w")).alias("_min_size"),
        F.count_if(not_finite("image")).alias("_image_bad"), F.count_if(not_finite("label")).alias("_label_bad"),
        (F.sum(positives) / F.sum(F.size("label"))).alias("positive_rate"),
        F.min(F.array_min("label")).alias("label_min"), F.max(F.array_max("label")).alias("label_max"),
    )
    size_bad = F.lit(False) if patch_size is None else (F.col("patch_size") != patch_size) | (F.col("_min_size") != patch_size)
    error = first_reason(
        (F.col("_missing") > 0, "missing_keys"), (F.col("_channels") > 0, "image_shape"),
        (F.col("_label_channels") > 0, "label_shape"), ((F.col("_shape") > 0) | F.col("_mixed"), "shape_mismatch"),
        (size_bad, "patch_size"), (F.col("_image_bad") > 0, "image_not_finite"), (F.col("_label_bad") > 0, "label_not_finite"),
    )
    return agg.select(file, "samples", "patch_size", "positive_rate", "label_min", "label_max", error.alias("error"))


def align_labels(pixels: DataFrame, keys: list[str], sizes: DataFrame) -> DataFrame:
    """Integer-stride label alignment then crop.

    ``sizes`` has one row per key with ``src_h, src_w, dst_h, dst_w``; strides round half to even.
    """
    joined = pixels.join(sizes, keys)
    sy = F.greatest(F.lit(1), F.bround(F.col("src_h") / F.col("dst_h"))).cast("int")
    sx = F.greatest(F.lit(1), F.bround(F.col("src_w") / F.col("dst_w"))).cast("int")
    same = (F.col("src_h") == F.col("dst_h")) & (F.col("src_w") == F.col("dst_w"))
    sy, sx = F.when(same, 1).otherwise(sy), F.when(same, 1).otherwise(sx)
    ny, nx = F.floor(F.col("y") / sy).cast("int"), F.floor(F.col("x") / sx).cast("int")
    rest = [c for c in pixels.columns if c not in {*keys, "y", "x"}]
    kept = joined.filter((F.col("y") % sy == 0) & (F.col("x") % sx == 0) & (ny < F.col("dst_h")) & (nx < F.col("dst_w")))
    return kept.select(*keys, ny.alias("y"), nx.alias("x"), *rest)


def normalize(pixels: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    """Clip each (segment, layer) to its 1 % and 99 % quantiles and scale to [0, 1].

    The quantiles come from collapsed value counts through the running-count path, so a
    large layer is not held in one aggregation buffer.
    """
    from evalgate.operators.metrics import quantiles, running_counts

    counts = pixels.groupBy(*keys, F.col(value).cast("double").alias("prob")).agg(
        F.count(F.lit(1)).alias("n"), F.lit(0).cast("long").alias("pos"))
    q = quantiles(running_counts(counts, keys), keys, [0.01, 0.99])
    bounds = q.groupBy(*keys).agg(
        F.max(F.when(F.col("q_index") == 0, F.col("threshold"))).alias("_lo"),
        F.max(F.when(F.col("q_index") == 1, F.col("threshold"))).alias("_hi"))
    scaled = (F.col(value) - F.col("_lo")) / F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1e-6))
    return pixels.join(bounds, keys).withColumn(
        "normalized", F.least(F.greatest(scaled, F.lit(0.0)), F.lit(1.0))).drop("_lo", "_hi")
