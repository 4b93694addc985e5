"""Rule tables: fixed values that must equal the published tool's for right results."""

from __future__ import annotations

# Keys left out of the configuration signature.
VOLATILE_KEYS = [
    "artifact_dir", "artifact_path", "artifacts_dir", "config_signature", "created_at", "db_path", "dedupe_key",
    "log_dir", "metrics", "output", "output_dir", "outputs", "resolved_data", "result_json", "run_dir", "run_id",
    "secondary_metrics_json", "timestamp", "updated_at", "validation_setup", "proposal_id", "proposal_status",
    "proposal_score", "proposal_score_components", "triage_failures", "score_reasons", "optuna_trial_number",
    "optuna_study_name", "optuna_storage",
]

# Mutation family of a changed path; anything else is "other".
MUTATION_FAMILIES = {
    "balanced_calibration": ["balanced_calibration"],
    "hard_fold_sampling_calibration": ["hard_fold_sampling_calibration"],
    "augmentation_policy": ["training.augment_flips", "training.augment_rotation"],
    "z_context": ["dataset.z_offsets"],
    "optimizer": ["training.learning_rate", "training.weight_decay", "training.epochs", "training.batch_size"],
    "loss_calibration": [
        "training.pos_weight", "training.dice_loss_weight", "training.focal_loss_weight", "training.focal_gamma",
        "training.positive_rate_loss_weight", "training.positive_rate_loss_tolerance", "training.tversky_loss_weight",
        "training.tversky_alpha", "training.tversky_beta", "training.focal_tversky_gamma",
    ],
    "data_sampling": [
        "training.sampling_strategy", "training.stateful_sampler", "training.group_stratified_sampling",
        "training.sampling_curriculum", "training.patch_sampling", "training.hard_negative_fraction",
        "training.positive_patch_fraction", "training.max_train_samples", "training.max_train_pixels",
        "training.sample_positive_fraction",
    ],
    "model_family": ["model.name", "model.input_mode", "model.base_channels", "model.depth", "model.hidden_units"],
    "inference_calibration": ["evaluation.threshold", "evaluation.max_pred_positive_rate_ratio", "evaluation.tta_flips"],
    "replication": ["training.seed", "training.seeds", "training.deterministic"],
}

# Bounds of mutable numeric parameters.
PARAM_BOUNDS = {
    "training.pos_weight": (0.25, 25.0), "training.learning_rate": (0.001, 0.25), "training.weight_decay": (0.0, 0.05),
    "evaluation.threshold": (0.05, 0.95), "training.epochs": (2.0, 20.0), "training.dice_loss_weight": (0.0, 0.8),
    "training.focal_loss_weight": (0.0, 0.5), "training.focal_alpha": (0.05, 0.95), "training.focal_gamma": (0.5, 5.0),
    "training.combo_loss_weight": (0.0, 0.8), "training.combo_bce_weight": (0.0, 1.0),
    "training.combo_dice_weight": (0.0, 1.0), "training.positive_rate_loss_weight": (0.0, 0.1),
    "training.positive_rate_loss_tolerance": (0.001, 0.02), "training.tversky_loss_weight": (0.0, 0.5),
    "training.tversky_beta": (0.1, 0.9), "model.base_channels": (4.0, 16.0), "training.batch_size": (2.0, 32.0),
    "training.max_train_samples": (1.0, 4096.0), "model.depth": (1.0, 3.0), "model.hidden_units": (8.0, 96.0),
    "dataset.z_offsets": (-8.0, 8.0), "training.max_train_pixels": (100000.0, 1200000.0),
    "training.sample_positive_fraction": (0.05, 0.95), "training.hard_negative_fraction": (0.1, 0.9),
    "evaluation.max_pred_positive_rate_ratio": (1.5, 3.5),
}

# Searched paths; the value is the canonical text of the default.
SEARCH_DEFAULTS = {
    "model.name": "tiny_numpy_ink_logreg", "model.input_mode": "null", "model.base_channels": "null",
    "model.depth": "2.0", "model.hidden_units": "24.0", "dataset.research_scope": "null", "dataset.train_npz": "null",
    "dataset.val_npz": "null", "dataset.z_offsets": "null", "dataset.num_workers": "8.0",
    "dataset.prefetch_factor": "4.0", "dataset.pin_memory": "false", "training.epochs": "5.0",
    "training.batch_size": "null", "training.learning_rate": "0.2", "training.weight_decay": "0.0",
    "training.pos_weight": "2.0", "training.max_train_samples": "null", "training.max_train_pixels": "600000.0",
    "training.sample_positive_fraction": "null", "training.dice_loss_weight": "null",
    "training.focal_loss_weight": "null", "training.focal_alpha": "null", "training.focal_gamma": "null",
    "training.combo_loss_weight": "null", "training.combo_bce_weight": "null", "training.combo_dice_weight": "null",
    "training.positive_rate_loss_weight": "null", "training.positive_rate_loss_tolerance": "null",
    "training.positive_rate_loss_target": "null", "training.tversky_loss_weight": "null",
    "training.tversky_alpha": "null", "training.tversky_beta": "null", "training.focal_tversky_gamma": "null",
    "training.augment_flips": "null", "training.augment_rotation": "null", "training.seed": "1337.0",
    "training.seeds": "null", "training.deterministic": "null", "training.sampling_strategy": "null",
    "training.stateful_sampler": "false", "training.group_stratified_sampling": "false",
    "training.sampling_curriculum": "null", "training.patch_sampling": "null",
    "training.hard_negative_fraction": "null", "training.positive_patch_fraction": "null",
    "evaluation.threshold": "0.5", "evaluation.use_villa_metrics": "true",
    "evaluation.max_pred_positive_rate_ratio": "null", "evaluation.tta_flips": "null",
}

# Configuration ranges as (path, low, high, low is open, allowed words).
RANGE_RULES = [
    ("model.depth", 1, 3, False, []), ("model.hidden_units", 1, None, False, []), ("model.base_channels", 1, None, False, []),
    ("dataset.patch_size", 1, None, False, []), ("dataset.max_samples_per_split", 1, None, False, []),
    ("dataset.num_workers", 0, None, False, []), ("dataset.prefetch_factor", 1, None, False, []),
    ("training.epochs", 1, None, False, []), ("training.batch_size", 1, None, False, []),
    ("training.learning_rate", 0, None, True, []), ("training.weight_decay", 0, None, False, []),
    ("training.pos_weight", None, None, False, ["auto"]), ("training.max_train_samples", 0, None, False, []),
    ("training.max_train_pixels", 0, None, False, []), ("training.sample_positive_fraction", 0, 1, False, []),
    ("training.num_threads", 1, None, False, []), ("training.hard_negative_fraction", 0, 1, False, []),
    ("training.positive_patch_min_ink", 0, 1, False, []), ("training.negative_patch_max_ink", 0, 1, False, []),
    ("training.positive_patch_fraction", 0, 1, False, []), ("training.dice_loss_weight", 0, None, False, []),
    ("training.focal_loss_weight", 0, None, False, []), ("training.focal_alpha", 0, 1, False, []),
    ("training.focal_gamma", 0, None, False, []), ("training.combo_loss_weight", 0, None, False, []),
    ("training.combo_bce_weight", 0, None, False, []), ("training.combo_dice_weight", 0, None, False, []),
    ("training.positive_rate_loss_weight", 0, None, False, []), ("training.positive_rate_loss_tolerance", 0, None, False, []),
    ("training.positive_rate_loss_target", None, None, False, ["auto", "auto_train", "train"]),
    ("training.tversky_loss_weight", 0, None, False, []), ("training.tversky_alpha", 0, 1, False, []),
    ("training.tversky_beta", 0, 1, False, []), ("training.focal_tversky_gamma", 0, None, False, []),
    ("evaluation.threshold", 0, 1, False, []), ("evaluation.calibration_bins", 1, None, False, []),
    ("evaluation.max_pred_positive_rate_ratio", 0, None, True, []), ("evaluation.min_pred_positive_rate_ratio", 0, None, False, []),
    ("evaluation.target_pred_positive_rate", None, None, False, ["auto", "auto_val", "val"]),
]

# Required and optional metric keys with their kind.
REQUIRED_METRICS = {
    "val_loss": "number", "val_f1": "number", "val_f05": "number", "best_threshold": "number", "precision": "number",
    "recall": "number", "average_precision": "number", "ap_prevalence_lift": "number", "val_positive_rate": "number",
    "pred_positive_rate": "number", "fixed_threshold_status": "string",
}
OPTIONAL_METRICS = {"promotion_checks": "object", "loo_promotion_ready": "boolean", "full_tile_promotion_ready": "boolean"}

# Action and severity of each quality reason.
QUALITY_ACTIONS = {
    "positive_rate_ratio_suspicious": ("calibrate_positive_rate", "blocker"),
    "positive_rate_ratio_review": ("review_positive_rate", "warning"),
    "fixed_threshold_weak": ("calibrate_probability_scale", "warning"),
    "no_fixed_positive_predictions": ("calibrate_probability_scale", "warning"),
    "fixed_zero_precision": ("calibrate_probability_scale", "warning"),
    "fixed_zero_recall": ("calibrate_probability_scale", "warning"),
    "weak_relative_to_selected_f1": ("calibrate_probability_scale", "warning"),
    "weak_ap_lift": ("improve_ranking_signal", "warning"),
    "weak_full_tile_f1": ("inspect_full_tile_errors", "blocker"),
    "blank_or_no_positive_mask": ("check_inference_wiring", "blocker"),
    "flat_probabilities": ("check_probability_scale", "blocker"),
    "flooding": ("mine_hard_negatives", "blocker"),
    "possible_flooding": ("review_flooding", "warning"),
    "speckle_or_isolated_positives": ("mine_hard_negatives", "blocker"),
    "many_isolated_positives": ("mine_hard_negatives", "blocker"),
    "fragmented_threshold_mask": ("inspect_decoded_noise", "blocker"),
    "unstructured_noise": ("inspect_decoded_noise", "blocker"),
    "high_frequency_noise": ("inspect_decoded_noise", "blocker"),
    "invalid_values": ("check_artifact_integrity", "blocker"),
}

# Fixed value: configuration section that holds planner metadata.
PLANNER_SECTION = "planner"

HELD_OUT_MODES = ["cross-segment", "cross-scroll", "leave-one-segment-out"]
COST_RANK = {"cheap": 0, "normal": 1, "expensive": 2}

# Paths that differ between the folds and seeds of one configuration.
FOLD_PATHS = [
    "resolved_data", "validation_setup", "dataset.train_npz", "dataset.val_npz", "dataset.validation_mode", "training.seed",
    f"{PLANNER_SECTION}.heldout_segment", f"{PLANNER_SECTION}.seed_repeat", f"{PLANNER_SECTION}.fold_map",
]
