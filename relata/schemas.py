"""Schemas of the documents the readers take."""

from __future__ import annotations

from pyspark.sql import types as T

_parse = T._parse_datatype_string

INSTANCE = "struct<id string, category string, caption string, position array<double>, scale array<double>, R array<array<double>>, corners array<array<double>>, box_2d_rend array<double>, box_2d_proj array<double>>"

def instances() -> T.ArrayType:
    return T.ArrayType(T.StructType.fromDDL(f"i {INSTANCE}")["i"].dataType)

AUDIT = "archive string, capture_id string, frame_index int, temporal_bin int, total int, geometric int, oracle int, natural int, natural_interior int, sharpness double, width int, height int, image_member string, instance_member string"
CANDIDATE = AUDIT + ", candidate_rank int, selected_by_frame_rule boolean, capture_sharpness_cutoff double, capture_eligible_frames int, capture_high_sharpness_frames int"
OBJECT = "struct<instance_index int, instance_id string, category string, position array<double>, box_2d_rend array<double>, box_area_px2 double, visible_fraction double, interior boolean>"
QUALITY = "struct<both_interior boolean, minimum_visible_fraction double, box_iou double, intersection_over_smaller_box double, minimum_box_area_px2 double, minimum_box_area_fraction double, minimum_box_side_px double, minimum_border_margin_px double, box_center_distance_px double>"
RELATION = f"scene_id string, capture_id string, scene_candidate_rank int, frame_index int, temporal_bin int, archive string, image_member string, instance_member string, pair_id string, pair_index int, fold string, distance_stratum string, distance_stratum_index int, within_stratum_index int, ground_truth_m double, object_a {OBJECT}, object_b {OBJECT}, pair_quality {QUALITY}, stimulus_path string, stimulus_sha256 string"
QUERY = "pair_id string, scene_id string, fold string, stimulus string, ground_truth_m double, prompt string"
RESULT = QUERY + ", run_index int, condition string, model_id string, model_revision string, temperature double, max_tokens int, generation_seed int, stimulus_sha256 string, raw_response string, predicted_distance_m double, elapsed_seconds double, absolute_error_m double, relative_error double, prediction_to_gt_ratio double, log_error double"
ORDER = "order_index int, capture_id string, order_key_sha256 string, url string"
DECISION = "capture_id string, candidate_frames int, best_candidate_rank int, best_frame_index int, best_strict_pair_count int, accepted boolean, rejection_reasons array<string>"
LEDGER = "schema_version string, order_index int, capture_id string, order_key_sha256 string, selection_accepted boolean, selection_pair_count int, selection_decision string, visual_qc string, visual_qc_note string, capture_accepted boolean, capture_decision string, artifacts map<string, struct<path string, size_bytes bigint, sha256 string>>"
