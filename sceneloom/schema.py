"""Explicit schemas of scene data, as DDL.  Readers use these and never infer."""

BOX = "corners ARRAY<ARRAY<DOUBLE>>, min ARRAY<DOUBLE>, max ARRAY<DOUBLE>, center ARRAY<DOUBLE>, size ARRAY<DOUBLE>"
COMPONENT = f"component_id INT, caption STRING, bbox STRUCT<{BOX.replace(' ARRAY', ': ARRAY')}>, best_crop STRING"
CAMERA = "camera_id INT, model STRING, width BIGINT, height BIGINT, params ARRAY<DOUBLE>"
IMAGE = "image_id INT, qvec ARRAY<DOUBLE>, tvec ARRAY<DOUBLE>, camera_id INT, name STRING, observations ARRAY<STRUCT<x: DOUBLE, y: DOUBLE, point3d_id: BIGINT>>"
POINT = "point3d_id BIGINT, xyz ARRAY<DOUBLE>, rgb ARRAY<SMALLINT>, error DOUBLE, track ARRAY<STRUCT<image_id: INT, point2d_idx: INT>>"
CAPTION = "component_id INT, caption STRING, num_images_used INT, crop_filenames ARRAY<STRING>"
CROP = "crop_filename: STRING, source_image: STRING, instance_id: STRING, crop_index: INT, crop_coordinates: ARRAY<DOUBLE>, image_id: INT, fraction_visible: DOUBLE, visible_points: INT, total_points: INT"
MANIFEST = f"MAP<STRING, STRUCT<component_id: INT, total_crops: INT, crops: ARRAY<STRUCT<{CROP}>>>>"
IMAGE_ASSOCIATION = "image_id INT, image_name STRING, mask_ids ARRAY<STRING>, mask_point3d_sets ARRAY<ARRAY<BIGINT>>, H INT, W INT"
OBJECT_ASSOCIATION = "MAP<STRING, MAP<STRING, MAP<STRING, ARRAY<BIGINT>>>>"
INVENTORY = "MAP<STRING, ARRAY<STRING>>"
FLOOR_POINT = "point_id BIGINT, coords ARRAY<DOUBLE>"
MASK = "obj_id INT, segmentation STRUCT<size: ARRAY<INT>, counts: STRING>, area DOUBLE"
RESULT = "file STRING, config STRING, tools ARRAY<STRING>, benchmark_type STRING, question STRING, expected_text STRING, predicted_text STRING, expected_components ARRAY<STRING>, predicted_components ARRAY<STRING>, metrics MAP<STRING, DOUBLE>"
SEG_GROUPS = "segGroups ARRAY<STRUCT<id: INT, objectId: INT, partId: INT, index: INT, label: STRING, segments: ARRAY<BIGINT>>>"
BENCHMARK = "dataset_name STRING, question STRING, expected_answer STRING, benchmark_name STRING, benchmark_type STRING"
RUNTIME = "dataset_name STRING, step STRING, duration_seconds DOUBLE, status STRING"

#: Camera models with their numbers of parameters.  Fixed values of the structure-from-motion file format, by model id from 0 on.
CAMERA_MODELS = [
    ("SIMPLE_PINHOLE", 3), ("PINHOLE", 4), ("SIMPLE_RADIAL", 4), ("RADIAL", 5), ("OPENCV", 8), ("OPENCV_FISHEYE", 8),
    ("FULL_OPENCV", 12), ("FOV", 5), ("SIMPLE_RADIAL_FISHEYE", 4), ("RADIAL_FISHEYE", 5), ("THIN_PRISM_FISHEYE", 12),
]
