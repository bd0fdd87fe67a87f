"""Explicit schemas of every file and stream the readers accept."""

LABELME = (
    "version STRING, flags MAP<STRING,BOOLEAN>, "
    "shapes ARRAY<STRUCT<label: STRING, points: ARRAY<ARRAY<DOUBLE>>, group_id: INT, "
    "shape_type: STRING, flags: MAP<STRING,BOOLEAN>>>, "
    "imagePath STRING, imageData STRING, imageHeight INT, imageWidth INT, _corrupt_record STRING"
)

PRELABEL = (
    "image STRING, width INT, height INT, "
    "detections ARRAY<STRUCT<class: STRING, score: DOUBLE, bbox: ARRAY<DOUBLE>, polygon: ARRAY<ARRAY<DOUBLE>>>>"
)

SESSION = (
    "session_id STRING, base_frame STRING, ee_frame STRING, board STRING, "
    "samples ARRAY<STRUCT<index: INT, image: STRING, base_T_ee: ARRAY<ARRAY<DOUBLE>>, n_corners: INT>>"
)

RUN_METRICS = (
    "model STRING, mask_map50_95 DOUBLE, mask_map50 DOUBLE, box_map50_95 DOUBLE, "
    "box_map50 DOUBLE, mask_p DOUBLE, mask_r DOUBLE"
)

XYZ = "STRUCT<x: DOUBLE, y: DOUBLE, z: DOUBLE>"

FRAMES = (
    "session_id STRING, frame_index BIGINT, ts TIMESTAMP, "
    f"detections ARRAY<STRUCT<class_name: STRING, confidence: DOUBLE, center: {XYZ}, extent: {XYZ}, "
    "yaw_deg: DOUBLE, point_count: INT, in_workspace: BOOLEAN, yaw_reliable: BOOLEAN>>"
)

POSES = (
    "session_id STRING, ts TIMESTAMP, tx DOUBLE, ty DOUBLE, tz DOUBLE, "
    "qx DOUBLE, qy DOUBLE, qz DOUBLE, qw DOUBLE"
)

JOINT_STATES = (
    "robot_id STRING, ts TIMESTAMP, name ARRAY<STRING>, position ARRAY<DOUBLE>, "
    "velocity ARRAY<DOUBLE>, effort ARRAY<DOUBLE>"
)

ARM_STATUS = (
    "robot_id STRING, ts TIMESTAMP, mode STRING, enabled BOOLEAN, control_loop_active BOOLEAN, "
    "state_machine STRING, joint_names ARRAY<STRING>, per_joint_status_code ARRAY<INT>, error_codes ARRAY<STRING>"
)

INTRINSICS = (
    "STRUCT<width: INT, height: INT, fx: DOUBLE, fy: DOUBLE, ppx: DOUBLE, ppy: DOUBLE, "
    "model: STRING, coeffs: ARRAY<DOUBLE>>"
)
