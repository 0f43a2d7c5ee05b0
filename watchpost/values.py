"""Constants that results depend on, in one place."""
from __future__ import annotations

from dataclasses import dataclass

# --- Fixed values: vocabulary ------------------------------------------------
OBJECT_CLASSES = ["person", "bicycle", "car", "motorcycle", "bus", "truck",
                  "boat", "cattle", "uav", "unknown"]
VEHICLES = ["car", "motorcycle", "bus", "truck"]
PRIORITIES = ["info", "low", "medium", "high", "critical"]
COMPASS = ["East", "North-East", "North", "North-West",
           "West", "South-West", "South", "South-East"]

# --- Fixed values: model class index -> object class -------------------------
CLASS_OF_INDEX = {0: "person", 1: "bicycle", 2: "car", 3: "motorcycle", 5: "bus",
                  7: "truck", 8: "boat", 15: "cattle", 16: "cattle", 17: "cattle",
                  18: "cattle", 19: "cattle", 20: "cattle", 21: "cattle"}

# --- Fixed values: class -> capability that authorises it --------------------
CAPABILITY_OF_CLASS = {
    "person": "person_detection", "car": "vehicle_detection",
    "motorcycle": "vehicle_detection", "bus": "vehicle_detection",
    "truck": "vehicle_detection", "bicycle": "vehicle_detection",
    "cattle": "animal_detection", "boat": "boat_detection", "uav": "uav_detection"}

# --- Fixed values: priority bands and pixel-density bands --------------------
PRIORITY_BANDS = [("critical", 0.85), ("high", 0.65), ("medium", 0.45), ("low", 0.25)]
DORI_BANDS = [("identify", 250.0), ("recognise", 125.0), ("observe", 62.0), ("detect", 25.0)]
DORI_PX = {"monitor": 12.0, "detect": 25.0, "observe": 62.0,
           "recognise": 125.0, "identify": 250.0}

# --- Fixed values: event score weights ---------------------------------------
BASE_WEIGHT = {"line_crossing": 0.52, "zone_intrusion": 0.46, "wrong_direction": 0.40,
               "loitering": 0.28, "group_movement": 0.44, "vehicle_movement": 0.26,
               "off_route_movement": 0.42, "temporal_anomaly": 0.30,
               "repeat_entity": 0.38, "corridor_dropout": 0.44, "night_movement": 0.50,
               "suspicious_activity": 0.60, "camera_tamper": 0.78,
               "camera_offline": 0.34, "stream_replay_suspected": 0.82}
DEFAULT_BASE = 0.30
CLASS_WEIGHT = {"person": 0.10, "truck": 0.09, "car": 0.06, "motorcycle": 0.07,
                "bus": 0.04, "bicycle": 0.04, "boat": 0.08, "uav": 0.20,
                "cattle": -0.14, "unknown": 0.0}
ROUTINE_MOVEMENT = ["line_crossing", "zone_intrusion", "wrong_direction",
                    "off_route_movement", "vehicle_movement", "group_movement",
                    "suspicious_activity", "loitering"]
HARD_TRIPWIRES = ["line_crossing", "zone_intrusion", "wrong_direction"]

# --- Fixed values: capability rules ------------------------------------------
# capability, pixel-density band it needs, needs fine detail
CAPABILITY_RULES = [
    ("person_detection", "detect", False), ("vehicle_detection", "detect", False),
    ("animal_detection", "detect", False), ("boat_detection", "detect", False),
    ("uav_detection", "observe", False), ("tracking", "detect", False),
    ("direction_analysis", "detect", False), ("speed_estimation", "detect", False),
    ("anpr", "identify", True), ("face_detection", "recognise", True),
    ("face_recognition", "identify", False)]
ROLE_CAPABILITIES = {
    "perimeter": ["person_detection", "vehicle_detection", "animal_detection",
                  "uav_detection", "tracking", "direction_analysis", "speed_estimation"],
    "approach": ["person_detection", "vehicle_detection", "animal_detection",
                 "tracking", "direction_analysis", "speed_estimation", "anpr"],
    "chokepoint": ["person_detection", "vehicle_detection", "tracking",
                   "direction_analysis", "anpr", "face_detection"],
    "riverine": ["person_detection", "boat_detection", "animal_detection",
                 "tracking", "direction_analysis", "speed_estimation"]}

# --- Fixed values: plate grammars --------------------------------------------
PLATE_GRAMMAR = r"^([A-Z]{2})(\d{1,2})([A-Z]{0,3})(\d{1,4})$"
PLATE_SEARCH = r"[A-Z]{2}[0-9]{1,2}[A-Z]{1,3}[0-9]{4}"

HOURS_PER_WEEK = 168


@dataclass(frozen=True)
class Params:
    """Tunable thresholds with their deployed defaults."""
    # rules
    loiter_s: float = 30.0
    group_size: int = 3
    group_window_s: float = 20.0
    cooldown_s: float = 30.0
    confirm_frames: int = 3
    line_margin: float = 0.012
    off_route: float = 0.10
    off_route_hits: int = 8
    night_hits: int = 5
    suspicious_hits: int = 30
    suspicious_history: int = 20
    # tracker
    match_iou: float = 0.30
    low_match_iou: float = 0.15
    high_confidence: float = 0.55
    max_lost: int = 30
    min_hits: int = 3
    history: int = 90
    trail: int = 40
    # governor
    budget_per_hour: int = 20
    floor: float = 0.25
    ceiling: float = 0.92
    # normalcy
    half_life_days: float = 45.0
    drop_below: float = 0.05
    unusual_ratio: float = 2.0
    routine_ratio: float = 0.6
    min_samples: int = 5
    # patrol
    strong_match: float = 0.72
    uncertain_match: float = 0.45
    off_schedule_cap: float = 0.65
    deviation_identity: float = 0.70
    suppress_adjust: float = -0.35
    downgrade_adjust: float = -0.16
    deviation_adjust: float = 0.16
    # corridor
    handoff_accept: float = 0.45
    appearance_min: float = 0.40
    timing_only_min: float = 0.60
    sigmas: float = 2.5
    # plates
    plate_px: float = 90.0
    plate_window_h: float = 168.0
    plate_sightings: int = 3
    night_from: int = 22
    night_to: int = 5
    plate_attempt_frames: int = 6
    # sync
    sync_batch: int = 25
    queue_cap_bytes: int = 2 * 1024 ** 3
    evict_to: float = 0.85
    drift_tolerance_s: float = 5.0
    retention_days: int = 30
    retention_packages: int = 3000
    # profiling
    person_height_m: float = 1.7
    min_frames: int = 40
    min_ground: int = 28
    deadline_factor: int = 15
    aspect_min: float = 1.15
    aspect_max: float = 9.0
    coarse_resolution: float = 0.018
    fine_resolution: float = 0.070
    max_blockiness: float = 0.45
    max_noise: float = 9.0
    min_speed_fps: float = 4.0
    min_uav_sharpness: float = 40.0
    # camera integrity
    frozen_digests: int = 12
    frozen_streak: int = 3
    persistence: int = 45
    baseline_frames: int = 120
    moved_divergence: float = 46.0
    reference_alpha: float = 0.02


DEFAULTS = Params()
