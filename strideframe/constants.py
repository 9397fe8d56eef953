"""Fixed values that define results; they must equal the published analysis."""

from __future__ import annotations

# --- fixed values: joints and feature names ---------------------------------
MOTION_JOINTS = (
    "left_shoulder", "right_shoulder",
    "left_elbow", "right_elbow",
    "left_wrist", "right_wrist",
)
AXIS_FEATURES = (
    "avg_speed", "std_speed", "amplitude",
    "total_energy", "dominant_freq", "centroid",
)
EIGHT_STATS = ("mean", "median", "std", "min", "max", "range", "q25", "q75")

# --- fixed values: sampling and windows --------------------------------------
DEFAULT_FPS = 20.0
SEGMENT_WINDOW_SEC = 1.0
SEGMENT_STEP_SEC = 0.5
DETECTOR_WINDOW_SEC = 2.0
DETECTOR_STEP_SEC = 0.5
POSITIVE_OFFSETS_SEC = (-0.5, 0.0, 0.5)
NEGATIVE_EXCLUSION_SEC = 8.0
NEGATIVE_STEP_SEC = 3.0
NEGATIVE_RATIO = 4
SMOOTH_PROB_SEC = 2.0
BASE_PROB_THRESHOLD = 0.55
VIDEO_PROB_QUANTILE = 0.90
MIN_BOUNDARY_GAP_SEC = 30.0
MIN_WORK_CYCLE_SEC = 30.0
EDGE_IGNORE_SEC = 5.0
CLASS_CUT = 0.5
RANDOM_SEED = 42

# --- fixed values: clustering -------------------------------------------------
VIDEO_K_RANGE = tuple(range(2, 14))
VIDEO_N_INIT = 50
SEGMENT_K_VALUES = (2, 3, 4, 5, 6)
SEGMENT_N_INIT = 20
SEGMENT_MAX_ITER = 500
SEGMENT_META = (
    "Video", "Segment_ID", "Start_Frame", "End_Frame",
    "Start_sec", "End_sec", "FPS",
)
NON_FEATURE_PATTERNS = ("cluster", "pca_", "tsne_")
CLUSTER_NAMES = {1: "Cluster 1", 2: "Cluster 2", 3: "Cluster 3"}
TIMELINE_BIN_PERCENT = 5

# --- fixed values: density estimation ----------------------------------------
PHASES = ("P1", "P2", "P3")
HANDS = ("left", "right")
CELL_SIZE_SW = 0.025
BANDWIDTHS_SW = tuple(round(i / 100, 2) for i in range(1, 31))
GRID_MARGIN_SW = 4 * 0.18
MIN_VALID_SAMPLES = 10
MIN_PHASE_AVAILABILITY = 0.50
SCORE_FLOOR = 1e-15
KERNEL_TRUNCATE = 8.0
COVERAGES = (0.50, 0.90)

# --- fixed values: propulsion ---------------------------------------------------
IMAGE_WIDTH_PX = 3840.0
IMAGE_HEIGHT_PX = 2160.0
NEEDLE_SCREEN_PX = (0.34713542 * 3840.0, 0.54768519 * 2160.0)
NEEDLE_ANALYSIS_PX = (1333.0, -1183.0)
MAX_INTERPOLATION_FRAMES = 3
FORWARD_VELOCITY_SW_S = 0.010
SYNC_BRIDGE_S = 0.15
SYNC_MIN_S = 0.30
MIN_NET_FORWARD_SW = 0.005
MERGE_MAX_GAP_S = 0.50
MERGE_RETURN_TOLERANCE_SW = 0.010
BOOTSTRAP_REPLICATES = 10_000
BOOTSTRAP_SEED = 20260815
REFERENCE_SHOULDER_WIDTH_M = 0.40

# --- fixed values: session outcomes ------------------------------------------
BASIC_MIN_SAMPLES = 3
HIGHER_MIN_SAMPLES = 10
PROFILE_GRID = 101
SESSION_PROFILES = {
    "S1": "Program-generated reference",
    "S2": "Program-generated oscillatory",
    "U1": "Human-operated",
    "U2": "Human-operated",
}
SESSION_FILES = (
    "phase1_grab.json", "phase2_push.json",
    "phase3_return.json", "session_meta.json",
)
