"""Fixed values of the incident domain and tunable parameters.

The tables in this file are *fixed values*: results only agree with published
numbers when these texts, rates and thresholds are used as they stand.
"""

# ---- fixed values: geography ------------------------------------------------
EARTH_RADIUS_M = 6_371_000.0
LAT_MIN, LAT_MAX = 12.80, 13.27
LON_MIN, LON_MAX = 77.31, 77.77

# ---- fixed values: clustering and density -----------------------------------
EPS_METRES = 500.0
MIN_SAMPLES = 5
KDE_FACTOR = 0.02
KDE_GRID = 200
KDE_CUTOFF_SIGMA = 8.0
MIN_DENSITY_ROWS = 20
TIME_BANDS = ("early_morning", "evening", "late_night", "off_peak")
PEAK_BANDS = ("early_morning", "evening")
N_DENSITY_CAUSES = 6

# ---- fixed values: corridor risk --------------------------------------------
MIN_CORRIDOR_EVENTS = 10
RISK_WEIGHTS = {"closure": 0.40, "impact": 0.40, "volume": 0.20}

# ---- fixed values: text cleaning --------------------------------------------
TRUTH_WIDE = ("true", "yes", "1", "y", "t")
TRUTH_SPATIAL = ("true", "yes", "1")
TRUTH_RULES = ("true", "1", "yes")
PLANNED_TYPES = ("planned", "scheduled")
PLANNED_CAUSES = (
    "planned_event", "public_event", "vip_movement", "rally", "festival", "procession", "protest",
)
CAUSE_GROUPS = (
    "vehicle_breakdown", "accident", "pot_holes", "construction",
    "water_logging", "tree_fall", "congestion", "others",
)
PLACEHOLDER_LABELS = ("no_junction", "no_zone", "unknown")
SAMPLE_CAUSES = (
    "vehicle_breakdown", "accident", "pot_holes", "water_logging", "tree_fall",
    "construction", "public_event", "congestion", "procession", "vip_movement",
)
REQUIRED_COLUMNS = (
    "latitude", "longitude", "event_cause", "requires_road_closure", "priority", "corridor",
    "start_datetime", "event_type", "endlatitude", "endlongitude", "junction", "zone", "status",
)

# ---- fixed values: impact model ---------------------------------------------
IMPACT_WEIGHTS = {"priority": 0.4, "closure": 0.4, "duration": 0.2}
PRIORITY_PROB = {"high": 0.85, "low": 0.15}
RULES_DURATION_CAP_H = 72.0
MAX_DURATION_H = 720.0
FALLBACK_MIN_EXAMPLES = 30
ENCODING_SMOOTHING = 20.0
ENCODING_MIN_LEAF = 20
CLOSURE_RATE_BY_CAUSE = {
    "vehicle_breakdown": 0.065, "accident": 0.19, "pot_holes": 0.09, "construction": 0.14,
    "water_logging": 0.10, "tree_fall": 0.15, "road_conditions": 0.08, "congestion": 0.04,
    "public_event": 0.12, "procession": 0.11, "vip_movement": 0.20, "protest": 0.13,
    "others": 0.08, "debris": 0.07, "default": 0.083,
}
MEDIAN_HOURS_BY_CAUSE = {
    "vehicle_breakdown": 3.5, "accident": 5.0, "pot_holes": 8.0, "construction": 12.0,
    "water_logging": 6.0, "tree_fall": 4.5, "road_conditions": 6.5, "congestion": 2.0,
    "public_event": 8.0, "procession": 6.0, "vip_movement": 4.0, "protest": 5.0,
    "others": 4.0, "debris": 3.0, "default": 4.0,
}

# ---- fixed values: deployment scaling ---------------------------------------
OFFICER_STEP, OFFICER_CLAMP = 0.15, (0.4, 2.0)
BARRICADE_STEP, BARRICADE_CLAMP = 0.10, (0.5, 1.8)
TIER_BOOST = {"HIGH": (0.30, 0.20), "MEDIUM": (0.10, 0.10), "LOW": (0.0, 0.0)}
HOUR_BOOST = (("Morning Peak", 4, 7, 0.20), ("Evening Peak", 19, 23, 0.25))
CLOSURE_TRIGGER = 0.50
CLOSURE_EXTRA = (2, 4)
OFFICER_RANGE = (1, 20)
BARRICADE_RANGE = (0, 30)
BLOCK_RADIUS_M = 200.0
DETOUR_SPEED_KMH = 25.0
DETOUR_SIDE_M, DETOUR_MID_M, DETOUR_END_M = 500.0, 600.0, 200.0

# ---- fixed values: response decision table ----------------------------------
# cause, officers, recovery vans, barricades, escalation, equipment, notes, priority override
RESPONSE_TEMPLATES = (
    ("vehicle_breakdown", 2, 1, 2, [], ["traffic cones", "reflective signs", "tow cable"],
     "Most common cause. Recovery van is the critical resource. "
     "Park patrol vehicle upstream with hazard lights.", None),
    ("accident", 4, 1, 4, ["Ambulance / 108", "Fire & Emergency (if entrapment)"],
     ["first aid kit", "traffic cones", "reflective signs", "flares"],
     "Secure the scene first. Preserve evidence for FIR. "
     "One officer directs traffic; one manages scene.", "HIGH"),
    ("pot_holes", 1, 0, 2, ["BBMP / Civil Works"], ["warning signs", "traffic cones"],
     "Place warning cones immediately. Escalate to BBMP for repair. "
     "Monitor until repair crew arrives.", None),
    ("water_logging", 1, 0, 3, ["BBMP Storm Water Drain Dept", "Fire Dept (if deep)"],
     ["warning signs", "barricade tape", "depth markers"],
     "Do NOT allow vehicles to enter flooded stretch. "
     "Check for submerged manholes. Alert Fire Dept if depth > 2ft.", None),
    ("construction", 1, 0, 4, ["BBMP / PWD"],
     ["barricade tape", "reflective signs", "diversion boards"],
     "Verify construction permit. Ensure night-visibility markers. "
     "Coordinate with contractor for expected duration.", None),
    ("tree_fall", 2, 0, 3, ["Forest Department", "BBMP Tree Cell", "BESCOM (if wires involved)"],
     ["barricade tape", "reflective signs", "traffic cones"],
     "Check for downed power lines FIRST — do not touch if wires present. "
     "Cordon area until Forest/BBMP removal team arrives.", "HIGH"),
    ("road_conditions", 1, 0, 2, ["BBMP / PWD"], ["warning signs", "traffic cones"],
     "Surface hazard warning. Slow-zone signage if applicable. "
     "Escalate to BBMP for resurfacing.", None),
    ("congestion", 3, 0, 0, [], ["handheld radio", "whistle", "reflective jacket"],
     "Deploy at junction points. Manual signal override may be needed. "
     "Focus on clearing bottleneck, not blocking.", None),
    ("public_event", 6, 0, 8, ["Event Coordinator", "Traffic Control Room"],
     ["barricade tape", "diversion boards", "PA system", "CCTV mobile unit"],
     "Pre-deploy barricades 2h before event start. "
     "Coordinate diversion routes with traffic control room. "
     "Post-event: phase removal to avoid secondary congestion.", None),
    ("procession", 5, 0, 6, ["Religious Affairs Dept", "Traffic Control Room"],
     ["barricade tape", "diversion boards", "PA system"],
     "Deploy along entire route. Lead and tail vehicles. "
     "Coordinate with organiser for exact timing and route.", None),
    ("vip_movement", 8, 0, 10, ["SPG / Protocol Division", "Traffic Control Room"],
     ["road closure boards", "diversion boards", "radio set"],
     "Full route sanitisation. Advance party 30 min before. "
     "Coordinate with SPG for exact convoy timing.", "HIGH"),
    ("protest", 6, 0, 6, ["Rapid Action Force", "Traffic Control Room"],
     ["barricade tape", "riot shields (standby)", "PA system", "CCTV mobile unit"],
     "Maintain safe distance. Do not escalate. "
     "Have Rapid Action Force on standby. Monitor crowd density.", "HIGH"),
    ("Debris", 1, 0, 2, ["BBMP Cleanup"], ["traffic cones", "broom/shovel (if minor)"],
     "Clear minor debris immediately if safe.", None),
    ("fog / low visibility", 2, 0, 2, [], ["flares", "reflective signs", "fog lights"],
     "Reduce speed limit signage. Deploy flares at 100m intervals. "
     "Alert control room for advisory broadcasts.", None),
    ("test_demo", 0, 0, 0, [], [], "Test event — no deployment needed.", None),
)
DEFAULT_TEMPLATE = (
    "default", 2, 0, 2, [], ["traffic cones", "reflective signs"],
    "Unknown cause type. Deploy standard patrol. Assess on-site.", None,
)
DIVERSION_BOARDS = ("road closure boards", "diversion boards")

# ---- fixed values: anomaly detector -----------------------------------------
BASELINE_DAYS = 90
FOREST_TREES = 100
FOREST_SAMPLE = 256
CONTAMINATION = 0.05

# ---- learning ----------------------------------------------------------------
SEED = 42
N_FOLDS = 5
CATEGORICAL_FEATURES = ("cause_cat", "corridor_cat", "zone_cat", "veh_type_cat", "police_station_cat")
NUMERIC_FEATURES = (
    "hour", "dow", "month", "is_weekend", "is_morning_peak",
    "is_evening_peak", "is_midday_quiet", "is_planned", "lat", "lon",
)
PRIORITY_CATEGORICAL = ("cause_cat", "zone_cat", "veh_type_cat")
