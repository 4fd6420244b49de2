"""Fixed values of the data model: they decide results and are stated here once."""

# Distances, windows and tolerances of the dataset builder.
EARTH_RADIUS_KM = 6371.0
MAX_RANGE_KM = 150.0
WINDOW_BEFORE_MIN = 30
WINDOW_AFTER_MIN = 10
VELOCITY_TOLERANCE_MIN = 8
LIVE_PAIR_SECONDS = 300
EXCLUDE_KM = 30.0
EXCLUDE_MIN = 45
REFLECTIVITY_PRODUCT = "N0B"
VELOCITY_PRODUCT = "N0S"

# Fallback radar sites (id, latitude, longitude).
FALLBACK_STATIONS = [
    ("KTLX", 35.3331, -97.2778), ("KICT", 37.6544, -97.4428), ("KFWS", 32.5728, -97.3031),
    ("KEAX", 38.8100, -94.2644), ("KLSX", 38.6989, -90.6828), ("KIND", 39.7075, -86.2803),
    ("KOHX", 36.2472, -86.5625), ("KBMX", 33.1722, -86.7700), ("KLCH", 30.1253, -93.2158),
    ("KHGX", 29.4719, -95.0792), ("KMPX", 44.8489, -93.5656), ("KLOT", 41.6044, -88.0847),
]

# Bounding box of the contiguous United States (exclusive bounds).
BBOX = {"lon_min": -125.0, "lon_max": -66.0, "lat_min": 24.0, "lat_max": 50.0}

# Model-input geometry and palette-index codes.
BOX_KM = 120.0
KM_PER_DEGREE = 111.0
MIN_BOX_PX = 8
TENSOR_SIDE = 128
REFLECTIVITY_CODES = {"missing": (0,), "denom": 255.0}
VELOCITY_CODES = {"missing": (0, 15), "denom": 15.0}
TRANSFORM_VERSION = "1.0"

# Colour-scale ranges.
VALUE_RANGE = {"reflectivity": (-20.0, 70.0), "velocity": (-100.0, 100.0)}
UNITS = {"reflectivity": "dBZ", "velocity": "knots"}

# Alert events that may notify, with their short codes.
EVENT_CODES = {
    "Tornado Warning": "TO.W",
    "Severe Thunderstorm Warning": "SVR",
    "Flash Flood Warning": "FFW",
    "Flood Warning": "FLW",
    "High Wind Warning": "HWW",
    "Winter Storm Warning": "WSW",
    "Ice Storm Warning": "ISW",
    "Extreme Wind Warning": "EWW",
}
ALLOWED_EVENTS = tuple(EVENT_CODES)
COOL_OFF_BYPASS = ("Tornado Warning",)
DAILY_CAP_SECONDS = 86400
COOL_OFF_SECONDS = 1800
PER_CYCLE_CAP = 5
LEDGER_HOURS = 48
ALERT_POLL_SECONDS = 300
MAX_SCORE_AGE_SECONDS = 1800
RISK_THRESHOLD = 0.8

# Frame intake.
MIN_FRAME_AGE_SECONDS = 600
MIN_GRID_BYTES = 1000
MIN_PNG_BYTES = 200
IDLE_MINUTES = 20
CAPTURE_INTERVAL_SECONDS = 600
RETENTION_DAYS = {"frames": 30, "grids": 60, "logs": 14}
EXPECTED_PIXELS_PER_SECOND = 40000
