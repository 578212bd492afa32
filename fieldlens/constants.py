"""Thresholds, word lists and lookup tables the results depend on."""

# ---- fixed values: compass and wind -------------------------------------------------
COMPASS = ["N", "NNE", "NE", "ENE", "E", "ESE", "SE", "SSE",
           "S", "SSW", "SW", "WSW", "W", "WNW", "NW", "NNW"]
OCTANTS = ["N", "NE", "E", "SE", "S", "SW", "W", "NW"]
CONE_HALF_ANGLE_DEG = 30.0
CONE_REACH_M = 200.0
LANE_SPREAD_DEG = 10.0
MIN_LANE_SPREAD_DEG = 3.0
MAX_LANE_SPREAD_DEG = 80.0
MIN_LANE_REACH_M = 5.0
CAMERA_SPREAD_DEG = 21.0
CAMERA_REACH_M = 25.0

# ---- fixed values: earth ------------------------------------------------------------
HAVERSINE_RADIUS_M = 6371000.0
MEAN_RADIUS_M = 6371008.8
M2_PER_ACRE = 4046.8564224
M_PER_YARD = 0.9144
FEET_PER_METRE = 3.280839895

# ---- fixed values: exposure and rates -----------------------------------------------
MIN_HOURS = 10
MIN_LIVE_DAYS = 10
TWILIGHT_HOURS = 1.5
SILENT_AFTER_HOURS = 48
Z95 = 1.959963984540054
VISIT_GAP_SECONDS = 300
LIGHT_BANDS = ["dawn", "day", "dusk", "night"]
DAY_STATES = ["live", "quota-dark", "silent", "unknown"]
# (key, lower bound inclusive or None, upper bound exclusive or None), Fahrenheit
TEMP_BANDS = [("lt20", None, 20.0), ("20s", 20.0, 35.0), ("30s", 35.0, 50.0),
              ("50s", 50.0, 65.0), ("gte65", 65.0, None)]
PRESSURE_BANDS = ["low", "mid", "high"]
PRESSURE_LOW_BELOW = 29.8
PRESSURE_HIGH_ABOVE = 30.1
AXIS_TIERS = {"light": "A", "wind": "B", "temp": "B", "pressure": "D"}

# ---- fixed values: vocabulary -------------------------------------------------------
SPECIES = ["deer", "turkey", "bear", "coyote", "raccoon", "other"]
VENDOR_SPECIES = {"deer": "deer", "buck": "deer", "doe": "deer", "fawn": "deer",
                  "turkey": "turkey", "bear": "bear", "coyote": "coyote",
                  "raccoon": "raccoon"}
STAND_TYPES = ["stand", "tripod", "ground-blind", "box-blind", "saddle", "other"]
MARKER_LABELS = {"rub": "Rub", "scrape": "Scrape", "bed": "Bed", "trail": "Trail",
                 "food-plot": "Food plot", "water": "Water", "access": "Access route",
                 "other": "Other"}
CROP_KINDS = ["corn", "soybeans", "alfalfa", "winter-wheat", "oats", "clover",
              "brassicas", "pasture", "other"]
SIT_WINDOWS = ["AM", "PM"]
UNKNOWN_WORDS = ["unk", "unknown", "n/a"]
PHOTO_DATE_KEYS = ["originDate", "date", "createDate", "creationDate", "dateTime"]

# ---- fixed values: sit journal ------------------------------------------------------
MIN_SITS = 12
MIN_PER_BUCKET = 3
RATING_ORDER = ["poor", "fair", "good", "strong", "prime"]
RATING_FLOORS = [(46, "PRIME"), (34, "strong"), (24, "good"), (14, "fair")]
MIN_SIGHTINGS = 12
ITERATIONS = 5000

# ---- fixed values: movement model ---------------------------------------------------
TIER_RANK = {"Y": 5, "A": 4, "B": 3, "C": 2, "D": 1}
# (from MM-DD, to MM-DD, score, phase, evidence tier)
SEASON_CALENDAR = [
    ("09-01", "09-30", 10, "Early season", "C"),
    ("10-01", "10-17", 6, "October transition", "B"),
    ("10-18", "10-22", 18, "Pre-rut / scraping", "A"),
    ("10-23", "11-04", 26, "Peak rut — seeking", "A"),
    ("11-05", "11-11", 30, "Peak rut — best week", "A"),
    ("11-12", "11-15", 24, "Peak rut — closing", "A"),
    ("11-16", "11-25", 16, "Post-peak seeking", "B"),
    ("11-26", "12-10", 8, "Post-rut recovery", "C"),
    ("12-11", "12-20", 12, "Second rut", "B"),
    ("12-21", "01-31", 10, "Late season", "C"),
    ("02-01", "08-31", 2, "Off season", "A"),
]
OFF_SEASON_CAP = 5
MONTHLY_NORMAL_F = [15, 20, 32, 45, 57, 66, 70, 68, 59, 47, 33, 20]
SYNODIC_DAYS = 29.530588853
NEW_MOON_EPOCH_S = 947182440            # 2000-01-06T18:14:00Z
MOON_NAMES = [(0.02, "new"), (0.24, "waxing crescent"), (0.27, "first quarter"),
              (0.48, "waxing gibbous"), (0.52, "full"), (0.73, "waning gibbous"),
              (0.77, "last quarter"), (0.98, "waning crescent"), (1.01, "new")]
INHG_PER_HPA = 0.02952998751
SIT_WINDOW_HOURS = {"AM": ("sunrise", -1.5, 3.5), "PM": ("sunset", -3.5, 0.5)}
SEASON_MONTHS = [9, 10, 11, 12, 1]

# ---- fixed values: stand ranking ----------------------------------------------------
# (minimum slope in degrees, strength, weight)
THERMAL_BANDS = [(12.0, "strong", 1.0), (5.0, "moderate", 0.6), (2.0, "weak", 0.25)]
RECOVERY_DAYS = 3.0
PRESSURE_WINDOW_DAYS = 21.0
FIELD_REACH_M = 250.0
FRESH_CUT_DAYS = 21.0
NEAR_CAMERA_M = 400.0
GROUND_GAP_M = 2000.0
WEATHER_RADIUS_M = 2000.0

# ---- fixed values: legal light and walking ------------------------------------------
OPEN_BEFORE_SUNRISE_MIN = 30
CLOSE_AFTER_SUNSET_MIN = 20
SETTLE_MIN = 30
WALK_MPS = 0.9
FORECAST_TTL_MINUTES = 45
SCAN_TTL_DAYS = 5

# ---- fixed values: parcels and radar ------------------------------------------------
PARCEL_CLASSES = {"1": "residential", "2": "commercial", "3": "manufacturing",
                  "4": "agricultural", "5": "undeveloped", "5M": "agricultural forest",
                  "6": "productive forest", "7": "other", "8": "tax-exempt"}
RADAR_STALE_MINUTES = 30

# ---- fixed values: quota and health -------------------------------------------------
QUOTA_WARN_AT = 0.8
QUOTA_MIN_ELAPSED_DAYS = 1
QUOTA_PROJECTION_FLOOR_DAYS = 3
GAP_RECENT_DAYS = 30
SILENT_DAYS = 30                           # age from which a camera counts as silent
COUNTER_RESET_DROP = 100

# ---- fixed values: imagery and crops ------------------------------------------------
UNUSABLE_SCENE_CLASSES = [0, 1, 3, 8, 9, 10, 11]
MIN_CLEAR_PIXELS = 8
MAX_SCENES = 14
CUT_LEVEL = 0.35
CUT_DROP = 0.20
FAST_DAYS = 12
STANDING_FRACTION = 0.75
STALE_DAYS = 10
MIN_REFERENCE_FIELDS = 8
SEARCH_RADII_M = [2000.0, 5000.0, 10000.0]
MAX_SHIFT_DAYS = 12
SHIFT_PENALTY = 0.35
PRIOR_WEIGHT = 0.6
CURVE_STEP_DAYS = 4
PERSISTENT_CROPS = ["alfalfa", "clover", "pasture"]

# ---- fixed values: perceptual hashes and travel -------------------------------------
HASH_COLS = 16
HASH_ROWS = 16
WIND_BITS = 12
WIND_MIN_BASELINE = 3
MIN_SUBJECT_BITS = 12
MIN_DRIFT_COLS = 1.5
MIN_FRAMES_SELF = 3

# ---- fixed values: track cleaning ---------------------------------------------------
MAX_ACCURACY_M = 50.0
MAX_SPEED_MPS = 3.0
MIN_EPSILON_M = 4.0
STRAY_M = 40.0

# ---- fixed values: contours ---------------------------------------------------------
CONTOUR_STEPS_FT = [1, 2, 5, 10, 20, 40, 100]     # goes on as 200, 500, 1000, ... for more relief

# ---- fixed values: words of land-cover categories and the crop kind they tell, first match wins
CROP_WORDS = [("corn", "corn"), ("soybean", "soybeans"), ("alfalfa", "alfalfa"), ("winter wheat", "winter-wheat"), ("oats", "oats"), ("clover", "clover"),
              ("turnip", "brassicas"), ("radish", "brassicas"), ("canola", "brassicas"), ("rape seed", "brassicas"), ("mustard", "brassicas"),
              ("grass", "pasture"), ("pasture", "pasture"), ("hay", "pasture"), ("fallow", "pasture"), ("sod", "pasture")]

# ---- fixed values: words of a season phase and the advice that goes with it, first match wins
SIT_ADVICE = [("best week", "sit all day"), ("seeking", "sit all day"), ("closing", "hunt the doe groups"), ("transition", "hunt tight to cover"),
              ("Late season", "hunt the best feed in the afternoon"), ("recovery", "hunt the best feed in the afternoon")]
