"""Constants of the delay-analytics domain.

Fixed values: these must equal the published project's settings for the
results to agree, so they are stated here plainly and in natural order.
"""

# --- fixed values -----------------------------------------------------------
DELAY_THRESHOLD = 15          # minutes; "late" means ARRIVAL_DELAY > 15
MAX_DELAY = 180               # minutes; cap of the regression target
HUB_QUANTILE = 0.90           # airports at or above this traffic quantile are hubs
EDA_HUB_QUANTILE = 0.95       # quantile used by the exploratory hub table
TRAIN_MONTHS = [1, 2, 3, 4, 5, 6, 7, 8, 9, 10]
TEST_MONTHS = [11, 12]

LEAKAGE_COLS = [
    "DEPARTURE_TIME", "DEPARTURE_DELAY", "TAXI_OUT", "WHEELS_OFF", "ELAPSED_TIME",
    "AIR_TIME", "WHEELS_ON", "TAXI_IN", "ARRIVAL_TIME", "DIVERTED", "CANCELLED",
    "CANCELLATION_REASON", "AIR_SYSTEM_DELAY", "SECURITY_DELAY", "AIRLINE_DELAY",
    "LATE_AIRCRAFT_DELAY", "WEATHER_DELAY",
]

PEAK_HOURS = [7, 8, 9, 17, 18, 19, 20]
RED_EYE_HOURS = [0, 1, 2, 3, 4, 5, 21, 22, 23]
NOTEBOOK_RED_EYE_HOURS = [0, 1, 2, 3, 4, 5]
NOTEBOOK_DEP_PEAK = (14, 22)
NOTEBOOK_ARR_PEAK = (16, 23)
WEEKEND_DAYS = [6, 7]
SUMMER_MONTHS = [6, 7, 8]
HOLIDAY_MONTHS = [7, 8, 12]

# time slots: right-closed bins (-1, 5], (5, 11], (11, 17], (17, 23]
TIME_SLOTS = [("night", -1, 5), ("morning", 5, 11), ("afternoon", 11, 17), ("evening", 17, 23)]
# distance classes: left-closed bins [0, 500), [500, 1500), [1500, inf)
DISTANCE_CLASSES = [("short", 0.0, 500.0), ("medium", 500.0, 1500.0), ("long", 1500.0, None)]
# delay classes: right-closed (-inf, 0], (0, 15], (15, 60], (60, inf)
DELAY_CLASSES = [("Early", None, 0.0), ("On-time", 0.0, 15.0),
                 ("Slight delay", 15.0, 60.0), ("Severe delay", 60.0, None)]

# cyclic encodings: (source column, period, output prefix)
CYCLIC = [("MONTH", 12, "MONTH"), ("DAY_OF_WEEK", 7, "DAY"),
          ("DEP_HOUR", 24, "DEP_HOUR"), ("ARR_HOUR", 24, "ARR_HOUR")]

FEATURES_CLS = [
    "MONTH_SIN", "MONTH_COS", "DAY_SIN", "DAY_COS",
    "DEP_HOUR_SIN", "DEP_HOUR_COS", "ARR_HOUR_SIN", "ARR_HOUR_COS",
    "IS_WEEKEND", "IS_SUMMER", "IS_HOLIDAY_SEASON",
    "DEP_TIME_SLOT", "DEP_IS_PEAK_HOUR", "DEP_IS_RED_EYE",
    "ARR_TIME_SLOT", "ARR_IS_PEAK_HOUR", "ARR_IS_RED_EYE",
    "DISTANCE_CAT",
    "ROUTE", "ORIGIN_AIRPORT", "DESTINATION_AIRPORT", "AIRLINE",
    "IS_ORIGIN_HUB", "IS_DEST_HUB",
    "ROUTE_DELAY_RATE_15", "AIRLINE_DELAY_RATE_15", "HOUR_DELAY_RATE_15",
]
FEATURES_REG = [
    "MONTH_SIN", "MONTH_COS", "DAY_SIN", "DAY_COS",
    "DEP_HOUR_SIN", "DEP_HOUR_COS", "ARR_HOUR_SIN", "ARR_HOUR_COS",
    "IS_WEEKEND", "IS_SUMMER", "IS_HOLIDAY_SEASON",
    "DISTANCE",
    "ROUTE", "ORIGIN_AIRPORT", "DESTINATION_AIRPORT", "AIRLINE",
    "IS_ORIGIN_HUB", "IS_DEST_HUB",
    "ROUTE_DELAY_MEAN", "AIRLINE_DELAY_MEAN", "HOUR_DELAY_MEAN",
]
CAT_LOW_CLS = ["DEP_TIME_SLOT", "DISTANCE_CAT", "ARR_TIME_SLOT"]
CAT_LOW_REG: list = []
CAT_HIGH = ["ROUTE", "ORIGIN_AIRPORT", "DESTINATION_AIRPORT", "AIRLINE"]

# reference hyper-parameters of the two stages
CLASSIFIER_PARAMS = {"stepSize": 0.1, "maxDepth": 10, "maxIter": 200}
REGRESSOR_PARAMS = {"stepSize": 0.1, "maxDepth": 6, "maxIter": 100}
# grid searched by the notebook for every algorithm
PARAM_GRID = {"stepSize": [0.05, 0.1], "maxDepth": [6, 10], "maxIter": [100, 200]}
# expanding temporal folds: (train months <= a, validation months b..c)
TEMPORAL_FOLDS = [(6, 7, 8), (8, 9, 10)]
F1_EPS = 1e-9

# scoring request ranges
REQUEST_RULES = [
    ("month", 1, 12), ("day_of_week", 1, 7),
    ("scheduled_departure_hour", 0, 23), ("scheduled_arrival_hour", 0, 23),
]
SLOT_FIELDS = [
    "month", "day_of_week", "scheduled_departure_hour", "scheduled_arrival_hour",
    "origin_airport_code", "destination_airport_code", "airline_code", "distance",
]
# JSON types of the slots in tool calls and results
SLOT_TYPES = {
    "month": "INT", "day_of_week": "INT", "scheduled_departure_hour": "INT", "scheduled_arrival_hour": "INT",
    "origin_airport_code": "STRING", "destination_airport_code": "STRING", "airline_code": "STRING", "distance": "DOUBLE",
}
# earth radius in miles of the great-circle distance
EARTH_RADIUS_MILES = 3958.8
ENTITY_MAX_BYTES = 64 << 20    # vectors of a broadcast entity table
SESSION_HISTORY = 30          # messages kept per session
SEARCH_K = 5                  # neighbours returned by vector search
TOP_ROUTES = 20               # routes shown in the route table
MIN_ROUTE_SUPPORT = 100       # flights a route needs for the best/worst table
BEST_WORST_N = 5
TOP_IMPORTANCES = 15
# --- end of fixed values ----------------------------------------------------

# Scale knobs (ours, not the reference's).
BROADCAST_MAX_ROWS = 2_000_000   # lookup tables of more rows are never broadcast,
BROADCAST_MAX_BYTES = 256 << 20  # nor those whose rows, at their schema's width, take more than this
PREFIX_BUCKETS = 64              # range buckets of the distributed prefix sum
