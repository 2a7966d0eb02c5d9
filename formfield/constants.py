"""Fixed values of the scoring model and of the page format."""

# --- Fixed values: model -----------------------------------------------------
NO_PRICE = 999.0
MIN_PRICE = 1.01
MARKET_ALPHA = 0.60
MARKET_TAB_WEIGHT = 0.55
MARKET_BF_WEIGHT = 0.45
FUND_SCALE = 1.10
COMPONENT_WEIGHTS = {
    "speed": 0.29,
    "early": 0.23,
    "box": 0.14,
    "trackdist": 0.14,
    "form": 0.10,
    "trainer": 0.05,
    "freshness": 0.05,
}
BOX_PRIOR = {1: 0.187, 2: 0.141, 3: 0.117, 4: 0.110, 5: 0.108, 6: 0.100, 7: 0.107, 8: 0.130}
BOX_PRIOR_OTHER = 0.125
QUICK_PHRASES = ("quick to begin",)
SLOW_PHRASES = ("slow to begin", "slowly away")
RECENT_RUNS = 6

# --- Fixed values: defaults of an absent field -------------------------------
DEFAULTS = {
    "form": "",
    "trainer_win": 0.10,
    "trainer_place": 0.35,
    "tra_dist_best": 0.0,
    "dls": 14,
}
NO_RECORD = "0-0-0"

# --- Fixed values: labels of the record strip, in page order ------------------
RECORD_LABELS = (
    "Car", "12m", "Crs", "Dist", "Crs & Dist",
    "FU", "2U", "3U", "ClockW", "AClockW", "Dirt", "Sand",
)
RECORD_KINDS = {
    "Car": "career",
    "12m": "12m",
    "Crs": "course",
    "Dist": "distance",
    "Crs & Dist": "course_distance",
    "FU": "fu",
    "2U": "2u",
    "3U": "3u",
}

# --- Fixed values: page limits ------------------------------------------------
MAX_TAB = 10
MAX_BOX = 8
MIN_PAGE_CHARS = 300
RUN_LOOKBACK = 18
PREFIX_CHARS = 320
FALLBACK_CHARS = 400

# --- Fixed values: wording of the data-quality warnings -----------------------
WARN_NO_TABLE = "Could not locate the runners table."
WARN_NO_DETAIL = "No detail block found for #%s %s."
WARN_UNASSIGNED = "One or more active reserves could not be assigned to a vacant box."
WARN_DETAILS_MISSING = "Detailed form was not parsed for %s active runner(s)."
WARN_FEW_RUNS = "%s active runner(s) have fewer than three parsed recent runs; model confidence is reduced."
WARN_TAB_GAP = "Tab number %s is missing from the parsed field."
