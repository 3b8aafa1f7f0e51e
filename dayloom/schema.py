"""Names and fixed settings shared by the operators."""

KEY = "series_id"
DAY = "ds"
TARGET = "y"

# They must equal these for results to match.
LAGS = (1, 7, 30, 90, 365)
WINDOWS = (7, 30, 90)
PERIODS = (7, 30, 365)
HARMONICS = 3
MAX_PERIOD = 400
TOP_PERIODS = 3
MIN_CYCLES = 3
MIN_ACF_ROWS = 16
PEAK_FLOOR = 0.1
TEST_FRACTION = 0.2
MIN_ROWS = 10
TREND_RIDGE = 1e-6
MAX_TREND_DEGREE = 2
MIN_TREND_ROWS = 5
NUMERIC_SHARE = 0.6
LABEL_SAMPLE = 200
TOP_MODELS = 3

# Longest look-back of any feature: recursion never needs older values.
MEMORY = max(LAGS + WINDOWS)
