"""Fixed values that results depend on."""

# --- fixed values: link and air interface -----------------------------------------------------
SLOT_SECONDS = 0.0005
SUBCARRIERS_PER_PRB = 12
SYMBOLS_PER_SLOT = 14
EXPONENT_BITS = 8
PRBS_PER_CELL = 273
OVERHEAD = 1.08
CONTROL_RESERVE = 0.03
LINK_GBPS = 25.0
REFERENCE_WIDTH = 9
SLOTS_PER_SECOND = 2000
DATA_RES = 168 * 0.8            # usable resource elements of one PRB-layer in one slot

# --- fixed values: default cell classes (class, name, deadline, priority, bits per RE, layers) --
CELL_CLASSES = [
    (0, "LL-0", 4, 3.0, 2.5, 4),
    (1, "LL-1", 4, 3.0, 4.0, 4),
    (2, "LL-2", 4, 3.0, 3.0, 4),
    (3, "eMBB-0", 20, 1.0, 2.0, 4),
    (4, "eMBB-1", 20, 1.0, 3.5, 4),
    (5, "eMBB-2", 20, 1.0, 4.5, 4),
    (6, "eMBB-3", 20, 1.0, 5.5, 4),
    (7, "eMBB-4", 20, 1.0, 3.0, 4),
]

# --- fixed values: scenarios (name, family, offered load) -----------------------------------------
SCENARIOS = [
    ("low", "synthetic", 0.50),
    ("moderate", "synthetic", 0.65),
    ("high", "synthetic", 0.80),
    ("overload_bursts", "synthetic", 0.80),
    ("shift", "synthetic", 0.80),
    ("tgpp_moderate", "3gpp", 0.65),
    ("tgpp_high", "3gpp", 0.80),
    ("mm_moderate", "markov", 0.65),
    ("mm_high", "markov", 0.80),
    ("mm_shift", "markov", 0.80),
]
# inclusive seed ranges of the three splits
SEED_SPLITS = {"train": (1000, 1015), "val": (2000, 2003), "test": (3000, 3019)}

# --- fixed values: forecasting --------------------------------------------------------------------
QUANTILE_LEVELS = [0.05, 0.25, 0.5, 0.75, 0.9, 0.95]
LAG_BLOCKS = 6
LAST_SLOTS = 4
RATE_LAGS = 3
FORECAST_WINDOW = 30
NUM_PATCHES = 16

# --- fixed values: control ------------------------------------------------------------------------
INTERVAL_SLOTS = 20
TELEMETRY_DELAY = 2
W_MIN = 0.25
LL_DEADLINE = 10               # a key is low-latency when its deadline is at most this

# --- fixed values: TS 38.214 CQI efficiencies and TR 36.942 link mapping ---------------------------
CQI_EFFICIENCY = [0.1523, 0.2344, 0.3770, 0.6016, 0.8770, 1.1758, 1.4766, 1.9141,
                  2.4063, 2.7305, 3.3223, 3.9023, 4.5234, 5.1152, 5.5547]
SHANNON_ALPHA = 0.6
SINR_MIN_DB = -10.0

# --- fixed values: digits as words, for labels that may hold letters only ---------------------------
DIGIT_WORDS = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine"]
