"""Production defaults of the pipeline. All are parameters of the operators that use them."""

# Limits, thresholds and weights that results depend on.
MIN_TEXT_CHARS = 300
VECTOR_SIZE = 384
DEDUP_COSINE = 0.90
STORY_COSINE = 0.93
ENTITY_MIN_DF = 3
ENTITY_FULL_AT = 4
ENTITY_MIN_CHARS = 4
COVERAGE_FULL_AT_MIN = 3
SCALE_VALUES = {1: 0.0, 2: 0.25, 3: 0.5, 4: 0.75, 5: 1.0}
SCALE_UNGRADED = 0.5
NOVELTY_FLOOR = 0.88
WEIGHTS = {"lexrank": 0.0, "coverage": 0.25, "entity": 0.15, "scale": 0.40, "novelty": 0.20, "topic": 0.20}
QUOTA = {"TR": 7, "CA": 7, "SC": 6}
ITEMS = 20
DEFICIT_POOL_CAP = 500
MAX_RESERVE_SCAN = 50
MAX_VERSIONS = 6
LEXRANK_DAMPING, LEXRANK_ROUNDS, LEXRANK_TOLERANCE = 0.85, 100, 1e-6
SEEN_KEEP_DAYS = 30
FINAL_VERDICTS = ("accepted", "rejected", "short", "non_event", "prefiltered")
PENDING = "pending"
REGIONS = ("NO", "TR", "CA", "SC", "MIX")
EVENT_WINDOW_DAYS = 7
LEAST_LABELS, LEAST_MINORITY, TARGET_RECALL, LEAST_GAIN = 3000, 500, 0.97, 0.30
JUDGE_BATCH, JUDGE_TEXT_CHARS = 10, 2000
