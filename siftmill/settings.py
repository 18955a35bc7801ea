"""Defaults of the operators. All of them are parameters."""

from __future__ import annotations

# Thresholds, sizes and word lists that results depend on.
WINDOW_SENTENCES = 3
WINDOW_STRIDE = 1
MIN_TOKENS = 20
MAX_MODEL_TOKENS = 512
NEIGHBOURS = 50
RISK_NEIGHBOURS = 100
RISK_DENSITY = 0.45
SAFE_DENSITY = 0.40
HIGH_EMOTION = 0.7
LOW_EMOTION = 0.3
EMOTION_FLAG = 0.5
PROBE_THRESHOLD = 0.90
TEMPERATURE = 1.0
AMBIGUOUS_BELOW = 0.25
RISK_THRESHOLD = 0.5
AUTHOR_CAP = 5
EXEMPT_AUTHORS = ("unknown",)
UNKNOWN_AUTHORS = ("unknown", "[deleted]", "")
FIRST_SECOND = 1627776000.0
LAST_SECOND = 1661990400.0
QUOTA_FLOOR = 10_000
QUOTA_CEILING = 200_000
QUOTA_PER_GROUP = 60_000
TEST_SHARE = 0.15
SEED = 42
REQUESTS_PER_MINUTE = 5_000
TOKENS_PER_MINUTE = 5_000_000
EMBEDDING_WIDTH = 1536
NO_CLASS = "(none)"
EMPTY_BODIES = ("nan", "none", "", "[removed]", "[deleted]")
RISK_TABLE_MARK = "mental_health"
REMOVAL_MARKS = ("[removed]", "[deleted]")
SKIPPED_CSV_FILES = ("emotion_words.csv", "ekman_labels.csv")
EMOTIONS = (
    "admiration", "amusement", "anger", "annoyance", "approval", "caring", "confusion",
    "curiosity", "desire", "disappointment", "disapproval", "disgust", "embarrassment",
    "excitement", "fear", "gratitude", "grief", "joy", "love", "nervousness", "optimism",
    "pride", "realization", "relief", "remorse", "sadness", "surprise", "neutral",
)
POSITIVE_EMOTIONS = (
    "joy", "love", "excitement", "admiration", "optimism", "pride", "amusement", "gratitude",
)
NEGATIVE_EMOTIONS = (
    "sadness", "grief", "anger", "fear", "nervousness", "remorse", "disgust", "annoyance",
    "disappointment",
)
# The characters that trimming removes: all Unicode blanks and the ASCII separators.
BLANKS = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
# A token: a run of letters, digits and underscores, or one other visible character.
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\p{Z}\t\n\x0b\f\r\x1c-\x1f\x85]"
