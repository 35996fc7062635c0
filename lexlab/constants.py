"""Fixed values that must equal the behaviour being rebuilt.

Everything here is a plain constant; logic lives in the operators.
"""

# --- fixed values: label domain (general family), id order ---------------
GENERAL_LABELS = ["negative", "neutral", "positive"]          # ids 0, 1, 2

# --- fixed values: per-family label order ---------------------------------
FAMILY_LABEL2ID = {
    "general": {"negative": 0, "neutral": 1, "positive": 2},
    "finance": {"positive": 0, "negative": 1, "neutral": 2},
}

# --- fixed values: corpus agreement subsets -> file name -------------------
AGREEMENT_FILES = {
    "all": "Sentences_AllAgree.txt",
    "75": "Sentences_75Agree.txt",
    "66": "Sentences_66Agree.txt",
    "50": "Sentences_50Agree.txt",
}
# minimum annotator agreement (percent) for each subset; subsets are nested
AGREEMENT_MIN_PCT = {"all": 100, "75": 75, "66": 66, "50": 50}

# --- fixed values: corpus line format --------------------------------------
CORPUS_DELIMITER = "@"
CORPUS_ENCODING = "ISO-8859-1"

# Characters Python's str.strip() removes (Unicode White_Space plus the
# information separators U+001C..U+001F), in code-point order.
STRIP_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0"
    "\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# --- fixed values: parameter-name substrings that mark a trainable head ---
HEAD_KEYS = ["classifier", "pre_classifier", "score"]

# --- fixed values: split ratios and seeds ----------------------------------
TRAIN_RATIO_NUM, RATIO_DEN = 70, 100        # 70 / 30 first cut
TEST_OF_HOLDOUT_NUM, HOLDOUT_DEN = 50, 100  # 50 / 50 of the holdout
SPLIT_SEED = 42
LADDER_SEEDS = [42, 43, 44]
MAX_LENGTH = 128
EVAL_BATCH_SIZE = 32
LORA_RANK = 8
