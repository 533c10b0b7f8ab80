"""Word lists, messages, templates and configured limits.

Everything here has to equal the published behaviour for results to be right;
there is no logic in this file.
"""

# --- fixed values: text normalisation -------------------------------------

# The 32 ASCII punctuation characters (Python's string.punctuation).
ASCII_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

# Typographic quotes that the English word tokenizer sets apart as tokens of
# their own; they are never alphanumeric, so a space in their place is enough.
TYPOGRAPHIC_QUOTES = "«“‘„»”’"

# The characters Python's str.split()/str.strip() treat as white space.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The same set as a regular-expression class (valid in java.util.regex and RE2).
WHITESPACE_CLASS = (
    r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)
ALNUM_TOKEN = r"^[\p{L}\p{N}]+$"

# English stopwords. Entries with an apostrophe are left out: punctuation is
# deleted before the test, so they can never match.
STOPWORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves "
    "he him his himself she her hers herself it its itself they them their "
    "theirs themselves what which who whom this that these those am is are "
    "was were be been being have has had having do does did doing a an the "
    "and but if or because as until while of at by for with about against "
    "between into through during before after above below to from up down in "
    "out on off over under again further then once here there when where why "
    "how all any both each few more most other some such no nor not only own "
    "same so than too very s t can will just don should now d ll m o re ve y "
    "ain aren couldn didn doesn hadn hasn haven isn ma mightn mustn needn "
    "shan shouldn wasn weren won wouldn"
).split()

# Run-together words that the English word tokenizer splits in two.
CONTRACTIONS = {
    "cannot": "can not",
    "gimme": "gim me",
    "gonna": "gon na",
    "gotta": "got ta",
    "lemme": "lem me",
    "wanna": "wan na",
}

# Sentence: a run of non-terminators with the terminators that follow it.
SENTENCE = r"[^.!?]+[.!?]*"

# --- fixed values: quality score ------------------------------------------

SCORE_TARGET_SIMILARITY = 0.3
SCORE_SIMILARITY_SPAN = 0.7
SCORE_WEIGHTS = {"lexical": 0.3, "overlap": 0.2, "length": 0.2, "semantic": 0.3}
SUMMARY_METRICS = (
    "lexical_similarity",
    "word_overlap",
    "jaccard_similarity",
    "length_ratio",
    "semantic_similarity",
    "overall_score",
)

# --- fixed values: validation ---------------------------------------------

MAX_TEXT_CHARS = 10_000
MAX_BATCH_TEXTS = 1_000
MAX_REQUEST_TEXTS = 100
MAX_REQUEST_COST = 10
NOT_A_STRING = "Must be a string"
EMPTY_TEXT = "Cannot be empty"
TEXT_TOO_LONG = "Text too long (max 10000 chars)"
EMPTY_BATCH = "Input list cannot be empty"
TOO_MANY_TEXTS = "Too many texts (max {limit})"
EMPTY_PAIR = "Empty input"

# --- fixed values: prompts and replies ------------------------------------

REWRITE_PROMPT = "Paraphrase the following sentence: "
SEQ2SEQ_PREFIX = "paraphrase: "
CLASSIFY_PROMPT_HEAD = (
    "Classify the following sentence as human-written or machine-generated.\n\n"
    "Categories:\n"
    "- '1': Human-written\n"
    "- '0': Machine-generated\n\n"
    "Respond with ONLY the digit '0' or '1'.\n\n"
    'Sentence: "'
)
CLASSIFY_PROMPT_TAIL = '"\n\nClassification:'
NO_RESULT = "Could not generate paraphrase."
CALL_FAILED = "Error generating paraphrase."
UNKNOWN_PROVIDER = "Unknown provider."
FALLBACK_REPLIES = (NO_RESULT, CALL_FAILED, UNKNOWN_PROVIDER)
OFFLINE_REPLY_PREFIX = "Processed: "
REPORT_RULE = "-" * 40

# --- fixed values: providers and limits -----------------------------------

DEFAULT_PROVIDER = "openrouter"
PROVIDERS = {
    "openrouter": {
        "model": "deepseek/deepseek-chat-v3-0324:free",
        "features": ["paraphrase", "classification"],
        "capacity": 30.0,
        "refill": 0.5,
    },
    "gemini": {
        "model": "gemini-2.5-pro",
        "features": ["paraphrase"],
        "capacity": 60.0,
        "refill": 1.0,
    },
}
GLOBAL_CAPACITY = 100.0
GLOBAL_REFILL = 2.0

# --- fixed values: retries, memo and store --------------------------------

MAX_RETRIES = 3
RETRY_DELAY = 1.0
MEMO_TTL_SECONDS = 3600
MEMO_PREFIX = "paraphrase"
