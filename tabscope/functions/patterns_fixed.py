"""Fixed values that results must agree on.

FIXED VALUES: the regular expressions, name rules and suffix lists below decide
which columns are reported, so they are kept exactly as the behaviour we match
expects.  They are data, not logic; change them only together with the tests.
"""

# FIXED VALUES - personal-data regexes, in priority order (ties go to the earlier one).
PII_PATTERNS = (
    ("EMAIL", r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"),
    ("SSN", r"\d{3}-\d{2}-\d{4}"),
    ("PHONE", r"(\+\d{1,2}\s)?\(?\d{3}\)?[\s.-]\d{3}[\s.-]\d{4}"),
)

# FIXED VALUES - column-name rule for a person's name (matched on the lower-cased name).
PERSON_NAME_REGEX = (
    r"^(?:(?:first|last|full|given|middle|sur|family|"
    r"customer|person|employee|client|owner|contact)_)?name$"
)
PERSON_NAME_TYPE = "NAME"
PERSON_NAME_CONFIDENCE = 0.75

# FIXED VALUES - universal (always active) value patterns, in order.
UNIVERSAL_PATTERNS = (
    ("IBAN", r"^[A-Z]{2}\d{2}[A-Z0-9]{11,30}$"),
    ("SWIFT_BIC", r"^[A-Z]{6}[A-Z0-9]{2}([A-Z0-9]{3})?$"),
    ("ISO_8601", r"^\d{4}-\d{2}-\d{2}"),
    ("ISO_4217", r"^[A-Z]{3}$"),
    ("EMAIL", r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"),
)

# What every match of a fixed regex needs, as cheap SQL over {q} (a final line break, which ``$`` allows, counts).
NEEDS = {
    PII_PATTERNS[0][1]: "contains({q}, '@')",
    PII_PATTERNS[1][1]: "length({q}) >= 11 AND contains({q}, '-')",
    PII_PATTERNS[2][1]: r"length({q}) >= 12 AND {q} RLIKE '\\d{{3}}[\\s.-]\\d{{4}}'",  # its end, which is found faster
    UNIVERSAL_PATTERNS[0][1]: "length({q}) BETWEEN 15 AND 36",
    UNIVERSAL_PATTERNS[1][1]: "length({q}) BETWEEN 8 AND 13",
    UNIVERSAL_PATTERNS[2][1]: "substring({q}, 5, 1) = '-'",
    UNIVERSAL_PATTERNS[3][1]: "length({q}) BETWEEN 3 AND 5",
    UNIVERSAL_PATTERNS[4][1]: "contains({q}, '@')",
}

# FIXED VALUES - the shipped source-system patterns (user patterns; unanchored).
DEFAULT_CUSTOM_PATTERNS = (
    ("ACCOUNT_ID", r"ACC-\d{6}"),
    ("CUSTOMER_ID", r"CUST-\d{6}"),
    ("LOAN_ID", r"LOAN-\d{6}"),
    ("BRANCH_CODE", r"BR-\d{3}"),
)

# FIXED VALUES - name-suffix heuristics, in the order they are reported.
NAME_HEURISTICS = (
    ("LIKELY_KEY", ("_id", "_pk", "_key")),
    ("LIKELY_TEMPORAL", ("_date", "_dt", "_timestamp")),
    ("LIKELY_MEASURE", ("_amt", "_amount", "_bal", "_balance")),
)
HIGH_UNIQUENESS = "HIGH_UNIQUENESS_CANDIDATE"
LOW_CARDINALITY = "LOW_CARDINALITY_CATEGORICAL"

# FIXED VALUES - thresholds.
PII_MIN_CONFIDENCE = 0.1          # strictly greater
PATTERN_MIN_RATIO = 0.5           # strictly greater
HIGH_UNIQUENESS_RATIO = 0.95      # strictly greater, and no nulls
LOW_CARDINALITY_MAX_DISTINCT = 50  # strictly less
LOW_CARDINALITY_MAX_RATIO = 0.1   # strictly less
FK_MIN_RATIO = 0.90               # greater or equal
IQR_FENCE = 1.5
INTERESTING_NULL_PCT = 0.10       # greater or equal
DQ_NULL_PCT = 0.20                # greater or equal
REPORT_SCHEMA_VERSION = "1.1.0"
DEFAULT_SOURCE_SYSTEM = "unknown"

# FIXED VALUES - deterministic interpretation texts and weights.
BK_CONFIDENCE = 0.65
BK_REASONING = "Heuristic: unique/non-null or ID-like column."
DQ_NULL_TEXT = "%s has high null rate (%.0f%%)."
DQ_OUTLIER_TEXT = "%s shows outliers (IQR heuristic)."
PII_TEXT = "%s: detected %s (confidence %.2f)."
INTERPRETATION_CONFIDENCE = 0.25
SCORE_PII = 2.0
SCORE_PK = 1.5
SCORE_PATTERN = 1.0
SCORE_OUTLIER = 1.0
TABLE_ORDER_UP_TO = 50            # wider tables are ranked by score
TOP_COLUMNS = 30                  # and their first so many ranks are marked
