"""Fixed values that must equal the reference's for the same results.

FIXED VALUES - stated plainly, in the order the reference uses them.
"""

# Survey sentinel codes (negative codes mean "not a real answer").
SENTINEL_CODES = [-3, -5, -8, -13]

# Labels that carry no information and become NULL.
UNINFORMATIVE_LABELS = [
    "Don't Know",
    "Refused",
    "Not Applicable",
    "Missing",
    "Unit in retirement village",
]

# Education of the household head, from the level POSITION of the labelled
# factor to years of schooling.  (lo, hi, result) in evaluation order; a
# result of None means NULL; ("minus", k) means position - k; rows that
# match no rule keep their value.
EDUCATION_POSITION_RULES = [
    (None, 4, None),
    (5, 17, ("minus", 5)),
    (18, 22, 11),
    (23, 24, 13),
    (25, 25, 15),
    (26, 27, 16),
    (28, 28, 18),
    (29, 29, None),
    (30, 30, 0),
]

# Education of the household head from the RAW code, as a nested if/else,
# outermost test first.  Afterwards codes < 0 and code 24 become NULL.
EDUCATION_CODE_RULES = [
    (25, 25, 0),
    (13, 17, 11),
    (21, 23, ("minus", 6)),
    (18, 19, 13),
    (20, 20, 13),
]
EDUCATION_CODE_NULL = [24]

# Text removed from district labels, applied in this order.
DISTRICT_LABEL_PATTERNS = [
    " District Municipality",
    " Municipality",
    " Metropolitan",
    "City Of ",
]

# Default number of outcome-quantile break points in a stratified split
# (the break points include the minimum and maximum).
SPLIT_BREAKS = 5

# Default number of bootstrap draws when no resampling control is given.
BOOTSTRAP_DRAWS = 25

# Near-zero-variance screen: frequency ratio and percent-unique cut-offs.
NZV_FREQ_CUT = 95 / 5
NZV_UNIQUE_CUT = 10

# Correlation filter cut-off.
CORRELATION_CUTOFF = 0.75

# Aliasing tolerance of the least-squares decomposition.
ALIAS_TOL = 1e-7
