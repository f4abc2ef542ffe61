"""Limits, word lists and names that several parts share."""

# What counts as which file, which word, which name.
COMPRESSIONS = ("gz", "bz2", "xz")
CSV_NAME = r"(?i)\.csv(\.(gz|bz2|xz))?$"
NULL_WORDS = ("na", "n/a", "null", "nan", "none")
WATCHED_WORDS = ("user", "username", "login", "uid", "owner", "submitter", "email", "mail", "name", "project", "account", "person")
#: Numbers as a text reader without locale takes them; the guard keeps out what only Spark's cast accepts.
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"

VALUES_TRACKED = 1000
VALUES_SHOWN = 10
SINGLE_VALUE_SHARE = 0.99
LEAST_COVERAGE = 0.10
PREVIEW_ROWS = 1000
EXACT_COUNT_BYTES = 8 << 20
CELLS_A_BATCH, LEAST_BATCH, MOST_BATCH = 1_000_000, 2_000, 100_000
MANIFEST_FORMAT = 1

DRAFTS, MARKDOWN, REPORTS, INDEX = "draft_croissants", "draft_markdown", "reports", "INDEX.txt"
