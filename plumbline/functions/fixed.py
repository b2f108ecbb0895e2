"""Fixed values.

Word lists, patterns, thresholds and weights that decide results. They are data,
not logic: changing one changes what a check counts or what a fix touches.
"""

# Words that mean "no data" when they are the whole trimmed, lower-cased cell.
JUNK_WORDS = [
    "unknown", "unknwon", "unknow",
    "error", "err", "#error", "#err",
    "n/a", "na", "n.a", "n.a.", "#n/a", "#na",
    "null", "none", "nil",
    "missing", "miss",
    "undefined", "undef",
    "-", "--", "---", "?", "??",
    "not available", "not applicable",
    "empty", "blank",
    "tbd", "tbc", "todo",
]

# Words that mark a row as test data when they stand at word boundaries.
TEST_WORDS = ["test", "dummy", "fake", "sample", "xxx", "n/a", "asdf", "null", "123"]

# Value pairs that make a column boolean, and the truth value of each word.
BOOLEAN_PAIRS = [("true", "false"), ("yes", "no"), ("y", "n"), ("1", "0")]

# Patterns (Python semantics: \w and \s are Unicode aware, hence (?U)).
EMAIL_PATTERN = r"(?U)^[\w\.-]+@[\w\.-]+\.\w{2,}$"
PHONE_PATTERN = r"(?U)^\+?[\d\s\-\(\)]{7,15}$"
HTML_TAG_PATTERN = r"<[^>]+>"
SQL_BREAKING_PATTERN = r"['\";\\]"
CURRENCY_PATTERN = r"[$,%€£]"
NUMBER_PATTERN = r"(?i)^\s*[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?|inf(?:inity)?)\s*$"

# Every character that counts as whitespace at the edges of a text.
WHITESPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
              "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")

# Column roles, found as case-insensitive substrings of the column name.
DATE_WORDS = ["date", "time"]
EMAIL_WORDS = ["email", "mail"]
PHONE_WORDS = ["phone", "mobile", "tel", "cell"]
PII_WORDS = ["email", "phone", "mobile", "ssn", "passport", "address", "password",
             "dob", "birth", "credit", "card", "ip", "name"]
KEY_WORDS = ["id", "key", "code", "uuid", "pk"]
FEATURE_DATE_WORDS = ["date", "time", "day", "month", "year", "created", "updated"]
PRICE_WORDS = ["price", "cost", "spend", "spent", "amount", "revenue", "sales", "total"]
QUANTITY_WORDS = ["qty", "quantity", "count", "units", "volume", "num"]
# The narrower lists by which a unit price picks its two columns.
UNIT_PRICE_WORDS = ["price", "cost", "spend", "spent", "amount", "total"]
UNIT_QUANTITY_WORDS = ["qty", "quantity", "count", "units"]

# Business impact of a gap, by words in the column name; the first match wins.
IMPACT_CLASSES = [
    ("contact", ["phone", "mobile", "tel"]),
    ("email", ["email", "mail"]),
    ("finance", ["price", "revenue", "amount", "sales", "cost"]),
    ("time", ["date", "time", "created", "updated"]),
    ("identity", ["name", "customer", "client", "user"]),
    ("demography", ["age", "gender", "region", "city", "country"]),
]

# Date formats tried after the ISO forms; the first one that parses wins.
DATE_FORMATS = ["yyyy/MM/dd", "dd/MM/yyyy", "MM/dd/yyyy", "dd-MM-yyyy", "dd.MM.yyyy",
                "dd MMM yyyy", "MMM dd, yyyy"]

# Day first and month first: a column is read in one of the two orders only.
DATE_ORDERS = ["dd/MM/yyyy", "MM/dd/yyyy"]

# Cells of a CSV file that mean "missing".
NA_VALUES = ["#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
             "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]

# The 17 scored checks, in reporting order:
# (check, label, category, fix, HIGH weight, MEDIUM weight)
CHECKS = [
    ("duplicates", "Duplicate rows", "A", "remove_duplicates", 20, 10),
    ("empty_rows", "Empty or whitespace-only rows", "A", "drop_empty_rows", 10, 5),
    ("nulls", "Missing values", "A", "smart_impute", 25, 12),
    ("outliers", "Statistical outliers", "A", "handle_outliers", 15, 7),
    ("column_names", "Non-standard column names", "A", "clean_column_names", 0, 5),
    ("string_quality", "String quality", "A", "standardize_strings", 0, 7),
    ("date_formats", "Date formats", "A", "fix_date_formats", 0, 8),
    ("data_types", "Wrong data types", "A", "fix_numeric_strings", 0, 8),
    ("sparse_columns", "Sparse columns", "A", "drop_sparse_columns", 15, 8),
    ("constant_columns", "Constant columns", "A", "drop_constant_columns", 0, 5),
    ("high_correlation", "Highly correlated columns", "A", "drop_highly_correlated", 0, 5),
    ("mixed_types", "Mixed types in a column", "M", None, 0, 7),
    ("email_format", "Invalid email addresses", "A", "validate_emails", 10, 5),
    ("phone_format", "Invalid phone numbers", "A", "validate_phones", 0, 5),
    ("test_data", "Test or junk rows", "A", "flag_test_data", 0, 5),
    ("typos", "Near-duplicate values", "A", "auto_fix_typos", 0, 5),
    ("pii", "Possible personal data", "M", None, 10, 0),
]

# Lowest score of each grade; anything lower is D.
GRADES = [("A", 90), ("B", 75), ("C", 55)]

# Fixes in the order in which an approved plan applies them.
FIX_ORDER = ["duplicates", "empty_rows", "nulls", "outliers", "column_names", "string_quality",
             "date_formats", "data_types", "sparse_columns", "constant_columns",
             "high_correlation", "email_format", "phone_format", "test_data", "typos"]
