"""Fixed values the results depend on.

These are stated once, plainly, because they must equal the behaviour being
reproduced (column names, text rules, limits). Everything else in the library
derives from them.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES — the sales table
# ---------------------------------------------------------------------------

# The eight sales columns, by name and in this order.
SALES_COLUMNS = ["Date", "Day", "OrderID", "Item", "Quantity", "Price", "Category", "PaymentType"]

# Date text written and read by the sales table: day/month/year/hour:minute:second.
DATE_TEXT_FORMAT_SPARK = "dd/MM/yyyy/HH:mm:ss"     # writing (zero padded)
DATE_PARSE_FORMAT_SPARK = "d/M/yyyy/H:m:s"         # reading (one or two digits)
DATE_FORMAT_SQL = "%d/%m/%Y/%H:%M:%S"              # the same in strftime notation
# Shape a date text must have before it is parsed: 1-2 digit day, month, hour,
# minute, second and a 4-digit year, nothing around it.
DATE_TEXT_SHAPE = r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}/[0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2}$"

# Labels that mean "no value" after trimming, for category and payment type.
UNKNOWN_LABEL = "Unknown"
UNKNOWN_WORDS = ["", "nan", "None"]
# Text a missing value turns into for order and item keys.
MISSING_KEY = "nan"

# Default missing-value spellings of the pandas readers (exact, untrimmed match).
EXCEL_NA_VALUES = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

# Characters Python's str.strip() removes (str.isspace(), all below U+3001),
# derived by rule rather than listed; a plain blank trim keeps most of them.
PY_WHITESPACE = "".join(ch for ch in map(chr, range(0x3001)) if ch.isspace())

# A number a text cell may hold (pandas to_numeric accepts these; "1d",
# "1,000" and "0x10" are not numbers).
NUMBER_SHAPE = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"

# Time-of-day buckets: before 12h, before 18h, the rest.
BUCKETS = ["morning", "daytime", "evening"]
MORNING_BEFORE_HOUR = 12
DAYTIME_BEFORE_HOUR = 18

# Chart limits.
TOP_ITEMS = 20
TOP_PAIRS = 20
PAIR_SEPARATOR = " + "

# ---------------------------------------------------------------------------
# FIXED VALUES — uploads and validation
# ---------------------------------------------------------------------------

WORKBOOK_SUFFIXES = [".xlsx", ".xlsm", ".xltx", ".xltm"]
MAX_UPLOAD_BYTES = 10 * 1024 * 1024            # size must be below this
PROFILE_SUFFIXES = [".xlsx", ".xls", ".csv"]
MAX_PROFILE_BYTES = 10 * 1024 * 1024           # size may equal this

CHECK_TITLES = [
    "1. File Type: Excel",
    "2. File Size: < 10MB",
    "3. Required Columns + Datatypes",
]
MSG_TYPE_OK = "File type is valid Excel format."
MSG_TYPE_BAD = "Only Excel files (.xlsx/.xlsm/.xltx/.xltm) are allowed."
MSG_SIZE_OK = "File size is less than 10MB."
MSG_SIZE_BAD = "File size must be less than 10MB."
MSG_UNREADABLE = "Unable to read Excel file. The file might be corrupted."
MSG_EMPTY_FILE = "Excel file is empty."
MSG_BAD_HEADER = "Required columns are missing or in incorrect order. Expected: " + ", ".join(SALES_COLUMNS)
MSG_NO_DATA = "Excel file must include at least one data row."
MSG_SCHEMA_OK = "Required columns and datatypes are valid."
MSG_SKIPPED = "Skipped because file type or file size validation failed."

# ---------------------------------------------------------------------------
# FIXED VALUES — recording sales and inventory
# ---------------------------------------------------------------------------

ORDER_PREFIX = "O"
FIRST_LAST_ORDER_NUMBER = 100          # so the first order is O101
ITEM_PREFIX = "I"
FIRST_LAST_ITEM_NUMBER = 1000          # so the first item is I1001
MAX_ITEM_LEN = 120
MAX_CATEGORY_LEN = 80
MAX_PAYMENT_LEN = 50
MAX_DATASET_NAME_LEN = 120
MAX_ITEM_ID_LEN = 20
MAX_BARCODE_LEN = 80
INVENTORY_TIME_FORMAT = "dd/MM/yyyy HH:mm"
WEEKDAY_FORMAT = "EEEE"

# ---------------------------------------------------------------------------
# FIXED VALUES — dataset profile and chat messages
# ---------------------------------------------------------------------------

SAMPLE_ROWS = 20
SAMPLE_VALUE_CHARS = 80
MAX_CONTEXT_CHARS = 7000
MSG_EMPTY_DATASET = "The uploaded dataset is empty."
TOPIC_LOOKBACK = 6
HISTORY_KEEP = 8
HISTORY_ROLES = ["user", "assistant"]
FOLLOW_UP_MAX_CHARS = 20

BUSINESS_KEYWORDS = [
    "business", "sale", "sales", "profit", "profits", "revenue", "inventory",
    "inventories", "pricing", "price", "prices", "margin", "margins",
    "customer", "customers", "marketing", "promotion", "promotions",
    "forecast", "forecasting", "demand", "order", "orders", "stock", "stocks",
    "cost", "costs", "retail", "upsell", "cross-sell", "cross sell", "growth",
    "strategy", "strategies", "operation", "operations", "trend", "trending",
    "month", "year", "cashflow", "cash flow", "conversion", "store",
]

FOLLOW_UP_PHRASES = [
    "yes", "no", "ok", "okay", "sure", "continue", "go ahead", "next",
    "first", "second", "third",
]

# Chat request settings.
CHAT_TEMPERATURE = 0.2
CHAT_MAX_TOKENS = 500

# ---------------------------------------------------------------------------
# FIXED VALUES — barcode scans
# ---------------------------------------------------------------------------

# A repeated code is accepted again only after this many milliseconds.
SCAN_REPEAT_MS = 1500
