"""String expressions shared by all operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tokens a CSV reader treats as missing.
MISSING_TOKENS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)

# Code points that count as whitespace, tabs and no-break spaces included.
WHITESPACE = tuple(
    chr(i)
    for i in (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
              0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
)

# Format rules that can be switched on per column.
EMAIL_PATTERN = r"(?U)^[\w\.\+\-]+@[\w\-]+\.[a-zA-Z]{2,}$"
PHONE_PATTERN = r"(?U)^[\+\d\s\-\(\)]{7,15}$"

# Phrases that mark a message as unrelated to data quality.
OFF_TOPIC_PHRASES = (
    "poem",
    "joke",
    "story",
    "recipe",
    "weather",
    "news",
    "sports",
    "translate",
    "write me",
    "write a",
    "sing",
    "lyrics",
    "fiction",
    "stock price",
    "crypto",
    "investment advice",
    "personal advice",
    "what is the capital",
    "who is the president",
    "history of",
    "meaning of life",
    "tell me about yourself",
)


def drop_missing_tokens(c: Column) -> Column:
    return F.when(~c.isin(*MISSING_TOKENS), c)


def has_outer_whitespace(c: Column) -> Column:
    """Looks at the first and last character only, whatever the length of the text."""
    one = F.lit(1)
    return F.left(c, one).isin(*WHITESPACE) | F.right(c, one).isin(*WHITESPACE)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit("".join(WHITESPACE)))


def is_off_topic(message: Column) -> Column:
    pattern = "|".join(rf"\Q{p}\E" for p in OFF_TOPIC_PHRASES)
    return F.lower(message).rlike(pattern)


def listed(names: Column) -> Column:
    """Text of a string array in list notation: ``['a', 'b']``."""
    quoted = F.transform(names, lambda n: F.concat(F.lit("'"), n, F.lit("'")))
    return F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))
