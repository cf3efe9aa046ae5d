"""How each column of a table is read: as number, text, boolean, time or nested value."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.functions.numbers import text_to_number
from assayer.functions.times import to_naive_utc

# A column whose name holds one of these must not be negative.
NON_NEGATIVE_WORDS = (
    "age",
    "qty",
    "quantity",
    "count",
    "los",
    "stay",
    "price",
    "stock",
    "duration",
    "amount",
    "revenue",
    "salary",
    "cost",
    "rating",
    "score",
    "length",
)

# A column whose name holds one of these may hold money.
VALUE_WORDS = (
    "revenue",
    "amount",
    "price",
    "sales",
    "cost",
    "value",
    "total",
    "payment",
    "transaction",
    "spend",
    "income",
    "earning",
    "fee",
    "charge",
    "invoice",
    "balance",
    "profit",
    "loss",
)

# Currency by part of the column name, first hit wins.
CURRENCY_WORDS = (
    ("inr", "₹"),
    ("rupee", "₹"),
    ("rs", "₹"),
    ("usd", "$"),
    ("dollar", "$"),
    ("eur", "€"),
    ("euro", "€"),
    ("gbp", "£"),
    ("pound", "£"),
)
DEFAULT_CURRENCY = "$"


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


@dataclass(frozen=True)
class ColumnSpec:
    ordinal: int
    name: str
    dtype: str
    kind: str  # number, text, bool, time, other

    @property
    def value(self) -> Column:
        """The column with NaN read as missing."""
        c = quoted(self.name)
        return F.when(~F.isnan(c), c) if self.dtype in ("float", "double") else c

    @property
    def number(self) -> Column:
        if self.kind == "text":
            return text_to_number(quoted(self.name))
        if self.kind == "number":
            return self.value.cast("double")
        return F.lit(None).cast("double")

    @property
    def time(self) -> Column:
        return to_naive_utc(quoted(self.name), self.dtype)

    @property
    def groupable(self) -> Column:
        """The column in a form that can be grouped and counted distinct."""
        if self.dtype == "binary":
            return F.hex(quoted(self.name))
        if self.kind == "other":
            return F.to_json(quoted(self.name))
        return self.value

    @property
    def label(self) -> Column:
        """Text form shown as a category value."""
        if self.dtype in ("float", "double"):
            return (self.value + F.lit(0.0)).cast("string")
        return self.groupable.cast("string")


def _kind(dtype: T.DataType) -> str:
    if isinstance(dtype, (T.StringType, T.CharType, T.VarcharType)):
        return "text"
    if isinstance(dtype, T.NumericType):
        return "number"
    if isinstance(dtype, T.BooleanType):
        return "bool"
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "time"
    return "other"


def distinct_names(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """Give repeated column names a suffix (``a``, ``a.1``); also list the repeated names."""
    counts = Counter(df.columns)
    repeated = [n for n, c in counts.items() if c > 1]
    if not repeated:
        return df, []
    seen: Counter = Counter()
    names = []
    for n in df.columns:
        names.append(n if seen[n] == 0 else f"{n}.{seen[n]}")
        seen[n] += 1
    return df.toDF(*names), repeated


def column_specs(df: DataFrame) -> list[ColumnSpec]:
    return [
        ColumnSpec(i, f.name, f.dataType.simpleString(), _kind(f.dataType))
        for i, f in enumerate(df.schema.fields)
    ]


def name_has(name: str, words: tuple[str, ...], match: str = "substring") -> int:
    """How many of the words occur in the name."""
    low = name.lower()
    if match == "token":
        parts = set(low.replace("-", " ").replace("_", " ").split())
        return sum(w in parts for w in words)
    return sum(w in low for w in words)


def currency_of(name: str) -> str:
    low = name.lower()
    return next((sign for word, sign in CURRENCY_WORDS if word in low), DEFAULT_CURRENCY)
