"""Readers and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.functions.numbers import INTEGER_PATTERN, text_to_number
from assayer.functions.texts import drop_missing_tokens
from assayer.operators.columns import column_specs, distinct_names, quoted
from assayer.operators.facts import one_row

_BOOLEAN_WORDS = ("True", "TRUE", "true", "False", "FALSE", "false")
_EXACT_DOUBLE = 2**53  # larger integers are not all doubles


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_csv(spark: SparkSession, path: str, infer: bool = True, multi_line: bool = False) -> DataFrame:
    """CSV with a header: missing-value tokens become null, then types are inferred.

    Inference reads the files once more; pass ``infer=False`` to keep text. Files with line
    breaks inside quotes need ``multi_line``, which makes each file one task; without it
    they are found by their odd quotes and refused.
    """
    if not multi_line:
        quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
        if not spark.read.text(path).where(quotes % 2 == 1).isEmpty():
            raise ValueError(f"{path} has line breaks inside quotes: read it with multi_line=True")
    raw = spark.read.option("header", True).option("escape", '"').option("multiLine", multi_line).csv(path)
    raw = normalise_missing(distinct_names(raw)[0])
    return infer_types(raw) if infer else raw


def normalise_missing(df: DataFrame) -> DataFrame:
    """Turn missing-value tokens of text columns into null."""
    return df.select(
        *[
            drop_missing_tokens(quoted(f.name)).alias(f.name) if isinstance(f.dataType, T.StringType) else quoted(f.name)
            for f in df.schema.fields
        ]
    )


def infer_types(df: DataFrame, per_pass: int = 240) -> DataFrame:
    """Cast each text column whose values are all integers, numbers or booleans.

    Integers become bigint, decimal(38,0) if they are longer, and stay text if even that does not hold
    them. Numbers become double, unless an integer among them is no double.
    """
    texts = [s for s in column_specs(df) if s.kind == "text"]
    wanted = {}
    for s in texts:
        c = quoted(s.name)
        wanted |= {
            f"{s.ordinal}_n": F.count(c),
            f"{s.ordinal}_int": F.count_if(c.rlike(INTEGER_PATTERN)),
            f"{s.ordinal}_big": F.count(F.when(c.rlike(INTEGER_PATTERN), c.try_cast("bigint"))),
            f"{s.ordinal}_long": F.count(F.when(c.rlike(INTEGER_PATTERN), c.try_cast("decimal(38,0)"))),
            f"{s.ordinal}_num": F.count(text_to_number(c)),
            f"{s.ordinal}_lost": F.count_if(
                c.rlike(INTEGER_PATTERN) & ~F.coalesce(F.abs(c.try_cast("decimal(38,0)")) <= _EXACT_DOUBLE, F.lit(False))
            ),
            f"{s.ordinal}_bool": F.count_if(c.isin(*_BOOLEAN_WORDS)),
        }
    got = one_row(df, wanted, per_pass) if wanted else {}
    out = []
    for s in column_specs(df):
        c, n = quoted(s.name), got.get(f"{s.ordinal}_n", 0)
        if n and got[f"{s.ordinal}_big"] == n:
            c = c.try_cast("bigint")
        elif n and got[f"{s.ordinal}_long"] == n:
            c = c.try_cast("decimal(38,0)")
        elif n and got[f"{s.ordinal}_num"] == n and not got[f"{s.ordinal}_lost"]:
            c = text_to_number(c)
        elif n and got[f"{s.ordinal}_bool"] == n:
            c = c.try_cast("boolean")
        out.append(c.alias(s.name))
    return df.select(*out)


def write_csv(df: DataFrame, path: str) -> None:
    """A CSV folder, each file with a header; null and NaN become empty fields."""
    cells = [
        (s.value.cast("string") if s.kind == "time" else s.groupable if s.kind == "other" else s.value).alias(s.name)
        for s in column_specs(df)
    ]
    (
        df.select(*cells)
        .write.option("header", True)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path)


def preview(df: DataFrame, order: list[str], rows: int = 200) -> DataFrame:
    """The first rows by the given columns, all as text, missing values empty.

    Each task keeps only its first rows, so no global sort takes place.
    """
    first = df.orderBy(*[quoted(c) for c in order]).limit(rows)
    return first.select(*[F.coalesce(s.label, F.lit("")).alias(s.name) for s in column_specs(df)])
