"""The first scan: bounded counts per column, and the role each column takes from them.

Everything here is a flat aggregate: one row per task is shuffled, and the driver
receives one row whose width depends on the schema alone.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.config import Config
from assayer.functions.numbers import count_where, is_number
from assayer.functions.texts import has_outer_whitespace
from assayer.functions.times import LAYOUTS, Layout, layouts_of, look, other_order, shape_of
from assayer.operators.columns import (
    NON_NEGATIVE_WORDS,
    VALUE_WORDS,
    ColumnSpec,
    column_specs,
    name_has,
    quoted,
)
from assayer.operators.small import small_frame


def one_row(df: DataFrame, aggregates: dict[str, Column], per_pass: int) -> dict:
    """Evaluate many global aggregates, in several narrow scans if there are very many.

    Each scan reads only the columns it needs, so a columnar table is still read once.
    """
    names = list(aggregates)
    out: dict = {}
    for i in range(0, len(names), per_pass):
        part = names[i : i + per_pass]
        out.update(df.agg(*[aggregates[n].alias(n) for n in part]).first().asDict())
    return out


@dataclass(frozen=True)
class ColumnFacts:
    spec: ColumnSpec
    rows: int
    present: int
    numeric: int = 0
    whitespace: int = 0
    layout: Layout | None = None  # the one that most values of a text column are in
    timed: int = 0
    like_times: int = 0  # values that look like a time, read or not
    ambiguous: int = 0  # values read that are another day if day and month change places
    first_time: datetime | None = None
    last_time: datetime | None = None
    mean: float | None = None
    std: float | None = None
    low: float | None = None
    high: float | None = None
    negative: int = 0
    approx_distinct: int | None = None

    @property
    def missing(self) -> int:
        return self.rows - self.present


@dataclass(frozen=True)
class Facts:
    rows: int
    columns: list[ColumnFacts]
    repeated_names: list[str] = field(default_factory=list)


def _basic(spec: ColumnSpec, cfg: Config) -> dict[str, Column]:
    out = {"present": F.count(spec.value)}
    if cfg.distinct == "approx":
        out["approx"] = F.approx_count_distinct(spec.groupable)
    if spec.kind == "number":
        out |= _moments(spec.number)
    elif spec.kind == "time":
        out |= _span(spec.time)
    return out


def _text_counts(df: DataFrame, specs: list[ColumnSpec], cfg: Config) -> dict[int, dict]:
    """What the values of each text column look like, by ordinal.

    The columns are stacked, so that one small set of expressions serves any number of
    them; each task sends one row per column and shape of its times.
    """
    names = [str(s.ordinal) for s in specs]
    long = df.select(*[quoted(s.name).alias(n) for s, n in zip(specs, names)]).unpivot([], names, "ordinal", "value")
    long = long.select("ordinal", "value", look(F.col("value")).alias("look"))  # made once, tested and grouped
    c = F.col("value")
    wanted = {"present": F.count(c), "numeric": count_where(is_number(c)), "whitespace": count_where(has_outer_whitespace(c))}
    out = {s.ordinal: dict.fromkeys(wanted, 0) | {"shapes": {}} for s in specs}
    present = long.where(c.isNotNull())
    for row in present.groupBy("ordinal", shape_of(F.col("look")).alias("shape")).agg(*[x.alias(k) for k, x in wanted.items()]).collect():
        counts = out[int(row["ordinal"])]
        for k in wanted:
            counts[k] += row[k]
        if row["shape"] is not None:
            counts["shapes"][row["shape"]] = row["present"]
    if cfg.distinct == "approx":
        for row in present.groupBy("ordinal").agg(F.approx_count_distinct(c).alias("approx")).collect():
            out[int(row["ordinal"])]["approx"] = row["approx"]
    return out


#: Groups of layouts with the same pattern are the same.
_PATTERNS = [x.pattern for x in LAYOUTS]
_EPOCH = datetime(1970, 1, 1)


def _micros(t: Column) -> Column:
    # A number reaches the driver for any year, a time only for the years that Python has.
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), t)


def _read_times(df: DataFrame, columns: list[ColumnFacts], shapes: dict[int, dict[str, int]], cfg: Config) -> list[ColumnFacts]:
    """Columns with text that looks like times, with the layout that reads most of it.

    The shapes name the layouts to try, mostly one or two, so only these are parsed, in one scan of these columns that
    also finds the span of the times. A text is matched once per pattern, and each time is put together once.
    """
    tried = {o: layouts_of(found) for o, found in shapes.items() if found}
    matched, times, wanted = {}, {}, {}
    for c in columns:
        o, text = c.spec.ordinal, quoted(c.spec.name)
        for layout in tried.get(o, ()):
            n, other = LAYOUTS.index(layout), other_order(layout)
            t = F.col(f"t{o}_{n}")
            if layout.index is None:
                same = f"g{o}_{_PATTERNS.index(layout.pattern)}"
                matched[same], times[f"t{o}_{n}"] = layout.groups(text), layout.put_together(F.col(same))
            else:
                matched[f"t{o}_{n}"], times[f"t{o}_{n}"] = layout.time(text), t
            wanted |= {f"{o}_timed{n}": F.count(t), f"{o}_first{n}": _micros(F.min(t)), f"{o}_last{n}": _micros(F.max(t))}
            if other in tried[o]:
                wanted[f"{o}_either{n}"] = count_where(t != F.col(f"t{o}_{LAYOUTS.index(other)}"))
    read = df.select(*[x.alias(k) for k, x in matched.items()]).select(*[x.alias(k) for k, x in times.items()])
    got = one_row(read, wanted, max(1, cfg.aggregates_per_pass // 2)) if wanted else {}
    out = []
    for c in columns:
        o = c.spec.ordinal
        counts = {layout: got[f"{o}_timed{LAYOUTS.index(layout)}"] for layout in tried.get(o, ())}
        if counts:
            best = max(counts, key=counts.get)  # of equal ones the first
            c = replace(c, like_times=sum(shapes[o].values()))
            if counts[best]:
                n = LAYOUTS.index(best)
                c = replace(c, layout=best, timed=counts[best], ambiguous=got.get(f"{o}_either{n}", 0))
                if is_dated(c, cfg):
                    first, last = (_EPOCH + timedelta(microseconds=got[f"{o}_{k}{n}"]) for k in ("first", "last"))
                    c = replace(c, first_time=first, last_time=last)
        out.append(c)
    return out


def _span(t: Column) -> dict[str, Column]:
    return {"first_time": F.min(t), "last_time": F.max(t)}


def _moments(x: Column) -> dict[str, Column]:
    return {
        "mean": F.avg(x),
        "std": F.stddev_samp(x),
        "low": F.min(x),
        "high": F.max(x),
        "negative": count_where(x < 0),
    }


def _read(spec: ColumnSpec, rows: int, got: dict) -> ColumnFacts:
    keep = {k: got[k] for k in ("mean", "std", "low", "high", "negative", "whitespace") if k in got}
    base = ColumnFacts(spec, rows, got["present"], approx_distinct=got.get("approx"), **keep)
    if spec.kind == "number":
        return replace(base, numeric=got["present"])
    if spec.kind == "text":
        return replace(base, numeric=got["numeric"])
    if spec.kind == "time":
        return replace(base, timed=got["present"], first_time=got["first_time"], last_time=got["last_time"])
    return base


def _split(got: dict, specs: list[ColumnSpec]) -> dict[int, dict]:
    parts: dict[int, dict] = {s.ordinal: {} for s in specs}
    for key, value in got.items():
        ordinal, _, metric = key.partition("_")
        if ordinal.isdigit():
            parts[int(ordinal)][metric] = value
    return parts


def gather_facts(df: DataFrame, cfg: Config, repeated_names: list[str] | None = None) -> Facts:
    specs = column_specs(df)
    texts = [s for s in specs if s.kind == "text"]
    others = [s for s in specs if s.kind != "text"]
    wanted = {f"{s.ordinal}_{k}": c for s in others for k, c in _basic(s, cfg).items()}
    got = one_row(df, {"rows": F.count(F.lit(1)), **wanted}, cfg.aggregates_per_pass)
    rows = got["rows"]
    if rows == 0:
        raise ValueError("the table has no rows")
    parts = _split(got, others) | (_text_counts(df, texts, cfg) if texts else {})
    columns = [_read(s, rows, parts[s.ordinal]) for s in specs]
    columns = _read_times(df, columns, {s.ordinal: parts[s.ordinal]["shapes"] for s in texts}, cfg)

    # Text that turned out to be numbers gets its statistics in a second narrow scan, which
    # parses each value once, before the aggregates.
    parsed, wanted = [], {}
    for c in columns:
        o = c.spec.ordinal
        if c.spec.kind == "text" and (is_numeric(c, cfg) or could_be_value(c, cfg)):
            parsed.append(c.spec.number.alias(f"x{o}"))
            wanted |= {f"{o}_{k}": x for k, x in _moments(F.col(f"x{o}")).items()}
    if wanted:
        parts = _split(one_row(df.select(*parsed), wanted, cfg.aggregates_per_pass), specs)
        columns = [replace(c, **parts[c.spec.ordinal]) for c in columns]
    return Facts(rows, columns, repeated_names or [])


def missing_counts(df: DataFrame) -> DataFrame:
    """(ordinal, name, missing_count, total_rows) from one flat aggregate that parses nothing; not evaluated yet."""
    specs = column_specs(df)
    counts = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count(s.value).alias(f"c{s.ordinal}") for s in specs])
    rows = [
        F.struct(
            F.lit(s.ordinal).alias("ordinal"),
            F.lit(s.name).alias("name"),
            (F.col("rows") - F.col(f"c{s.ordinal}")).alias("missing_count"),
            F.col("rows").alias("total_rows"),
        )
        for s in specs
    ]
    return counts.select(F.inline(F.array(*rows)))


def time_layouts(df: DataFrame, cfg: Config) -> DataFrame:
    """Per text column with values that look like times: its layout, how many it reads, and which it cannot.

    ``unread_count`` are values of the look of a time that the layout does not read; ``ambiguous_count`` values
    that are another day if day and month change places. ``layout`` is null if no value is a time.
    """
    rows = [
        {
            "ordinal": c.spec.ordinal,
            "name": c.spec.name,
            "layout": c.layout.name if c.layout else None,
            "parsed_count": c.timed,
            "unread_count": c.like_times - c.timed,
            "ambiguous_count": c.ambiguous,
            "is_date": is_dated(c, cfg),
            "first_time": c.first_time,
            "last_time": c.last_time,
        }
        for c in gather_facts(df, cfg).columns
        if c.spec.kind == "text" and c.like_times
    ]
    schema = "ordinal int, name string, layout string, parsed_count bigint, unread_count bigint, ambiguous_count bigint, is_date boolean, first_time timestamp_ntz, last_time timestamp_ntz"
    return small_frame(df.sparkSession, rows, schema)


def _share(part: int, facts: ColumnFacts, cfg: Config) -> float:
    base = facts.present if cfg.ratio_base == "non_null" else facts.rows
    return part / base if base else 0.0


def is_numeric(facts: ColumnFacts, cfg: Config) -> bool:
    """Whether the column is profiled as numbers."""
    return facts.spec.kind in ("number", "text") and _share(facts.numeric, facts, cfg) > cfg.numeric_ratio


def is_dated(facts: ColumnFacts, cfg: Config) -> bool:
    if facts.spec.kind == "time":
        return True
    return facts.layout is not None and _share(facts.timed, facts, cfg) > cfg.date_ratio


def is_mixed(facts: ColumnFacts, cfg: Config) -> bool:
    """Text column of which a notable part, but not all, are numbers."""
    return facts.spec.kind == "text" and cfg.mixed_low < facts.numeric / facts.rows < cfg.mixed_high


def role(facts: ColumnFacts, cfg: Config) -> str:
    if facts.present == 0:
        return "empty"
    if facts.spec.kind == "time":
        return "temporal"
    if facts.spec.kind == "other":
        return "nested"
    if is_numeric(facts, cfg):
        return "numeric"
    if facts.spec.kind == "text" and is_dated(facts, cfg):
        return "date_text"
    return "categorical"


def is_categorical(facts: ColumnFacts, cfg: Config) -> bool:
    """Whether the column is profiled as categories (everything but numbers, times, nested)."""
    return facts.spec.kind in ("number", "text", "bool") and not is_numeric(facts, cfg)


def mixed_values(facts: ColumnFacts, cfg: Config) -> int:
    """Non-numeric values of a text column that is partly numeric, else 0."""
    if facts.spec.kind == "text" and 0 < facts.numeric < facts.present * cfg.format_mix:
        return facts.present - facts.numeric
    return 0


def negatives(facts: ColumnFacts, cfg: Config) -> int:
    """Negative values, if the name says that there should be none."""
    if is_numeric(facts, cfg) and name_has(facts.spec.name, NON_NEGATIVE_WORDS, cfg.keyword_match):
        return facts.negative
    return 0


def could_be_value(facts: ColumnFacts, cfg: Config) -> bool:
    """Whether name and content allow the column to hold money."""
    if facts.spec.kind not in ("number", "text") or facts.numeric == 0:
        return False
    plain = facts.spec.name.replace("_", " ").replace("-", " ")
    return name_has(plain, VALUE_WORDS) > 0 and facts.numeric / facts.rows >= cfg.value_ratio
