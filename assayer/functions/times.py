"""Date and time expressions shared by all operators."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

_CLOCK = r"\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?"
_OFFSET = r"(Z|[+-]\d{2}:\d{2})$"

# Layouts tried first, in this order: format, least and largest length of the text, pattern. Length and pattern keep text that cannot fit away
# from the parser. Parts in brackets may be absent.
TIME_FORMATS = (
    ("yyyy-MM-dd", 10, 10, r"^\d{4}-\d{2}-\d{2}$"),
    ("yyyy-MM-dd HH:mm:ss", 19, 19, r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$"),
    ("yyyy-MM-dd HH:mm[:ss][.SSSSSSSSS]", 16, 29, rf"^\d{{4}}-\d{{2}}-\d{{2}} {_CLOCK}$"),
    ("yyyy-MM-dd'T'HH:mm[:ss][.SSSSSSSSS][XXX]", 16, 35, rf"^\d{{4}}-\d{{2}}-\d{{2}}T{_CLOCK}(Z|[+-]\d{{2}}:\d{{2}})?$"),
    ("yyyy/MM/dd", 10, 10, r"^\d{4}/\d{2}/\d{2}$"),
    ("MM/dd/yyyy", 10, 10, r"^\d{2}/\d{2}/\d{4}$"),
    ("dd/MM/yyyy", 10, 10, r"^\d{2}/\d{2}/\d{4}$"),
    ("dd-MM-yyyy", 10, 10, r"^\d{2}-\d{2}-\d{4}$"),
    ("d MMM yyyy", 10, 11, r"^\d{1,2} [A-Z][a-z]{2} \d{4}$"),
)

SECONDS_PER_DAY = 86_400

#: Longer text is no time.
LONGEST = 48

_MONTHS = "jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec"
# Whole names only: three letters, or all of them.
_A_WEEKDAY = r"\b(?:mon(?:day)?|tues?(?:day)?|wed(?:nesday)?|thu(?:rs(?:day)?)?|fri(?:day)?|sat(?:urday)?|sun(?:day)?)\b"
_A_MONTH = (
    r"\b(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sep(?:t(?:ember)?)?|oct(?:ober)?"
    r"|nov(?:ember)?|dec(?:ember)?)\b"
)
_WEEKDAY = rf"(?:{_A_WEEKDAY},? +)?"
_MONTH = rf"(?={_A_MONTH})({_MONTHS})[a-z]*\.?"
_TIME = r"(?:[t ] *(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?(?: ?([ap]m))?)?"
_ZONE = r"(?: ?(z|utc|gmt|[+-]\d{2}:?\d{2}))?"
_YEAR = r"(\d{4}|\d{2})"
_SEPARATORS = "-/. "


def _orders() -> dict[str, tuple[str, str]]:
    """Name of each order of a date's parts: its pattern, and which part each group is."""
    found = {}
    for sep in _SEPARATORS:
        s = "\\" + sep if sep in ".-" else sep
        found[f"y{sep}M{sep}d"] = rf"(\d{{4}}){s}(\d{{1,2}}){s}(\d{{1,2}})", "yMd"
        found[f"M{sep}d{sep}y"] = rf"(\d{{1,2}}){s}(\d{{1,2}}){s}{_YEAR}", "Mdy"
        found[f"d{sep}M{sep}y"] = rf"(\d{{1,2}}){s}(\d{{1,2}}){s}{_YEAR}", "dMy"
    found["d MMM y"] = rf"(\d{{1,2}})(?:st|nd|rd|th)?[-/ ]{_MONTH}[-/, ]{{1,2}}{_YEAR}", "dNy"
    found["MMM d y"] = rf"{_MONTH} ?(\d{{1,2}})(?:st|nd|rd|th)?,? (\d{{4}})", "Ndy"
    found["yyyyMMdd"] = r"(\d{4})(\d{2})(\d{2})", "yMd"
    return found


@dataclass(frozen=True)
class Layout:
    """One way to write a time. The fixed ones have an index; the others are an order of a date's parts."""

    name: str
    index: int | None = None
    parts: str = ""  # of the date: y year, M month, N name of a month, d day
    pattern: str = ""

    def time(self, c: Column) -> Column:
        """Time held by a string in this layout, in UTC if it names an offset, without a zone; else null."""
        if self.index is not None:
            return _fixed_time(c, self.index)
        return self.put_together(self.groups(c))

    def groups(self, c: Column) -> Column:
        """The parts of a text in a layout without an index, matched once; of other text null or a list of one."""
        whole = f"(?i)^{self.pattern}$"
        found = F.split(F.regexp_replace(c, whole, "$1|$2|$3|$4|$5|$6|$7|$8|$9"), r"\|")
        return F.when((F.length(c) <= LONGEST) & ~c.contains("|"), found)

    def put_together(self, groups: Column) -> Column:
        """The time that ``groups`` found; layouts of one pattern can share them."""
        # A list of one gives the groups a name, so that the text is matched once.
        t = F.transform(F.array(groups), lambda g: F.when(F.size(g) == 9, self._assembled(g).cast("timestamp_ntz")))
        return F.get(t, F.lit(0))

    def _assembled(self, groups: Column) -> Column:
        field = lambda i: F.nullif(F.get(groups, F.lit(i)), F.lit(""))
        of = {part: field(i) for i, part in enumerate(self.parts)}
        hour, minute, second, fraction, half, zone = map(field, range(3, 9))
        year = of["y"].cast("int")
        # Two digits mean 1969 to 2068.
        year = F.when(F.length(of["y"]) == 2, year + F.when(year < 69, 2000).otherwise(1900)).otherwise(year)
        if self.name == "yyyyMMdd":
            year = F.when(year.between(1900, 2100), year)
        month = F.floor((F.position(F.lower(of["N"]), F.lit(_MONTHS)) + 3) / 4) if "N" in of else of["M"]
        hours = F.coalesce(hour.cast("int"), F.lit(0))
        afternoon = F.when(F.lower(half) == "pm", 12).otherwise(0)
        hours = F.when(half.isNull(), hours).when(hours.between(1, 12), hours % 12 + afternoon)
        seconds = F.concat(F.coalesce(second, F.lit("0")), F.lit("."), F.rpad(F.coalesce(fraction, F.lit("0")), 6, "0"))
        minutes = F.coalesce(minute.cast("int"), F.lit(0))
        t = F.try_make_timestamp_ntz(year, month.cast("int"), of["d"].cast("int"), hours, minutes, seconds.cast("decimal(16,6)"))
        offset = F.regexp_replace(zone, "[^0-9]", "")
        offset = F.substring(offset, 1, 2).cast("int") * 60 + F.substring(offset, 3, 2).cast("int")
        east = F.when(zone.startswith("-"), -offset).when(zone.startswith("+"), offset).otherwise(0)
        return F.timestamp_add("MINUTE", -east, t)


#: All layouts, by precedence where two read equally many values.
LAYOUTS = tuple(Layout(x[0], i) for i, x in enumerate(TIME_FORMATS)) + tuple(
    Layout(name, None, parts, _WEEKDAY + pattern + _TIME + _ZONE) for name, (pattern, parts) in _orders().items()
)

# All layouts at once, as they read a look.
_LOOK = (
    "^(?:mon,? +)?(?:"
    + "|".join(dict.fromkeys(x.replace(_MONTH, r"\bjan\b\.?").replace(r"\d", "9") for x, _ in _orders().values()))
    + ")"
    + (_TIME + _ZONE).replace(r"\d", "9").replace("[ap]m", "am").replace("z|utc|gmt", "z")
    + "$"
)

# Every time has as many digits.
_THREE_DIGITS = "[0-9][^0-9]*[0-9][^0-9]*[0-9]"


def look(c: Column) -> Column:
    """A text in lower case, each digit as 9 and each name as one example; null if it is too long or has too few digits."""
    plain = F.regexp_replace(F.lower(c), _A_WEEKDAY, "mon")
    plain = F.regexp_replace(plain, _A_MONTH, "jan")
    plain = F.regexp_replace(F.regexp_replace(plain, r"utc|gmt", "z"), "pm", "am")
    # Most texts have no names.
    plain = F.when(c.rlike("[A-Za-z]{2}"), plain).otherwise(F.lower(c))
    return F.when((F.length(c) <= LONGEST) & c.rlike(_THREE_DIGITS), F.regexp_replace(plain, "[0-9]", "9"))


def shape_of(looks: Column) -> Column:
    """The look of a text that may be a time, null for other text.

    Only text that some order of a date's parts fits has a shape, so a column has few of them.
    """
    return F.when(looks.rlike(_LOOK), looks)


def shape(c: Column) -> Column:
    """What a text that may be a time looks like, null for other text: each digit is 9, each name one example."""
    return shape_of(look(c))


def layouts_of(shapes: Iterable[str]) -> list[Layout]:
    """The layouts that a text of one of these shapes can be in."""
    found = []
    for layout in LAYOUTS:
        if layout.index is None:
            fits = re.compile(layout.pattern, re.IGNORECASE).fullmatch
            texts = shapes
        else:
            fits = re.compile(TIME_FORMATS[layout.index][3]).match
            texts = [x.replace("t", "T").replace("z", "Z").replace("jan", "Jan") for x in shapes]
        if any(fits(x) for x in texts):
            found.append(layout)
    return found


def other_order(layout: Layout) -> Layout | None:
    """The layout with day and month in the other order, if the text does not tell which it is."""
    swapped = {"Mdy": "dMy", "dMy": "Mdy"}
    if layout.index is not None:
        swapped = {"MM/dd/yyyy": "d/M/y", "dd/MM/yyyy": "M/d/y", "dd-MM-yyyy": "M-d-y"}
        return next((x for x in LAYOUTS if x.name == swapped.get(layout.name)), None)
    separator = layout.name[1]
    return next((x for x in LAYOUTS if layout.parts in swapped and x.parts == swapped[layout.parts] and x.name[1] == separator), None)


def _fixed_time(c: Column, layout: int) -> Column:
    fmt, shortest, longest, guard = TIME_FORMATS[layout]
    fits = F.length(c).between(shortest, longest) & c.rlike(guard)
    t = F.when(fits, F.try_to_timestamp(c, F.lit(fmt)))
    if "XXX" in fmt:
        return F.when(c.rlike(_OFFSET), to_naive_utc(t, "timestamp")).otherwise(t.cast("timestamp_ntz"))
    return t.cast("timestamp_ntz")


def to_naive_utc(c: Column, dtype: str) -> Column:
    """One zone-free type for dates, naive and zoned timestamps."""
    if dtype == "timestamp":
        return F.convert_timezone(None, F.lit("UTC"), c.cast("timestamp_ntz"))
    return c.cast("timestamp_ntz")


def whole_days(later: Column, earlier: Column) -> Column:
    """Full days between two naive timestamps, floored (so -1 for an hour ahead)."""
    micros = F.timestamp_diff("MICROSECOND", earlier, later)
    return F.floor(micros / F.lit(float(SECONDS_PER_DAY * 1_000_000))).cast("bigint")
