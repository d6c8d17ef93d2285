"""Dates and times in running text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

_SEP = r"(?:年|-|/|\.)"
#: forms from the most to the least telling; the groups are named by their letters in `fields`
FORMS = [
    (r"(\d{4})(年|-|/|\.)(\d{1,2})(?:月|\2)(\d{1,2})日? (\d{1,2})[点:](\d{1,2})[分:](\d{1,2})秒?", "y.mdHMS"),
    (r"(\d{4})(年|-|/|\.)(\d{1,2})(?:月|\2)(\d{1,2})日? (\d{1,2})[点:](\d{1,2})分?", "y.mdHM"),
    (r"(\d{4})(年|-|/|\.)(\d{1,2})(?:月|\2)(\d{1,2})日?", "y.md"),
    (r"(?<!\d)(\d{2})(年|-|/|\.)(\d{1,2})(?:月|\2)(\d{1,2})日?", "Y.md"),
    (r"(?<!\d)(\d{1,2})[月/.-](\d{1,2})日? (\d{1,2})[点:](\d{1,2})[分:](\d{1,2})秒?", "mdHMS"),
    (r"(?<!\d)(\d{1,2})[月/.-](\d{1,2})日? (\d{1,2})[点:](\d{1,2})分?", "mdHM"),
    (r"(?<!\d)(\d{1,2})(?:月(\d{1,2})日|[/.-](\d{1,2}))", "mdd"),
    (r"(?<!\d)(\d{1,2})[点:](\d{1,2})[分:](\d{1,2})秒?", "HMS"),
    (r"(?<!\d)(\d{1,2})(?:点(\d{1,2})分|:(\d{1,2}))", "HMM"),
]
AGO = {"天": 86400, "小时": 3600, "分钟": 60, "秒": 1}


def extract_time(c, base: str = "2024-06-15 12:00:00") -> Column:
    """The first form that the text holds, as timestamp_ntz; what it lacks comes from base.

    `N天前` and its like count back from base. Without any, null. Two-digit
    years are 1969 to 2068. A form that is no date gives way to the next.
    """
    t = col(c)
    b = F.lit(base).cast("timestamp_ntz")
    found = []
    for pattern, fields in FORMS:
        value: dict = {}
        for i, f in enumerate(fields):
            if f != ".":
                got = F.regexp_extract(t, pattern, i + 1)
                value.setdefault(f, []).append(F.when(got != "", got.cast("int")))
        part = {k: F.coalesce(*v) for k, v in value.items()}
        if "Y" in part:
            part["y"] = F.when(part["Y"] < 69, part["Y"] + 2000).otherwise(part["Y"] + 1900)
        y = part.get("y", F.year(b))
        m = part.get("m", F.month(b))
        d = part.get("d", F.dayofmonth(b))
        text = F.format_string("%04d-%02d-%02d %02d:%02d:%02d", y, m, d, *[part.get(k, F.lit(0)) for k in "HMS"])
        found.append(F.when(t.rlike(pattern), F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz")))
    unit = F.regexp_extract(t, r"(\d{1,9})(天|小时|分钟|秒)前", 2)
    many = F.regexp_extract(t, r"(\d{1,9})(天|小时|分钟|秒)前", 1).cast("long")
    seconds = F.coalesce(*[F.when(unit == k, many * v) for k, v in AGO.items()])
    ago = F.when(seconds.isNotNull(), (b - F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))).cast("timestamp_ntz"))
    return F.coalesce(*found, ago)


def year_of_path(path) -> Column:
    """The first of January of the first year from 1800 to 2099 in a path; else null."""
    y = F.regexp_extract(col(path), r"((?:18|19|20)\d{2})", 1)
    return F.when(y != "", F.make_date(y.cast("int"), F.lit(1), F.lit(1)).cast("timestamp_ntz"))


def partial_date(c) -> Column:
    """Y, Y-M or Y-M-D as timestamp_ntz; else null."""
    t = F.trim(col(c))
    part = lambda i: F.regexp_extract(t, r"^(\d{4})(?:-(\d{1,2}))?(?:-(\d{1,2}))?$", i)
    text = F.concat_ws("-", part(1), F.lpad(F.when(part(2) == "", "1").otherwise(part(2)), 2, "0"), F.lpad(F.when(part(3) == "", "1").otherwise(part(3)), 2, "0"))
    return F.when(part(1) != "", F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("timestamp_ntz"))
