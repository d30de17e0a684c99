"""Display forms of lead and run fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def shown_rating(google: Column, directory: Column) -> Column:
    """The map rating, else the directory's with /10."""
    return F.coalesce(google.cast("string"), F.concat(directory.cast("string"), F.lit("/10")))


def duration(seconds: Column) -> Column:
    s = F.floor(F.pmod(seconds, F.lit(60)) + 0.5)
    m, h = F.floor(F.pmod(seconds, F.lit(3600)) / 60), F.floor(seconds / 3600)
    text = F.when(h > 0, F.format_string("%dh %dm", h, m)).when(m == 0, F.format_string("%ds", s)).otherwise(F.format_string("%dm %ds", m, s))
    return F.when(F.coalesce(seconds, F.lit(0)) == 0, "—").otherwise(text)


def cities_label(c: Column) -> Column:
    """'N cities' for a JSON array, the text itself otherwise, — if blank."""
    n = F.json_array_length(c)
    return F.when(F.coalesce(c, F.lit("")) == "", "—").when(n.isNotNull(), F.concat(n.cast("string"), F.lit(" cities"))).otherwise(c)


def safe_label(c: Column) -> Column:
    """A file-name part: other than letters, digits, _ and - replaced, cut at 40."""
    return F.substring(F.regexp_replace(c, r"(?U)[^\w\-]", "_"), 1, 40)
