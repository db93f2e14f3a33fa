"""Names, row hashes and coordinates found in text."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

FIELD_SEPARATOR = "\x1f"
# What counts as a number: a cast alone would take suffixes such as 12D as well.
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
NULL_MARK = "\\N"


def slug(name: str) -> str:
    """Lower case ASCII words joined by underscores."""
    plain = unicodedata.normalize("NFKD", name).encode("ascii", "ignore").decode()
    return "_".join(re.findall(r"[a-z0-9]+", plain.lower()))


def slugs(names: Sequence[str]) -> list[str]:
    """Slugs for a header; repeats get a running number, since columns need unique names."""
    seen: dict[str, int] = {}
    result = []
    for name in names:
        base = slug(name) or "column"
        seen[base] = seen.get(base, 0) + 1
        result.append(base if seen[base] == 1 else f"{base}_{seen[base]}")
    return result


def row_hash(columns: Sequence[str]) -> Column:
    """md5 over all columns; a separator and a null mark keep different rows apart."""
    parts = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(NULL_MARK)) for c in columns]
    return F.md5(F.concat_ws(FIELD_SEPARATOR, *parts))


def strict_double(text: Column) -> Column:
    """A number as written in full, blanks around it allowed; null for any other text."""
    value = F.trim(text)
    return F.when(value.rlike(NUMBER), value.try_cast("double"))


def location_lat(location: Column) -> Column:
    """Latitude from text such as "(41.88, -87.73)"."""
    return strict_double(F.regexp_extract(location, r"\((.*),.*\)", 1))


def location_lon(location: Column) -> Column:
    return strict_double(F.regexp_extract(location, r"\(.*,(.*)\)", 1))
