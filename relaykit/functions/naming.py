"""Table and column names."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column
from pyspark.sql import functions as F


# Fixed value: digits of the mark on shortened names.
HASH_DIGITS = 8


def words(name: str) -> list[str]:
    """Lower-case words of a path: split at dots, punctuation and lower-to-upper case changes."""
    spaced = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", " ", name.replace("[]", ""))
    return [w.lower() for w in re.split(r"[^A-Za-z0-9]+", spaced) if w]


def style(name: str, case: str = "snake_case") -> str:
    parts = words(name)
    if case == "camelCase":
        return "".join(parts[:1] + [w.capitalize() for w in parts[1:]])
    return ("-" if case == "kebab-case" else "_").join(parts)


def shorten(name: str, limit: int = 63) -> str:
    """A name over the limit gives up its end for a mark: an underscore and the first digits of its SHA-1."""
    mark = "_" + hashlib.sha1(name.encode()).hexdigest()[:HASH_DIGITS]
    return name if len(name) <= limit else (name[: max(0, limit - len(mark))] + mark).lstrip("_")


def column_name(path: str, case: str = "snake_case", limit: int = 63) -> str:
    return shorten(style(path, case), limit)


def unique_names(names: list[str]) -> list[str]:
    """The names in order; one that is taken already gets the next free number: ``a, a_2, a_3``."""
    taken, out = set(names), []
    for name in names:
        new, n = name, 1
        while new in out or (n > 1 and new in taken):
            n += 1
            new = f"{name}_{n}"
        out.append(new)
    return out


def rename_columns(df, case: str = "snake_case", limit: int = 63):
    """Renames every column by its path; columns that would end up with one name get numbers."""
    return df.toDF(*unique_names([column_name(col, case, limit) for col in df.columns]))


def identifier(name: Column) -> Column:
    """Catalog identifier: trimmed, lower case, other characters to single underscores, never empty."""
    safe = F.regexp_replace(F.lower(F.regexp_replace(name, r"^\s+|\s+$", "")), "[^a-z0-9]+", "_")
    bare = F.regexp_replace(safe, "^_+|_+$", "")
    return F.when(F.length(bare) > 0, bare).otherwise("unnamed_column")
