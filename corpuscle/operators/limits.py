"""The rules' limits from a table, checked before any rule runs."""

from __future__ import annotations

from pyspark.sql import DataFrame

# Each limit's kind, its least and greatest value, and what it is unless it is set.
LIMITS = {
    "title_min": (int, 1, 200, 30),
    "title_max": (int, 1, 300, 65),
    "description_min": (int, 1, 400, 110),
    "description_max": (int, 1, 600, 165),
    "thin_words": (int, 1, 100000, 300),
    "good_words": (int, 1, 100000, 900),
    "extract_share": (float, 0.01, 1.0, 0.2),
    "anchor_variety": (float, 0.01, 1.0, 0.8),
}
# Limits of which the first must stay below the second.
ORDERED = (("title_min", "title_max"), ("description_min", "description_max"), ("thin_words", "good_words"))


def checked(given: dict[str, object]) -> dict[str, float]:
    """All limits, those of ``given`` in place of the usual ones; a ValueError says what is wrong.

    Names must be known, values numbers (no truth values) of their kind and range; ordered
    pairs are judged by the values that hold in the end.
    """
    out = {name: usual for name, (*_, usual) in LIMITS.items()}
    for name, value in given.items():
        if name not in LIMITS:
            raise ValueError(f"unknown limit {name!r}; there are {', '.join(sorted(LIMITS))}")
        kind, least, most, _ = LIMITS[name]
        if isinstance(value, bool) or not isinstance(value, (int, float)):
            raise ValueError(f"limit {name!r} takes a number, not {value!r}")
        if kind is int and not isinstance(value, int):
            raise ValueError(f"limit {name!r} takes a whole number, not {value!r}")
        if not least <= value <= most:
            raise ValueError(f"limit {name!r} lies between {least} and {most}, not at {value}")
        out[name] = kind(value)
    for low, high in ORDERED:
        if out[low] >= out[high]:
            raise ValueError(f"limit {low!r} ({out[low]}) must stay below {high!r} ({out[high]})")
    return out


def from_table(table: DataFrame) -> dict[str, float]:
    """Limits from ``name, value`` (text, as JSON numbers); later checks are those of :func:`checked`.

    The table holds at most one row for each known limit, else a name is unknown or repeats.
    """
    rows = table.select("name", "value").limit(len(LIMITS) + 1).collect()
    given: dict[str, object] = {}
    for row in rows:
        if row["name"] in given:
            raise ValueError(f"limit {row['name']!r} is set twice")
        given[row["name"]] = number(row["value"])
    return checked(given)


def number(text: str | None) -> object:
    for kind in (int, float):
        try:
            return kind(text)
        except (TypeError, ValueError):
            pass
    return text
