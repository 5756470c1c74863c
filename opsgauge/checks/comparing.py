"""Order-insensitive comparison of two results, columns matched by name."""

from __future__ import annotations

from collections import Counter


def compare(columns: list, rows: list, expected_columns: list, expected_rows: list) -> str | None:
    """What differs, or None."""
    if sorted(columns) != sorted(expected_columns):
        return f"columns {sorted(columns)} expected {sorted(expected_columns)}"
    got = Counter(_ordered(columns, rows))
    expected = Counter(_ordered(expected_columns, expected_rows))
    if got == expected:
        return None
    surplus, missing = got - expected, expected - got
    return (
        f"{sum(surplus.values())} unexpected, {sum(missing.values())} missing, in {sorted(columns)}: "
        f"got {_sample(surplus)} expected {_sample(missing)}"
    )


def _ordered(columns: list, rows: list) -> list:
    places = sorted(range(len(columns)), key=lambda at: columns[at])
    return [tuple(row[at] for at in places) for row in rows]


def _sample(rows: Counter) -> str:
    return str(sorted(map(str, rows))[:2])[:700]
