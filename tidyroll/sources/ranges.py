"""Ranges of a database table with about equal numbers of rows, from counts that the database makes."""

from __future__ import annotations

from collections.abc import Callable, Iterable

# Steps that a span of ids is counted in; a query gives no more rows than this.
STEPS = 1024

Query = Callable[[str], Iterable[tuple]]


def _counts(query: Query, table: str, key: str, low: int, high: int, most: int) -> list[tuple[int, int, int]]:
    """(first id, last id, rows) of spans in order, counted ever finer until a span has no more than
    `most` rows or is a single id."""
    width = -(-(high - low + 1) // STEPS)
    step = f"floor(({key} - {low}) / {width})"
    found = query(
        f"select {step} as step, count(*) as n from {table}"
        f" where {key} >= {low} and {key} <= {high} group by {step}"
    )
    spans: list[tuple[int, int, int]] = []
    for at, n in sorted((int(at), int(n)) for at, n in found):
        first = low + at * width
        last = min(high, first + width - 1)
        # no more than rows / most spans of a level are that heavy
        if n > most and last > first:
            spans += _counts(query, table, key, first, last, most)
        else:
            spans.append((first, last, n))
    return spans


def _days(query: Query, table: str, key: str, one: int, day: str, most: int) -> list[str]:
    """Conditions that cut the rows of one id by a date; a day is the smallest part. Rows without a
    date come with the first."""
    cast = f"cast({day} as date)"
    found = query(
        f"select {cast} as day, count(*) as n from {table} where {key} = {one}"
        f" and {day} is not null group by {cast}"
    )
    cuts, held = [], 0
    for when, n in sorted((str(when)[:10], int(n)) for when, n in found):
        if held and held + n > most:
            cuts.append(when)
            held = 0
        held += n
    here = f"{key} = {one}"
    if not cuts:
        return [here]
    parts = [f"{here} and ({day} < '{cuts[0]}' or {day} is null)"]
    parts += [f"{here} and {day} >= '{a}' and {day} < '{b}'" for a, b in zip(cuts, cuts[1:], strict=False)]
    return [*parts, f"{here} and {day} >= '{cuts[-1]}'"]


def even_ranges(query: Query, table: str, key: str, day: str, partitions: int) -> list[str]:
    """Conditions, one for each part to read, that share the rows of `table` out evenly.

    Every row meets exactly one of them. Parts have at most about a `partitions`-th of the rows: ids
    next to each other are read together, and an id with more rows than that is cut by the column
    `day`. Only counts are read, by ranges of ids and by days. An empty table has no parts; rows
    without an id are a part of their own.
    """
    ((low, high, rows, keyed),) = query(
        f"select min({key}) as low, max({key}) as high, count(*) as n, count({key}) as keyed from {table}"
    )
    parts = [f"{key} is null"] if rows > keyed else []
    if low is None:
        return parts
    most = max(1, -(-keyed // partitions))
    first, last, held = None, None, 0

    def close() -> None:
        if first is not None:
            parts.append(f"{key} >= {first} and {key} <= {last}")

    for start, end, n in _counts(query, table, key, int(low), int(high), most):
        if n > most or (held and held + n > most):
            close()
            first, held = None, 0
        if n > most:
            parts += _days(query, table, key, start, day, most)
        else:
            first, last, held = (start if first is None else first), end, held + n
    close()
    return parts
