"""Small results as text: console and Markdown tables.  Only summaries come here; larger ones are refused."""

from __future__ import annotations

import textwrap

from pyspark.sql import DataFrame

MOST_ROWS = 10_000


def _rows(df: DataFrame) -> list[list[str]]:
    rows = df.limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ValueError(f"a report holds at most {MOST_ROWS} rows")
    return [["" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v) for v in r] for r in rows]


def markdown(df: DataFrame, title: str) -> str:
    rows = _rows(df)
    cell = lambda v: v.replace("|", "\\|").replace("\n", " ")
    lines = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join(map(cell, r)) + " |" for r in rows)]) + "\n"


def console(df: DataFrame, title: str) -> str:
    rows = [df.columns, *_rows(df)]
    width = [max(len(r[i]) for r in rows) for i in range(len(df.columns))]
    return "\n".join([title, "", *("  ".join(v.ljust(w) for v, w in zip(r, width)).rstrip() for r in rows)]) + "\n"


def wrap(text: str, width: int = 100) -> str:
    """Greedy word wrap of a paragraph."""
    return textwrap.fill(text, width, break_long_words=False, break_on_hyphens=False)


def bar(share: float, width: int = 20) -> str:
    return "#" * round(share * width)


def duration(seconds: int) -> str:
    """A span in its two largest units."""
    days, rest = divmod(int(seconds), 86_400)
    hours, rest = divmod(rest, 3600)
    minutes, left = divmod(rest, 60)
    units = [(days, "d"), (hours, "h"), (minutes, "min"), (left, "s")]
    first = next((i for i, (n, _) in enumerate(units) if n), 3)
    return " ".join(f"{n} {u}" for n, u in units[first : first + 2] if n) or "0 s"
