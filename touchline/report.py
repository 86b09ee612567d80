"""Text and HTML reports of small results; rows are collected here and nowhere earlier."""

from __future__ import annotations

import html
import json
from pathlib import Path

from pyspark.sql import DataFrame

LIMIT = 200


def cell(v: object) -> str:
    if v is None:
        return "-"
    if isinstance(v, bool):
        return "yes" if v else "no"
    return f"{v:.2f}" if isinstance(v, float) else str(v)


def rows_of(df: DataFrame, limit: int = LIMIT) -> list[list[str]]:
    return [[cell(v) for v in r] for r in df.limit(limit).collect()]


def text_block(title: str, df: DataFrame, limit: int = LIMIT) -> str:
    """A title and a table of fixed width, numbers to the right."""
    names, rows = df.columns, rows_of(df, limit)
    numeric = {n for n, t in df.dtypes if t in ("int", "bigint", "double", "float", "smallint") or t.startswith("decimal")}
    width = [max(len(n), *(len(r[i]) for r in rows)) if rows else len(n) for i, n in enumerate(names)]
    line = lambda r: "  ".join(c.rjust(w) if n in numeric else c.ljust(w) for c, w, n in zip(r, width, names)).rstrip()
    return "\n".join([title, "-" * len(title), line(names), *map(line, rows)]) + "\n"


def text_report(blocks: dict[str, DataFrame], limit: int = LIMIT) -> str:
    return "\n".join(text_block(t, df, limit) for t, df in blocks.items())


def html_report(title: str, panels: dict[str, DataFrame | None], limit: int = LIMIT) -> str:
    """A page with a table per panel; a panel that is missing says so. Every text is escaped."""
    e = html.escape
    out = [f"<!doctype html><html><head><meta charset='utf-8'><title>{e(title)}</title></head><body><h1>{e(title)}</h1>"]
    for name, df in panels.items():
        out.append(f"<section><h2>{e(name)}</h2>")
        if df is None:
            out.append("<p>not available</p>")
        else:
            head = "".join(f"<th>{e(c)}</th>" for c in df.columns)
            body = "".join("<tr>" + "".join(f"<td>{e(c)}</td>" for c in r) + "</tr>" for r in rows_of(df, limit))
            out.append(f"<table><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table>")
        out.append("</section>")
    return "".join(out) + "</body></html>"


def countdown(seconds: float) -> str:
    """Time to a deadline in words."""
    if seconds <= 0:
        return "passed"
    hours, minutes = int(seconds // 3600), int(seconds % 3600 // 60)
    return f"{hours // 24}d {hours % 24}h" if hours >= 24 else f"{hours}h {minutes}m"


def save_decision(record: dict, path: str) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(record, indent=2, default=float))
