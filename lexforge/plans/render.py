"""Pages as text: column names once, one tab-separated line per row."""

from __future__ import annotations

from lexforge.operators.paging import Page


def cell(value: object) -> str:
    """Tabs, line breaks and backslashes escaped; floats with three decimals; lists with commas."""
    if value is None:
        return ""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float):
        return f"{value:.3f}"
    if isinstance(value, (list, tuple)):
        return ",".join(cell(v) for v in value)
    return str(value).replace("\\", "\\\\").replace("\t", "\\t").replace("\n", "\\n")


def render(page: Page) -> str:
    """The page's table and, above it, what holds for all rows; empty values are left out."""
    out = []
    if page.has_more:
        out.append("has_more: true")
    if page.next_offset is not None:
        out.append(f"next_offset: {page.next_offset}")
    for key, value in page.extra.items():
        if value not in (None, [], {}):
            out.append(f"{key}: {cell(value)}")
    columns = list(dict.fromkeys(k for r in page.results for k in r))
    out.append(f"results[{len(page.results)}] " + "\t".join(columns))
    out += ["\t".join(cell(r.get(c)) for c in columns) for r in page.results]
    return "\n".join(out)


def preamble(page: Page) -> list[str]:
    """Lines for standard error: ``# key=value``."""
    told = {"has_more": page.has_more, "next_offset": page.next_offset, **page.extra}
    return [f"# {k}={cell(v)}" for k, v in told.items() if v not in (None, False, [], {})]


def rows(page: Page) -> list[str]:
    """Lines for standard output."""
    columns = list(dict.fromkeys(k for r in page.results for k in r))
    return ["\t".join(cell(r.get(c)) for c in columns) for r in page.results]
