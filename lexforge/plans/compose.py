"""Several operations in one call; a step's arguments may refer to earlier results as ``$N.field``."""

from __future__ import annotations

import re
from typing import Any

from lexforge.operators.paging import Page

MAX_STEPS = 8
_REFERENCE = re.compile(r"\$(\d+)\.([A-Za-z_]\w*)(?:\[(\d+)\])?")


def value_of(reference: str, results: list[Page]) -> Any:
    """What ``$N.field`` (of the first row) or ``$N.field[K]`` (of row K) stands for; N counts from 1."""
    found = _REFERENCE.fullmatch(reference)
    if not found:
        return reference
    step, name, row = int(found[1]), found[2], int(found[3] or 0)
    if not 1 <= step <= len(results):
        raise ValueError(f"{reference}: no such step")
    page = results[step - 1]
    if name in page.extra:
        return page.extra[name]
    if row >= len(page.results) or name not in page.results[row]:
        raise ValueError(f"{reference}: no such value")
    return page.results[row][name]


def run_plan(session: Any, steps: list[dict]) -> list[Page]:
    """Results of the steps ``{"tool": name, "arguments": {...}}`` in order."""
    if not 1 <= len(steps) <= MAX_STEPS:
        raise ValueError(f"1..{MAX_STEPS} steps")
    results: list[Page] = []
    for step in steps:
        arguments = {k: value_of(v, results) if isinstance(v, str) else v for k, v in step.get("arguments", {}).items()}
        results.append(getattr(session, step["tool"])(**arguments))
    return results


def path_problems(paths: list[dict], session: Any) -> list[str]:
    """Authored tool paths, run step by step: what each step was to show and didn't."""
    out, seen = [], []
    for n, step in enumerate(paths, 1):
        arguments = {k: value_of(v, seen) if isinstance(v, str) else v for k, v in step["arguments"].items()}
        page = getattr(session, step["tool"])(**arguments)
        seen.append(page)
        shown = render_text(page)
        out += [f"step {n}: {want!r} isn't shown" for want in step.get("expect", []) if want not in shown]
    return out


def render_text(page: Page) -> str:
    from lexforge.plans.render import render

    return render(page)


def crawl(session: Any, terms: list[str], wanted: list[tuple[str, str]], most_calls: int = 20) -> dict:
    """A bounded lexical crawl: exact searches, then reads around hits, until all wanted (path, leaf) were on screen."""
    shown, calls = "", 0
    left = set(wanted)
    for term in terms:
        if calls >= most_calls or not left:
            break
        page = session.search_exact(query=term, limit=20)
        calls += 1
        shown += render_text(page)
        for row in page.results[:3]:
            if calls >= most_calls:
                break
            calls += 1
            start = max(1, row["line"] - 20)
            shown += row["path"] + "\n" + render_text(session.read_source(row["path"], start, start + 60))
        left = {(p, leaf) for p, leaf in left if not (p in shown and leaf in shown)}
    return {"found": len(wanted) - len(left), "wanted": len(wanted), "calls": calls, "lower_bound": 1 + len({p for p, _ in wanted})}
