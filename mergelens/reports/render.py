"""Plain-text tables, panels and formats."""

from __future__ import annotations

DASH = "—"
# How trend labels are shown.
ARROWS = {"": "", "up": "↑", "down": "↓", "stable": "→", "up_lower_quality": "↗", "down_better_quality": "↘", "mixed": "•"}
COLOURS = {"green": "\033[32m", "yellow": "\033[33m", "red": "\033[31m"}


def number(x, digits: int = 1, unit: str = "") -> str:
    return DASH if x is None else f"{x:.{digits}f}{unit}"


def paint(text: str, colour: str | None, on: bool) -> str:
    return f"{COLOURS[colour]}{text}\033[0m" if on and colour in COLOURS else text


def table(head: list[str], rows: list[list[str]]) -> str:
    """Columns padded to their widest cell; colour codes take no room."""
    import re

    bare = lambda s: len(re.sub(r"\033\[\d+m", "", s))
    widths = [max(bare(str(r[i])) for r in [head, *rows]) for i in range(len(head))]
    line = lambda cells: "  ".join(str(c) + " " * (w - bare(str(c))) for c, w in zip(cells, widths, strict=True)).rstrip()
    return "\n".join([line(head), line(["-" * w for w in widths]), *map(line, rows)])


def markdown(head: list[str], rows: list[list]) -> str:
    cells = lambda r: "| " + " | ".join("" if c is None else str(c) for c in r) + " |"
    return "\n".join([cells(head), "|" + "|".join("---" for _ in head) + "|", *map(cells, rows)])


def panel(title: str, body: str) -> str:
    return f"== {title} ==\n{body}\n"
