"""Regular expressions for reading: split into fragments, aligned as text, and coloured as HTML."""

from __future__ import annotations

import html
import re

_FRAGMENT = re.compile(r"(\[\^?\]?(?:\\.|\[:\w+:\]|[^\]\\])*\]|\((?:\\.|[^)\\])*\)|\\p\{\w+\}|\\.|[^\\])([*+?]|\{\d+(?:,\d*)?\})?", re.DOTALL)
#: Colours by kind of fragment (fixed values).
COLOURS = {"anchor": "#888888", "class": "#0055aa", "group": "#aa5500", "literal": "#222222"}


def fragments(pattern: str) -> list[tuple[str, str, str]]:
    """``(kind, text, quantifier)`` of each part; neighbouring plain characters are one literal."""
    out: list[tuple[str, str, str]] = []
    for m in _FRAGMENT.finditer(pattern):
        text, count = m[1], m[2] or ""
        if text in "^$":
            kind = "anchor"
        elif text[0] == "(":
            kind = "group"
        elif text[0] == "[" or text == "." or re.fullmatch(r"\\(p\{\w+\}|[dDwWsS])", text):
            kind = "class"
        else:
            kind = "literal"
        if kind == "literal" and not count and out and out[-1][0] == "literal" and not out[-1][2]:
            out[-1] = ("literal", out[-1][1] + text, "")
        else:
            out.append((kind, text, count))
    return out


def as_text(pattern: str) -> str:
    """Fragments one a line, with their kinds."""
    return "\n".join(f"{k:8}{t}{q}" for k, t, q in fragments(pattern))


def as_html(pattern: str) -> str:
    return "".join(f'<span style="color:{COLOURS[k]}">{html.escape(t + q)}</span>' for k, t, q in fragments(pattern))
