"""Small readings of source lines, for checks that look at a line alone; whole files are read by syntax.py."""

from __future__ import annotations

from .syntax import plain_literal  # noqa: F401


def without_comments(line: str) -> str:
    """A line up to a // that stands outside quotes."""
    quote, i = "", 0
    while i < len(line):
        c = line[i]
        if quote:
            if c == "\\":
                i += 1
            elif c == quote:
                quote = ""
        elif c in "'\"`":
            quote = c
        elif line.startswith("//", i) and (i == 0 or line[i - 1] != ":"):
            return line[:i]
        i += 1
    return line


def arguments(text: str, start: int) -> tuple[list[str], int] | None:
    """Top-level arguments of the call whose parenthesis opens at start, and where it closes; None if it doesn't."""
    depth, quote, parts, begin, i = 0, "", [], start + 1, start
    while i < len(text):
        c = text[i]
        if quote:
            if c == "\\":
                i += 1
            elif c == quote:
                quote = ""
        elif c in "'\"`":
            quote = c
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
            if not depth:
                last = text[begin:i].strip()
                return parts + ([last] if last or parts else []), i
        elif c == "," and depth == 1:
            parts.append(text[begin:i].strip())
            begin = i + 1
        i += 1
    return None
