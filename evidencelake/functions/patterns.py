"""Regular expressions and replacements as callers write them in Python, for Spark's Java engine."""

from __future__ import annotations

import re

#: Any case, by Unicode, with Unicode classes, and line ends as in Python: only \n.
ANY_CASE = "(?iuUd)"


def valid(pattern: str) -> bool:
    try:
        re.compile(pattern)
    except re.error:
        return False
    return True


def java(pattern: str) -> str:
    """The same expression for Java: groups by number instead of by name, \\z for \\Z, brackets and & within classes as themselves."""
    names = re.compile(pattern).groupindex
    out, i, inside = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            pair = pattern[i : i + 2]
            out.append(r"\z" if pair == r"\Z" else pair)
            i += 2
            continue
        if inside:
            if c == "]":
                inside = False
            out.append("\\" + c if c in "[&" else c)
        elif c == "[":
            inside = True
            out.append(c)
            for first in ("^", "]"):  # a bracket that comes first is itself
                if pattern[i + 1 : i + 2] == first:
                    i += 1
                    out.append("\\]" if first == "]" else first)
        elif m := re.match(r"\(\?P<\w+>", pattern[i:]):
            out.append("(")
            i += len(m[0])
            continue
        elif m := re.match(r"\(\?P=(\w+)\)", pattern[i:]):
            out.append(f"(?:\\{names[m[1]]})")
            i += len(m[0])
            continue
        else:
            out.append(c)
        i += 1
    return "".join(out)


def java_replacement(new: str, pattern: str) -> str:
    """A replacement for Java: \\1, \\g<1> and \\g<name> are groups, \\n and its like are characters, a dollar sign is itself."""
    names = re.compile(pattern).groupindex
    plain = {"n": "\n", "t": "\t", "r": "\r", "\\": "\\\\"}

    def one(m: re.Match) -> str:
        if m["dollar"]:
            return r"\$"
        group = m["number"] or m["name"]
        if group:
            return f"${group if group.isdigit() else names[group]}"
        return plain.get(m["other"], "\\\\" + m["other"])

    return re.sub(r"(?P<dollar>\$)|\\(?:(?P<number>\d{1,2})|g<(?P<name>\w+)>|(?P<other>.))", one, new, flags=re.DOTALL)
