"""Path globs compiled to one regular expression at plan time."""

from __future__ import annotations

import re


class BadGlob(ValueError):
    pass


def glob_to_regex(glob: str) -> str:
    """Regular expression (whole path) for a glob.

    ``*`` and ``?`` also cross ``/``; ``**/`` at the start matches any or no directories,
    ``/**`` at the end matches everything below, ``/**/`` any or no directories between;
    ``[..]``, ``[!..]``, ``{a,b}`` and backslash escapes are understood.
    """
    out, depth, i = [], 0, 0
    while i < len(glob):
        ch = glob[i]
        if ch == "*":
            run = len(glob[i:]) - len(glob[i:].lstrip("*"))
            end = i + run
            opens = i == 0 or glob[i - 1] == "/"
            if run == 2 and opens and glob[end:end + 1] == "/":
                # the "/" before was already written: "a/" + "**/" is "a/" + any directories
                out.append("(?:.*/)?" if i else "(?:/?|.*/)")
                i = end + 1
                continue
            out.append(".*")
            i = end
            continue
        if ch == "?":
            out.append(".")
        elif ch == "[":
            close = glob.find("]", i + 2 + (glob[i + 1:i + 2] in ("!", "^")) - 1)
            if close < 0:
                raise BadGlob(glob)
            body = glob[i + 1:close]
            negate = body[:1] in ("!", "^")
            body = body[1:] if negate else body
            if not body:
                raise BadGlob(glob)
            out.append("[" + ("^" if negate else "") + re.sub(r"([\\\[\]^&~])", r"\\\1", body) + "]")
            i = close
        elif ch == "{":
            depth += 1
            out.append("(?:")
        elif ch == "}":
            depth -= 1
            if depth < 0:
                raise BadGlob(glob)
            out.append(")")
        elif ch == "," and depth:
            out.append("|")
        elif ch == "\\":
            if i + 1 >= len(glob):
                raise BadGlob(glob)
            i += 1
            out.append(re.escape(glob[i]))
        else:
            out.append(re.escape(ch))
        i += 1
    if depth:
        raise BadGlob(glob)
    return "".join(out)


def combine(globs, fallback_anywhere: bool = False) -> str | None:
    """One anchored regular expression for many globs; None when there are none."""
    parts = []
    for glob in globs:
        try:
            parts.append(glob_to_regex(glob))
        except BadGlob:
            if not fallback_anywhere:
                raise
            try:
                parts.append(glob_to_regex("**/" + glob))
            except BadGlob:
                continue
    return "(?s)\\A(?:" + "|".join(parts) + ")\\z" if parts else None
