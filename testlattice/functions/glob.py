"""path globs as regular expressions, translated when the plan is made."""

from __future__ import annotations

import re


def glob_regex(pattern: str) -> str:
    """An anchored expression for ``*`` (within a name), ``**`` (across names), ``?``, ``[...]``, ``[!...]`` and ``{a,b}``."""
    out, depth, at = "", 0, 0
    while at < len(pattern):
        c = pattern[at]
        if pattern.startswith("**", at):
            out, at = out + ".*", at + 1
        elif c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and "]" in pattern[at + 2 :]:
            end = pattern.index("]", at + 2)
            inner = pattern[at + 1 : end]
            inner = ("^" + inner[1:] if inner[0] in "!^" else inner).replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out, at = out + f"(?!/)[{inner}]", end
        elif c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        elif c == "\\" and at + 1 < len(pattern):
            at += 1
            out += re.escape(pattern[at])
        else:
            out += re.escape(c)
        at += 1
    if depth:
        raise ValueError(f"a group is not closed in {pattern!r}")
    return f"^{out}$"
