"""Rule pattern dialect helpers.

Site rules are written in Python ``re`` syntax.  Spark evaluates Java
regular expressions, so rule text is translated once, when the rules table
is loaded (a handful of strings per site, not per row).
"""

from __future__ import annotations

import re


#: Java flags that give classes (\\w, \\d, \\s, \\b) and line ends their Python meaning.
PYTHON_FLAGS = "(?Ud)"
_QUANTIFIER = re.compile(r"\{\d*(?:,\d*)?\}")


def _literal_signs(pat: str) -> str:
    """Braces that are no quantifier, and [ and && within a class, are literal in Python but not in Java."""
    out, i, inside = [], 0, False
    while i < len(pat):
        c = pat[i]
        if c == "\\":
            out.append(pat[i:i + 2])
            i += 2
            continue
        if not inside and c == "{":
            m = _QUANTIFIER.match(pat, i)
            if m and m[0] not in ("{}", "{,}") and i:
                out.append("{0" + m[0][1:] if m[0][1] == "," else m[0])
                i = m.end()
                continue
            out.append("\\{")
        elif not inside and c == "[":
            inside = True
            first = re.match(r"\[\^?\]?", pat[i:])[0]  # a ] that comes first is literal
            out.append(first.replace("]", "\\]"))
            i += len(first)
            continue
        elif inside and c in "[&":
            out.append("\\" + c)
        else:
            inside = inside and c != "]"
            out.append(c)
        i += 1
    return "".join(out)


def python_pattern_to_java(pat: str) -> str:
    """Named groups, end anchors and literal signs in Java spelling, with Python's meaning of classes."""
    if pat is None:
        return None
    pat = _literal_signs(pat)
    pat = pat.replace("(?P<", "(?<")
    pat = re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", pat)
    pat = re.sub(r"(?<!\\)\\Z", r"\\z", pat)
    return PYTHON_FLAGS + pat


def python_replacement_to_java(rep: str) -> str:
    """``\\1`` / ``\\g<1>`` / ``\\g<name>`` group references in Java form; literal ``$`` escaped."""
    if rep is None:
        return None
    out = []
    i = 0
    while i < len(rep):
        ch = rep[i]
        if ch == "$":
            out.append("\\$")
        elif ch == "\\" and i + 1 < len(rep):
            nxt = rep[i + 1]
            if nxt.isdigit():
                out.append("$" + nxt)
                i += 1
            elif nxt == "g":
                m = re.match(r"\\g<(\w+)>", rep[i:])
                if m:
                    name = m.group(1)
                    out.append("$" + name if name.isdigit() else "${" + name + "}")
                    i += len(m.group(0)) - 1
                else:
                    out.append("\\\\")
            elif nxt == "\\":
                out.append("\\\\")
                i += 1
            elif nxt == "n":
                out.append("\n")
                i += 1
            else:
                out.append("\\\\")
        elif ch == "\\":
            out.append("\\\\")
        else:
            out.append(ch)
        i += 1
    return "".join(out)


def pattern_error(pat: str) -> str | None:
    """Why a rule pattern is unusable (checked with Python's engine), or None."""
    try:
        re.compile(pat)
    except re.error as exc:  # noqa: PERF203
        return str(exc)
    return None
