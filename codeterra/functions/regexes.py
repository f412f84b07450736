"""Regular expressions of the web's dialect in Java's."""

from __future__ import annotations

_WORD = "A-Za-z0-9_"
_BOUND = f"(?:(?<![{_WORD}])(?=[{_WORD}])|(?<=[{_WORD}])(?![{_WORD}]))"
_SPACE = "\\s\\x0B\u00a0\ufeff\\p{Z}"
_ANY = "[^\\n\\r\u2028\u2029]"


def portable(pattern: str) -> str:
    """pattern with Java's meaning made that of the web's: ASCII word boundaries, Unicode blanks, `.` and `$` by its own line ends."""
    out, inside, at = [], False, 0
    while at < len(pattern):
        one, two = pattern[at], pattern[at : at + 2]
        if one == "\\":
            if two == r"\s":
                out.append(_SPACE if inside else f"[{_SPACE}]")
            elif two == r"\b" and not inside:
                out.append(_BOUND)
            else:
                out.append(two)
            at += 2
            continue
        if one == "[":
            out.append(r"\[" if inside else one)
            inside = True
        elif one == "]":
            out.append(one)
            inside = False
        elif inside:
            out.append(one)
        else:
            out.append({".": _ANY, "$": r"\z"}.get(one, one))
        at += 1
    return "".join(out)
