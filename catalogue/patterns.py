"""The Java patterns in the words of RE2, for the SQL twins."""

import re

_EDGE = r"[^\p{L}\p{N}_]"


def re2(pattern: str) -> str:
    """Word edges become explicit, because those of RE2 know ASCII letters only."""
    out, i = [], 0
    while i < len(pattern):
        if pattern.startswith(r"\b", i):
            after, before = pattern[i + 2 : i + 3], pattern[i - 1 : i] if i else ""
            leads = (after.isalpha() or after == "(") and not before.isalpha()
            out.append(f"(?:^|{_EDGE})" if leads else f"(?:$|{_EDGE})")
            i += 2
        else:
            step = 2 if pattern[i] == "\\" else 1
            out.append(pattern[i : i + step])
            i += step
    return "(?i)" + "".join(out)


def lit(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def has(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, {lit(re2(pattern))})"


def group(text: str, pattern: str, n: int = 1) -> str:
    return f"regexp_extract({text}, {lit(re2(pattern))}, {n})"


def under(domain: str, names) -> str:
    ends = "|".join(re.escape(n) for n in names)
    return f"coalesce(regexp_matches({domain}, {lit(rf'(?:^|\.)(?:{ends})$')}), false)"
