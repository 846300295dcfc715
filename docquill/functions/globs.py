"""Path globs as anchored regular expressions.

Supported syntax: ``**`` (any number of path segments), ``*`` (within a
segment), ``?``, ``[...]``/``[!...]`` classes and ``{a,b}`` alternatives.
The translation runs once on the driver over the short list of patterns;
the result is a single regex evaluated by the JVM (and by RE2 in oracles: no
look-around, no back-references). A malformed glob yields ``None`` and so
matches nothing.
"""

from __future__ import annotations

_SPECIAL = set(".^$|()[]{}*+?\\")


def _esc(ch: str) -> str:
    return "\\" + ch if ch in _SPECIAL else ch


def glob_to_regex(glob: str) -> str | None:
    """Regex body (no anchors) matching exactly the paths the glob matches."""
    out: list[str] = []
    i, n = 0, len(glob)
    depth = 0
    while i < n:
        ch = glob[i]
        if ch == "*":
            if i + 1 < n and glob[i + 1] == "*":
                at_start = i == 0 or glob[i - 1] == "/"
                j = i + 2
                if at_start and j < n and glob[j] == "/":
                    out.append("(?:[^/]*/)*")       # '**/' : zero or more directories
                    i = j + 1
                    continue
                if at_start and j == n:
                    if out and out[-1] == "/":
                        out[-1] = "(?:/.*)?"        # trailing '/**': the directory and all below
                    else:
                        out.append(".*")
                    i = j
                    continue
                out.append(".*")
                i = j
                continue
            out.append("[^/]*")
        elif ch == "?":
            out.append("[^/]")
        elif ch == "[":
            j = glob.find("]", i + 2 if i + 1 < n and glob[i + 1] in "!^" else i + 1)
            if j < 0:
                return None
            body = glob[i + 1:j]
            neg = body[:1] in ("!", "^")
            if neg:
                body = body[1:]
            body = body.replace("\\", "\\\\")
            out.append("[" + ("^/" if neg else "") + body + "]")
            i = j + 1
            continue
        elif ch == "{":
            depth += 1
            out.append("(?:")
        elif ch == "}" and depth > 0:
            depth -= 1
            out.append(")")
        elif ch == "," and depth > 0:
            out.append("|")
        elif ch == "\\" and i + 1 < n:
            out.append(_esc(glob[i + 1]))
            i += 2
            continue
        else:
            out.append(_esc(ch))
        i += 1
    if depth:
        return None
    return "".join(out)


def globs_regex(globs, ancestors: bool = False) -> str | None:
    """One anchored regex for "any glob matches".

    With ``ancestors=True`` it also matches when a glob matches any ancestor
    directory of the path (directory pruning during a walk): the glob must
    match a prefix that is followed by ``/``.
    """
    bodies = [b for b in (glob_to_regex(g) for g in globs) if b is not None]
    if not bodies:
        return None
    alt = "|".join(f"(?:{b})" for b in bodies)
    return f"^(?:{alt})(?:/.*)?$" if ancestors else f"^(?:{alt})$"
