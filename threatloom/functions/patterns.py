"""Regular expressions in the JVM dialect, with the word semantics the rules rely on.

The rule catalogue is written for an engine whose ``\\w`` is "letter, number or
underscore" in the Unicode sense.  The JVM's default is ASCII, and its Unicode
mode also counts combining marks, so word boundaries are spelled out instead.

A scan over long bodies is dominated by positions that cannot start a match.
``gated`` puts a look-ahead in front of an alternation that admits only the
leading letters its members can start with; it never changes what matches.
"""

from __future__ import annotations

import re

WORD = r"[\p{L}\p{N}_]"
_AT_EDGE = rf"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"


def unicode_regex(pattern: str) -> str:
    """``pattern`` for the JVM with Unicode ``\\w \\d \\s`` and Unicode ``\\b``."""
    body = pattern.replace(r"\b", _AT_EDGE)
    body = body.replace(r"[\w", r"[\p{L}\p{N}_").replace(r"\w", WORD)
    return "(?U)" + body


def _inner(pattern: str) -> str | None:
    """The part between a leading and a trailing ``\\b``, if both are there."""
    if pattern.startswith(r"\b") and pattern.endswith(r"\b") and r"\b" not in pattern[2:-2]:
        return pattern[2:-2]
    return None


def _alternatives(body: str) -> list[str]:
    """The alternatives of a pattern at its outermost level."""
    found, depth, start, at = [], 0, 0, 0
    while at < len(body):
        if body[at] == "\\":
            at += 1
        elif body[at] in "([":
            depth += 1
        elif body[at] in ")]":
            depth -= 1
        elif body[at] == "|" and not depth:
            found.append(body[start:at])
            start = at + 1
        at += 1
    return [*found, body[start:]]


def _first_group(body: str) -> str | None:
    """What a pattern's leading group holds, or the pattern itself without one; None if the group may be absent."""
    if not body.startswith("("):
        return body
    depth, at = 0, 0
    for at, letter in enumerate(body):
        depth += (letter == "(") - (letter == ")")
        if not depth:
            break
    if body[at + 1 : at + 2] in ("?", "*", "{"):
        return None
    return body[1:at].removeprefix("?:")


def leading_texts(patterns: list[str], depth: int = 4) -> set[str] | None:
    """Texts of at most ``depth`` letters, one of which opens every match; None if unknown."""
    found = set()
    for pattern in patterns:
        inner = _first_group(pattern.removeprefix(r"\b"))
        for choice in _alternatives(inner) if inner is not None else [""]:
            literal = re.match(r"[a-z0-9 ]*", choice)[0]
            if choice[len(literal) : len(literal) + 1] in ("?", "*", "{"):
                literal = literal[:-1]
            if not literal:
                return None
            found.add(literal[:depth])
    return {t for t in found if not any(o != t and t.startswith(o) for o in found)} or None


def _trie(texts: set[str]) -> str:
    groups: dict[str, set[str]] = {}
    for t in texts:
        groups.setdefault(t[0], set()).add(t[1:])
    ends = "".join(sorted(re.escape(c) for c, rest in groups.items() if "" in rest))
    parts = [f"[{ends}]"] if ends else []
    parts += [re.escape(c) + _trie(rest) for c, rest in sorted(groups.items()) if "" not in rest]
    return parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")"


def any_of(patterns: list[str], gate: bool = True) -> str:
    """One ordered alternation over ``patterns``; the first that matches wins."""
    inner = [_inner(p) for p in patterns]
    if not patterns:
        return "(?!)"
    if any(i is None for i in inner):
        return "(?U)" + "|".join(f"(?:{unicode_regex(p)[4:]})" for p in patterns)
    body = "|".join(f"(?:{unicode_regex(i)[4:]})" for i in inner)
    lead = leading_texts(patterns) if gate else None
    if lead is None:
        return f"(?U)(?<!{WORD})(?:{body})(?!{WORD})"
    first = "".join(sorted({re.escape(t[0]) for t in lead}))
    return f"(?U)(?=[{first}])(?<!{WORD})(?={_trie(lead)})(?:{body})(?!{WORD})"


def whole(pattern: str) -> str:
    """``pattern`` anchored to the entire text."""
    return rf"(?U)\A(?:{unicode_regex(pattern)[4:]})\z"
