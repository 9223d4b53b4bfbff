"""Regular-expression predicates with bounded resources.

Patterns see bytes, not characters: only A-Z fold, classes such as \\d, \\w and \\s are
ASCII, `.` is one byte of UTF-8. Both engines follow that: the bounded one searches
bytes, the JVM's the same bytes as Latin-1 characters (ASCII texts as they are). What
the JVM reads otherwise (&& or [ inside a class) is left to the bounded engine.

A pattern is simple if no quantifier applies to a group that holds another
quantifier or an alternation. Simple patterns run in the JVM. Others could
overflow its stack or take exponential time on a hostile value, so they run in
Arrow batches with a time limit that grows with the value's length, so that only
super-linear backtracking reaches it; a value that does, does not match. A
pattern that does not compile disables its predicate and is counted.
"""

from __future__ import annotations

import re
import warnings
from re import _parser as parser

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Seconds that a risky pattern may take on one value, and more for each of its characters
#: (linear matching takes some 0.1 microseconds a character).
TIME_LIMIT, CHAR_LIMIT = 0.05, 20e-6
_REPEATS = (parser.MAX_REPEAT, parser.MIN_REPEAT, parser.POSSESSIVE_REPEAT)


def _inner(op, arg):
    """The sub-patterns of a parsed item."""
    if op in _REPEATS:
        return [arg[2]]
    if op is parser.SUBPATTERN:
        return [arg[3]]
    if op is parser.BRANCH:
        return list(arg[1])
    if op in (parser.ASSERT, parser.ASSERT_NOT):
        return [arg[1]]
    if op is parser.ATOMIC_GROUP:
        return [arg]
    if op is parser.GROUPREF_EXISTS:
        return [x for x in arg[1:] if x is not None]
    return []


def _varies(items) -> bool:
    """Whether a pattern holds a quantifier or an alternation anywhere."""
    return any(
        op in _REPEATS or op is parser.BRANCH or any(_varies(x) for x in _inner(op, arg)) for op, arg in items
    )


def _risky(items) -> bool:
    for op, arg in items:
        if op in _REPEATS and arg[1] > 1 and _varies(arg[2]):
            return True
        if op in (parser.GROUPREF, parser.GROUPREF_EXISTS):
            return True
        if any(_risky(x) for x in _inner(op, arg)):
            return True
    return False


def _classes(pattern: str) -> list[str]:
    """What stands between the brackets of each class."""
    out, i = [], 0
    while i < len(pattern):
        if pattern[i] == "\\":
            i += 2
        elif pattern[i] == "[":
            j = i + 1 + pattern[i + 1 : i + 2].count("^")
            j += pattern[j : j + 1].count("]")  # a first ] is a member
            while j < len(pattern) and pattern[j] != "]":
                j += 1 + (pattern[j] == "\\")
            out.append(pattern[i + 1 : j])
            i = j + 1
        else:
            i += 1
    return out


def is_simple(pattern: str) -> bool:
    """False also for what this parser doesn't know."""
    if len(pattern) > 4_000 or "|" in pattern and re.search(r"\)[*+{]", pattern):
        return False  # the parser below turns (a|b) into a set; the JVM recurses
    if any("&&" in c or "[" in c or c.startswith(("]", "^]")) for c in _classes(pattern)):
        return False
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            return not _risky(parser.parse(pattern))
    except (re.error, RecursionError, OverflowError):
        return False


def _jvm_compiles(pattern: str) -> bool:
    spark = SparkSession.getActiveSession()
    try:
        spark._jvm.java.util.regex.Pattern.compile(pattern)
        return True
    except Exception:  # the gateway wraps the JVM's syntax error
        return False


# What word borders mean where only ASCII letters, digits and _ are words.
_BORDER, _NO_BORDER = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))", r"(?:(?<=\w)(?=\w)|(?<!\w)(?!\w))"


def _escapes(pattern: str, table: dict[str, str]) -> str:
    """pattern with escapes outside of classes replaced."""
    out, i, inside = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            pair = pattern[i : i + 2]
            out.append(pair if inside else table.get(pair, pair))
            i += 2
            continue
        if c == "[" and not inside:
            inside = True
            if pattern[i + 1 : i + 2] == "^":
                out.append(c)
                i, c = i + 1, "^"
            if pattern[i + 1 : i + 2] == "]":
                out.append(c)
                i, c = i + 1, "]"
        elif c == "]":
            inside = False
        out.append(c)
        i += 1
    return "".join(out)


def compiled(pattern: str, cased: bool):
    """The pattern for the bounded engine, or None if it doesn't compile.

    A single code unit's escape is forbidden: it could cut a character."""
    import regex

    if re.search(r"(?<!\\)(?:\\\\)*\\C", pattern):
        return None
    own = _escapes(pattern, {r"\Z": r"(?=\n?\Z)", r"\z": r"\Z"})
    try:
        return regex.compile(own.encode(), regex.V0 | regex.ASCII | (0 if cased else regex.IGNORECASE))
    except (regex.error, RecursionError):
        return None


def search(pattern: str, cased: bool, text: str, limit: float = TIME_LIMIT, per_char: float = CHAR_LIMIT) -> bool:
    """Unanchored search; no match if the pattern is bad or time runs out."""
    p = compiled(pattern, cased)
    if p is None:
        return False
    try:
        return p.search(text.encode(), timeout=limit + per_char * len(text)) is not None
    except TimeoutError:
        return False


def _jvm_pattern(pattern: str, cased: bool) -> str:
    own = _escapes(pattern.encode().decode("latin-1"), {r"\b": _BORDER, r"\B": _NO_BORDER})
    return ("(?d)" if cased else "(?d)(?i)") + own


def _octets(v: Column) -> Column:
    """The bytes of a text as characters; an ASCII text is that already."""
    return F.when(F.octet_length(v) == F.char_length(v), v).otherwise(F.decode(F.encode(v, "UTF-8"), "ISO-8859-1"))


def plan(pattern: str, cased: bool) -> str:
    """How a pattern runs: "native", "bounded" or "skipped"."""
    if compiled(pattern, cased) is None:
        return "skipped"
    return "native" if is_simple(pattern) and _jvm_compiles(_jvm_pattern(pattern, cased)) else "bounded"


def matches(v: Column, pattern: str, cased: bool) -> Column:
    how = plan(pattern, cased)
    if how == "skipped":
        return F.lit(False)
    if how == "native":
        return _octets(v).rlike(_jvm_pattern(pattern, cased))

    @F.udf(T.BooleanType(), useArrow=True)
    def bounded(text):
        return None if text is None else search(pattern, cased, text)

    return bounded(v)
