"""Regular expressions that mean the same in Spark and in the SQL that checks it.

A rule is (pattern, flags, replacement). In Spark, classes are Unicode-aware (`U`) and only a newline ends a line
(`d`); the other dialect gets the bare pattern with the same flags and `\\1` for `$1`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

Rule = tuple[str, str, str]


def spark_pattern(pattern: str, flags: str = "") -> str:
    return f"(?Ud{flags}){_steady(pattern)}"


def _steady(pattern: str) -> str:
    """White space at a line's begin is taken for good: no rule goes on with white space, and giving it back sign by sign makes a run of blank lines cost its cube."""
    return r"^\s*+" + pattern.removeprefix(r"^\s*") if pattern.startswith(r"^\s*") else pattern


def sql_pattern(pattern: str, flags: str = "") -> str:
    return (f"(?{flags})" if flags else "") + pattern


def plain(pattern: str) -> str:
    """A pattern without possessive marks and the look behind at white space, which only save steps."""
    for mark, without in (("*+", "*"), ("++", "+"), ("}+", "}"), (r"(?<!\s)", "")):
        pattern = pattern.replace(mark, without)
    return pattern


#: White space, as Unicode-aware `\\s` has it.
SPACES = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def apply(text: Column, rules: Iterable[Rule]) -> Column:
    """Every rule in turn."""
    for pattern, flags, new in rules:
        text = F.regexp_replace(text, spark_pattern(pattern, flags), new)
    return text


def holds(text: Column, signs: Iterable[str]) -> Column:
    """Whether a text holds one of the signs: a plain search, many times faster than a pattern."""
    held = F.lit(False)
    for sign in signs:
        held = held | text.contains(sign)
    return held


def any_of(rules: Iterable[Rule]) -> str:
    """One pattern that a text matches where any of the rules does; what all begin with is tried once."""
    rules = list(rules)
    begin = r"^\s*" if all(p.startswith(r"^\s*") and "m" in f for p, f, _ in rules) else ""
    return f"(?Ud{'m' if begin else ''}){_steady(begin)}(?:" + "|".join(f"(?{f}:{p.removeprefix(begin) if begin else _steady(p)})" for p, f, _ in rules) + ")"


def apply_gated(text: Column, rules: Iterable[Rule], signs: dict[str, list[str]]) -> Column:
    """Every rule in turn, each only for texts that hold one of its signs (by its pattern); without signs for all.

    The rules are a constant array that one fold runs over, so the expression is no deeper for many rules than for one,
    and what a rule's text holds is looked up in the text as the rules before left it.
    """

    def described(rule: Rule) -> Column:
        pattern, flags, new = rule
        return F.struct(F.lit(spark_pattern(pattern, flags)).alias("pattern"), F.lit(new).alias("new"), F.array(*map(F.lit, signs.get(pattern, []))).cast("array<string>").alias("signs"))

    def step(x: Column, rule: Column) -> Column:
        held = (F.size(rule["signs"]) == 0) | F.exists(rule["signs"], lambda s: F.contains(x, s))
        return F.when(held, F.regexp_replace(x, rule["pattern"], rule["new"])).otherwise(x)

    return F.aggregate(F.array(*map(described, rules)), text, step)


def apply_probed(text: Column, rules: Iterable[Rule], signs: dict[str, list[str]]) -> Column:
    """The same, for texts in which any of the rules matches; one pass over a text where none does."""
    rules = list(rules)
    return let(text, lambda x: F.when(x.rlike(any_of(rules)), apply_gated(x, rules, signs)).otherwise(x))


def quoted(text: str) -> str:
    """A string literal of standard SQL."""
    return "'" + text.replace("'", "''") + "'"


def sql_apply(text: str, rules: Iterable[Rule]) -> str:
    """The same rules as an SQL expression."""
    for pattern, flags, new in rules:
        new = new
        for i in range(1, 10):
            new = new.replace(f"${i}", f"\\{i}")
        text = f"regexp_replace({text}, {quoted(sql_pattern(pattern, flags))}, {literal(new)}, 'g')"
    return text


def literal(text: str) -> str:
    """A literal with newlines and control characters spelled as chr()."""
    parts, plain = [], ""
    for c in text:
        if ord(c) < 32:
            if plain:
                parts.append(quoted(plain))
            parts.append(f"chr({ord(c)})")
            plain = ""
        else:
            plain += c
    if plain or not parts:
        parts.append(quoted(plain))
    return "(" + " || ".join(parts) + ")" if len(parts) > 1 else parts[0]


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.trim(text, F.lit(SPACES))


def sql_strip(text: str) -> str:
    return f"regexp_replace(regexp_replace({text}, '^\\s+', ''), '\\s+$', '')"


def unspaced_length(text: Column) -> Column:
    """Characters that aren't white space."""
    return F.length(F.regexp_replace(text, r"(?U)\s+", ""))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, for expressions that lambdas refer to again and again."""
    return F.transform(F.array(value), use)[0]
