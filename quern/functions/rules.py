"""Rules as data: a caller's table of (attribute, order, pattern, frame) becomes one ordered Column, or a function that
SQL can call.

For a text of an attribute the first rule, by order, whose pattern matches the whole text gives the result: its frame,
in which {x} stands for the pattern's first group and {1}, {2}, ... for its groups, white space made single. Texts that
no rule matches, and attributes without rules, give null. A null attribute in a rule means any. Rules of one order are
tried by pattern. Patterns are Java's, without case and in Unicode; trailing stops of the text are not seen by them.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

#: A rule table is a list that people write; a larger one is an error, not a plan of a million branches.
MOST = 5_000
_SLOT = re.compile(r"\{(x|\d+)\}")


@dataclass(frozen=True)
class Rule:
    attribute: str | None
    order: int
    pattern: str
    frame: str


def from_table(df: DataFrame) -> list[Rule]:
    """Rules from a table with columns attribute, order, pattern, frame; rows without a pattern or a frame are left out."""
    rows = df.select("attribute", "order", "pattern", "frame").filter("pattern IS NOT NULL AND frame IS NOT NULL").limit(MOST + 1).collect()
    if len(rows) > MOST:
        raise ValueError(f"more than {MOST} rules")
    return checked(Rule(r["attribute"], r["order"] or 0, r["pattern"], r["frame"]) for r in rows)


def checked(rules: Iterable[Rule]) -> list[Rule]:
    """In the order of trial. A frame that asks for a group which its pattern does not have is an error, not an empty word."""
    out = sorted(rules, key=lambda r: (r.order, r.pattern, r.frame, r.attribute or ""))
    for r in out:
        groups = len(re.findall(r"(?<!\\)\((?!\?)|\(\?<[A-Za-z]", r.pattern))
        if any(int("1" if s == "x" else s) > groups for s in _SLOT.findall(r.frame)):
            raise ValueError(f"frame {r.frame!r} asks for a group that {r.pattern!r} has not")
    return out


def _seen(c: Column) -> Column:
    return F.regexp_replace(F.btrim(c), r"[.!?]+$", "")


def _whole(pattern: str) -> str:
    return f"(?iU)^(?:{pattern})$"


def _filled(c: Column, rule: Rule) -> Column:
    """The frame's fixed pieces and the groups between them."""
    pieces = _SLOT.split(rule.frame)
    parts = [F.lit(p) if i % 2 == 0 else F.btrim(F.regexp_extract(c, _whole(rule.pattern), int("1" if p == "x" else p))) for i, p in enumerate(pieces)]
    return F.btrim(F.regexp_replace(F.concat(*parts), r"\s+", " "))


def compiled(rules: Iterable[Rule], c: Column, attribute: Column) -> Column:
    """All rules as one Column: a branch for each attribute, in which its rules and those for any are tried in order."""
    ordered, text = checked(rules), _seen(c)
    branch = lambda some: F.coalesce(*(F.when(text.rlike(_whole(r.pattern)), _filled(text, r)) for r in some), F.lit(None).cast("string"))
    names = list(dict.fromkeys(r.attribute for r in ordered if r.attribute is not None))
    general = branch([r for r in ordered if r.attribute is None])
    cases = [(attribute == name, branch([r for r in ordered if r.attribute in (name, None)])) for name in names]
    return functools.reduce(lambda done, case: done.when(*case), cases[1:], F.when(*cases[0])).otherwise(general) if cases else general


def python_pattern(pattern: str) -> re.Pattern:
    """A Java pattern as Python reads it: only the names of Unicode letter classes differ among what rules use."""
    plain = pattern.replace(r"\p{L}", r"[^\W\d_]").replace(r"\p{N}", r"\d")
    return re.compile(f"(?:{plain})", re.I)


def register(spark: SparkSession, name: str, rules: Iterable[Rule]) -> None:
    """A table function for SQL: name(text, attribute) gives (place, frame_no, sentence) of every rule that matches, in
    the order of trial; place 0 is the one that compiled() takes. SELECT ... FROM t, LATERAL name(t.text, t.attribute)."""
    ordered = checked(rules)

    class Rules:
        def __init__(self) -> None:
            self.known = [(i, r, python_pattern(r.pattern)) for i, r in enumerate(ordered)]

        def eval(self, text: str, attribute: str) -> Iterator[tuple[int, int, str]]:
            if text is None:
                return
            seen, place = re.sub(r"[.!?]+$", "", text.strip(" ")), 0
            for i, r, pattern in self.known:
                found = pattern.fullmatch(seen) if r.attribute in (attribute, None) else None
                if found:
                    filled = _SLOT.sub(lambda s, found=found: (found[int("1" if s[1] == "x" else s[1])] or "").strip(" "), r.frame)
                    yield place, i, re.sub(r"\s+", " ", filled).strip(" ")
                    place += 1

    spark.udtf.register(name, udtf(Rules, returnType="place int, frame_no int, sentence string"))
