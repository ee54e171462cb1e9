"""Splitting a table into branches and composing sources, joins and analyzers into one result."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowspark.functions.parse import Parser, parse
from flowspark.operators.joins import text_key_join
from flowspark.operators.rules import Rule, apply_rules, predicate

Step = Callable[[DataFrame], DataFrame]


def branch_conditions(subject: Column, cases: Sequence[tuple], kind: str = "equals") -> list[Column]:
    """One condition per case and a last one for rows that match none (or have no value)."""
    tests = [predicate(kind, subject, value) for value, *_ in cases]
    none = F.lit(True)
    for test in tests:
        none = none & ~test
    return [*tests, none]


def branches(df: DataFrame, subject: str | Column, cases: Sequence[tuple], default: Step | None = None,
             kind: str = "equals") -> list[DataFrame]:
    """Every case that holds gives its own output: cases do not exclude each other.

    `cases`: (value, step). The last output belongs to the rows that match no case.
    """
    col = F.col(subject) if isinstance(subject, str) else subject
    conditions = branch_conditions(col, cases, kind)
    steps = [step for _, step in cases] + [default]
    return [df.where(c).transform(s) if s else df.where(c) for c, s in zip(conditions, steps)]


def branch_union(df: DataFrame, subject: str | Column, cases: Sequence[tuple], kind: str = "equals",
                 name: str = "branch") -> DataFrame:
    """The outputs of `branches` with plain steps as one table, read in one pass: the matching
    branch numbers are an array that is exploded."""
    col = F.col(subject) if isinstance(subject, str) else subject
    conditions = branch_conditions(col, cases, kind)
    numbers = F.filter(F.array(*[F.when(c, F.lit(i)) for i, c in enumerate(conditions)]), lambda x: x.isNotNull())
    return df.withColumn(name, F.explode(numbers))


def analyzer(step: Step) -> Step:
    """Run another analyzer on a branch."""
    return step


def parser_step(column: str, parser: Parser, rules: Sequence[Rule] = ()) -> Step:
    """Parse a column and apply rules on a branch."""
    return lambda df: apply_rules(parse(df, column, parser), rules)


def none_step() -> Step:
    return lambda df: df


@dataclass
class Source:
    """A leaf: a named table with the rules to apply to it."""

    name: str
    rules: Sequence[Rule] = ()


@dataclass
class Joined:
    """Two channels joined on keys compared as text."""

    first: Source | Joined | Analyzed
    second: Source | Joined | Analyzed
    on: Sequence[tuple[str, str]] = field(default_factory=list)


@dataclass
class Analyzed:
    """A channel passed through an analyzer step."""

    channel: Source | Joined | Analyzed
    step: Step


def build(channel, tables: dict[str, DataFrame], known: dict | None = None) -> DataFrame:
    """The DataFrame of a channel tree; a sub-tree used twice is built once."""
    known = {} if known is None else known
    if id(channel) in known:
        return known[id(channel)]
    if isinstance(channel, Source):
        df = apply_rules(tables[channel.name], channel.rules)
    elif isinstance(channel, Joined):
        df = text_key_join(build(channel.first, tables, known), build(channel.second, tables, known), channel.on)
    else:
        df = channel.step(build(channel.channel, tables, known))
    known[id(channel)] = df
    return df
