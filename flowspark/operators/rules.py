"""Row rules: each builds a DataFrame -> DataFrame step; `apply_rules` runs a list of them in order.

A template `%{field}` inside a text stands for the value of that column. A missing column and a
null value mean the same thing.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowspark.functions import text as tx
from flowspark.functions.grok import group_numbers

Rule = Callable[[DataFrame], DataFrame]
TEMPLATE = re.compile(r"%\{([^}]*)\}")


def has(df: DataFrame, name: str) -> bool:
    """True when a (dotted) column exists; a literal dotted name wins."""
    if name in df.columns:
        return True
    kind: T.DataType = df.schema
    for part in name.split("."):
        if isinstance(kind, T.StructType) and part in kind.names:
            kind = kind[part].dataType
        else:
            return False
    return True


def get(df: DataFrame, name: str) -> Column:
    if name in df.columns:
        return F.col(f"`{name}`")
    return F.col(name) if has(df, name) else F.lit(None).cast("string")


def filled(df: DataFrame, text: str) -> Column:
    """A text with its templates replaced by column values, missing ones by nothing."""
    pieces, at = [], 0
    for hit in TEMPLATE.finditer(text):
        if hit.start() > at:
            pieces.append(F.lit(text[at:hit.start()]))
        pieces.append(F.coalesce(get(df, hit.group(1)).cast("string"), F.lit("")))
        at = hit.end()
    if at < len(text) or not pieces:
        pieces.append(F.lit(text[at:]))
    return pieces[0] if len(pieces) == 1 else F.concat(*pieces)


def put(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Set a column; a dotted name sets a struct field, making missing parents."""
    if name in df.columns or "." not in name:
        return df.withColumn(name, value)
    top, rest = name.split(".", 1)
    if top in df.columns and isinstance(df.schema[top].dataType, T.StructType):
        parts, kind = rest.split("."), df.schema[top].dataType
        for i, part in enumerate(parts[:-1]):
            if not (isinstance(kind, T.StructType) and part in kind.names):
                for missing in reversed(parts[i + 1:]):
                    value = F.struct(value.alias(missing))
                return df.withColumn(top, F.col(top).withField(".".join(parts[:i + 1]), value))
            kind = kind[part].dataType
        return df.withColumn(top, F.col(top).withField(rest, value))
    for missing in reversed(rest.split(".")):
        value = F.struct(value.alias(missing))
    return df.withColumn(top, value)


def take_away(df: DataFrame, name: str) -> DataFrame:
    """Drop a column or struct field; a struct left without fields goes too."""
    if name in df.columns:
        return df.drop(F.col(f"`{name}`"))
    if not has(df, name):
        return df
    parent, leaf = name.rsplit(".", 1)
    kind: T.DataType = df.schema
    for part in parent.split("."):
        kind = kind[part].dataType
    if len(kind.names) == 1:
        return take_away(df, parent)
    top, _, inner = name.partition(".")
    return df.withColumn(top, F.col(top).dropFields(inner))


# -- adding, removing, renaming ------------------------------------------------

def add_fields(fields: dict[str, str]) -> Rule:
    """Constant or templated values under constant or templated names.

    A template in a name stands for the *name* of that column when the row has a value there. A
    value that is only one template is skipped for rows where it is missing.
    """

    def step(df: DataFrame) -> DataFrame:
        for name, text in fields.items():
            if not name or not text:
                continue
            whole = TEMPLATE.fullmatch(text)
            value = filled(df, text)
            if whole and not has(df, whole.group(1)):
                continue
            wanted = get(df, whole.group(1)).isNotNull() if whole else F.lit(True)
            hit = TEMPLATE.search(name)
            if hit:
                if hit.group(0) == name or not hit.group(1):
                    continue
                bare = name.replace(hit.group(0), "")
                known = get(df, hit.group(1)).isNotNull()
                if has(df, hit.group(1)):
                    target = name.replace(hit.group(0), hit.group(1))
                    df = put(df, target, F.when(wanted & known, value).otherwise(get(df, target).cast("string")))
                if bare not in df.columns:  # rows without that column use the name without the template
                    if not has(df, hit.group(1)):
                        df = put(df, bare, F.when(wanted, value))
                    continue
            else:
                old = get(df, name).cast("string")
                df = put(df, name, value if not whole else F.when(wanted, value).otherwise(old))
        return df

    return step


def add_tags(tags: Sequence[str]) -> Rule:
    """`pre%{k}suf` copies column k under the name `pre` + k + `suf`; the rest is left out."""

    def step(df: DataFrame) -> DataFrame:
        for tag in tags:
            hit = TEMPLATE.search(tag)
            if hit and hit.group(0) != tag and has(df, hit.group(1)):
                df = df.withColumn(tag.replace(hit.group(0), hit.group(1)), get(df, hit.group(1)))
        return df

    return step


def remove_fields(names: Sequence[str]) -> Rule:
    def step(df: DataFrame) -> DataFrame:
        for name in names:
            df = take_away(df, name)
        return df

    return step


def remove_tags(names: Sequence[str]) -> Rule:
    """Names may hold a template standing for the name of an existing column."""

    def step(df: DataFrame) -> DataFrame:
        known = [TEMPLATE.sub(lambda m: m.group(1) if has(df, m.group(1)) else "", n) for n in names]
        return remove_fields(known)(df)

    return step


def mapping(pairs: dict[str, str]) -> Rule:
    """Rename or move; a nested source may go to the top level and the other way round."""

    def step(df: DataFrame) -> DataFrame:
        for old, new in pairs.items():
            if old == new or not has(df, old):
                continue
            if old in df.columns and new not in df.columns and "." not in new:
                df = df.withColumnRenamed(old, new)
            else:
                df = take_away(put(df, new, get(df, old)), old)
        return df

    return step


def merger(fields: Sequence[str], field: str, separator: str) -> Rule:
    def step(df: DataFrame) -> DataFrame:
        parts = [F.coalesce(get(df, f).cast("string"), F.lit("")) for f in fields]
        return put(df, field, F.concat_ws(separator, *parts))

    return step


# -- changing values -----------------------------------------------------------

def replace(field: str, pattern: str, to: str) -> Rule:
    def step(df: DataFrame) -> DataFrame:
        if not has(df, field):
            return df
        return put(df, field, F.regexp_replace(get(df, field), F.lit(pattern), filled(df, to)))

    return step


def field_cut(field: str, start: int, limit: int) -> Rule:
    def step(df: DataFrame) -> DataFrame:
        return put(df, field, tx.cut(get(df, field), start, limit)) if has(df, field) else df

    return step


def _arith(field: str, value: float, empty, op) -> Rule:
    def step(df: DataFrame) -> DataFrame:
        if not has(df, field):
            return df
        col = get(df, field)
        kind = df.schema[field].dataType if field in df.columns else T.StringType()
        if isinstance(kind, T.NumericType):
            return put(df, field, op(col, F.lit(value)))
        text = F.trim(col.cast("string"))
        whole = F.when(text.rlike(r"^-?\d+$"), op(text.try_cast("bigint"), F.lit(value)).cast("string"))
        real = F.when(text.rlike(r"^-?\d*\.?\d*$"), op(text.try_cast("double"), F.lit(value)).cast("string"))
        return put(df, field, F.when(text == "", F.lit(empty).cast("string")).otherwise(F.coalesce(whole, real, col)))

    return step


def field_multiply(field: str, value: float) -> Rule:
    """Multiply a number or numeric text; empty text becomes 0, other text stays."""
    return _arith(field, value, 0, lambda a, b: a * b)


def field_add(field: str, value: float) -> Rule:
    """Add a constant; empty text becomes the constant."""
    return _arith(field, value, value, lambda a, b: a + b)


# -- row fan-out, dropping, marking ---------------------------------------------

def extends(field: str) -> Rule:
    """One row per list element; struct elements are merged into the row, whose own columns win.

    A row with an empty list goes, a row without a list stays.
    """

    def step(df: DataFrame) -> DataFrame:
        if field not in df.columns or not isinstance(df.schema[field].dataType, T.ArrayType):
            return df
        element = df.schema[field].dataType.elementType
        kept = df.where(F.col(field).isNull() | (F.size(field) > 0))
        rows = kept.withColumn(field, F.explode_outer(field))
        if not isinstance(element, T.StructType):
            return rows
        own = [c for c in df.columns if c != field]
        merged = []
        for name in element.names:
            inner = F.col(field).getField(name)
            merged.append(F.coalesce(F.col(name), inner).alias(name) if name in own else inner.alias(name))
        return rows.select(*[c for c in own if c not in element.names], *merged)

    return changes_rows(step)


def list_to_map(field: str, names: Sequence[str]) -> Rule:
    """Columns by position from a list, as many as both sides have."""

    def step(df: DataFrame) -> DataFrame:
        if field not in df.columns:
            return df
        size = F.least(F.size(field), F.lit(len(names)))
        keys = F.slice(F.array(*[F.lit(n) for n in names]), F.lit(1), size)
        return df.withColumn(field, F.map_from_arrays(keys, F.slice(field, F.lit(1), size)))

    return step


def drop_rows(condition: Column | str | None = None) -> Rule:
    """Drop all rows, or those where the condition holds (unknown means it does not)."""
    cond = F.lit(True) if condition is None else F.expr(condition) if isinstance(condition, str) else condition
    return changes_rows(lambda df: df.where(~F.coalesce(cond, F.lit(False))))


def mark_error(message: str = "error", condition: Column | str | None = None) -> Rule:
    def step(df: DataFrame) -> DataFrame:
        cond = F.lit(True) if condition is None else F.expr(condition) if isinstance(condition, str) else condition
        old = F.col("_error") if "_error" in df.columns else F.lit(None).cast("string")
        return df.withColumn("_error", F.when(cond, F.lit(message)).otherwise(old))

    return step


def ignore() -> Rule:
    return lambda df: df


# -- switches: the first case that holds decides --------------------------------

def predicate(kind: str, col: Column, value) -> Column:
    """equals, prefix, suffix, match (whole text), contain; never null."""
    text = col.cast("string")
    value = str(value)
    if kind == "equals":
        hit = text == F.lit(value)
    elif kind == "prefix":
        hit = text.startswith(value)
    elif kind == "suffix":
        hit = text.endswith(value)
    elif kind == "match":
        hit = tx.full_match(text, value)
    elif kind == "contain":
        hit = text.contains(value)
    else:
        raise ValueError(f"unknown predicate {kind}")
    return F.coalesce(hit, F.lit(False))


def switch(field: str | Column, cases: Sequence[tuple], default: Sequence[Rule] = (), kind: str = "equals") -> Rule:
    """Run the rules of the first case that holds on a row, else the default rules.

    `cases`: (value, [rules]). `field` may be a computed Column. Column rules of all cases fold
    into one CASE per written column over a single pass; a case that fans rows out or drops them
    is run on its own share of the rows.
    """

    def step(df: DataFrame) -> DataFrame:
        subject = get(df, field) if isinstance(field, str) else field
        branch = F.lit(len(cases))
        for number in range(len(cases) - 1, -1, -1):
            branch = F.when(predicate(kind, subject, cases[number][0]), F.lit(number)).otherwise(branch)
        tagged = df.withColumn("_case", branch)
        plans = [rules for _, rules in cases] + [list(default)]
        return _folded(tagged, plans)

    return step


def _one_to_one(rules: Sequence[Rule]) -> bool:
    return not any(getattr(r, "changes_rows", False) for r in rules)


def changes_rows(rule: Rule) -> Rule:
    """Mark a rule inside a switch that drops rows or fans them out."""
    rule.changes_rows = True
    return rule


def _folded(tagged: DataFrame, plans: Sequence[Sequence[Rule]]) -> DataFrame:
    if not all(_one_to_one(p) for p in plans):
        parts = [apply_rules(tagged.where(F.col("_case") == i), p) for i, p in enumerate(plans)]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part, allowMissingColumns=True)
        return out.drop("_case")
    # Each plan is a projection of the same row: keep the row, collect every plan's result in one
    # struct, then choose per written column.
    results, names, work = [], list(tagged.columns), tagged
    for i, rules in enumerate(plans):
        done = [f"_plan{k}" for k in range(i)]
        row = F.struct(*[F.col(f"`{c}`") for c in tagged.columns])
        applied = apply_rules(work.select(row.alias("_keep"), *[F.col(f"`{c}`") for c in tagged.columns], *done), rules)
        own = [c for c in applied.columns if c != "_keep" and c not in done]
        names += [c for c in own if c not in names]
        work = applied.select(*[F.col(f"_keep.`{c}`").alias(c) for c in tagged.columns], *done,
                              F.struct(*[F.col(f"`{c}`") for c in own]).alias(f"_plan{i}"))
        results.append(own)
    chosen = []
    for name in names:
        if name == "_case":
            continue
        value = None
        for i in range(len(plans) - 1, -1, -1):
            part = F.col(f"_plan{i}.`{name}`") if name in results[i] else F.lit(None)
            value = part if value is None else F.when(F.col("_case") == i, part).otherwise(value)
        chosen.append(value.alias(name))
    return work.select(*chosen)


def script(assignments: dict[str, str] | None = None, function=None, schema=None) -> Rule:
    """SQL expressions per column, or a pandas function over batches with a declared schema."""

    def step(df: DataFrame) -> DataFrame:
        if assignments:
            return df.withColumns({k: F.expr(v) for k, v in assignments.items()})

        names = list(schema.names if hasattr(schema, "names") else T._parse_datatype_string(schema).names)

        def batches(frames):
            import pandas as pd

            for frame in frames:
                try:
                    out = function(frame)
                except Exception:
                    # find the rows that fail, keep them with their message
                    rows = []
                    for i in range(len(frame)):
                        one = frame.iloc[i:i + 1]
                        try:
                            rows.append(function(one))
                        except Exception as error:
                            rows.append(one.assign(_error=str(error)))
                    out = pd.concat(rows, ignore_index=True) if rows else frame
                if "_error" in names and "_error" not in out.columns:
                    out = out.assign(_error=None)
                yield out.reindex(columns=names)

        return df.mapInPandas(batches, schema)

    return step


def apply_rules(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    for rule in rules:
        df = df.transform(rule)
    return df


# -- captures --------------------------------------------------------------------

def capture(field: str, patterns: Sequence[str], every: bool = False) -> Rule:
    """Named groups into columns: from the first pattern found, or from every pattern found."""

    def step(df: DataFrame) -> DataFrame:
        col = get(df, field)
        hits = [col.rlike(p) for p in patterns]
        found: dict[str, Column] = {}
        for i in range(len(patterns) - 1, -1, -1):
            groups = group_numbers(patterns[i])
            names = set(groups) if every else set(found) | set(groups)
            for name in names:
                value = (F.nullif(F.regexp_extract(col, patterns[i], groups[name]), F.lit(""))
                         if name in groups else F.lit(None).cast("string"))
                later = found.get(name, F.lit(None).cast("string"))
                if every:  # a later pattern overwrites an earlier one
                    found[name] = F.coalesce(later, F.when(hits[i], value))
                else:
                    found[name] = F.when(hits[i], value).otherwise(later)
        out = {}
        for name in sorted(found):
            old = get(df, name) if has(df, name) else F.lit(None).cast("string")
            out[name] = F.coalesce(found[name], old)
        return df.withColumns(out)

    return step


def xpath_fields(field: str, paths: dict[str, tuple[str, bool]], trim: bool = True) -> Rule:
    """name -> (path, many): text of one node, or the list of all node texts."""

    def step(df: DataFrame) -> DataFrame:
        out = {}
        for name, (path, many) in paths.items():
            if many:
                found = F.xpath(get(df, field), F.lit(path))
                out[name] = F.transform(found, lambda x: F.trim(x)) if trim else found
            else:
                found = F.xpath_string(get(df, field), F.lit(path))
                out[name] = F.trim(found) if trim else found
        return df.withColumns(out)

    return step


def xml_to_text(field: str, tags: Sequence[str], target: str) -> Rule:
    """Text of the chosen tags, one per line."""

    def step(df: DataFrame) -> DataFrame:
        found = F.concat(*[F.xpath(get(df, field), F.lit(f"//{t}/text()")) for t in tags])
        return df.withColumn(target, F.array_join(F.transform(found, lambda x: F.trim(x)), "\n"))

    return step


def stable_id(fields: Sequence[str], target: str = "_id") -> Rule:
    """One field as it is; several as upper-case MD5 of their values joined by `-`."""

    def step(df: DataFrame) -> DataFrame:
        cols = [get(df, f).cast("string") for f in fields]
        if not cols:
            return df.withColumn(target, F.lit(None).cast("string"))
        if len(cols) == 1:
            return df.withColumn(target, cols[0])
        some = F.coalesce(*cols).isNotNull()
        return df.withColumn(target, F.when(some, F.upper(F.md5(F.concat_ws("-", *cols)))))

    return step
