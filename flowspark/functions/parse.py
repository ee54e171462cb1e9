"""Parsers: a text column becomes typed columns.

A parser is a function from a text Column to a `Parsed`: one Column per field and a flag that
tells whether the text had the parser's shape. All of them are Catalyst expressions.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowspark.functions.grok import expand
from flowspark.operators.rules import Rule, apply_rules, has, put, take_away


@dataclass
class Parsed:
    """Fields and success flag; `prepare` holds columns both use, projected first so that the
    costly part (a regex, a fold) runs once per row."""

    fields: dict[str, Column]
    ok: Column
    prepare: dict[str, Column] = field(default_factory=dict)


Parser = Callable[[Column], Parsed]
_numbers = itertools.count()


def _prepared(value: Column) -> tuple[Column, dict[str, Column]]:
    name = f"_step{next(_numbers)}"
    return F.col(name), {name: value}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a value to a lambda variable, so that `body` may use it many times."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def raw() -> Parser:
    return lambda c: Parsed({"raw": c}, F.lit(True))


def transfer() -> Parser:
    """Nothing parsed; `parse` keeps all other columns anyway."""
    return raw()


# -- JSON -----------------------------------------------------------------------

def json_schema_of(df: DataFrame, col: str) -> T.StructType:
    """Schema merged over the whole text column by one aggregate; texts that are no JSON are skipped."""
    found = df.agg(F.schema_of_variant_agg(F.try_parse_json(col)).alias("s")).first()["s"]
    ddl = re.sub(r"DECIMAL\(\d+,\s*\d+\)", "DOUBLE", found).replace("OBJECT<", "STRUCT<")
    ddl = re.sub(r"\b(?:VOID|VARIANT)\b", "STRING", ddl)
    return T._parse_datatype_string(ddl)


def json(schema: T.StructType | str) -> Parser:
    """An object gives its fields, a top-level array the list `raw`; anything else is a failure."""
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)

    guarded = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])

    def step(c: Column) -> Parsed:
        text = F.ltrim(F.ltrim(c, F.lit("\ufeff")))
        first = F.substring(text, 1, 1)
        row, prepare = _prepared(F.from_json(F.when(first == "{", text), guarded, {"columnNameOfCorruptRecord": "_bad"}))
        is_object = row.isNotNull() & row.getField("_bad").isNull()
        fields = {f.name: row.getField(f.name) for f in schema.fields}
        ok = is_object
        if "raw" not in fields:
            items = F.from_json(F.when(first == "[", text), T.ArrayType(T.StringType()))
            fields["raw"] = items
            ok = is_object | ((first == "[") & items.isNotNull())
        return Parsed(fields, F.coalesce(ok, F.lit(False)), prepare)

    return step


# -- XML ------------------------------------------------------------------------

def clean_xml(c: Column) -> Column:
    """Control signs out, stray `&` and `<` inside text written as entities."""
    text = F.regexp_replace(c, "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]", "")
    text = F.regexp_replace(text, "&(?!(?:amp|lt|gt|quot|apos|#\\d+|#x[0-9a-fA-F]+);)", "&amp;")
    return F.regexp_replace(text, "<(?![A-Za-z_/!?])", "&lt;")


def xml(schema: T.StructType | str) -> Parser:
    """Child elements as fields; declare a repeated tag as an array."""
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    guarded = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])

    def step(c: Column) -> Parsed:
        row, prepare = _prepared(F.from_xml(clean_xml(c), guarded,
                                            {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
        ok = F.coalesce(row.isNotNull() & row.getField("_bad").isNull(), F.lit(False))
        return Parsed({f.name: row.getField(f.name) for f in schema.fields}, ok, prepare)

    return step


# -- regular expressions ----------------------------------------------------------

_MARK = "\u0001"


def captures(c: Column, regex: str, numbers: Sequence[int]) -> Column:
    """The wanted groups of the first match as an array of text, in one pass over the value."""
    joined = _MARK.join(f"${n}" for n in numbers)
    whole = f"^[\\s\\S]*?(?:{regex})[\\s\\S]*$"
    return F.when(c.rlike(regex), F.split(F.regexp_replace(c, F.lit(whole), F.lit(joined)), _MARK))


def regex(template: str, library: dict[str, str] | None = None, time_parts: bool = False) -> Parser:
    """A regular expression with `%{PATTERN:field}` parts; dotted names become nested structs. `time_parts` adds what
    date and time patterns capture, for `dates.captured_time`."""
    grok = expand(template, library, time_parts)
    numbers = [(n, g) for n, found in grok.every.items() for g in (found if time_parts else found[:1])]

    def step(c: Column) -> Parsed:
        hits, prepare = _prepared(captures(c, grok.regex, [g for _, g in numbers]))
        found: dict[str, list[Column]] = {}
        for i, (n, _) in enumerate(numbers):
            found.setdefault(n, []).append(F.nullif(hits.getItem(i), F.lit("")))
        flat = {n: own[0] if len(own) == 1 else F.coalesce(*own) for n, own in found.items()}
        return Parsed(nest(flat), hits.isNotNull(), prepare)

    return step


def nest(flat: dict[str, Column]) -> dict[str, Column]:
    """Dotted names to nested structs."""
    tree: dict = {}
    for name, col in flat.items():
        at = tree
        *parents, leaf = name.split(".")
        for part in parents:
            at = at.setdefault(part, {})
        at[leaf] = col

    def build(node):
        return node if isinstance(node, Column) else F.struct(*[build(v).alias(k) for k, v in node.items()])

    return {k: build(v) for k, v in tree.items()}


# -- delimited --------------------------------------------------------------------

def _unquoted(c: Column) -> Column:
    return F.regexp_replace(c, r"""^(?:"([\s\S]*)"|'([\s\S]*)')$""", "$1$2")


def delimited(delimiter: str, names: Sequence[str], quotes: bool = True) -> Parser:
    """Split into the declared fields.

    More pieces than fields are put back into the last one, fewer are a failure. `-` and (but for
    the last field) empty text are null; surrounding quotes go, a delimiter inside a quoted piece
    does not split.
    """
    d = re.escape(delimiter)
    n = len(names)

    def step(c: Column) -> Parsed:
        if quotes:
            plain = f"(?:(?!{d})[\\s\\S])*"

            def quoted(q):
                tail = f"(?:(?!{d})[^{q}])*"
                return f"{q}[^{q}]*{q}{tail}(?:{q}[^{q}]*{q}{tail})*"

            piece = f"(?>{quoted(chr(34))}|{quoted(chr(39))}|[\"'][\\s\\S]*|{plain})"
            found, prepare = _prepared(F.regexp_extract_all(c, F.lit(f"\\G(?:^|{d})({piece})"), F.lit(1)))
            last = F.array_join(F.slice(found, F.lit(n), F.greatest(F.size(found) - n + 1, F.lit(0))), delimiter)
        else:
            found, prepare = _prepared(F.split(c, d, n))
            last = F.get(found, F.lit(n - 1))
        ok = F.size(found) >= n
        fields = {}
        for i, name in enumerate(names):
            value = F.trim(F.get(found, F.lit(i)) if i < n - 1 else last)
            empty = (value == "-") | (value == "") if i < n - 1 else value == "-"
            fields[name] = F.when(ok & ~empty, _unquoted(value))
        return Parsed(fields, F.coalesce(ok, F.lit(False)), prepare)

    return step


# -- key-value ----------------------------------------------------------------------

def _kv_value(v: Column) -> Column:
    bare = _unquoted(v)
    return F.when(~((v == "") | bare.isin("null", "N/A")), bare)


def key_value_map(c: Column, delimiter: str = ",", tab: str = "=") -> Column:
    """Pairs as a map, in order, later keys winning; null values are left out.

    A quoted value may hold the delimiter. A piece without `tab` becomes the prefix `piece_` of the
    next key; at the very end it is added to the last value.
    """
    d = re.escape(delimiter)
    piece = f"(?:\"(?:\\\\.|[^\"\\\\])*\"|'(?:\\\\.|[^'\\\\])*'|(?!{d})[\\s\\S])*"
    pieces = F.regexp_extract_all(F.trim(c), F.lit(f"\\G(?:^|{d})({piece})"), F.lit(1))
    pair = "struct<key:string,value:string>"
    start = F.from_json(F.lit('{"done":[]}'), f"struct<parent:string,done:array<{pair}>>")

    def fold(state, p):
        at = F.instr(p, tab)
        key = F.trim(F.concat_ws("_", state.getField("parent"), F.substring(p, F.lit(1), at - 1)))
        value = F.substring(p, at + len(tab), F.length(p))
        entry = F.struct(key.alias("key"), value.alias("value"))
        return F.when(at > 0, F.struct(F.lit(None).cast("string").alias("parent"),
                                       F.array_append(state.getField("done"), entry).alias("done"))) \
            .otherwise(F.struct(F.nullif(F.concat_ws("_", state.getField("parent"), p), F.lit("")).alias("parent"),
                                state.getField("done").alias("done")))

    def finish(state):
        done, rest = state.getField("done"), state.getField("parent")
        lastone = F.element_at(done, -1)
        longer = F.struct(lastone.getField("key").alias("key"),
                          F.concat(lastone.getField("value"), F.lit(delimiter), rest).alias("value"))
        return F.when(rest.isNotNull() & (F.size(done) > 0),
                      F.array_append(F.slice(done, F.lit(1), F.size(done) - 1), longer)).otherwise(done)

    return let(F.aggregate(pieces, start, fold, finish), lambda done: _last_wins(done, _kv_value))


def _last_wins(entries: Column, value_of: Callable[[Column], Column]) -> Column:
    """(key, value) entries as a map: the last value of each key, without null values."""
    backward = F.reverse(entries)
    keys = F.transform(backward, lambda e: e.getField("key"))
    last = F.filter(backward, lambda e, i: F.array_position(keys, e.getField("key")) == i + 1)
    valued = F.transform(F.reverse(last), lambda e: F.struct(e.getField("key").alias("key"),
                                                             value_of(e.getField("value")).alias("value")))
    return F.map_from_entries(F.filter(valued, lambda e: e.getField("value").isNotNull()))


def key_value(delimiter: str = ",", tab: str = "=", keys: Sequence[str] | None = None) -> Parser:
    """All pairs in the map `fields`, or the declared keys as columns."""

    def step(c: Column) -> Parsed:
        pairs, prepare = _prepared(key_value_map(c, delimiter, tab))
        ok = F.coalesce(F.size(pairs) > 0, F.lit(False))
        fields = {"fields": pairs} if keys is None else {k: F.try_element_at(pairs, F.lit(k)) for k in keys}
        return Parsed(fields, ok, prepare)

    return step


# -- CEF -----------------------------------------------------------------------------

# The header fields in order.
CEF_HEADER = ("version", "device_vendor", "device_product", "device_version", "signature_id", "name", "severity")


def cef() -> Parser:
    """Seven header fields between unescaped pipes and the map `extension` of `k=v` pairs."""

    def step(c: Column) -> Parsed:
        parts, prepare = _prepared(F.split(F.trim(c), r"(?<!\\)\|", 8))
        ok = F.coalesce((F.size(parts) == 8) & F.get(parts, F.lit(0)).startswith("CEF:"), F.lit(False))
        fields = {}
        for i, name in enumerate(CEF_HEADER):
            value = F.trim(F.get(parts, F.lit(i)))
            value = F.substring(value, F.lit(5), F.length(value)) if i == 0 else value
            fields[name] = F.when(ok & (value != ""), value)
        pair = r"(?:^| )([^ =\\]+=[\s\S]*?)(?=(?: [^ =\\]+=)|$)"
        found = F.transform(F.regexp_extract_all(F.get(parts, F.lit(7)), F.lit(pair), F.lit(1)), lambda kv: F.struct(
            F.substring_index(kv, "=", 1).alias("key"), F.substring(kv, F.instr(kv, "=") + 1, F.length(kv)).alias("value")))
        extension = let(found, lambda e: _last_wins(e, lambda v: F.nullif(v, F.lit(""))))
        fields["extension"] = F.when(ok, extension)
        return Parsed(fields, ok, prepare)

    return step


# -- combinations ----------------------------------------------------------------------

def _union_names(parsed: Sequence[Parsed]) -> list[str]:
    names: list[str] = []
    for p in parsed:
        names += [n for n in p.fields if n not in names]
    return names


def select(parsers: Sequence[Parser]) -> Parser:
    """The first parser that fits the text gives all its fields."""

    def step(c: Column) -> Parsed:
        tried = [p(c) for p in parsers]
        fields = {}
        for name in _union_names(tried):
            value = F.lit(None)
            for p in reversed(tried):
                value = F.when(p.ok, p.fields.get(name, F.lit(None))).otherwise(value)
            fields[name] = value
        ok = F.lit(False)
        for p in tried:
            ok = ok | p.ok
        return Parsed(fields, ok, {k: v for p in tried for k, v in p.prepare.items()})

    return step


def chain(parsers: Sequence[Parser]) -> Parser:
    """All parsers on the same text; a later one overwrites an earlier one."""

    def step(c: Column) -> Parsed:
        tried = [p(c) for p in parsers]
        fields = {n: F.coalesce(*[p.fields[n] for p in reversed(tried) if n in p.fields]) for n in _union_names(tried)}
        ok = F.lit(True)
        for p in tried:
            ok = ok & p.ok
        return Parsed(fields, ok, {k: v for p in tried for k, v in p.prepare.items()})

    return step


# -- applying a parser --------------------------------------------------------------------

def parse(df: DataFrame, col: str, parser: Parser, keep_raw: bool = True) -> DataFrame:
    """Parsed fields next to the other columns; failures keep their text and get an `_error`."""
    parsed = parser(F.col(col))
    message = F.when(~parsed.ok, F.lit("no match for the parser"))
    if "_error" in df.columns:
        message = F.coalesce(F.col("_error"), message)
    fields = {n: F.when(parsed.ok, v) for n, v in parsed.fields.items()}
    others = [F.col(f"`{c}`") for c in df.columns if c not in fields and c not in (col, "_error", "_raw")]
    text = [F.col(col).alias("_raw")] if keep_raw else [F.when(~parsed.ok, F.col(col)).alias("_raw")]
    ready = df.withColumns(parsed.prepare) if parsed.prepare else df
    return ready.select(*others, *[v.alias(n) for n, v in fields.items()], *text, message.alias("_error"))


def split_good_bad(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows without and rows with an `_error`."""
    return df.where(F.col("_error").isNull()).drop("_error"), df.where(F.col("_error").isNotNull())


def reparse(field: str, parser: Parser, rules: Sequence[Rule] = ()) -> Rule:
    """Parse a column again. Keys that exist already become `field_key`; a lone `raw` replaces the field."""

    def step(df: DataFrame) -> DataFrame:
        if not has(df, field):
            return df
        parsed = parser(F.col(field))
        fields = {n: F.when(parsed.ok, v) for n, v in parsed.fields.items()}
        ready = df.withColumns(parsed.prepare) if parsed.prepare else df
        if list(fields) == ["raw"]:
            out = put(ready, field, F.coalesce(fields["raw"], F.col(field))).drop(*parsed.prepare)
            return apply_rules(out, rules)
        named = {(f"{field}_{n}" if n in df.columns and n != field else n): v for n, v in fields.items()}
        message = F.when(~parsed.ok & F.col(field).isNotNull(), F.lit(f"{field}: no match for the parser"))
        old = F.col("_error") if "_error" in df.columns else F.lit(None).cast("string")
        out = ready.withColumns({**named, "_error": F.coalesce(old, message)}).drop(*parsed.prepare)
        if field not in named:
            out = take_away(out, field)
        return apply_rules(out, rules)

    return step


# -- nested records --------------------------------------------------------------------------

def flatten(df: DataFrame) -> DataFrame:
    """Dotted leaf columns; every nested parent also stays as JSON text.

    Maps in a list are merged leaf by leaf, their values joined by `,`.
    """
    out: list[Column] = []

    def walk(col: Column, name: str, kind: T.DataType):
        if isinstance(kind, T.StructType):
            out.append(F.to_json(col).alias(name))
            for f in kind.fields:
                walk(col.getField(f.name), f"{name}.{f.name}", f.dataType)
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            out.append(F.to_json(col).alias(name))
            for f in kind.elementType.fields:
                texts = F.transform(col.getField(f.name), lambda x: x.cast("string"))
                out.append(F.array_join(texts, ",").alias(f"{name}.{f.name}"))
        elif isinstance(kind, (T.MapType, T.ArrayType)):
            out.append(F.to_json(col).alias(name))
        else:
            out.append(col.alias(name))

    for field in df.schema.fields:
        walk(F.col(f"`{field.name}`"), field.name, field.dataType)
    return df.select(*out)


def properties(df: DataFrame) -> DataFrame:
    """One row per leaf path: type, a sample value, share of rows that have one."""
    flat = []

    def walk(col: Column, name: str, kind: T.DataType):
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                walk(col.getField(f.name), f"{name}.{f.name}", f.dataType)
        else:
            flat.append((name, kind.simpleString(), col))

    for field in df.schema.fields:
        walk(F.col(f"`{field.name}`"), field.name, field.dataType)
    aggregates = [F.count(F.lit(1)).alias("_rows")]
    for i, (_, kind, col) in enumerate(flat):
        text = F.to_json(F.struct(col.alias("v"))) if kind.startswith(("array", "map")) else col.cast("string")
        aggregates += [F.count(col).alias(f"n{i}"), F.min(text).alias(f"s{i}")]
    one = df.agg(*aggregates)
    rows = F.array(*[
        F.struct(F.lit(name).alias("key"), F.lit(kind).alias("type"), F.col(f"s{i}").alias("sample"),
                 F.when(F.col("_rows") > 0, F.col(f"n{i}") / F.col("_rows")).alias("filled"))
        for i, (name, kind, _) in enumerate(flat)])
    return one.select(F.explode(rows).alias("p")).select("p.*")
