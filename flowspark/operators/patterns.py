"""Log pattern mining to a fixpoint, by a prefix-filter similarity join of templates, and matching lines with patterns.

A template is a list of tokens, of parameters (masked numbers) and of skips, where tokens of some lines were left out.
Two templates merge into their longest common subsequence when it holds at least `min_matched` of the tokens of the
longest line that either stands for. So a template always covers that share of each of its lines, however often it was
merged, and the answer is a fixpoint: no two templates that are left can merge.

* Candidates: with tokens ordered by their frequency over all templates, two that can merge share one of the rarest
  `weight - need + 1` tokens of each (`prefix`). These are buckets; a pair is met in one bucket only, and only if lengths
  and bitmaps of both token sets allow the agreement (exact bounds).
* Stars: in each bucket members meet its leaders, the largest template and an even share of the others, not each other.
  When a round merges nothing, leaders are `GROWTH` times as many; the last round has all members of all buckets as
  leaders and finds nothing, which proves the fixpoint.
* Each template follows the highest-ranking centre it can merge with, unless that centre follows another itself. A
  centre's followers are folded task by task and the partial results once more, so a family with a third of all lines
  costs one row per task in one place.

Only distinct masked lines with their counts are ever compared. Tables of a round replace those of the round before.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowspark.functions.text import log_tokens
from flowspark.plans.scale import WorkTables, lookup_join

GAP = "\u0000"      # a parameter inside a template
JOIN = "\u0001"     # between the tokens of a template
SKIP = "\u0002"     # tokens left out between common ones, while templates are merged
LEADERS, GROWTH = 1, 16
BITS = 256

STATE = "id long, n long, size int, tokens array<string>, freqs array<long>"
INDEXED = STATE + ", weight int, prefix array<long>, bits array<long>"


# -- common subsequences ------------------------------------------------------------------

def lcs(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Positions of a longest common subsequence of two token lists.

    A row of the length table is the bits of one integer: bit j is 0 where the length grows at column j.
    """
    masks: dict[str, int] = {}
    for j, token in enumerate(b):
        masks[token] = masks.get(token, 0) | 1 << j
    full = (1 << len(b)) - 1
    rows = [full]
    for token in a:
        row = rows[-1]
        met = row & masks.get(token, 0)
        rows.append((row + met | row - met) & full)
    out, i, j = [], len(a), len(b)
    while i and j:
        if rows[i] >> (j - 1) & 1:
            j -= 1
        elif not rows[i - 1] >> (j - 1) & 1:
            i -= 1
        else:
            i, j = i - 1, j - 1
            out.append((i, j))
    return out[::-1]


def need(ratio: float, size: int) -> int:
    """Tokens that a template of lines of at most `size` tokens has to keep."""
    return max(1, math.ceil(ratio * size - 1e-9))


def _plain(tokens: list[str]) -> tuple[list[str], list[bool]]:
    """Tokens without skips, and for each place (the end too) whether a skip stands before it."""
    out, skips, skip = [], [], False
    for token in tokens:
        if token == SKIP:
            skip = True
        else:
            out.append(token)
            skips.append(skip)
            skip = False
    return out, [*skips, skip]


def merged(a: list[str], b: list[str], least: int) -> list[str] | None:
    """The common template of two, or None when it has fewer than `least` tokens or no text."""
    (x, skips_x), (y, skips_y) = _plain(a), _plain(b)
    common = lcs(x, y)
    if len(common) < least or not any(x[p] != GAP and x[p].strip() for p, _ in common):
        return None
    out, i, j = [], 0, 0
    for p, q in [*common, (len(x), len(y))]:
        if p > i or q > j or any(skips_x[i:p + 1]) or any(skips_y[j:q + 1]):
            out.append(SKIP)
        out += x[p:p + 1]
        i, j = p + 1, q + 1
    return out


def merge_templates(a: list[str], b: list[str], min_matched: float) -> list[str] | None:
    """The common template of two lines' tokens, or None when it covers too little of either."""
    out = merged(a, b, need(min_matched, max(len(a), len(b))))
    return None if out is None else _shown(out)


def _shown(tokens: list[str]) -> list[str]:
    """Tokens with each stretch of parameters and skips as one parameter."""
    out: list[str] = []
    for token in tokens:
        token = GAP if token == SKIP else token
        if token != GAP or not out or out[-1] != GAP:
            out.append(token)
    return out


# -- the index ------------------------------------------------------------------------------

def _index(df: DataFrame, ratio: float) -> DataFrame:
    """`STATE` with the number of tokens, the hashes of the rarest ones and a bitmap of all."""

    def one(tokens: list[str], freqs: list[int], size: int) -> tuple[int, list[int], list[int]]:
        seen: Counter[str] = Counter()
        elements = []
        for token, freq in zip(tokens, freqs):
            if token != SKIP:
                seen[token] += 1
                elements.append((freq, token, seen[token]))
        elements.sort()
        codes = [zlib.crc32(f"{k} {token}".encode()) << 32 | zlib.adler32(token.encode()) for _, token, k in elements]
        bitmap = 0
        for code in codes:
            bitmap |= 1 << (code >> 32) % BITS
        longs = [int.from_bytes((bitmap >> at & (1 << 64) - 1).to_bytes(8, "little"), "little", signed=True) for at in range(0, BITS, 64)]
        return len(elements), [c - (1 << 63) for c in codes[:max(1, len(elements) - need(ratio, size) + 1)]], longs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [one(*row) for row in zip(*(batch.column(c).to_pylist() for c in ("tokens", "freqs", "size")))]
            yield pa.RecordBatch.from_arrays([
                *batch.columns, pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.list_(pa.int64())),
                pa.array([f[2] for f in found], pa.list_(pa.int64()))], names=[*batch.schema.names, "weight", "prefix", "bits"])

    return df.mapInArrow(run, INDEXED)


def _rank(prefix: str = "") -> Column:
    """Larger templates first."""
    return F.struct((-F.col(f"{prefix}n")).alias("down"), F.col(f"{prefix}id").alias("id"))


def _placed(state: DataFrame, most: int) -> DataFrame:
    """Members of buckets with two members or more, and whether they lead there."""
    entries = state.select("id", "n", "size", "weight", "bits", "prefix", F.explode("prefix").alias("bucket"))
    buckets = entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("members"), F.min(_rank()).alias("top")).where("members > 1")
    share = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1 << 30)) * F.col("members") < F.lit(most << 30)
    return entries.join(buckets, "bucket").withColumn("leads", (F.col("top.id") == F.col("id")) | share).drop("top")


def _candidates(placed: DataFrame, ratio: float) -> DataFrame:
    """`(follower, centre)` of members and leaders that may agree enough."""
    centre = placed.where("leads").select("bucket", *[F.col(c).alias(f"c_{c}") for c in ("id", "n", "size", "weight", "bits", "prefix")])
    least = F.greatest(F.lit(1), F.ceil(F.lit(ratio) * F.greatest("size", "c_size") - F.lit(1e-9)))

    def outside(a: str, b: str) -> Column:
        """Tokens of one that surely aren't in the other."""
        total = F.lit(0)
        for k in range(BITS // 64):
            total = total + F.bit_count(F.col(a)[k].bitwiseAND(F.bitwise_not(F.col(b)[k])))
        return total

    once = ~F.col("leads") | (_rank("c_") < _rank())
    allowed = (F.col("weight") - outside("bits", "c_bits") >= least) & (F.col("c_weight") - outside("c_bits", "bits") >= least)
    met = placed.join(centre, "bucket").where((F.col("id") != F.col("c_id")) & once & allowed
                                              & (F.array_min(F.array_intersect("prefix", "c_prefix")) == F.col("bucket")))
    first = F.least(_rank(), _rank("c_"))["id"]
    return met.select(F.when(first == F.col("id"), F.col("c_id")).otherwise(F.col("id")).alias("follower"), first.alias("centre"))


def _with_tokens(pairs: DataFrame, state: DataFrame) -> DataFrame:
    own = state.select(F.col("id").alias("follower"), "n", "size", "tokens", "freqs")
    other = state.select(F.col("id").alias("centre"), F.col("n").alias("c_n"), F.col("size").alias("c_size"),
                         F.col("tokens").alias("c_tokens"), F.col("freqs").alias("c_freqs"))
    return pairs.join(own, "follower").join(other, "centre")


def _verified(pairs: DataFrame, state: DataFrame, ratio: float) -> DataFrame:
    """`(follower, centre, c_n)` of the pairs that can merge."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("tokens", "size", "c_tokens", "c_size")))
            good = pa.array([merged(c, t, need(ratio, max(s, k))) is not None for t, s, c, k in rows], pa.bool_())
            yield batch.select(["follower", "centre", "c_n"]).filter(good)

    return _with_tokens(pairs, state).mapInArrow(run, "follower long, centre long, c_n long")


PARTS = "whole boolean, centre long, c_n long, n long, size int, tokens array<string>, freqs array<long>"


def _folded(rows: DataFrame, ratio: float, from_parts: bool) -> DataFrame:
    """Followers, or partial results, of a centre merged one after the other; what no longer fits stays as it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: dict | None = None
        for batch in batches:
            done: list[dict] = []
            for row in batch.to_pylist():
                if current is None or current["centre"] != row["centre"]:
                    if current is not None:
                        done.append(current)
                    if from_parts:
                        current = {**row, "n": row["n"] + row["c_n"], "whole": True}
                        continue
                    current = {"whole": True, "centre": row["centre"], "c_n": row["c_n"], "n": 0, "size": row["c_size"],
                               "tokens": row["c_tokens"], "freqs": row["c_freqs"]}
                size = max(current["size"], row["size"])
                both = merged(current["tokens"], row["tokens"], need(ratio, size))
                if both is None:
                    done.append({k: row[k] for k in ("centre", "c_n", "n", "size", "tokens", "freqs")} | {"whole": False})
                else:
                    known = dict(zip(current["tokens"], current["freqs"]))
                    current.update(n=current["n"] + row["n"], size=size, tokens=both, freqs=[known.get(t, 0) for t in both])
            yield pa.RecordBatch.from_pylist([{k: d[k] for k in SHAPE.names} for d in done], SHAPE)
        if current is not None:
            yield pa.RecordBatch.from_pylist([{k: current[k] for k in SHAPE.names}], SHAPE)

    return rows.mapInArrow(run, PARTS)


SHAPE = pa.schema([("whole", pa.bool_()), ("centre", pa.int64()), ("c_n", pa.int64()), ("n", pa.int64()), ("size", pa.int32()),
                   ("tokens", pa.list_(pa.string())), ("freqs", pa.list_(pa.int64()))])


def _distinct(df: DataFrame) -> DataFrame:
    """One row for each list of tokens."""
    keyed = df.withColumn("id", F.xxhash64("tokens"))
    return keyed.groupBy("id").agg(F.sum("n").alias("n"), F.max("size").alias("size"), F.first("tokens").alias("tokens"),
                                   F.first("freqs").alias("freqs"))


def _first_state(lines: DataFrame, work: WorkTables) -> DataFrame:
    """Distinct masked lines with their counts, tokens beside the number of templates that hold them."""
    masked = F.transform("tokens", lambda t: F.when(t.rlike("^(?:[0-9]+|[\\x00-\\x02])$"), F.lit(GAP)).otherwise(t))
    counted = lines.select(log_tokens("line").alias("tokens")).select(masked.alias("tokens")).groupBy("tokens").agg(F.count(F.lit(1)).alias("n"))
    plain = work.put("lines", counted.withColumn("id", F.xxhash64("tokens")))
    freqs = plain.select(F.explode(F.array_distinct("tokens")).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("freq"))
    placed = plain.select("id", F.posexplode("tokens").alias("pos", "token"))
    told = lookup_join(placed, work.put("freqs", freqs), ["token"], "inner").groupBy("id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "freq"))), lambda x: x["freq"]).alias("freqs"))
    return plain.join(told, "id").select("id", "n", F.size("tokens").alias("size"), "tokens", "freqs")


def mined(lines: DataFrame, min_matched: float, leaders: int = LEADERS) -> DataFrame:
    """`(n, size, tokens)` of the templates of `lines (line)` at the fixpoint; `leaders` decides only how soon it comes."""
    work = WorkTables(lines.sparkSession, "patterns")
    state = work.put("state", _index(_first_state(lines, work), min_matched))
    work.drop("lines", "freqs")
    most = leaders
    while True:
        placed = work.put("placed", _placed(state, most))
        biggest = placed.agg(F.max("members")).first()[0] or 0
        if not biggest:
            break
        met = work.put("met", _verified(_candidates(placed, min_matched), state, min_matched))
        if met.isEmpty():
            if most >= biggest:
                break
            most *= GROWTH
            continue
        best = met.groupBy("follower").agg(F.min(F.struct((-F.col("c_n")).alias("down"), F.col("centre").alias("id")))["id"].alias("centre"))
        best = work.put("best", best)
        moves = work.put("moves", best.join(best.select(F.col("follower").alias("centre")), "centre", "left_anti"))
        rows = _with_tokens(moves, state).sortWithinPartitions("centre", "follower")
        parts = work.put("parts", _folded(rows, min_matched, False))
        whole = parts.where("whole").withColumn("place", F.xxhash64("tokens", "n")).repartition("centre").sortWithinPartitions("centre", "place")
        new = _folded(whole.drop("place"), min_matched, True).unionByName(parts.where("NOT whole"))
        gone = moves.select(F.col("follower").alias("id")).union(moves.select("centre")).distinct()
        kept = state.join(gone, "id", "left_anti").select("n", "size", "tokens", "freqs")
        state = work.put("state", _index(_distinct(kept.unionByName(new.select("n", "size", "tokens", "freqs"))).select(
            "id", "n", "size", "tokens", "freqs"), min_matched))
    work.drop("placed", "met", "best", "moves", "parts")
    return state.select("n", "size", "tokens")


def mine_patterns(df: DataFrame, text: str, min_matched: float = 0.7) -> DataFrame:
    """Log templates with their shares: cluster_total, cluster_scale, pattern, pattern_key, pattern_size, pattern_scale, lcs."""
    lines = df.select(F.trim(text).alias("line")).where("line <> ''")
    found = mined(lines, min_matched)
    total = found.agg(F.sum("n").alias("t")).first()["t"] or 0
    shown = T.StructType.fromDDL("n long, template string")

    def show(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([JOIN.join(_shown(t)) for t in batch.column(1).to_pylist()], pa.string())],
                                             names=shown.names)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = [describe_template(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array([t[k] for t in told], pa.string()) for k in range(3)]],
                                             names=[*shown.names, "pattern", "pattern_key", "lcs"])

    table = found.select("n", "tokens").mapInArrow(show, shown).groupBy("template").agg(F.sum("n").alias("n")).select("n", "template")
    told = table.mapInArrow(describe, "n long, template string, pattern string, pattern_key string, lcs string")
    return told.select(F.lit(total).alias("cluster_total"), F.lit(1.0).alias("cluster_scale"), "pattern", "pattern_key",
                       F.col("n").alias("pattern_size"), (F.col("n") / F.lit(total)).alias("pattern_scale"), "lcs", "template")


def describe_template(template: str) -> tuple[str, str, str]:
    """Elements as JSON, key with `*` for parameters, the fixed texts."""
    elements, number = [], 0
    for token in template.split(JOIN):
        if token == GAP:
            elements.append({"param": str(number)})
            number += 1
        elif elements and "text" in elements[-1]:
            elements[-1]["text"] += token
        else:
            elements.append({"text": token})
    texts = [e["text"] for e in elements if "text" in e]
    key = "".join(e["text"].strip() if "text" in e else "*" for e in elements)
    return json.dumps(elements, ensure_ascii=False), key, ",".join(texts)


# -- matching ---------------------------------------------------------------------------------

class PatternIndex:
    """Patterns filed by their distinct texts, the rarest first: a text that most patterns share comes last in the tree, so a
    line only walks the branches whose texts it holds."""

    def __init__(self, rows: list[tuple[str, str, int]]):
        known = [(_texts(template), key, weight) for template, key, weight in rows]
        freq: Counter[str] = Counter()
        for texts, _, weight in known:
            for text in set(texts):
                freq[text] += weight
        self.root: dict = {}
        for texts, key, _ in known:
            node = self.root
            for text in sorted(set(texts), key=lambda t: (freq[t], t)):
                node = node.setdefault(text, {})
            if texts:
                node.setdefault(None, []).append((-len(texts), key, texts))

    def best(self, tokens: list[str], found: tuple[int, str] | None = None) -> tuple[int, str] | None:
        """`(-texts, key)` of the longest pattern whose texts occur in order, the smallest key of equals; `found` is one known
        already."""
        have = set(tokens)
        nodes = [self.root]
        while nodes:
            node = nodes.pop()
            for down, key, texts in node.get(None, ()):
                if found is None or (down, key) < found:
                    rest = iter(tokens)
                    if all(text in rest for text in texts):
                        found = (down, key)
            small, large = (node, have) if len(node) < len(have) else (have, node)
            nodes += [node[text] for text in small if text is not None and text in large]
        return found


_TOKEN = re.compile("[0-9A-Za-z]+|[^\x00-\x7f]+|[\x00-\x7f]")
MODEL_BYTES = 16 * 1024 * 1024


def match_patterns(df: DataFrame, text: str, patterns: DataFrame, model_bytes: int = MODEL_BYTES) -> DataFrame:
    """`isMatch` and `patternKey` of the longest pattern whose tokens occur in order in the line.

    The model goes to the lines in blocks of about `model_bytes`, dealt by a hash, so a model of any size fits; a line that
    meets a second block brings its best pattern so far along. Lines are never shuffled, whatever token they share.
    """
    weight = F.col("pattern_size") if "pattern_size" in patterns.columns else F.lit(1)
    model = patterns.select("template", "pattern_key", weight.cast("long").alias("weight"))
    size = model.agg(F.sum(F.octet_length("template") + F.octet_length("pattern_key") + 64)).first()[0] or 0
    blocks = max(1, math.ceil(size / model_bytes))
    spark = df.sparkSession
    work = WorkTables(spark, "matches")
    at = len(df.columns)
    out = T.StructType([*df.schema.fields, T.StructField("_line", T.StringType()), T.StructField("_down", T.IntegerType()),
                        T.StructField("patternKey", T.StringType())])
    rows = df.select("*", F.trim(text).alias("_line"), F.lit(None).cast("int").alias("_down"), F.lit(None).cast("string").alias("patternKey"))
    for block in range(blocks):
        own = model.where(F.pmod(F.xxhash64("template", "pattern_key"), F.lit(blocks)) == block)
        index = spark.sparkContext.broadcast(PatternIndex([tuple(r) for r in own.collect()]))  # one block, about `model_bytes`

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                best = [found if line is None else index.value.best(_TOKEN.findall(line), found) for line, found in zip(
                    batch.column(at).to_pylist(), [None if d is None else (d, k) for d, k in zip(
                        batch.column(at + 1).to_pylist(), batch.column(at + 2).to_pylist())])]
                yield pa.RecordBatch.from_arrays([
                    *batch.columns[:at + 1], pa.array([b and b[0] for b in best], pa.int32()), pa.array([b and b[1] for b in best], pa.string())],
                    names=out.names)

        rows = rows.mapInArrow(run, out)
        if block + 1 < blocks:
            rows = work.put("lines", rows)
    return rows.withColumn("isMatch", F.col("patternKey").isNotNull()).drop("_line", "_down")


def _texts(template: str) -> list[str]:
    return [t for t in template.split(JOIN) if t not in (GAP, "")]
