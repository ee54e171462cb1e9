"""Hidden Markov models over event sequences, in two levels: blocks of a sequence, then its chain of blocks.

A sequence is cut into blocks. For each block one small state-by-state matrix says how it carries
scores (or probabilities) from its start to its end; a pass over these matrices fixes the messages
at the block borders; then every block is solved alone. The result equals the one-pass algorithm,
but no task holds more than a block and a list of small matrices.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.plans.scale import lags, ordered

BLOCK = 50_000


@dataclass
class Hmm:
    initial: np.ndarray
    transition: np.ndarray
    emission: np.ndarray


def frequencies(df: DataFrame, keys: Sequence[str], order: str, state: str, symbol: str) -> DataFrame:
    """Supervised estimate as rows `(kind, a, b, p)`: i = initial state a, t = from a to b, e = a shows b."""
    placed = lags(ordered(df.select(*keys, order, state, symbol), keys, [order]), keys, {"_prev": (state, 1)})
    text = {c: F.col(c).cast("string") for c in (state, symbol, "_prev")}
    events = F.array(
        F.when(F.col("_pos") == 1, F.struct(F.lit("i").alias("kind"), F.lit("").alias("a"), text[state].alias("b"))),
        F.when(F.col("_pos") > 1, F.struct(F.lit("t").alias("kind"), text["_prev"].alias("a"), text[state].alias("b"))),
        F.struct(F.lit("e").alias("kind"), text[state].alias("a"), text[symbol].alias("b")))
    counts = placed.select(F.explode(events).alias("r")).where("r IS NOT NULL").select("r.*").groupBy("kind", "a", "b").count()
    totals = counts.groupBy("kind", "a").agg(F.sum("count").alias("all"))
    return counts.join(totals, ["kind", "a"]).select("kind", "a", "b", (F.col("count") / F.col("all")).alias("p"))


def to_model(rows: DataFrame, states: Sequence[str], symbols: Sequence[str]) -> Hmm:
    """The rows of `frequencies` as matrices (states and symbols are short lists)."""
    s, o = {v: i for i, v in enumerate(states)}, {v: i for i, v in enumerate(symbols)}
    model = Hmm(np.zeros(len(s)), np.zeros((len(s), len(s))), np.zeros((len(s), len(o))))
    for r in rows.collect():
        if r["kind"] == "i":
            model.initial[s[r["b"]]] = r["p"]
        elif r["kind"] == "t":
            model.transition[s[r["a"]], s[r["b"]]] = r["p"]
        else:
            model.emission[s[r["a"]], o[r["b"]]] = r["p"]
    return model


def blocks(df: DataFrame, keys: Sequence[str], order: str, symbol: str, size: int = BLOCK) -> DataFrame:
    """`(keys, block, symbols, n_blocks)`: symbol numbers of each block in order."""
    placed = ordered(df.select(*keys, order, F.col(symbol).cast("int").alias("_o")), keys, [order])
    placed = placed.withColumn("block", F.floor((F.col("_pos") - 1) / size)).withColumn("n_blocks", F.ceil(F.col("_n") / size))
    packed = placed.groupBy(*keys, "block", "n_blocks").agg(F.array_sort(F.collect_list(F.struct("_pos", "_o"))).alias("_s"))
    return packed.select(*keys, "block", "n_blocks", F.transform("_s", lambda x: x.getField("_o")).alias("symbols"))


def _kinds(df: DataFrame, keys: Sequence[str]) -> str:
    return ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)


def viterbi(packed: DataFrame, keys: Sequence[str], model: Hmm) -> DataFrame:
    """`(keys, block, states)`: the most likely state numbers; `packed` comes from `blocks`."""
    names, kinds = list(keys), _kinds(packed, keys)
    with np.errstate(divide="ignore"):
        start, step, shows = np.log(model.initial), np.log(model.transition), np.log(model.emission)
    k = len(start)

    def best_ends(symbols, first):
        """Best score from each entry state (or from the start) to each end state."""
        if first:
            score = np.full((k, k), -np.inf)
            score[0] = start + shows[:, symbols[0]]
            rest = symbols[1:]
        else:
            score, rest = np.full((k, k), -np.inf), symbols
            np.fill_diagonal(score, 0.0)
        for o in rest:
            score = (score[:, :, None] + step[None]).max(axis=1) + shows[:, o]
        return score

    def matrices(frames):
        for frame in frames:
            out = frame[[*names, "block"]].copy()
            out["m"] = [best_ends(s, b == 0).ravel().tolist() for s, b in zip(frame["symbols"], frame["block"])]
            yield out

    small = packed.mapInPandas(matrices, f"{kinds}, block long, m array<double>")

    def borders(frame):
        frame = frame.sort_values("block")
        ms = [np.array(m).reshape(k, k) for m in frame["m"]]
        score, back = ms[0][0], []
        for m in ms[1:]:
            total = score[:, None] + m
            back.append(total.argmax(axis=0))
            score = total.max(axis=0)
        ends = [int(score.argmax())]
        for b in reversed(back):
            ends.append(int(b[ends[-1]]))
        ends.reverse()
        out = frame[[*names, "block"]].copy()
        out["enter"] = np.array([-1, *ends[:-1]], dtype="int32")
        out["leave"] = np.array(ends, dtype="int32")
        return out

    fixed = small.groupBy(*names).applyInPandas(borders, f"{kinds}, block long, enter int, leave int")

    def solve(frames):
        for frame in frames:
            paths = []
            for symbols, enter, leave in zip(frame["symbols"], frame["enter"], frame["leave"]):
                back = []
                if enter < 0:
                    score, rest = start + shows[:, symbols[0]], symbols[1:]
                else:
                    score, rest = step[enter] + shows[:, symbols[0]], symbols[1:]
                for o in rest:
                    total = score[:, None] + step
                    back.append(total.argmax(axis=0))
                    score = total.max(axis=0) + shows[:, o]
                path = [int(leave)]
                for b in reversed(back):
                    path.append(int(b[path[-1]]))
                paths.append(path[::-1])
            out = frame[[*names, "block"]].copy()
            out["states"] = paths
            yield out

    both = packed.join(fixed, [*names, "block"])
    return both.mapInPandas(solve, f"{kinds}, block long, states array<int>")


def baum_welch(packed: DataFrame, keys: Sequence[str], model: Hmm, iterations: int) -> Hmm:
    """Expectation-maximisation: expected counts per block, summed by Spark, `iterations` times."""
    names, kinds = list(keys), _kinds(packed, keys)
    k, v = model.emission.shape
    for _ in range(iterations):
        start, step, shows = model.initial, model.transition, model.emission

        def matrices(frames, start=start, step=step, shows=shows):
            for frame in frames:
                out = frame[[*names, "block"]].copy()
                packed_m = []
                for symbols, block in zip(frame["symbols"], frame["block"]):
                    m = np.diag(start * shows[:, symbols[0]]) if block == 0 else np.eye(k)
                    for o in symbols[1:] if block == 0 else symbols:
                        m = (m @ step) * shows[:, o]
                        m = m / max(m.sum(), 1e-300)
                    packed_m.append(m.ravel().tolist())
                out["m"] = packed_m
                yield out

        small = packed.mapInPandas(matrices, f"{kinds}, block long, m array<double>")

        def borders(frame):
            frame = frame.sort_values("block")
            ms = [np.array(m).reshape(k, k) for m in frame["m"]]
            forward, entering = np.ones(k), []
            for m in ms:
                entering.append(forward.tolist())
                forward = forward @ m
                forward = forward / max(forward.sum(), 1e-300)
            backward, leaving = np.ones(k), []
            for m in reversed(ms):
                leaving.append(backward.tolist())
                backward = m @ backward
                backward = backward / max(backward.sum(), 1e-300)
            out = frame[[*names, "block"]].copy()
            out["enter"], out["leave"] = entering, leaving[::-1]
            return out

        fixed = small.groupBy(*names).applyInPandas(borders, f"{kinds}, block long, enter array<double>, leave array<double>")

        def expect(frames, start=start, step=step, shows=shows):
            import pandas as pd

            first, moves, seen = np.zeros(k), np.zeros((k, k)), np.zeros((k, v))
            for frame in frames:
                for symbols, block, enter, leave in zip(frame["symbols"], frame["block"], frame["enter"], frame["leave"]):
                    n = len(symbols)
                    alpha = np.zeros((n, k))
                    before = np.array(enter)
                    head = start * shows[:, symbols[0]] if block == 0 else (before @ step) * shows[:, symbols[0]]
                    alpha[0] = head / max(head.sum(), 1e-300)
                    for t in range(1, n):
                        a = (alpha[t - 1] @ step) * shows[:, symbols[t]]
                        alpha[t] = a / max(a.sum(), 1e-300)
                    beta = np.array(leave, dtype=float)
                    for t in range(n - 1, -1, -1):
                        gamma = alpha[t] * beta
                        gamma = gamma / max(gamma.sum(), 1e-300)
                        seen[:, symbols[t]] += gamma
                        if block == 0 and t == 0:
                            first += gamma
                            break
                        previous = alpha[t - 1] if t else before / max(before.sum(), 1e-300)
                        xi = previous[:, None] * step * (shows[:, symbols[t]] * beta)[None]
                        moves += xi / max(xi.sum(), 1e-300)
                        beta = step @ (shows[:, symbols[t]] * beta)
                        beta = beta / max(beta.sum(), 1e-300)
            cells = np.r_[first, moves.ravel(), seen.ravel()]
            yield pd.DataFrame({"i": np.arange(len(cells), dtype="int32"), "v": cells})

        counts = packed.join(fixed, [*names, "block"]).mapInPandas(expect, "i int, v double").groupBy("i").agg(F.sum("v").alias("v"))
        flat = np.zeros(k + k * k + k * v)
        for r in counts.collect():
            flat[r["i"]] = r["v"]
        first, moves, seen = flat[:k], flat[k:k + k * k].reshape(k, k), flat[k + k * k:].reshape(k, v)

        def shares(m):
            return m / np.maximum(m.sum(axis=-1, keepdims=True), 1e-300)

        model = Hmm(shares(first), shares(moves), shares(seen))
    return model
