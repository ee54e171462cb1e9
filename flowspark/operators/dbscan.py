"""Density clustering on a grid, without pairing up the points of a dense place.

Cells have side eps / sqrt(d), so all points of one cell are neighbours. A cell with enough points
is dense: all its points are core and belong together, whatever their number. Only the few points
of sparse cells are compared with points around them. Whether two dense cells touch is settled by
comparing boxes of ever smaller sub-cells.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowspark.operators.graph import components
from flowspark.plans.scale import checkpoint, join_back, ordered, salted_join

MAX_DIMS = 4


def _distance2(a: str, b: str, dims: int) -> Column:
    total = F.lit(0.0)
    for i in range(dims):
        total = total + F.pow(F.col(f"{a}{i}") - F.col(f"{b}{i}"), 2)
    return total


def _box_near2(dims: int, a: str, b: str) -> Column:
    """Squared distance of two boxes."""
    total = F.lit(0.0)
    for i in range(dims):
        gap = F.greatest(F.lit(0.0), F.col(f"{b}lo{i}") - F.col(f"{a}hi{i}"), F.col(f"{a}lo{i}") - F.col(f"{b}hi{i}"))
        total = total + gap * gap
    return total


def _box_far2(dims: int, a: str, b: str) -> Column:
    """Squared largest distance between points of two boxes."""
    total = F.lit(0.0)
    for i in range(dims):
        span = F.greatest(F.abs(F.col(f"{b}hi{i}") - F.col(f"{a}lo{i}")), F.abs(F.col(f"{a}hi{i}") - F.col(f"{b}lo{i}")))
        total = total + span * span
    return total


def dbscan(df: DataFrame, fields: Sequence[str], eps: float, min_points: int, row_id: str | None = None,
           inclusive: bool = True, count_self: bool = True) -> DataFrame:
    """`df` with `label` (from 1, in the order of `row_id`, else of the values); noise rows are left out.

    Neighbours lie within `eps` (below it when not `inclusive`); a point counts itself unless
    `count_self` is off. Equal points count once. A border point takes the lowest core label near it.
    """
    dims = len(fields)
    if not 1 <= dims <= MAX_DIMS:
        raise ValueError(f"1 to {MAX_DIMS} fields; project wider vectors first")
    limit = eps * eps
    # a strict bound is met inside a cell only when the cell is a little smaller
    side = eps / math.sqrt(dims) * (1.0 if inclusive else 1.0 - 1e-9)
    need = min_points if count_self else min_points + 1

    def near(d2: Column) -> Column:
        return d2 <= limit if inclusive else d2 < limit

    first = F.min(row_id) if row_id else F.lit(0)
    points = df.select(*[F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(fields)],
                       *([F.col(row_id)] if row_id else []))
    points = points.groupBy(*[f"x{i}" for i in range(dims)]).agg(first.alias("_first"))
    cell = F.array(*[F.floor(F.col(f"x{i}") / side).cast("long") for i in range(dims)])
    points = checkpoint(points.withColumn("cell", cell))
    rows = points.count()
    sizes = points.groupBy("cell").agg(F.count(F.lit(1)).alias("size"))
    points = join_back(points, sizes, ["cell"])
    dense_cells = sizes.where(F.col("size") >= need).select("cell")
    sparse = points.where(F.col("size") < need)

    # neighbours of the sparse points: cells within reach, fixed offsets
    reach = math.ceil(math.sqrt(dims))
    offsets = list(itertools.product(range(-reach, reach + 1), repeat=dims))
    around = F.array(*[F.array(*[F.get("cell", F.lit(i)) + o[i] for i in range(dims)]) for o in offsets])
    probes = sparse.select(*[F.col(f"x{i}").alias(f"p{i}") for i in range(dims)], F.explode(around).alias("cell"))
    targets = points.select("cell", *[f"x{i}" for i in range(dims)])
    # a sparse cell has fewer than `need` points, so each target row meets a bounded number of probes
    pairs = salted_join(targets, probes, ["cell"], rows=rows).where(near(_distance2("p", "x", dims)))
    key = [f"p{i}" for i in range(dims)]
    # the join already pairs a point with itself
    counted = pairs.groupBy(*key).agg(F.count(F.lit(1)).alias("near"))
    core_sparse = counted.where(F.col("near") >= need).select(*key)
    core_sparse = checkpoint(core_sparse)

    # nodes: one per dense cell, one per sparse core point
    def node_of_cell(c: Column) -> Column:
        return F.concat(F.lit("c"), F.array_join(c.cast("array<string>"), ","))

    def node_of_point(prefix: str) -> Column:
        return F.concat(F.lit("p"), F.concat_ws(",", *[F.col(f"{prefix}{i}").cast("string") for i in range(dims)]))

    core = points.where(F.col("size") >= need).select("cell", "_first", *[f"x{i}" for i in range(dims)], node_of_cell(F.col("cell")).alias("node"))
    named = core_sparse.select(*[F.col(f"p{i}").alias(f"x{i}") for i in range(dims)], node_of_point("p").alias("node"))
    lone = sparse.join(named, [f"x{i}" for i in range(dims)]).select("cell", "_first", *[f"x{i}" for i in range(dims)], "node")
    cores = checkpoint(core.unionByName(lone))

    # edges between a sparse core point and any core point near it
    core_probes = sparse.join(named, [f"x{i}" for i in range(dims)]).select(
        *[F.col(f"x{i}").alias(f"p{i}") for i in range(dims)], F.explode(around).alias("cell"), F.col("node").alias("a"))
    touching = salted_join(cores, core_probes, ["cell"], rows=rows).where(near(_distance2("p", "x", dims)))
    edges = touching.select("a", F.col("node").alias("b")).distinct()
    edges = edges.unionByName(_dense_edges(points, dense_cells, dims, side, offsets, limit, inclusive, node_of_cell))
    edges = edges.unionByName(cores.select(F.col("node").alias("a"), F.col("node").alias("b")).distinct())
    clusters = components(edges)

    # labels: rank of the cluster's first point
    members = cores.join(clusters, "node").select("component", "_first", *[f"x{i}" for i in range(dims)])
    order = F.struct("_first", *[f"x{i}" for i in range(dims)])
    leaders = members.groupBy("component").agg(F.min(order).alias("_lead")).select("component", "_lead.*")
    ranked = ordered(leaders, [], ["_first", *[f"x{i}" for i in range(dims)]]).select("component", F.col("_pos").cast("int").alias("label"))
    labelled = members.join(ranked, "component").select(*[f"x{i}" for i in range(dims)], "label")

    # border points: sparse, not core, near a core point
    labelled_cells = cores.join(clusters, "node").join(ranked, "component").select("cell", "label", *[f"x{i}" for i in range(dims)])
    border_probes = sparse.join(named, [f"x{i}" for i in range(dims)], "left_anti").select(
        *[F.col(f"x{i}").alias(f"p{i}") for i in range(dims)], F.explode(around).alias("cell"))
    border = salted_join(labelled_cells, border_probes, ["cell"], rows=rows).where(near(_distance2("p", "x", dims)))
    border = border.groupBy(*key).agg(F.min("label").alias("label")).select(*[F.col(f"p{i}").alias(f"x{i}") for i in range(dims)], "label")
    answer = labelled.unionByName(border)
    rows = df.withColumns({f"_x{i}": F.col(f).cast("double") for i, f in enumerate(fields)})
    return salted_join(rows, answer.select(*[F.col(f"x{i}").alias(f"_x{i}") for i in range(dims)], "label"),
                       [f"_x{i}" for i in range(dims)]).drop(*[f"_x{i}" for i in range(dims)])


def _dense_edges(points, dense_cells, dims, side, offsets, limit, inclusive, node_of_cell) -> DataFrame:
    """Pairs of dense cells with two points within reach, by box refinement.

    A pair of boxes farther apart than eps is dropped, one whose farthest points are within eps
    joins its cells; the others are split. Boxes are tight around their points, so single points
    end the search.
    """
    inside = points.join(dense_cells, "cell")

    def boxes(level: int) -> DataFrame:
        scale = 2 ** level
        sub = F.array(*[F.floor(F.col(f"x{i}") / side * scale).cast("long") for i in range(dims)])
        ends = [f(F.col(f"x{i}")).alias(f"{n}{i}") for n, f in (("lo", F.min), ("hi", F.max)) for i in range(dims)]
        return inside.groupBy("cell", sub.alias("sub")).agg(*ends)

    def named(df: DataFrame, p: str) -> DataFrame:
        return df.select(*[F.col(c).alias(p + c) for c in df.columns])

    upper = [o for o in offsets if o > tuple([0] * dims)]
    level = 0
    base = boxes(0)
    a = named(base, "a_").withColumn("b_cell", F.explode(F.array(*[
        F.array(*[F.get("a_cell", F.lit(i)) + o[i] for i in range(dims)]) for o in upper])))
    open_pairs = a.join(named(base, "b_"), "b_cell")
    found = None
    while True:
        close = _box_near2(dims, "a_", "b_")
        far = _box_far2(dims, "a_", "b_")
        alive = open_pairs.where(close <= limit if inclusive else close < limit)
        alive = checkpoint(alive.withColumn("_sure", far <= limit if inclusive else far < limit)
                           .select("a_cell", "b_cell", "a_sub", "b_sub", "_sure"))
        sure = alive.where("_sure").select("a_cell", "b_cell").distinct()
        found = sure if found is None else found.unionByName(sure)
        rest = alive.where("NOT _sure").join(sure, ["a_cell", "b_cell"], "left_anti").drop("_sure")
        if rest.isEmpty():
            break
        level += 1
        if level > 60:
            raise RuntimeError("box refinement did not end")
        finer = boxes(level).withColumn("up", F.transform("sub", lambda s: F.floor(s / 2).cast("long")))
        left = named(finer, "a_").withColumnRenamed("a_sub", "a_new").withColumnRenamed("a_up", "a_sub")
        right = named(finer, "b_").withColumnRenamed("b_sub", "b_new").withColumnRenamed("b_up", "b_sub")
        open_pairs = rest.join(left, ["a_cell", "a_sub"]).join(right, ["b_cell", "b_sub"]).drop("a_sub", "b_sub") \
            .withColumnRenamed("a_new", "a_sub").withColumnRenamed("b_new", "b_sub")
    return found.select(node_of_cell(F.col("a_cell")).alias("a"), node_of_cell(F.col("b_cell")).alias("b"))
