"""Operator 5, sharding by a k-d tree over document metadata (DataFrame functions only).

The tree splits a node of k shards into k/2 and the rest at the distributed
weighted quantile of the dimension that is widest in it (widths are relative
to the whole table), until each leaf holds one shard's share of the bytes. A
quantile is found by refining histograms of all nodes of a level at once; only
a bin per node reaches the driver. Ties are split by a hash, so a metadata
value that holds a third of all rows is no obstacle.

Equal texts are one unit and stay in one shard; only a group that is larger than
a shard is cut, into its ids, and an id repeated in it for a large part of a
shard into its rows. A unit above 1/UNIT_SHARE of a shard (there are few) would
upset the medians: such units are dealt first, the largest to the emptiest shard,
and the tree splits all others by what room that leaves on either side. Law:
``bytes``, the shards' sizes are near equal.

Defined cases: a null text has no bytes (its size is the fixed overhead) and
is a text equal to other nulls; null metadata counts as a value of its own;
repeated rows are separate rows; an empty table gives an empty
result; with fewer units than shards some shards stay empty; other columns are
ignored.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carthouse.llm.common import join_by_class, numbered, stage

#: Bytes added to every document's text.
OVERHEAD = 16
#: Units above this part of a shard are dealt one by one; there are less than this many times the shards.
UNIT_SHARE = 16
#: Histogram bins per node and refinement; a bin below this part of a shard is not refined.
BINS = 4096
FINE = 1000
#: Dimensions are scaled to this many values.
SCALE = 1 << 30


def category(c: Column) -> Column:
    """A text value as a number below SCALE; null is 0."""
    return F.coalesce(F.shiftright(F.crc32(c.cast("string").cast("binary")), 2), F.lit(0))


def _units(df: DataFrame, id_col: str, text_col: str, dims: dict[str, Column], shards: int):
    text = F.col(text_col)
    rows = df.select(F.col(id_col).alias("id"),
                     (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
                     F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).alias("crc"),
                     F.xxhash64(text, F.octet_length(text)).alias("g"),
                     *[F.coalesce(c.cast("double"), F.lit(0.0)).alias(f"d{i}") for i, c in enumerate(dims.values())])
    rows = stage(rows, "shard-rows")
    n = len(dims)
    whole = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("w"),
                     *[f(f"d{i}").alias(f"{k}{i}") for i in range(n) for k, f in (("lo", F.min), ("hi", F.max))]).first()
    if not whole["n"]:
        return rows, None, whole
    groups = rows.groupBy("g").agg(F.sum("size").alias("w"))
    # Fewer groups than shards do not fit one.
    large = groups.where(F.col("w") * shards > whole["w"]).select("g", F.lit(True).alias("large"))
    flagged = rows.join(F.broadcast(large), "g", "left")
    # Of those, ids repeated for a large part of a shard: fewer than UNIT_SHARE * shards.
    often = flagged.where("large").groupBy("g", "id").agg(F.sum("size").alias("w")).where(
        F.col("w") * UNIT_SHARE * shards > whole["w"]).select(F.col("g").alias("often_g"), F.col("id").alias("often_id"))
    flagged = flagged.join(F.broadcast(often), (F.col("g") == F.col("often_g")) & F.col("id").eqNullSafe(F.col("often_id")), "left")
    each = F.when(F.col("often_g").isNotNull(), F.xxhash64("g", "id", F.monotonically_increasing_id())).otherwise(
        F.xxhash64("g", "id"))
    rows = flagged.withColumn("u", F.when(F.col("large"), each).otherwise(F.col("g")))
    scaled = [(F.floor((F.min(f"d{i}") - whole[f"lo{i}"]) * ((SCALE - 1) / ((whole[f"hi{i}"] - whole[f"lo{i}"]) or 1)))
               .cast("long")).alias(f"d{i}") for i in range(n)]
    rows = stage(rows.select("id", "size", "crc", "u", *[f"d{i}" for i in range(n)]), "shard-units-rows")
    units = rows.groupBy("u").agg(F.sum("size").alias("w"), F.count(F.lit(1)).alias("n"), *scaled).withColumn(
        "h", F.shiftrightunsigned(F.xxhash64("u"), 32))
    return rows, stage(units, "shard-units"), whole


def deal(units: list[tuple[int, int]], shards: int, rest: int) -> tuple[dict[int, int], list[float]]:
    """Shards of the large units (number, size), the largest first to the emptiest shard, and the room for the ``rest``
    each shard is then left with: up to one level for all."""
    load, at = [(0, s) for s in range(shards)], {}
    for unit, size in sorted(units, key=lambda u: (-u[1], u[0])):
        held, s = heapq.heappop(load)
        at[unit] = s
        heapq.heappush(load, (held + size, s))
    full = sorted(load)
    level, taken = 0.0, 0
    for i, (held, _) in enumerate(full):
        taken += held
        level = (rest + taken) / (i + 1)
        if i + 1 == shards or level <= full[i + 1][0]:
            break
    room = [0.0] * shards
    for held, s in full:
        room[s] = max(0.0, level - held)
    return at, room


class _Tree:
    """Splits by node number (children of node i are 2i and 2i + 1)."""

    def __init__(self, room: list[float], dims: int):
        self.leaves = {1: (0, len(room))}  # node: first shard, number of shards
        self.room, self.dims, self.levels = room, dims, []

    def left(self, node: int) -> float:
        """The part of a node that belongs on its left side."""
        first, k = self.leaves[node]
        whole = sum(self.room[first:first + k])
        return sum(self.room[first:first + k // 2]) / whole if whole else (k // 2) / k

    def open(self) -> list[int]:
        return [i for i, (_, k) in self.leaves.items() if k > 1]

    def split(self, cuts: dict[int, tuple[int, int]]) -> None:
        """cuts: node to (dimension, first coordinate of the right side)."""
        self.levels.append(cuts)
        for i in cuts:
            first, k = self.leaves.pop(i)
            self.leaves[2 * i], self.leaves[2 * i + 1] = (first, k // 2), (first + k // 2, k - k // 2)

    def coordinate(self, dim: Column) -> Column:
        each = F.array(*[F.col(f"d{i}") for i in range(self.dims)])
        return F.element_at(each, dim + 1) * F.lit(1 << 32) + F.col("h")

    def descend(self, placed: DataFrame) -> DataFrame:
        """The units one level further down."""
        cuts = self.levels[-1]
        dim = by_node(F.col("node"), {i: c[0] for i, c in cuts.items()}, "int")
        cut = by_node(F.col("node"), {i: c[1] for i, c in cuts.items()}, "long")
        right = (self.coordinate(dim) >= cut).cast("int")
        return placed.withColumn("node", F.when(cut.isNull(), F.col("node")).otherwise(F.col("node") * 2 + right))


def by_node(node: Column, values: dict[int, int], kind: str) -> Column:
    """The node's value from a small table on the driver, null where it has none."""
    first, last = min(values), max(values)
    listed = F.array(*[F.lit(values.get(i)).cast(kind) for i in range(first, last + 1)])  # one literal
    return F.when((node >= first) & (node <= last), F.element_at(listed, node - F.lit(first - 1)))


def _cut_level(placed: DataFrame, tree: _Tree, total: int, shards: int) -> dict[int, tuple[int, int]]:
    """Where every open node of the tree is to be split; ``placed`` are units with their node."""
    placed = placed.where(F.col("node").isin(tree.open()))
    ranges = placed.groupBy("node").agg(F.sum("w").alias("w"), *[
        f(f"d{i}").alias(f"{k}{i}") for i in range(tree.dims) for k, f in (("lo", F.min), ("hi", F.max))]).collect()
    dim, goal, lo, hi, before, cuts = {}, {}, {}, {}, {}, {}
    for x in ranges:  # at most one row per shard
        i = x["node"]
        dim[i] = max(range(tree.dims), key=lambda d: (x[f"hi{d}"] - x[f"lo{d}"], -d))
        goal[i], before[i] = x["w"] * tree.left(i), 0
        lo[i], hi[i] = x[f"lo{dim[i]}"] << 32, (x[f"hi{dim[i]}"] + 1) << 32
    for i in tree.open():
        if i not in dim:  # an empty node
            cuts[i] = (0, 0)
    todo = set(dim)
    while todo:
        width = {i: -(-(hi[i] - lo[i]) // BINS) for i in todo}
        node = F.col("node")
        coordinate = tree.coordinate(by_node(node, {i: dim[i] for i in todo}, "int"))
        low = by_node(node, {i: lo[i] for i in todo}, "long")
        step = by_node(node, width, "long")
        binned = placed.where(node.isin(list(todo))).select("node", "w", (coordinate - low).alias("c"), step.alias("step"),
                                                            by_node(node, hi, "long").alias("hi"), low.alias("low"))
        binned = binned.where((F.col("c") >= 0) & (F.col("c") + F.col("low") < F.col("hi")))
        bins = binned.groupBy("node", F.expr("c div step").alias("bin")).agg(F.sum("w").alias("w"))
        upto = F.sum("w").over(Window.partitionBy("node").orderBy("bin"))  # at most BINS rows a node
        target = by_node(node, {i: goal[i] - before[i] for i in todo}, "double")
        hit = bins.withColumn("upto", upto).where(F.col("upto") >= target).groupBy("node").agg(
            F.min(F.struct("bin", "upto", "w")).alias("b")).collect()
        for x in hit:
            i, (b, end, w) = x["node"], x["b"]
            start = lo[i] + b * width[i]
            if width[i] > 1 and w * FINE * shards > total:
                before[i] += end - w
                lo[i], hi[i] = start, min(hi[i], start + width[i])
                continue
            short, over = goal[i] - before[i] - (end - w), before[i] + end - goal[i]
            cuts[i] = (dim[i], start if short < over else start + width[i])
            todo.discard(i)
    return cuts


def kd_shards(df: DataFrame, shards: int, dims: dict[str, Column], id_col: str = "doc_id",
              text_col: str = "text") -> DataFrame:
    """id_col, size, text_crc32, law, shard, slot (gapless from 0) and grown_shard of every row.

    ``dims`` are the metadata dimensions as numbers (see ``category``).
    """
    rows, units, whole = _units(df, id_col, text_col, dims, shards)
    if units is None:
        placed = rows.select("id", "size", "crc", F.lit(0).alias("shard"))
    else:
        # Fewer than UNIT_SHARE * shards units.
        large = {x["u"]: x["w"] for x in units.where(F.col("w") * UNIT_SHARE * shards > whole["w"]).select("u", "w").collect()}
        where, room = deal(list(large.items()), shards, whole["w"] - sum(large.values()))
        dealt = df.sparkSession.createDataFrame(list(where.items()), "dealt_u long, shard int")
        tree = _Tree(room, len(dims))
        at = units.join(F.broadcast(dealt), F.col("u") == F.col("dealt_u"), "left_anti").withColumn("node", F.lit(1))
        while tree.open():
            tree.split(_cut_level(at, tree, whole["w"], shards))
            at = stage(tree.descend(at), "shard-level")
        shard = by_node(F.col("node"), {i: first for i, (first, _) in tree.leaves.items()}, "int")
        small = at.select("u", F.col("n").alias("copies"), shard.alias("shard"))
        few = units.join(F.broadcast(dealt), F.col("u") == F.col("dealt_u")).select("u", F.col("n").alias("copies"), "shard")
        leaf = stage(small.unionByName(few), "shard-leaves")
        placed = join_by_class(rows.select("id", "size", "crc", "u"), leaf, "u", "copies", whole["n"])
    slots = numbered(placed.select("id", "size", "crc", "shard"), ["shard"], ["id", "crc", "size"], "slot")
    return slots.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"),
                        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
