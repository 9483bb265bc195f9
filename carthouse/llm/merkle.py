"""Operator 13, a Merkle manifest of a dataset as a SHA midstate tree.

A record's leaf is the SHA-256 of its fields, each ``-`` if null, else its
UTF-8 byte count, a colon and its value. Leaves of a group (source) ascend by
id; while several nodes remain, every 16 consecutive ones become the hash of
their hex digests. The last node is the group's subroot, and the subroots,
ordered by group (null first, bytewise), give the root in the same way.

A parent keeps a copy of its hash state from before each child. Folding a
replaced leaf resumes the state of its slot with the replacement and the
siblings to the right, level by level; what lies to the left is never hashed
again. A state cannot leave its process, so a task holds a chunk of 16**3
nodes: three levels with their states. Chunks of chunks give the levels above,
whose sibling lists come down again round by round (one row per chunk), and the
states before a chunk's own ancestors are made once per chunk. No group, level
or path list is ever in one task or the driver; only the root is.

Leaves are numbered by a range sort on (group, id, leaf) whose last key spreads
repeated rows, so neither a hot group nor a hot record fills a task.

Defined cases: every field may be null; a null group is a group of its own,
before all others; null ids come first; rows of one id are ordered by their
leaf, so repeated rows are repeated leaves; an empty or very long text is hashed
whole like any other; an empty table has no rows (and no root); only the named
columns take part.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carthouse.llm.common import numbered, stage

FAN_OUT = 16
#: Levels of one chunk: a task holds the FAN_OUT ** LEVELS nodes of one chunk at a time.
LEVELS = 3

_PATH = "array<struct<left:string,right:string>>"
_SIDES = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def leaf_digest(fields: list[Column]) -> Column:
    """Hex SHA-256 of the length-prefixed fields."""
    def framed(c: Column) -> Column:
        text = c.cast("string")
        return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))

    return F.sha2(F.concat(*[framed(c) for c in fields]).cast("binary"), 256)


def _chunked(nodes: DataFrame, size: int, fields: list[str]) -> DataFrame:
    """Nodes (grp, idx, m, fields) as rows (grp, chunk, m, items in order of idx), at most ``size`` items each."""
    items = F.sort_array(F.collect_list(F.struct("idx", *fields)))
    return nodes.groupBy("grp", (F.expr(f"idx div {size}")).alias("chunk"), "m").agg(items.alias("items"))


def _height(m: int, levels: int) -> int:
    """Levels a chunk goes up when its group has ``m`` nodes in this round."""
    up, nodes = 0, m
    while nodes > 1 and up < levels:
        nodes = -(-nodes // FAN_OUT)
        up += 1
    return up


def _parents(nodes: list[bytes]) -> list[bytes]:
    return [sha256(b"".join(nodes[i:i + FAN_OUT])).hexdigest().encode() for i in range(0, len(nodes), FAN_OUT)]


class _Runs:
    """One level of a chunk: its runs of siblings and, before each child, its parent's hash state."""

    def __init__(self, nodes: list[bytes], with_states: bool):
        self.nodes, self.width = nodes, len(nodes[0])
        self.runs = [b"".join(nodes[i:i + FAN_OUT]) for i in range(0, len(nodes), FAN_OUT)]
        self.states, self.parents = [], []
        for r, run in enumerate(self.runs):
            state = sha256()
            if with_states:
                for child in nodes[r * FAN_OUT:(r + 1) * FAN_OUT]:
                    self.states.append(state.copy())
                    state.update(child)
            else:
                state.update(run)
            self.parents.append(state.hexdigest().encode())

    def sides(self, i: int) -> tuple[bytes, bytes]:
        """The digests left and right of child ``i`` in its run."""
        run, at = self.runs[i // FAN_OUT], i % FAN_OUT * self.width
        return run[:at], run[at + self.width:]


def _levels(items: list[bytes], height: int, with_states: bool) -> list[_Runs]:
    out = []
    for _ in range(height):
        out.append(_Runs(items, with_states))
        items = out[-1].parents
    return out


def _chunk_digests(batch: pa.RecordBatch, row: int, field: str) -> list[bytes]:
    return [d.encode() for d in batch.column("items")[row].values.field(field).to_pylist()]


def _roots(batches: Iterator[pa.RecordBatch], levels: int) -> Iterator[pa.RecordBatch]:
    """A chunk's digest: a node of the next round."""
    for batch in batches:
        digests = []
        for row, m in enumerate(batch.column("m").to_pylist()):
            nodes = _chunk_digests(batch, row, "digest")
            for _ in range(_height(m, levels)):
                nodes = _parents(nodes)
            digests.append(nodes[0].decode())
        size = FAN_OUT ** levels
        up = [-(-m // size) for m in batch.column("m").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("grp"), batch.column("chunk"), pa.array(up, pa.int64()),
                                          pa.array(digests, pa.string())], names=["grp", "idx", "m", "digest"])


def _child_paths(batches: Iterator[pa.RecordBatch], levels: int) -> Iterator[pa.RecordBatch]:
    """The sibling lists of every node of a chunk: those within the chunk, then those above it."""
    for batch in batches:
        for row, m in enumerate(batch.column("m").to_pylist()):
            nodes, above = _chunk_digests(batch, row, "digest"), batch.column("path")[row].as_py()
            tree, paths = _levels(nodes, _height(m, levels), False), []
            for i in range(len(nodes)):
                own, at = [], i
                for level in tree:
                    left, right = level.sides(at)
                    own.append({"left": left.decode(), "right": right.decode()})
                    at //= FAN_OUT
                paths.append(own + above)
            n, one = len(nodes), [row] * len(nodes)
            yield pa.RecordBatch.from_arrays(
                [batch.column("grp").take(pa.array(one)), batch.column("items")[row].values.field("idx"),
                 pa.array(paths, _SIDES), batch.column("subroot").take(pa.array(one))],
                names=["grp", "chunk", "path", "subroot"]) if n else batch.slice(0, 0)


def _folds(batches: Iterator[pa.RecordBatch], levels: int, siblings: bool) -> Iterator[pa.RecordBatch]:
    """Proof and folded root of every leaf of a chunk."""
    for batch in batches:
        for row, m in enumerate(batch.column("m").to_pylist()):
            items, above = batch.column("items")[row].values, batch.column("path")[row].as_py()
            nodes = [d.encode() for d in items.field("digest").to_pylist()]
            swaps = items.field("swap").to_pylist()
            tree = _levels(nodes, _height(m, levels), True)
            upper = []
            for level in above:
                state = sha256(level["left"].encode())
                upper.append((state, level["right"].encode()))
            tail = "".join(level["left"] + level["right"] for level in above).encode()
            proofs, folded, paths = [], [], []
            for i, swap in enumerate(swaps):
                proof, digest, at, own = sha256(), nodes[i] if swap is None else swap.encode(), i, []
                for level in tree:
                    left, right = level.sides(at)
                    proof.update(left + right)
                    state = level.states[at].copy()
                    state.update(digest + right)
                    digest = state.hexdigest().encode()
                    if siblings:
                        own.append({"left": left.decode(), "right": right.decode()})
                    at //= FAN_OUT
                for before, right in upper:
                    state = before.copy()
                    state.update(digest + right)
                    digest = state.hexdigest().encode()
                proof.update(tail)
                proofs.append(proof.hexdigest())
                folded.append(digest.decode())
                paths.append(own + above if siblings else None)
            one = pa.array([row] * len(nodes))
            columns = [items.field("id"), items.field("digest"), batch.column("subroot").take(one),
                       pa.array(proofs, pa.string()), pa.array(folded, pa.string())]
            names = ["id", "leaf", "subroot", "proof_sha256", "folded_root"]
            if siblings:
                columns, names = columns + [pa.array(paths, _SIDES)], names + ["siblings"]
            yield pa.RecordBatch.from_arrays(columns, names=names)


def _climb(nodes: DataFrame, fields: list[str], levels: int) -> tuple[list[DataFrame], DataFrame]:
    """The chunks of every round, and the last node (grp, digest) of each group."""
    size, kind = FAN_OUT ** levels, nodes.schema["grp"].dataType.simpleString()
    rounds, done = [], []
    while True:
        rounds.append(stage(_chunked(nodes, size, fields), "merkle-chunks"))
        up = stage(rounds[-1].select("grp", "chunk", "m", "items").mapInArrow(
            partial(_roots, levels=levels), f"grp {kind}, idx long, m long, digest string"), "merkle-nodes")
        done.append(up.where("m = 1").select("grp", "digest"))
        nodes, fields = up.where("m > 1"), ["digest"]
        if nodes.isEmpty():
            return rounds, reduce(DataFrame.unionByName, done)


def _descend(rounds: list[DataFrame], tops: DataFrame, levels: int) -> DataFrame:
    """The first round's chunks with ``path`` and ``subroot``; ``tops`` (grp, path, subroot) has a row per group."""
    size, kind = FAN_OUT ** levels, tops.schema["grp"].dataType.simpleString()
    below = None
    for depth in range(len(rounds) - 1, -1, -1):
        chunks = rounds[depth]
        # A group whose nodes fit one chunk has its top here; the others hang on the round above.
        ends = chunks.where(F.col("m") <= size)
        at = tops.withColumnRenamed("grp", "top_grp")
        met = ends.join(at, ends["grp"].eqNullSafe(at["top_grp"])).drop("top_grp")
        if below is not None:
            at = below.withColumnsRenamed({"grp": "top_grp", "chunk": "top_chunk"})
            rest = chunks.where(F.col("m") > size)
            hung = rest.join(at, rest["grp"].eqNullSafe(at["top_grp"]) & (rest["chunk"] == at["top_chunk"]))
            met = met.unionByName(hung.drop("top_grp", "top_chunk"))
        if depth == 0:
            return met
        below = stage(met.mapInArrow(partial(_child_paths, levels=levels),
                                     f"grp {kind}, chunk long, path {_PATH}, subroot string"), "merkle-paths")


def merkle_manifest(df: DataFrame, fields: list[str], group_col: str, id_col: str, swaps: Column | None = None,
                    swapped: dict[str, Column] | None = None, siblings: bool = False, levels: int = LEVELS) -> DataFrame:
    """One row per record: id_col, leaf, subroot, root, proof_sha256, folded_root, verified.

    Records where ``swaps`` holds are folded with the leaf of their ``swapped``
    fields (field -> replacement) instead of their own. ``siblings`` adds the
    proof itself: per level, the digests left and right of the path.
    """
    own = leaf_digest([F.col(f"`{f}`") for f in fields])
    other = leaf_digest([(swapped or {}).get(f, F.col(f"`{f}`")) for f in fields])
    leaves = df.select(F.col(f"`{group_col}`").alias("grp"), F.col(f"`{id_col}`").alias("id"), own.alias("digest"),
                       (F.when(swaps, other) if swaps is not None else F.lit(None).cast("string")).alias("swap"))
    leaves = stage(leaves, "merkle-leaves")  # texts are hashed once; the range sort reads its input twice
    rounds, subroots = _climb(numbered(leaves, ["grp"], ["id", "digest"], "idx", "m"), ["id", "digest", "swap"], levels)
    subroots = stage(subroots, "merkle-subroots")
    kind = leaves.schema["id"].dataType.simpleString()
    out = f"id {kind}, leaf string, subroot string, proof_sha256 string, folded_root string"
    if subroots.isEmpty():
        shape = out.replace("folded_root", "root string, folded_root") + (f", siblings {_PATH}" if siblings else "")
        return df.sparkSession.createDataFrame([], shape + ", verified boolean").withColumnRenamed("id", id_col)
    # The same tree over the subroots; its nodes are numbered in the order of the groups.
    tops = stage(numbered(subroots.select(F.lit(0).alias("grp"), F.col("grp").alias("name"), "digest"), ["grp"], ["name"],
                          "idx", "m"), "merkle-tops")
    top_rounds, last = _climb(tops, ["name", "digest"], levels)
    root = last.first()["digest"]
    start = df.sparkSession.createDataFrame([(0, [], "")], f"grp int, path {_PATH}, subroot string")
    paths = _descend(top_rounds, start, levels).mapInArrow(
        partial(_child_paths, levels=levels), f"grp int, chunk long, path {_PATH}, subroot string")
    places = tops.select(F.col("name").alias("grp"), F.col("digest").alias("subroot"), "idx")
    by_group = stage(paths.drop("grp", "subroot").join(places, F.col("chunk") == F.col("idx"))
                     .select("grp", "path", "subroot"), "merkle-group-paths")
    met = _descend(rounds, by_group, levels)
    found = met.mapInArrow(partial(_folds, levels=levels, siblings=siblings),
                           out + (f", siblings {_PATH}" if siblings else ""))
    return found.withColumnRenamed("id", id_col).withColumn("root", F.lit(root)) \
        .withColumn("verified", F.col("folded_root") == F.col("root"))
