"""Operator 2, mixing sources to target weights by min-cost flow.

Documents may belong to several sources. They are aggregated by membership
pattern; a flow routes each pattern's words (first, second, third repetition at
rising cost) to the sources' quotas; then whole documents are selected in a
seeded order as long as they fit a pattern's share, then such as fit what is
left, and one more whose size is closest to that. Only the patterns reach the driver.

Targets: the sources share 100 % of all words by weight; a target stops at
``repeats`` times its source's words and the excess is shared again by weight.

Defined cases: a null text has no words; a null source is a source of its own,
ordered last; a document of no source (a null or empty array) is never taken;
documents without words are taken or left with their neighbours
in the seeded order; repeated rows (same id, same text) are numbered and taken
or left one by one; an empty table gives an empty result; more than ``max_patterns``
membership patterns raise an error, none is dropped; ``mixed`` carries other
columns through untouched whatever their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carthouse.llm.common import WORD, numbered, stage, unpacked

#: Patterns the driver plans for; above it the plan is refused.
MAX_PATTERNS = 100_000
#: How often a document may be repeated.
REPEATS = 3
#: Bits of the seeded order resolved by one histogram.
BITS = 12


def ordered(sources) -> list:
    """Sources by code point, null last."""
    return sorted((s for s in sources if s is not None)) + [None] * (None in sources)


def repeating_weights(sources: list) -> dict:
    """Weights 1, 2, 3, repeating over the ordered sources."""
    return {s: 1 + i % 3 for i, s in enumerate(ordered(set(sources)))}


def targets(sizes: dict, weights: dict, repeats: int = REPEATS) -> dict:
    """Words each source shall give: by weight, at most ``repeats`` times its own."""
    out, left, free = {}, float(sum(sizes.values())), list(sizes)
    while free:
        total = sum(weights[s] for s in free)
        over = [s for s in free if left * weights[s] / total > repeats * sizes[s]]
        if not over:
            return out | {s: left * weights[s] / total for s in free}
        for s in over:
            out[s] = float(repeats * sizes[s])
        left = float(sum(sizes.values())) - sum(out.values())
        free = [s for s in free if s not in out]
    return out


class _Flow:
    """Min-cost flow by successive shortest paths with node potentials."""

    def __init__(self, nodes: int):
        self.at: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[int] = []
        self.cost: list[int] = []

    def arc(self, a: int, b: int, room: int, cost: int) -> int:
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.at[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
            self.cost.append(c)
        return len(self.to) - 2

    def run(self, s: int, t: int) -> None:
        potential = [0] * len(self.at)  # costs start non-negative
        while True:
            far, via = [None] * len(self.at), [-1] * len(self.at)
            far[s], heap = 0, [(0, s)]
            while heap:
                d, u = heapq.heappop(heap)
                if d > far[u]:
                    continue
                for e in self.at[u]:
                    v = self.to[e]
                    if self.room[e] and (far[v] is None or d + self.cost[e] + potential[u] - potential[v] < far[v]):
                        far[v], via[v] = d + self.cost[e] + potential[u] - potential[v], e
                        heapq.heappush(heap, (far[v], v))
            if far[t] is None:
                return
            potential = [p + (f if f is not None else far[t]) for p, f in zip(potential, far)]
            path, v = [], t
            while v != s:
                path.append(via[v])
                v = self.to[via[v] ^ 1]
            push = min(self.room[e] for e in path)
            for e in path:
                self.room[e] -= push
                self.room[e ^ 1] += push


def route(patterns: list[tuple[tuple, int]], quotas: dict, repeats: int = REPEATS) -> list[int]:
    """Words to take of each (sources, words) pattern so that the sources' quotas
    are met as far as they can be, with as little repetition as possible."""
    names = list(quotas)
    where = {s: 1 + len(patterns) + i for i, s in enumerate(names)}
    end = 1 + len(patterns) + len(names)
    flow = _Flow(end + 1)
    taken = []
    for i, (sources, words) in enumerate(patterns):
        taken.append([flow.arc(0, 1 + i, words, r) for r in range(repeats)])  # the r-th repetition costs r
        for s in sources:
            flow.arc(1 + i, where[s], repeats * words, 0)
    for s in names:
        flow.arc(where[s], end, int(round(quotas[s])), 0)
    flow.run(0, end)
    return [sum(flow.room[e ^ 1] for e in arcs) for arcs in taken]


@dataclass
class Mix:
    """The plan of a mix: per pattern (row of ``plan``: members, pid, words,
    source_size and target of its first source, full passes, the
    stretches of the seeded order of which one more pass is taken, and the
    number of one more document that fills the rest best)."""
    rows: DataFrame
    plan: DataFrame
    order: Column
    sizes: dict
    targets: dict
    repeated: DataFrame | None  # seeded numbers that several rows share


def seeded_order(id_col: Column, text: Column, seed: int) -> Column:
    """A number from 0 to 2**63-1 that depends on the row and the seed only."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), id_col, F.xxhash64(text)), 1)


#: Rounds of filling what a share still lacks with documents that fit it, and the part of a target that may lack.
ROUNDS = 8
LACK = 0.001
_TOP = (1 << 63) - 1


def _cutoffs(rows: DataFrame, rest: dict[int, int]) -> dict[int, tuple[int, int]]:
    """Per pattern the largest seeded number still taken, and the words left, given the words to take.

    Two histograms of the seeded order narrow each pattern to one bin of
    2**(63 - 2 * BITS) numbers; only that bin's rows are put in order. A
    pattern whose rows all fit gives all of them."""
    spark = rows.sparkSession
    state, done = {pid: (0, 0) for pid in rest}, {}  # start of the bin, words before it
    kinds = "pid int, lo long, before long, rest long"
    for level in (1, 2):
        if not state:
            return done
        shift, span = 63 - BITS * level, 1 << (63 - BITS * (level - 1))
        known = spark.createDataFrame([(p, s, b, rest[p]) for p, (s, b) in state.items()], kinds)
        inside = rows.join(F.broadcast(known), "pid").where(  # one row per pattern, at most MAX_PATTERNS
            (F.col("r") >= F.col("lo")) & (F.col("r") - F.col("lo") < F.lit(span)) if level > 1 else F.lit(True))
        bins = inside.groupBy("pid", "before", "rest", F.shiftright("r", shift).alias("bin")).agg(F.sum("size").alias("words"))
        upto = F.col("before") + F.sum("words").over(Window.partitionBy("pid").orderBy("bin"))  # 2**BITS rows a pattern
        reached = F.when(F.col("upto") >= F.col("rest"), F.struct("bin", "upto", "words"))
        hit = bins.withColumn("upto", upto).groupBy("pid").agg(F.min(reached).alias("h"), F.max("upto").alias("all")).collect()
        done |= {x["pid"]: (_TOP, rest[x["pid"]] - x["all"]) for x in hit if x["h"] is None}
        state = {x["pid"]: (x["h"]["bin"] << shift, x["h"]["upto"] - x["h"]["words"]) for x in hit if x["h"] is not None}
    if not state:
        return done
    known = spark.createDataFrame([(p, s, b, rest[p]) for p, (s, b) in state.items()], kinds)
    inside = rows.join(F.broadcast(known), "pid").where(
        (F.col("r") >= F.col("lo")) & (F.col("r") - F.col("lo") < F.lit(1 << (63 - 2 * BITS))))
    same = inside.groupBy("pid", "before", "rest", "r").agg(F.sum("size").alias("size"))
    upto = F.col("before") + F.sum("size").over(Window.partitionBy("pid").orderBy("r"))
    last = same.withColumn("upto", upto).where(F.col("upto") <= F.col("rest")).groupBy("pid").agg(
        F.max("r").alias("r"), F.max("upto").alias("upto"))
    found = {x["pid"]: (x["r"], rest[x["pid"]] - x["upto"]) for x in last.collect()}
    return done | {p: found.get(p, (s - 1, rest[p] - b)) for p, (s, b) in state.items()}


def _selection(slim: DataFrame, rest: dict[int, int], aim: dict[int, int]) -> tuple[dict[int, list], dict[int, int]]:
    """Per pattern the stretches of the seeded order that are taken, as (after,
    up to, largest size), and the number of one last document.

    A stretch ends where the next document does not fit; the next one goes on
    with the documents that still fit."""
    spark, stretches, most = slim.sparkSession, {p: [] for p in rest}, dict.fromkeys(rest, _TOP)
    left = {p: n for p, n in rest.items() if n > 0}
    for _ in range(ROUNDS):
        todo = {p: n for p, n in left.items() if n > LACK * aim[p] and (not stretches[p] or stretches[p][-1][1] < _TOP)}
        if not todo:
            break
        from_ = {p: stretches[p][-1][1] if stretches[p] else -1 for p in todo}
        known = spark.createDataFrame([(p, from_[p], most[p]) for p in todo], "pid int, after long, most long")
        fits = slim.join(F.broadcast(known), "pid").where(
            (F.col("r") > F.col("after")) & (F.col("size") <= F.col("most"))).select("pid", "r", "size")
        got = _cutoffs(fits, todo)
        for p in todo:
            to, left[p] = got.get(p, (_TOP, left[p]))
            stretches[p].append((from_[p], max(to, from_[p]), most[p]))
            most[p] = left[p]
    return stretches, _fillers(slim, {p: n for p, n in left.items() if n > 0}, stretches)


def _in(stretches: Column) -> Column:
    return F.exists(stretches, lambda x: (F.col("r") > x["after"]) & (F.col("r") <= x["upto"]) & (F.col("size") <= x["most"]))


_STRETCHES = "stretches array<struct<after:long,upto:long,most:long>>"


def _fillers(slim: DataFrame, left: dict[int, int], stretches: dict[int, list]) -> dict[int, int]:
    """Per pattern the document not taken whose size is closest to the words left."""
    if not left:
        return {}
    known = slim.sparkSession.createDataFrame([(p, n, stretches[p]) for p, n in left.items()], "pid int, left long, " + _STRETCHES)
    near = F.min(F.struct(F.abs(F.col("size") - F.col("left")).alias("d"), "r", "left")).alias("b")
    best = slim.join(F.broadcast(known), "pid").where(~_in(F.col("stretches"))).groupBy("pid").agg(near)
    return {x["pid"]: x["b"]["r"] for x in best.collect() if x["b"]["d"] < x["b"]["left"]}


def _words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _apart(rows: DataFrame, repeated: DataFrame | None, seed: int) -> DataFrame:
    """``rows`` with a seeded number of its own for every repetition of a row; its first keeps the row's."""
    if repeated is None:
        return rows
    alone, again = rows.join(repeated, "r", "left_anti"), rows.join(repeated, "r", "left_semi")
    copy = numbered(again.select(rows.columns), ["r"], [], "copy")
    own = F.when(F.col("copy") == 0, F.col("r")).otherwise(F.shiftrightunsigned(F.xxhash64(F.lit(seed), "r", "copy"), 1))
    return alone.select(rows.columns).unionByName(copy.withColumn("r", own).select(rows.columns))


def _pattern(df: DataFrame, members: Column) -> Column:
    """A document's sources as a sorted set; without any (a null array) the empty set."""
    if df.select(members.alias("m")).schema["m"].dataType.typeName() != "array":
        members = F.array(members)
    return F.coalesce(F.sort_array(F.array_distinct(members)), F.array().cast("array<string>"))


def plan_mix(df: DataFrame, id_col: str, text_col: str, members: Column, weights: Callable[[list], dict],
             seed: int = 0, repeats: int = REPEATS, max_patterns: int = MAX_PATTERNS) -> Mix:
    """Plan a mix. ``members`` is an array of each document's sources, or one source."""
    spark = df.sparkSession
    order = seeded_order(F.col(id_col), F.col(text_col), seed)
    rows = df.select(F.col(id_col).alias("id"), _pattern(df, members).alias("members"),
                     _words(F.col(text_col)).alias("size"),
                     order.alias("r"))
    rows = stage(rows, "mix-rows")
    repeated = stage(rows.groupBy("r").count().where("count > 1").select("r"), "mix-repeated")
    repeated = None if repeated.isEmpty() else repeated
    if repeated is not None:
        rows = stage(_apart(rows, repeated, seed), "mix-rows")
    found = rows.groupBy("members").agg(F.sum("size").alias("words")).limit(max_patterns + 1).collect()
    if len(found) > max_patterns:
        raise ValueError(f"more than {max_patterns} membership patterns")
    key = lambda m: tuple((s is None, s or "") for s in m)
    patterns = sorted(((tuple(x["members"]), x["words"]) for x in found), key=lambda p: key(p[0]))
    sizes: dict = {}
    for sources, words in patterns:
        for s in sources:
            sizes[s] = sizes.get(s, 0) + words
    sizes = {s: sizes[s] for s in ordered(set(sizes))}
    goal = targets(sizes, weights(list(sizes)), repeats)
    take = route(patterns, goal, repeats)
    full = [t // w if w else 0 for t, (_, w) in zip(take, patterns)]
    named = spark.createDataFrame(
        [(list(s), i, w, f, float(sizes[s[0]]) if s else 0.0, goal[s[0]] if s else 0.0)
         for i, ((s, w), f) in enumerate(zip(patterns, full))],
        "members array<string>, pid int, words long, full int, source_size double, target double")
    # At most max_patterns rows: small enough to send to every task.
    slim = rows.join(F.broadcast(named.select("members", "pid")), "members").select("pid", "r", "size")
    rest = {i: t - f * w for i, (t, f, (_, w)) in enumerate(zip(take, full, patterns))}
    stretches, filler = _selection(slim, rest, dict(enumerate(take)))
    cuts = spark.createDataFrame([(i, stretches[i], filler.get(i, -1)) for i in rest], f"pid int, {_STRETCHES}, filler long")
    return Mix(rows, named.join(F.broadcast(cuts), "pid"), order, sizes, goal, repeated)


def _copies() -> Column:
    return F.col("full") + (_in(F.col("stretches")) | (F.col("r") == F.col("filler"))).cast("int")


def taken(mix: Mix) -> DataFrame:
    """Per document id, size, its first source's size and target, and the words the mix takes of it."""
    return mix.rows.join(F.broadcast(mix.plan), "members").select(
        "id", "size", F.col("source_size").cast("long").alias("source_size"), "target",
        (F.col("size") * _copies()).alias("taken"))


def mixed(df: DataFrame, mix: Mix, id_col: str, text_col: str, members: Column, seed: int = 0) -> DataFrame:
    """The mix itself: the rows of ``df``, each as often as the plan takes it.

    Decided from a row and the broadcast plan alone; only repeated rows are shuffled, to number them."""
    full = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"),
                     _pattern(df, members).alias("members"), _words(F.col(text_col)).alias("size"),
                     seeded_order(F.col(id_col), F.col(text_col), seed).alias("r"))
    full = _apart(full, mix.repeated, seed)
    met = full.join(F.broadcast(mix.plan), "members").select("row", _copies().alias("copies")).where("copies > 0")
    return unpacked(met.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))), df.columns)
