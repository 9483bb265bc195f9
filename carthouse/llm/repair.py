"""Operator 11, conversation structure repair by bidirectional Dijkstra over the edit lattice.

A conversation's rows, by turn, are edited until their role initials read
``(s?(ua)+)?``: Keep costs 0, Rerole to user or assistant 1, Delete 2, Insert an
empty user or assistant row 5; a blank or repeated row must be deleted, and a
truncated one costs 5 more unless it is. The lattice has a node for every number
of rows consumed and every state of that pattern. A forward and a reverse heap
grow from both ends; when they have met, every crossing of the least cost is
finished, and of the equal ones the ASCII-least audit (the edits' initials) is
taken. At one node two audits of equal cost are never prefixes of each other
(the same rows are consumed, and an Insert costs), so least halves make least
wholes.

Rows are dealt by one range sort on (conversation, turn, role, digest), whose
last key spreads repeated rows. A conversation that lies within a partition and
within BLOCK_ROWS rows and BLOCK_CHARS characters is solved where it is read.
Any other is cut into blocks: each block is searched between all pairs of states
on its own, a fold over the blocks' small tables (one at a time, cut points by
reference) picks the states, and the repaired text is hashed row by row. Those
two passes over one conversation are sequential, as its SHA-256 is, but hold no
texts: a conversation of any length takes time there, not memory. Only its audit
is as long as itself.

Defined cases: null role or text read as one space; a role whose first
character is not s, u or a cannot be kept; turns may be null (first), repeated
or negative; rows of one turn are ordered by role and the SHA-256 of their text;
a null conversation id is a conversation; rows with ``present`` false only name
their conversation; a conversation left without rows has zeros, an empty audit
and the digest of the empty text; an empty table gives an empty result; columns
other than the four named do not take part.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache, partial
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carthouse.llm.common import stage

#: Rows and characters up to which a conversation is solved in one piece; rows of a block beyond that.
BLOCK_ROWS = 256
BLOCK_CHARS = 8_000_000

# Costs of the edits.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
# The pattern (s?(ua)+)?: 0 nothing yet, 1 after s, 2 after u, 3 after a; it may end in 0 or 3.
STATES, ENDS = (0, 1, 2, 3), (0, 3)
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
TO = {0: 2, 1: 2, 2: 3, 3: 2}  # the state an inserted or reroled row leads to
NAME = {2: "user", 3: "assistant"}
LEGAL = {"su", "ua", "au"}
SPACE = " \t\n\x0b\x0c\r"
MOST = 2 ** 63 - 1  # turns further apart than a long can hold count as this many


def symbol(role: str, blank: bool, repeated: bool, truncated: bool) -> str:
    """A row as the search sees it: d must go, else the initial (x: none of the pattern's), upper case if truncated."""
    if blank or repeated:
        return "d"
    initial = role[:1] if role[:1] in ("s", "u", "a") else "x"
    return initial.upper() if truncated else initial


def _forward(pattern: str, i: int, q: int):
    """Edges out of a node: (next node, cost, edit)."""
    if i < len(pattern):
        c = pattern[i]
        yield (i + 1, q), DELETE, "D"
        if c != "d":
            more = TRUNCATED if c.isupper() else 0
            kept = NEXT.get((q, c.lower()))
            if kept is not None:
                yield (i + 1, kept), KEEP + more, "K"
            yield (i + 1, TO[q]), REROLE + more, "R"
    yield (i, TO[q]), INSERT, "I"


def _backward(pattern: str, i: int, q: int):
    """Edges into a node: (node before, cost, edit)."""
    if i:
        c = pattern[i - 1]
        yield (i - 1, q), DELETE, "D"
        if c != "d":
            more = TRUNCATED if c.isupper() else 0
            for p in STATES:
                if NEXT.get((p, c.lower())) == q:
                    yield (i - 1, p), KEEP + more, "K"
                if TO[p] == q:
                    yield (i - 1, p), REROLE + more, "R"
    for p in STATES:
        if TO[p] == q:
            yield (i, p), INSERT, "I"


@lru_cache(maxsize=1 << 16)
def search(pattern: str, start: int = 0, ends: tuple = ENDS) -> tuple[int, str] | None:
    """Least cost and, at that cost, ASCII-least audit from ``start`` to any of ``ends``; None if there is no way."""
    n = len(pattern)
    # Heaps hold (cost, rows consumed from that end, audit, state): edits of cost 0 consume a row, so among
    # equal costs a node comes after all that lead to it, and its first label out of the heap is its least.
    heaps = [[(0, 0, "", start)], [(0, 0, "", q) for q in ends]]
    settled: list[dict] = [{}, {}]
    best = None
    while heaps[0] or heaps[1]:
        tops = [h[0][0] if h else 0 for h in heaps]
        if best is not None and tops[0] + tops[1] > best[0]:
            break
        side = 0 if heaps[0] and (not heaps[1] or (tops[0], len(heaps[0])) <= (tops[1], len(heaps[1]))) else 1
        cost, used, audit, q = heapq.heappop(heaps[side])
        node = (used if side == 0 else n - used, q)
        if node in settled[side]:
            continue
        settled[side][node] = cost, audit
        over = settled[1 - side]
        if node in over:
            best = _less(best, cost + over[node][0], audit + over[node][1] if side == 0 else over[node][1] + audit)
        for (i, p), more, edit in (_forward if side == 0 else _backward)(pattern, *node):
            longer = audit + edit if side == 0 else edit + audit
            if (i, p) in over:
                c, rest = over[(i, p)]
                best = _less(best, cost + more + c, longer + rest if side == 0 else rest + longer)
            if (i, p) not in settled[side]:
                heapq.heappush(heaps[side], (cost + more, i if side == 0 else n - i, longer, p))
    return best


def _less(best, cost: int, audit: str):
    return (cost, audit) if best is None or (cost, audit) < best else best


def apply(audit: str, q: int, roles: list[str]) -> tuple[list[list[str]], int]:
    """What an audit makes of rows, entered in state ``q``: per row the roles of the rows in its place, None for
    its own text and a name for an empty one, and the state reached. Inserts at the end join the last row."""
    out, pending, at = [], [], 0
    for edit in audit:
        if edit == "I":
            q = TO[q]
            pending.append((NAME[q], False))
            continue
        if edit == "K":
            q = NEXT[(q, roles[at][:1])]
            pending.append((roles[at], True))
        elif edit == "R":
            q = TO[q]
            pending.append((NAME[q], True))
        out.append(pending)
        pending, at = [], at + 1
    if pending:
        if out:
            out[-1] = out[-1] + pending
        else:
            out.append(pending)
    return out, q


def _faults(text: str, repeated: bool) -> tuple[bool, bool, bool]:
    """(blank, duplicate, truncated): the first that applies."""
    shown = text.rstrip(SPACE)
    if not shown:
        return True, False, False
    return False, repeated, not repeated and shown[-1] not in ".!?"


def _solved(rows: list[tuple]) -> tuple:
    """Counts, audit and digest of one conversation held whole."""
    seen, symbols, faults = set(), [], [0, 0, 0]
    for _, role, text in rows:
        fault = _faults(text, (role, text) in seen)
        seen.add((role, text))
        faults = [a + b for a, b in zip(faults, fault)]
        symbols.append(symbol(role, *fault))
    turns = {t for t, _, _ in rows if t is not None}
    gaps = min(max(turns) - min(turns) + 1 - len(turns), MOST) if turns else 0
    roles = [r for _, r, _ in rows]
    illegal = sum(a[:1] + b[:1] not in LEGAL for a, b in zip(roles, roles[1:]))
    cost, audit = search("".join(symbols))
    edits, _ = apply(audit, 0, roles)
    lines = [f"{role}:{rows[i][2] if own else ''}" for i, made in enumerate(edits) for role, own in made]
    return gaps, *faults, illegal, cost, audit, sha256("\n".join(lines).encode("utf-8", "surrogatepass")).hexdigest()


_RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, " \
          "repaired_sha256 string"
_LONG = "part int, at long, turn {turn}, role string, text string"


def _first_pass(batches: Iterator[pa.RecordBatch], kind: pa.DataType, turn_kind: pa.DataType, rows_max: int,
                chars_max: int) -> Iterator[pa.RecordBatch]:
    """Rows in order: a result for every conversation that surely lies here whole, the rows of all others."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    fields = [("conv", kind), *[(n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
              ("audit", pa.string()), ("repaired_sha256", pa.string()), ("part", pa.int32()), ("at", pa.int64()),
              ("turn", turn_kind), ("role", pa.string()), ("text", pa.string()), ("whole", pa.bool_())]
    schema = pa.schema(fields)
    out: list[tuple] = []
    held: list[tuple] = []  # (turn, role, text, present) of the current conversation
    conv, chars, at, spilled, started, size = None, 0, 0, True, False, 0

    def spill():
        nonlocal at, size
        for turn, role, text, present in held:
            out.append((conv, *[None] * 8, part, at, turn, role if present else None, text if present else None, False))
            size += len(text)
            at += 1
        held.clear()

    def batch():
        nonlocal size
        columns = list(zip(*out))
        made = pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(columns, schema)], schema=schema)
        out.clear()
        size = 0
        return made

    for b in batches:
        for c, turn, role, text, present in zip(*(b.column(n).to_pylist() for n in ("conv", "turn", "role", "text", "present"))):
            if not started or c != conv or (c is None) != (conv is None):
                if started:
                    if spilled:
                        spill()
                    else:
                        out.append((conv, *_solved([r[:3] for r in held if r[3]]), None, None, None, None, None, True))
                        held.clear()
                # The first conversation of a partition may have begun in the one before.
                spilled = not started
                conv, chars, started = c, 0, True
            held.append((turn, role, text, present))
            chars += len(text)
            if spilled or len(held) > rows_max or chars > chars_max:
                spilled = True
                spill()
            if len(out) >= 4096 or size > chars_max:
                yield batch()
    if started:  # the last may go on in the next
        spill()
    if out:
        yield batch()


def _block_table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per block: counts, its ends, and the least audit between every two states."""
    for b in batches:
        out = []
        for items in b.column("items").to_pylist():
            symbols = "".join(symbol(r["initial"], r["blank"], r["duplicate"], r["truncated"]) for r in items)
            initials = [r["initial"] for r in items]
            turns = [r["turn"] for r in items if r["turn"] is not None]
            ways = []
            for p in STATES:
                for q in STATES:
                    found = search(symbols, p, (q,))
                    if found is not None:
                        ways.append({"p": p, "q": q, "cost": found[0], "audit": found[1]})
            out.append((sum(r["blank"] for r in items), sum(r["duplicate"] for r in items),
                        sum(r["truncated"] for r in items),
                        sum(a + z not in LEGAL for a, z in zip(initials, initials[1:])), initials[0], initials[-1],
                        min(turns, default=None), max(turns, default=None), len(set(turns)), ways))
        names = ["blank", "duplicate", "truncated", "illegal", "opens", "closes", "low", "high", "distinct", "ways"]
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()] * 3 + [pa.list_(pa.struct(
            [("p", pa.int32()), ("q", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))]
        columns = [pa.array(list(c), type=k) for c, k in zip(zip(*out), kinds)] if out else [pa.array([], k) for k in kinds]
        yield pa.RecordBatch.from_arrays([b.column("conv"), b.column("part"), b.column("block"), *columns],
                                         names=["conv", "part", "block", *names])


def _ahead(a, b) -> bool:
    """Whether the audit ending in node ``a`` (node before, block's way, blocks) is less than that of ``b``.

    Both end at the same row; they are compared from where they part."""
    left, right = [], []
    while a is not b:
        left.append(a[1][3])
        right.append(b[1][3])
        a, b = a[0], b[0]
    return "".join(reversed(left)) < "".join(reversed(right))


def _fold_blocks(batches: Iterator[pa.RecordBatch], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Blocks in order: the conversation's counts and, for every block, the state it is entered in and its audit."""
    schema = pa.schema([("conv", kind), *[(n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal",
                                                                  "cost")],
                        ("audit", pa.string()), ("part", pa.int32()), ("block", pa.int64()), ("enter", pa.int32()),
                        ("edits", pa.string())])
    state: dict = {}

    def finish():
        if not state:
            return
        cost, node = None, None
        for q in ENDS:
            if q in state["best"]:
                c, way = state["best"][q]
                if cost is None or c < cost or (c == cost and _ahead(way, node)):
                    cost, node = c, way
        chain = []
        while node is not None and node[0] is not None:
            chain.append(node[1])
            node = node[0]
        chain.reverse()
        low, high = state["low"], state["high"]
        gaps = 0 if low is None else min(high - low + 1 - state["distinct"], MOST)
        rows = [(state["conv"], gaps, *state["counts"], cost, "".join(w[3] for w in chain), None, None, None, None)]
        for k, (part, block, enter, edits) in enumerate(chain):
            rows.append((state["conv"], *[None] * 7, part, block, enter, edits))
            if len(rows) >= 4096 or k == len(chain) - 1:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(zip(*rows), schema)],
                                                 schema=schema)
                rows = []

    for b in batches:
        for r in b.to_pylist():
            if not state or r["conv"] != state["conv"] or (r["conv"] is None) != (state["conv"] is None):
                yield from finish()
                root = (None, None)
                state = {"conv": r["conv"], "counts": [0, 0, 0, 0], "low": None, "high": None, "distinct": 0, "closes": None,
                         "best": {0: (0, root)}}
            counts = [a + r[n] for a, n in zip(state["counts"], ("blank", "duplicate", "truncated", "illegal"))]
            if state["closes"] is not None:
                counts[3] += state["closes"] + r["opens"] not in LEGAL
            state["counts"], state["closes"] = counts, r["closes"]
            if r["low"] is not None:
                # Turns ascend, so a turn is shared with earlier blocks only where they meet.
                state["distinct"] += r["distinct"] - (state["high"] == r["low"])
                state["low"] = r["low"] if state["low"] is None else state["low"]
                state["high"] = r["high"]
            best: dict = {}
            for w in r["ways"]:
                if w["p"] not in state["best"]:
                    continue
                cost, before = state["best"][w["p"]]
                cost, node = cost + w["cost"], (before, (r["part"], r["block"], w["p"], w["audit"]))
                old = best.get(w["q"])
                if old is None or cost < old[0] or (cost == old[0] and _ahead(node, old[1])):
                    best[w["q"]] = cost, node
            state["best"] = best
    yield from finish()


def _hash_rows(batches: Iterator[pa.RecordBatch], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Rows in order with their block's audit: the digest of each conversation's repaired text, fed line by line."""
    made: list[tuple] = []
    current, block, lines, at, digest, first = None, None, [], 0, None, True

    def close():
        if digest is not None:
            made.append((current, digest.hexdigest()))

    for b in batches:
        for r in b.to_pylist():
            if digest is None or r["conv"] != current or (r["conv"] is None) != (current is None):
                close()
                current, digest, first, block = r["conv"], sha256(), True, None
            if block != (r["part"], r["block"]):
                block, at = (r["part"], r["block"]), 0
                lines, _ = apply(r["edits"], r["enter"], r["roles"])
            for role, own in lines[at]:
                digest.update(f"{'' if first else chr(10)}{role}:{r['text'] if own else ''}".encode("utf-8", "surrogatepass"))
                first = False
            at += 1
    close()
    yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in made], type=kind), pa.array([d for _, d in made], pa.string())],
                                     names=["conv", "repaired_sha256"])


def _long_results(long: DataFrame, kind: str, arrow: pa.DataType) -> DataFrame:
    """Results of the conversations that first had to be cut into blocks (``long``: staged rows)."""
    rows = long.where(F.col("role").isNotNull()).withColumn("block", F.expr(f"at div {BLOCK_ROWS}")) \
        .withColumn("sha", F.sha2(F.col("text").cast("binary"), 256))
    # A row is a duplicate unless it is the first of its role and text.
    place = F.struct("part", "at")
    first = rows.groupBy("conv", "role", "sha").agg(F.min(place).alias("first"))
    first = first.withColumnsRenamed({"conv": "f_conv", "role": "f_role", "sha": "f_sha"})
    ends = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    flagged = rows.select("conv", "part", "at", "block", "turn", "role", "sha", ends.alias("last")).join(
        first, rows["conv"].eqNullSafe(F.col("f_conv")) & (rows["role"] == F.col("f_role")) & (rows["sha"] == F.col("f_sha")))
    blank, again = F.col("last") == "", F.struct("part", "at") != F.col("first")
    slim = F.struct("at", F.col("turn").cast("long").alias("turn"), F.substring("role", 1, 1).alias("initial"), blank.alias("blank"),
                    (~blank & again).alias("duplicate"), (~blank & ~again & ~F.col("last").isin(".", "!", "?")).alias("truncated"))
    blocks = flagged.groupBy("conv", "part", "block").agg(F.sort_array(F.collect_list(slim)).alias("items"))
    table = stage(blocks.mapInArrow(_block_table, (
        f"conv {kind}, part int, block long, blank long, duplicate long, truncated long, illegal long, opens string, "
        "closes string, low long, high long, distinct long, ways array<struct<p:int,q:int,cost:long,audit:string>>")),
        "repair-blocks")
    folded = stage(table.repartition("conv").sortWithinPartitions("conv", "part", "block").mapInArrow(
        partial(_fold_blocks, kind=arrow), f"conv {kind}, gaps long, blank long, duplicate long, truncated long, "
        "illegal long, cost long, audit string, part int, block long, enter int, edits string"), "repair-folded")
    edits = folded.where(F.col("part").isNotNull()).select(F.col("conv").alias("e_conv"), F.col("part").alias("e_part"),
                                                           F.col("block").alias("e_block"), "enter", "edits")
    roles = rows.groupBy("conv", "part", "block").agg(F.sort_array(F.collect_list(F.struct("at", "role"))).alias("r")).select(
        F.col("conv").alias("r_conv"), F.col("part").alias("r_part"), F.col("block").alias("r_block"),
        F.col("r.role").alias("roles"))
    plan = edits.join(roles, F.col("e_conv").eqNullSafe(F.col("r_conv")) & (F.col("e_part") == F.col("r_part"))
                      & (F.col("e_block") == F.col("r_block"))).drop("r_conv", "r_part", "r_block")
    ready = rows.join(plan, rows["conv"].eqNullSafe(F.col("e_conv")) & (rows["part"] == F.col("e_part"))
                      & (rows["block"] == F.col("e_block"))).select("conv", "part", "block", "at", "text", "enter", "edits",
                                                                    "roles")
    hashed = ready.repartition("conv").sortWithinPartitions("conv", "part", "at").mapInArrow(
        partial(_hash_rows, kind=arrow), f"conv {kind}, repaired_sha256 string").withColumnRenamed("conv", "h_conv")
    counted = folded.where(F.col("part").isNull()).drop("part", "block", "enter", "edits").withColumnRenamed("conv", "c_conv")
    # Every conversation named, also those without rows.
    named = long.select("conv").distinct()
    with_counts = named.join(counted, F.col("conv").eqNullSafe(F.col("c_conv")), "left").drop("c_conv")
    full = with_counts.join(hashed, F.col("conv").eqNullSafe(F.col("h_conv")), "left").drop("h_conv")
    zero = [F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return full.select("conv", *zero, F.coalesce("audit", F.lit("")).alias("audit"),
                       F.coalesce("repaired_sha256", F.lit(sha256(b"").hexdigest())).alias("repaired_sha256"))


def repair(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
           present: Column | None = None, rows_max: int = BLOCK_ROWS, chars_max: int = BLOCK_CHARS) -> DataFrame:
    """One row per conversation: conv_col, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    from pyspark.sql.pandas.types import to_arrow_type

    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(" "))
    rows = df.select(F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{turn_col}`").alias("turn"),
                     F.coalesce(F.col(f"`{role_col}`"), F.lit(" ")).alias("role"), text.alias("text"),
                     (F.lit(True) if present is None else F.coalesce(present, F.lit(False))).alias("present"))
    rows = rows.withColumn("text", F.when(F.col("present"), F.col("text")).otherwise("")) \
        .withColumn("sha", F.sha2(F.col("text").cast("binary"), 256)).withColumn("spread", F.monotonically_increasing_id())
    keys = ["conv", "turn", "role", "sha", "spread"]
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    kind, turn = (rows.schema[c].dataType for c in ("conv", "turn"))
    arrow = to_arrow_type(kind)
    shape = f"conv {kind.simpleString()}, {_RESULT}, {_LONG.format(turn=turn.simpleString())}, whole boolean"
    passed = stage(dealt.select("conv", "turn", "role", "text", "present").mapInArrow(partial(
        _first_pass, kind=arrow, turn_kind=to_arrow_type(turn), rows_max=rows_max, chars_max=chars_max), shape), "repair-passed")
    whole = passed.where("whole").drop("part", "at", "turn", "role", "text", "whole")
    long = passed.where("not whole").select("conv", "part", "at", "turn", "role", "text")
    return whole.unionByName(_long_results(long, kind.simpleString(), arrow)).withColumnRenamed("conv", conv_col)
