"""Running (prefix) aggregates per key that do not put a hot key in one task.

A plain ``Window.partitionBy(key).orderBy(seq)`` sends every row of a key to
one task. Here the order column is cut into buckets: the window runs per
(key, bucket), a per-bucket summary (one row per key and bucket) is scanned
per key, and the carry of the earlier buckets is joined back on
(key, bucket). A key holding a third of all rows is spread over
rows / bucket_size tasks; the summary scan sees one row per bucket.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_BUCKET = 1 << 16


@dataclass(frozen=True)
class Running:
    """One running aggregate: ``out`` = kind(value) over earlier rows of the key.

    kind: "last" (latest non-null value) or "sum".
    inclusive: whether the current row counts as earlier.
    """
    out: str
    kind: str
    value: Column
    inclusive: bool = False


def running(df: DataFrame, keys: list[str], order: str, specs: list[Running],
            bucket_size: int = DEFAULT_BUCKET) -> DataFrame:
    b = "__bucket"
    df = df.withColumn(b, F.expr(f"{order} div {int(bucket_size)}"))
    for i, s in enumerate(specs):
        df = df.withColumn(f"__v{i}", s.value)

    part = keys + [b]
    w_excl = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    w_incl = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    local = []
    summary = []
    for i, s in enumerate(specs):
        v = F.col(f"__v{i}")
        w = w_incl if s.inclusive else w_excl
        if s.kind == "last":
            local.append(F.last(v, ignorenulls=True).over(w).alias(f"__l{i}"))
            summary.append(F.max_by(v, F.when(v.isNotNull(), F.col(order))).alias(f"__s{i}"))
        elif s.kind == "sum":
            local.append(F.sum(v).over(w).alias(f"__l{i}"))
            summary.append(F.sum(v).alias(f"__s{i}"))
        else:
            raise ValueError(s.kind)

    with_local = df.select("*", *local)
    buckets = df.groupBy(*part).agg(*summary)
    wb = Window.partitionBy(*keys).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    carry_cols = []
    for i, s in enumerate(specs):
        sv = F.col(f"__s{i}")
        carry_cols.append((F.last(sv, ignorenulls=True) if s.kind == "last" else F.sum(sv)).over(wb)
                          .alias(f"__c{i}"))
    carry = buckets.select(*part, *carry_cols)

    out = with_local.join(carry, part, "left")
    finals = []
    for i, s in enumerate(specs):
        lc, cc = F.col(f"__l{i}"), F.col(f"__c{i}")
        if s.kind == "last":
            finals.append(F.coalesce(lc, cc).alias(s.out))
        else:
            finals.append((F.coalesce(lc, F.lit(0)) + F.coalesce(cc, F.lit(0))).alias(s.out))
    drop = [b] + [f"__{p}{i}" for i in range(len(specs)) for p in ("v", "l", "c")]
    return out.select(*[c for c in out.columns if c not in drop], *finals)
