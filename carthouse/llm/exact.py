"""Operator 3, exact dedup with a heavy-hitter split (DataFrame functions only).

Texts are equal when identical after white space is deleted. A Misra-Gries
style summary (Spark's mergeable frequent-items sketch) names the digests that
may be frequent; one pass verifies them and finds each one's winner. These few
winners are broadcast, so copies of a hot text are settled where they are
read; the other digests, none of them frequent, use an ordinary shuffle.

Defined cases: a null text counts as empty, and all empty or blank texts are
one group; the row with the most code points in its original text stays, then
the one with the smallest id (an id comes before null); of repeated rows (same
id, same text) exactly one stays; an empty table gives an empty result; other
columns are carried through ``drop_copies`` untouched whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from carthouse.llm.common import HEAVY_SHARE, SPACE, packed, stage, unpacked

#: Counters of the frequent-items summary: a digest with at least 1/HEAVY_SHARE of the rows is always tracked.
COUNTERS = 16 * HEAVY_SHARE


def text_digest(text):
    """Lower-case hex SHA-256 of the text without white space."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE + "+", "").cast("binary"), 256)


def _fingerprints(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One slim row (id, sha, n, copies) per distinct id, digest and length."""
    text = F.col(text_col)
    slim = df.select(F.col(id_col).alias("id"), text_digest(text).alias("sha"),
                     F.length(F.coalesce(text, F.lit(""))).alias("n"))
    return stage(slim.groupBy("id", "sha", "n").agg(F.count(F.lit(1)).alias("copies")), "exact-fingerprints")


def _winner():
    """The best (n, id) of a group: most code points, then the smallest id, null last."""
    best = F.min(F.struct(-F.col("n"), F.col("id").isNull(), F.col("id")))
    return [best["id"].alias("keep_id"), (-best["col1"]).alias("keep_n"), F.sum("copies").alias("group_size")]


def _with_winner(slim: DataFrame) -> DataFrame:
    """Each slim row with its group's winner and size."""
    # One row: at most HEAVY_SHARE digests.
    tracked = slim.select(F.explode(F.expr(f"approx_top_k(sha, {HEAVY_SHARE}, {COUNTERS})")).alias("t"))
    names = tracked.select(F.col("t.item").alias("sha"))
    heavy = stage(slim.join(F.broadcast(names), "sha", "left_semi").groupBy("sha").agg(*_winner()), "exact-heavy")
    hot = slim.join(F.broadcast(heavy), "sha")
    rest = slim.join(F.broadcast(heavy.select("sha")), "sha", "left_anti")
    group = Window.partitionBy("sha")
    best = F.min(F.struct(-F.col("n"), F.col("id").isNull(), F.col("id"))).over(group)
    cold = rest.select("*", best.alias("b"), F.sum("copies").over(group).alias("group_size")).select(
        *slim.columns, F.col("b.id").alias("keep_id"), (-F.col("b.col1")).alias("keep_n"), "group_size")
    return hot.select(cold.columns).unionByName(cold)


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id_col, keep_id, group_size, kept, text_sha256."""
    rows = _with_winner(_fingerprints(df, id_col, text_col))
    stays = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("n") == F.col("keep_n"))
    return rows.select(F.col("id").alias(id_col), "keep_id", "group_size", stays.alias("stays"),
                       F.col("sha").alias("text_sha256"),
                       F.posexplode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("nth", "x")).select(
        id_col, "keep_id", "group_size", (F.col("stays") & (F.col("nth") == 0)).alias("kept"), "text_sha256")


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, one per group of equal texts, with all their columns."""
    rows = _with_winner(_fingerprints(df, id_col, text_col))
    stay = rows.where(F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("n") == F.col("keep_n"))).select("id", "sha")
    text = F.col("row").getField(text_col)
    full = packed(df).select("row", F.col("row").getField(id_col).alias("id"), text_digest(text).alias("sha"),
                             F.length(F.coalesce(text, F.lit(""))).alias("n"))
    stay = stay.withColumnsRenamed({"id": "stay_id", "sha": "stay_sha"})
    met = full.join(stay, (F.col("sha") == F.col("stay_sha")) & F.col("id").eqNullSafe(F.col("stay_id")), "left_semi")
    # Repeated rows share the join's key, so this window needs no further shuffle.
    nth = F.row_number().over(Window.partitionBy("sha", "id").orderBy(F.desc("n")))
    return unpacked(met.select("row", nth.alias("nth")).where(F.col("nth") == 1), df.columns)
