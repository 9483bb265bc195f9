"""UUID handling as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Canonical 8-4-4-4-12 hex form, and the 100-ns count between the
# Gregorian reform (1582-10-15) and the Unix epoch used by version-1 UUIDs.
UUID_PATTERN = "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
GREGORIAN_TO_UNIX_100NS = 0x01B21DD213814000


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def canonical_uuid(c) -> Column:
    """Lower-cased UUID text, NULL when it is not a UUID."""
    s = F.lower(F.trim(_c(c)))
    return F.when(s.rlike(UUID_PATTERN), s)


def is_uuid(c) -> Column:
    return F.coalesce(F.lower(_c(c)).rlike(UUID_PATTERN), F.lit(False))


def timeuuid_ticks(c) -> Column:
    """Version-1 UUID -> its 60-bit timestamp (100 ns since 1582-10-15).

    The text puts time_low first, so string order is not time order; this
    long is the sort key for journal offsets (F6).
    """
    u = F.lower(_c(c))
    hexts = F.concat(F.substring(u, 16, 3), F.substring(u, 10, 4), F.substring(u, 1, 8))
    return F.conv(hexts, 16, 10).cast("long")


def timeuuid_unix_millis(c) -> Column:
    return F.floor((timeuuid_ticks(c) - F.lit(GREGORIAN_TO_UNIX_100NS)) / F.lit(10_000)).cast("long")


def timeuuid_from_ticks(ticks, clock_seq, node) -> Column:
    """Build version-1 UUID text from a 60-bit tick count, a 14-bit clock
    sequence and a 48-bit node (all longs)."""
    h = F.lpad(F.lower(F.hex(_c(ticks))), 15, "0")
    cs = F.lpad(F.lower(F.hex(F.pmod(_c(clock_seq), F.lit(1 << 14)) + F.lit(0x8000))), 4, "0")
    nd = F.lpad(F.lower(F.hex(F.pmod(_c(node), F.lit(1 << 48)))), 12, "0")
    return F.concat_ws("-", F.substring(h, 8, 8), F.substring(h, 4, 4),
                       F.concat(F.lit("1"), F.substring(h, 1, 3)), cs, nd)


def name_uuid(name) -> Column:
    """Name-based UUID, version 3 (MD5 of the UTF-8 name), as text.

    Version nibble forced to 3, variant bits to 10.
    """
    h = F.md5(_c(name).cast("string"))
    variant_nibble = F.conv(F.substring(h, 17, 1), 16, 10).cast("int")
    variant = F.substring(F.lit("89ab"), (variant_nibble % 4) + 1, 1)
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-3"),
                    F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"),
                    F.substring(h, 21, 12))


def packed_id(c) -> Column:
    """An id text as bytes, less to shuffle and to keep: a canonical UUID as its 16, which order like the text; any
    other text behind 17 zero bytes, so that the two never meet."""
    text = _c(c)
    return F.when(text.rlike(UUID_PATTERN), F.unhex(F.replace(text, F.lit("-"), F.lit("")))) \
        .otherwise(F.concat(F.lit(bytes(17)), text.cast("binary")))


def unpacked_id(c) -> Column:
    """The text of ``packed_id``."""
    # The bytes are cut, not their digits: in a branch, Spark would make those anew for every part.
    uuid = F.lower(F.concat_ws("-", *[F.hex(F.substring(_c(c), at, n)) for at, n in ((1, 4), (5, 2), (7, 2), (9, 2), (11, 6))]))
    return F.when(F.length(_c(c)) == 16, uuid).otherwise(F.substring(_c(c), 18, 2 ** 31 - 1).cast("string"))


def with_ids(df, change, columns):
    """``df`` with ``change`` (``packed_id``, ``unpacked_id``) made to some of its columns, in place."""
    return df.select(*[change(F.col(f"`{c}`")).alias(c) if c in columns else F.col(f"`{c}`") for c in df.columns])


def random_uuid() -> Column:
    """Random (version 4) id (F8). Not reproducible across reruns; prefer
    ``name_uuid`` over stable inputs wherever a rerun must give equal ids."""
    return F.expr("uuid()")


def sql_name_uuid(expr: str) -> str:
    """The same version-3 UUID as ANSI-ish SQL text (DuckDB oracle)."""
    h = f"md5(CAST({expr} AS VARCHAR))"
    var = f"substr('89ab', ((strpos('0123456789abcdef', substr({h}, 17, 1)) - 1) % 4) + 1, 1)"
    return (f"(substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-3' || substr({h}, 14, 3) || '-' || "
            f"{var} || substr({h}, 18, 3) || '-' || substr({h}, 21, 12))")
