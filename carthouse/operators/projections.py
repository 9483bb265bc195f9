"""Projections of journal rows and the two bad-record policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carthouse.functions.ids import canonical_uuid
from carthouse.functions.money import line_total, to_billing
from carthouse.functions.time import calendar_fields, normalize_event_time, parse_event_time
from carthouse.schemas import EVENT_TYPES, ITEM_PURCHASED, TAG_BY_EVENT, TAG_CART_EVENT

STRICT = "strict"
PERMISSIVE = "permissive"


def require(value: Column, ok: Column, message: str) -> Column:
    """P4 building block: ``value`` where ``ok`` holds, else fail the query.

    Used on columns that are actually selected so the check cannot be pruned.
    """
    return F.when(F.coalesce(ok, F.lit(False)), value).otherwise(F.raise_error(F.lit(message)))


def _purchase_ok() -> Column:
    return (F.col("event_type") == ITEM_PURCHASED) & F.col("cart_id").isNotNull() & F.col("item").isNotNull()


def _gate(journal: DataFrame, policy: str) -> tuple[DataFrame, Column]:
    """Common gate of P1-P3.

    strict (P4): anything under the tag that is not a complete purchase fails
    the query; the returned condition is folded into a selected column.
    permissive (P5): rows without a cart id or item are dropped silently;
    present-but-malformed ids and times still fail.
    """
    if policy == PERMISSIVE:
        return journal.where(_purchase_ok()), F.lit(True)
    if policy != STRICT:
        raise ValueError(f"unknown policy {policy!r}")
    return journal, _purchase_ok()


def _parsed(journal: DataFrame, ok: Column, ids: dict, **rest) -> DataFrame:
    """What the checks look at, worked out once for a row: ``ids`` as canonical text, the time's instant, whether the row
    is ``ok``. Inside the checks, which are branches, Spark would work it out again wherever it stands."""
    return journal.select("offset", "offset_ts", "event_time", ok.alias("ok"), parse_event_time("event_time").alias("instant"),
                          *[canonical_uuid(c).alias(name) for name, c in ids.items()], *[c.alias(name) for name, c in rest.items()])


def _checked_uuid(name: str, what: str) -> Column:
    u = F.col(name)
    return require(u, F.col("ok") & u.isNotNull(), f"malformed ItemPurchased event: bad or missing {what}")


def _checked_time() -> Column:
    return require(F.col("event_time"), F.col("ok") & F.col("instant").isNotNull(), "malformed ItemPurchased event: bad time")


def _dated(checked: DataFrame, names=("year", "month", "day")) -> DataFrame:
    """``time`` gives way to its calendar fields: a step of its own, so that it is checked once and not for every field."""
    return checked.select(*[c for c in checked.columns if c != "time"], *calendar_fields("time", names))


def project_item_quantity(journal: DataFrame, policy: str = STRICT) -> DataFrame:
    """Purchase -> (offset, offset_ts, product, vendor, name, quantity, y, m, d)."""
    df, ok = _gate(journal, policy)
    parsed = _parsed(df, ok, {"product": F.col("item.product_id"), "vendor": F.col("item.vendor_id")},
                     name=F.col("item.name"), quantity=F.col("item.quantity"))
    return _dated(parsed.select(
        "offset", "offset_ts",
        _checked_uuid("product", "product id").alias("product_id"),
        _checked_uuid("vendor", "vendor id").alias("vendor_id"),
        "name", "quantity",
        _checked_time().alias("time"),
    ))


def project_vendor_charge(journal: DataFrame, policy: str = STRICT) -> DataFrame:
    """Purchase -> (offset, time, vendor, exact total, 2-dp total, y, m)."""
    df, ok = _gate(journal, policy)
    ok = ok & F.col("item.product_id").isNotNull()  # present, though not parsed here
    parsed = _parsed(df, ok, {"vendor": F.col("item.vendor_id")}, total=line_total(F.col("item.price"), F.col("item.quantity")))
    return _dated(parsed.select(
        "offset", "offset_ts",
        F.col("instant").alias("time_purchased"),
        _checked_uuid("vendor", "vendor id").alias("vendor_id"),
        "total",
        to_billing(F.col("total")).alias("total_2dp"),
        _checked_time().alias("time"),
    ), ("year", "month"))


def project_item_details(journal: DataFrame, policy: str = PERMISSIVE) -> DataFrame:
    """Purchase -> record fields; memberId is the persistence id."""
    df, ok = _gate(journal, policy)
    parsed = _parsed(df, ok, {"product": F.col("item.product_id"), "vendor": F.col("item.vendor_id"), "cart": F.col("cart_id")},
                     name=F.col("item.name"), price=F.col("item.price"), quantity=F.col("item.quantity"), member=F.col("persistence_id"))
    checked = parsed.select(
        "offset", "offset_ts",
        _checked_time().alias("time"),
        "name", "price", "quantity",
        _checked_uuid("product", "product id").alias("productId"),
        _checked_uuid("vendor", "vendor id").alias("vendorId"),
        _checked_uuid("cart", "cart id").alias("cartId"),
        F.col("member").alias("memberId"),
    )
    return checked.withColumn("time", normalize_event_time("time", checked=True))


def tag_events(events: DataFrame) -> DataFrame:
    """tags = {specific tag, 'cart-event'}; unknown event types stay untagged."""
    specific = F.create_map(*[x for k in EVENT_TYPES for x in (F.lit(k), F.lit(TAG_BY_EVENT[k]))])
    tag = specific[F.col("event_type")]
    return events.withColumn(
        "tags", F.when(tag.isNotNull(), F.array(tag, F.lit(TAG_CART_EVENT))).otherwise(F.array().cast("array<string>")))


def storage_tag(tags) -> Column:
    """The specific tag a journal row is stored under (NULL: untagged)."""
    return F.filter(tags, lambda t: t != F.lit(TAG_CART_EVENT))[0]


def filter_tag(journal: DataFrame, tag: str) -> DataFrame:
    """P7. ``array_contains`` is not pushed into parquet; a stored journal is
    laid out by tag, so there the directory of the tag is read and no other.
    Only the tag decides: a row under it that is no event of its kind reaches
    the strict projections, which fail on it."""
    df = journal.where(F.array_contains("tags", tag))
    if "tag" in journal.columns and tag != TAG_CART_EVENT:
        df = df.where(F.col("tag") == tag)
    return df


def after_offset(journal: DataFrame, after: tuple | int | None) -> DataFrame:
    """Strictly after a stored offset; no offset means from the start.

    ``after`` is (offset_ts, offset): events of the same time follow in the
    order of the offset's text. A bare time means after every event of it.
    """
    if after is None:
        return journal
    if not isinstance(after, tuple):
        return journal.where(F.col("offset_ts") > F.lit(int(after)))
    ts, offset = after
    # The first condition is implied by the second and is what the scan can use.
    return journal.where((F.col("offset_ts") >= F.lit(int(ts)))
                         & ((F.col("offset_ts") > F.lit(int(ts))) | (F.col("offset") > F.lit(offset))))
