"""Item JSON decoding and the sign split of a quantity delta."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from carthouse.functions.ids import canonical_uuid
from carthouse.schemas import ITEM_QUANTITY_DECREASED, ITEM_QUANTITY_INCREASED

# Fixed value: the item's JSON field names, all required.
ITEM_JSON_FIELDS = ("productId", "vendorId", "name", "price", "quantity")
_ITEM_JSON_DDL = "productId STRING, vendorId STRING, name STRING, price STRING, quantity STRING"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_item_json(text) -> Column:
    """Item JSON -> struct<item, errors>.

    ``price`` may be a number or a string; every field is required. The
    ``errors`` array names each missing or malformed field; ``item`` is NULL
    unless the array is empty.
    """
    # Bound to a name, so that the text is parsed once and not for every field and check.
    return F.transform(F.array(F.from_json(_c(text), _ITEM_JSON_DDL)), _checked_item)[0]


def _checked_item(j: Column) -> Column:
    pid, vid = canonical_uuid(j["productId"]), canonical_uuid(j["vendorId"])
    price = j["price"].try_cast("decimal(38,18)").cast("double")
    qty = F.when(j["quantity"].rlike(r"^\s*-?\d+\s*$"), j["quantity"].try_cast("int"))
    checks = [
        (pid.isNull(), "productId"),
        (vid.isNull(), "vendorId"),
        (j["name"].isNull(), "name"),
        (price.isNull(), "price"),
        (qty.isNull(), "quantity"),
    ]
    errors = F.filter(F.array(*[F.when(bad, F.lit(f"{n}: missing or invalid")) for bad, n in checks]),
                      lambda e: e.isNotNull())
    item = F.struct(pid.alias("product_id"), vid.alias("vendor_id"), j["name"].alias("name"),
                    price.alias("price"), qty.alias("quantity"))
    return F.struct(F.when(F.size(errors) == 0, item).alias("item"), errors.alias("errors"))


def delta_event_type(delta) -> Column:
    """Positive -> increased; zero or negative -> decreased."""
    return F.when(_c(delta) > 0, F.lit(ITEM_QUANTITY_INCREASED)).otherwise(F.lit(ITEM_QUANTITY_DECREASED))


def delta_amount(delta) -> Column:
    return F.abs(_c(delta)).cast("int")


def signed_amount(event_type, amount) -> Column:
    """Inverse of the split: the signed change an event applies."""
    return F.when(_c(event_type) == ITEM_QUANTITY_INCREASED, _c(amount)) \
        .when(_c(event_type) == ITEM_QUANTITY_DECREASED, -_c(amount))
