"""Fixed schemas of the journal, command log, snapshots and read-side tables.

Never inferred: every reader passes one of these.
"""

from __future__ import annotations

from pyspark.sql import types as T

# Event names, tags and error codes of the cart domain.
ITEM_ADDED = "ItemAdded"
ITEM_REMOVED = "ItemRemoved"
ITEM_QUANTITY_INCREASED = "ItemQuantityIncreased"
ITEM_QUANTITY_DECREASED = "ItemQuantityDecreased"
ITEM_PURCHASED = "ItemPurchased"
EVENT_TYPES = (ITEM_ADDED, ITEM_REMOVED, ITEM_QUANTITY_INCREASED,
               ITEM_QUANTITY_DECREASED, ITEM_PURCHASED)

# Journal tags, one specific tag per event type plus a general one.
TAG_ITEM_ADDED = "item-added"
TAG_ITEM_QUANTITY_INCREASED = "item-quantity-increased"
TAG_ITEM_QUANTITY_DECREASED = "item-quantity-decreased"
TAG_ITEM_PURCHASED = "item-purchased"
TAG_ITEM_REMOVED = "item-removed"
TAG_CART_EVENT = "cart-event"
TAG_BY_EVENT = {
    ITEM_ADDED: TAG_ITEM_ADDED,
    ITEM_REMOVED: TAG_ITEM_REMOVED,
    ITEM_QUANTITY_INCREASED: TAG_ITEM_QUANTITY_INCREASED,
    ITEM_QUANTITY_DECREASED: TAG_ITEM_QUANTITY_DECREASED,
    ITEM_PURCHASED: TAG_ITEM_PURCHASED,
}

# Commands and validation errors.
ADD_ITEM = "AddItem"
REMOVE_ITEM = "RemoveItem"
ADJUST_QUANTITY = "AdjustQuantity"
DISPLAY_CONTENTS = "DisplayContents"
CHECKOUT = "Checkout"
COMMANDS = (ADD_ITEM, REMOVE_ITEM, ADJUST_QUANTITY, DISPLAY_CONTENTS, CHECKOUT)

ITEM_NOT_IN_CART = "ItemNotInCart"
ITEM_ALREADY_IN_CART = "ItemAlreadyInCart"
NEGATIVE_QUANTITY = "NegativeQuantity"
EMPTY_CART_CHECKOUT = "EmptyCartCheckout"

# Names of the read sides and their tracked tag.
POPULAR_ITEMS_HYDRATOR = "popular-items-query"
VENDOR_BILLING_HYDRATOR = "vendor-billing-query"
KAFKA_PRODUCER_ID = "kafka-producer-example"

ITEM = T.StructType([
    T.StructField("product_id", T.StringType()),
    T.StructField("vendor_id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("price", T.DoubleType()),
    T.StructField("quantity", T.IntegerType()),
])

JOURNAL = T.StructType([
    T.StructField("persistence_id", T.StringType(), False),
    T.StructField("seq_nr", T.LongType(), False),
    T.StructField("offset", T.StringType()),
    T.StructField("offset_ts", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("tags", T.ArrayType(T.StringType())),
    T.StructField("cart_id", T.StringType()),
    T.StructField("item", ITEM),
    T.StructField("amount", T.IntegerType()),
    T.StructField("event_time", T.StringType()),
])

# Serialized journal: what a storage layer keeps (manifest + payload).
RAW_JOURNAL = T.StructType([
    T.StructField("persistence_id", T.StringType(), False),
    T.StructField("seq_nr", T.LongType(), False),
    T.StructField("offset", T.StringType()),
    T.StructField("offset_ts", T.LongType()),
    T.StructField("tags", T.ArrayType(T.StringType())),
    T.StructField("manifest", T.StringType()),
    T.StructField("payload", T.StringType()),
])

COMMANDS_SCHEMA = T.StructType([
    T.StructField("member_id", T.StringType(), False),
    T.StructField("seq", T.LongType(), False),
    T.StructField("command", T.StringType(), False),
    T.StructField("item", ITEM),
    T.StructField("product_id", T.StringType()),
    T.StructField("delta", T.IntegerType()),
    T.StructField("time", T.StringType()),
])

SNAPSHOT = T.StructType([
    T.StructField("persistence_id", T.StringType(), False),
    T.StructField("seq_nr", T.LongType(), False),
    T.StructField("cart_id", T.StringType()),
    T.StructField("items", T.MapType(T.StringType(), ITEM)),
])

ITEM_QUANTITY_BY_DAY = T.StructType([
    T.StructField("vendor_id", T.StringType()),
    T.StructField("product_id", T.StringType()),
    T.StructField("year", T.IntegerType()),
    T.StructField("month", T.IntegerType()),
    T.StructField("day", T.IntegerType()),
    T.StructField("quantity", T.LongType()),
    T.StructField("name", T.StringType()),
])
ITEM_QUANTITY_KEY = ["vendor_id", "product_id", "year", "month", "day"]

BALANCE = T.DecimalType(38, 18)
BILLING = T.DecimalType(21, 2)

BALANCE_BY_VENDOR = T.StructType([
    T.StructField("vendor_id", T.StringType()),
    T.StructField("year", T.IntegerType()),
    T.StructField("month", T.IntegerType()),
    T.StructField("balance", BALANCE),
])
VENDOR_BILLING = T.StructType([
    T.StructField("vendor_id", T.StringType()),
    T.StructField("year", T.IntegerType()),
    T.StructField("month", T.IntegerType()),
    T.StructField("balance", BILLING),
])
VENDOR_KEY = ["vendor_id", "year", "month"]

OFFSET_TRACKING = T.StructType([
    T.StructField("hydrator_id", T.StringType()),
    T.StructField("tag", T.StringType()),
    T.StructField("offset", T.StringType()),
])
PRODUCER_OFFSET_TRACKING = T.StructType([
    T.StructField("producer_id", T.StringType()),
    T.StructField("tag", T.StringType()),
    T.StructField("offset", T.StringType()),
])

PURCHASE_RECORD = T.StructType([
    T.StructField("time", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("price", T.DoubleType()),
    T.StructField("quantity", T.IntegerType()),
    T.StructField("productId", T.StringType()),
    T.StructField("vendorId", T.StringType()),
    T.StructField("cartId", T.StringType()),
    T.StructField("memberId", T.StringType()),
])
