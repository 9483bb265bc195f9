"""Scalar Column functions."""

from carthouse.functions.ids import (  # noqa: F401
    canonical_uuid, is_uuid, name_uuid, random_uuid, timeuuid_from_ticks, timeuuid_ticks,
    timeuuid_unix_millis)
from carthouse.functions.items import delta_amount, delta_event_type, parse_item_json, signed_amount  # noqa: F401
from carthouse.functions.kafka import java_string_hash, kafka_partition, purchase_record_json  # noqa: F401
from carthouse.functions.money import (  # noqa: F401
    absent_as_zero, line_total, price_from_wire, price_to_wire, to_billing)
from carthouse.functions.time import (  # noqa: F401
    calendar_fields, format_event_time, format_local_time, local_date, normalize_event_time, offset_text, parse_event_time,
    text_offset_minutes)
