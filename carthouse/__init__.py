"""carthouse: event-sourced cart analytics on PySpark.

An append-only journal of tagged cart events feeds keyed read-side tables
(item quantities per vendor/product/day, vendor balances per month), a
purchase-record feed, and cart replay / command validation. Every operator is
a DataFrame transformation; the streaming forms reuse the batch operators
inside Structured Streaming.
"""

from carthouse.session import build_session, checkpoint_root  # noqa: F401

__all__ = ["build_session", "checkpoint_root"]
