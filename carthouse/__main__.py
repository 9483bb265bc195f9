"""Start a hydrator or the command processor as a Structured Streaming job.

    python -m carthouse popular-items   --journal J --table T --offsets O
    python -m carthouse vendor-billing  --journal J --table T --offsets O [--rounded]
    python -m carthouse vendor-billing-jdbc --journal J --jdbc-url URL [--jdbc-user U --jdbc-password P]
    python -m carthouse item-purchased-events --journal J --offsets O --topic T --partitions N
                  (--bootstrap-servers HOSTS | --fallback-path DIR)
    python -m carthouse commands        --commands C --events E

(or ``spark-submit carthouse/__main__.py ...`` with the package on the
Python path). ``--available-now`` processes what is
there and stops; otherwise the query runs until stopped, and stopping on its
own is an error (an endless source must not end).
"""

from __future__ import annotations

import argparse
import os
import sys


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="carthouse")
    sub = p.add_subparsers(dest="job", required=True)

    def common(sp, journal=True):
        if journal:
            sp.add_argument("--journal", required=True, help="journal parquet directory (file source)")
            sp.add_argument("--raw", action="store_true", help="journal holds manifest + JSON payload rows")
        sp.add_argument("--checkpoint", help="checkpoint location (default: under spark.checkpoint.dir)")
        sp.add_argument("--interval", default="10 seconds")
        sp.add_argument("--available-now", action="store_true")
        sp.add_argument("--max-files-per-trigger", type=int)

    sp = sub.add_parser("popular-items")
    common(sp)
    sp.add_argument("--table", required=True)
    sp.add_argument("--offsets", required=True)

    sp = sub.add_parser("vendor-billing")
    common(sp)
    sp.add_argument("--table", required=True)
    sp.add_argument("--offsets", required=True)
    sp.add_argument("--rounded", action="store_true", help="2-dp balances, rounded per event")

    sp = sub.add_parser("vendor-billing-jdbc")
    common(sp)
    sp.add_argument("--jdbc-url", required=True)
    sp.add_argument("--jdbc-user")
    sp.add_argument("--jdbc-password")

    sp = sub.add_parser("item-purchased-events")
    common(sp)
    sp.add_argument("--offsets", required=True)
    sp.add_argument("--topic", required=True)
    sp.add_argument("--partitions", type=int, default=1)
    sp.add_argument("--bootstrap-servers")
    sp.add_argument("--fallback-path")

    sp = sub.add_parser("commands")
    common(sp, journal=False)
    sp.add_argument("--commands", required=True, help="command log parquet directory (file source)")
    sp.add_argument("--events", required=True, help="journal directory the events are appended to")
    return p


def main(argv=None) -> int:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from carthouse.session import build_session
    from carthouse.streaming import hydrators as H

    a = _parser().parse_args(argv)
    spark = build_session(app=f"carthouse-{a.job}")
    kw = dict(checkpoint=a.checkpoint, available_now=a.available_now, interval=a.interval,
              max_files_per_trigger=a.max_files_per_trigger)
    if a.job == "popular-items":
        h = H.item_quantity_stream(spark, a.journal, a.table, a.offsets, raw=a.raw, **kw)
    elif a.job == "vendor-billing":
        h = H.vendor_balance_stream(spark, a.journal, a.table, a.offsets, rounded=a.rounded, raw=a.raw, **kw)
    elif a.job == "vendor-billing-jdbc":
        props = {k: v for k, v in (("user", a.jdbc_user), ("password", a.jdbc_password)) if v}
        h = H.vendor_balance_stream(spark, a.journal, None, None, rounded=True, jdbc=(a.jdbc_url, props),
                                    raw=a.raw, **kw)
    elif a.job == "item-purchased-events":
        h = H.purchase_feed_stream(spark, a.journal, a.offsets, a.topic, a.partitions,
                                   bootstrap_servers=a.bootstrap_servers, fallback_path=a.fallback_path, raw=a.raw, **kw)
    else:
        from carthouse.session import checkpoint_root
        from carthouse.streaming.carts import start_commands
        checkpoint = a.checkpoint or os.path.join(checkpoint_root(spark), "streams", "commands")
        q = start_commands(spark, a.commands, a.events, checkpoint, max_files_per_trigger=a.max_files_per_trigger,
                           available_now=a.available_now, interval=a.interval)
        h = H.Hydrator("commands", q)
    h.await_done(endless=not a.available_now)
    return 0


if __name__ == "__main__":
    sys.exit(main())
