"""Cart operators: edge rows, the replay law, snapshots, and a property
test of T6/T7/T3 against a plain Python fold over random command logs."""

import os

import pytest

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from carthouse.operators import carts as C
from carthouse.plans import batch as B
from carthouse.schemas import COMMANDS_SCHEMA
from carthouse.sources import fixtures as X
from carthouse.sources.snapshots import read_snapshots, write_snapshots

from cartfold import fold
from conftest import SF_SMALL

P1, P2 = "00000000-0000-3000-8000-000000000001", "00000000-0000-3000-8000-000000000002"
VEND = "00000000-0000-3000-8000-0000000000aa"


def cmd(member, seq, command, product=None, qty=None, delta=None):
    item = (product, VEND, f"n{product[-1]}", 1.5, qty) if command == "AddItem" else None
    pid = product if command in ("RemoveItem", "AdjustQuantity") else None
    return (member, seq, command, item, pid, delta, f"2024-01-01T00:00:{seq % 60:02d}Z")


def as_dicts(rows):
    out = []
    for r in rows:
        out.append({"member_id": r[0], "seq": r[1], "command": r[2],
                    "item": None if r[3] is None else {"product_id": r[3][0], "quantity": r[3][4]},
                    "product_id": r[4], "delta": r[5]})
    return sorted(out, key=lambda d: (d["member_id"], d["seq"]))


def run(spark, rows, bucket=4):
    df = spark.createDataFrame(rows, COMMANDS_SCHEMA)
    verdicts, ends, journal = B.process_commands(df, bucket_size=bucket)
    v = {(r.member_id, r.seq): r.verdict for r in verdicts.collect()}
    ev = sorted((r.persistence_id[5:], r.event_type, r.item.product_id, r.item.quantity, r.amount)
                for r in journal.collect())
    lines = {(r.persistence_id[5:], r.product_id): r.quantity for r in C.replay_carts(journal).collect()}
    return v, ev, lines, journal


def check(spark, rows, bucket=4):
    v, ev, lines, journal = run(spark, rows, bucket)
    ev_want_v, ev_want, final = fold(as_dicts(rows))
    assert v == ev_want_v
    assert ev == sorted(ev_want)
    assert lines == final
    return journal


def test_edge_rows(spark):
    rows = [
        cmd("m1", 1, "AddItem", P1, 2), cmd("m1", 2, "AdjustQuantity", P1, delta=-2),   # NegativeQuantity
        cmd("m1", 3, "AdjustQuantity", P1, delta=0),                                    # decrease of 0
        cmd("m1", 4, "AddItem", P1, 5),                                                 # already in cart
        cmd("m1", 5, "RemoveItem", P1), cmd("m1", 6, "AddItem", P1, 7),                 # re-add counts
        cmd("m1", 7, "AddItem", P2, 0),                                                 # zero qty enters
        cmd("m1", 8, "Checkout"), cmd("m1", 9, "Checkout"),                            # 2nd is empty
        cmd("m2", 1, "Checkout"), cmd("m2", 2, "RemoveItem", P1), cmd("m2", 3, "DisplayContents"),
    ]
    v, ev, lines, journal = run(spark, rows)
    assert v[("m1", 2)] == "NegativeQuantity" and v[("m1", 3)] is None and v[("m1", 4)] == "ItemAlreadyInCart"
    assert v[("m1", 9)] == "EmptyCartCheckout" and v[("m2", 1)] == "EmptyCartCheckout"
    assert v[("m2", 2)] == "ItemNotInCart" and v[("m2", 3)] is None
    bought = journal.where(F.col("event_type") == "ItemPurchased").collect()
    assert sorted((b.item.product_id, b.item.quantity) for b in bought) == [(P1, 7), (P2, 0)]
    assert len({b.cart_id for b in bought}) == 1
    assert lines == {}
    check(spark, rows)


commands = st.lists(
    st.tuples(st.sampled_from(["m1", "m2", "m3"]),
              st.sampled_from(["AddItem", "AddItem", "RemoveItem", "AdjustQuantity", "AdjustQuantity", "Checkout"]),
              st.sampled_from([P1, P2]), st.integers(-2, 4), st.integers(-4, 4)),
    min_size=1, max_size=40)


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(commands)
def test_property_against_python_fold(spark, log):
    rows = [cmd(m, i + 1, c, p if c != "Checkout" else None, q if c == "AddItem" else None,
                d if c == "AdjustQuantity" else None)
            for i, (m, c, p, q, d) in enumerate(log)]
    check(spark, rows, bucket=3)


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(commands)
def test_property_hot_lines_cut_into_runs(spark, log):
    """Lines above 3 commands take the run-splitting path; the rest the
    plain fold; both against the Python fold."""
    rows = [cmd(m, i + 1, c, p if c != "Checkout" else None, q if c == "AddItem" else None,
                d if c == "AdjustQuantity" else None)
            for i, (m, c, p, q, d) in enumerate(log)]
    check(spark, rows, bucket=3)


def test_hot_line_with_add_remove_cycles(spark):
    rows = [cmd("m", 1, "RemoveItem", P1), cmd("m", 2, "AddItem", P1, 2), cmd("m", 3, "AddItem", P1, 9),
            cmd("m", 4, "AdjustQuantity", P1, delta=-2), cmd("m", 5, "AdjustQuantity", P1, delta=3),
            cmd("m", 6, "RemoveItem", P1), cmd("m", 7, "AdjustQuantity", P1, delta=1), cmd("m", 8, "RemoveItem", P1),
            cmd("m", 9, "AddItem", P1, 0), cmd("m", 10, "AdjustQuantity", P1, delta=-1),
            cmd("m", 11, "AdjustQuantity", P1, delta=1)]
    check(spark, rows, bucket=2)


def test_fixture_log_and_snapshot_law(spark, scratch):
    cmds = X.command_log(spark, SF_SMALL)
    rows = [tuple(r) for r in cmds.collect()]
    journal = check(spark, rows, bucket=64)
    full = {tuple(r) for r in C.replay_carts(journal).collect()}
    for cut in ("2024-01-01T12:00:00Z", "2024-01-15T00:00:00Z", "2099-01-01T00:00:00Z"):
        head = journal.where(F.col("event_time") < cut)
        snaps = C.snapshot_from_lines(C.replay_carts(head), head)
        path = os.path.join(scratch, "snap" + cut[:10])
        write_snapshots(snaps, path)
        got = {tuple(r) for r in C.replay_from_snapshot(journal, read_snapshots(spark, path)).collect()}
        assert got == full


def test_cart_contents_includes_empty_carts(spark):
    rows = [cmd("m1", 1, "AddItem", P2, 1), cmd("m1", 2, "AddItem", P1, 3), cmd("m2", 1, "AddItem", P1, 1),
            cmd("m2", 2, "Checkout")]
    df = spark.createDataFrame(rows, COMMANDS_SCHEMA)
    _, _, journal = B.process_commands(df, bucket_size=4)
    members = df.select(F.concat(F.lit("cart-"), "member_id").alias("persistence_id"))
    got = {r.persistence_id: r for r in C.cart_contents(journal, members).collect()}
    assert [i.product_id for i in got["cart-m1"].items] == [P1, P2] and got["cart-m1"].cart_id is not None
    assert got["cart-m2"].items == [] and got["cart-m2"].cart_id is None


def test_refused_checkout_keeps_the_cart(spark):
    """An empty checkout is refused and the cart (with its id) carries on;
    an accepted checkout starts a new cart."""
    rows = [cmd("m1", 1, "AddItem", P1, 1), cmd("m1", 2, "RemoveItem", P1), cmd("m1", 3, "Checkout"),
            cmd("m1", 4, "AddItem", P2, 2), cmd("m1", 5, "Checkout"), cmd("m1", 6, "AddItem", P1, 1)]
    df = spark.createDataFrame(rows, COMMANDS_SCHEMA)
    _, _, journal = B.process_commands(df, bucket_size=4)
    ev = {(r.seq_nr, r.event_type): r.cart_id for r in journal.collect()}
    first_cart = ev[(1, "ItemAdded")]
    assert ev[(2, "ItemRemoved")] == first_cart and ev[(3, "ItemAdded")] == first_cart
    assert ev[(4, "ItemPurchased")] == first_cart
    assert ev[(5, "ItemAdded")] != first_cart


def _scalar_fold(rows):
    """The cart rules one row at a time, for rows in order of their key."""
    key, line, out = None, None, []
    for r in rows:
        k = (r["member_id"], r["product"], r["epoch"], r["stretch"])
        if k != key:
            key, line = k, None
        before, verdict = line, None
        if r["command"] == "AddItem":
            if line is not None:
                verdict = "ItemAlreadyInCart"
            else:
                line = (r["add_vendor_id"], r["add_name"], r["add_price"], r["add_qty"])
        elif line is None:
            verdict = "ItemNotInCart"
        elif r["command"] == "RemoveItem":
            line = None
        elif line[3] + r["delta"] > 0:
            line = (*line[:3], line[3] + r["delta"])
        else:
            verdict = "NegativeQuantity"
        met = line if before is None else before
        out.append((verdict, before is not None, before and before[3], line is not None, line and line[3],
                    *(met[:3] if met else (None,) * 3)))
    ends = [i + 1 == len(rows) or any(rows[i][c] != rows[i + 1][c] for c in ("member_id", "product", "epoch", "stretch"))
            for i in range(len(rows))]
    return [(*o, e) for o, e in zip(out, ends)]


@pytest.mark.parametrize("size", [1, 2, 7, 5000])
def test_vectorised_fold_equals_the_rules_row_by_row(size):
    """Runs of refused changes, stretches over several batches, additions refused and lines never opened."""
    import random

    import pyarrow as pa

    from carthouse.operators.carts import _FOLD_COLS, _fold_partition
    rnd, rows = random.Random(size), []
    for member in "abc":
        for product in ("p", "q"):
            for epoch in range(4):
                for stretch in range(rnd.randint(1, 4)):
                    n, down = rnd.randint(1, 40), rnd.random() < 0.5
                    for i in range(n):
                        last = i == n - 1 and rnd.random() < 0.7
                        command = "RemoveItem" if last else rnd.choice(["AddItem"] + ["AdjustQuantity"] * (9 if i else 1))
                        delta = rnd.randint(-9, 3 if down else 9)
                        rows.append({"member_id": member, "product": product, "epoch": epoch, "stretch": stretch,
                                     "command": command, "delta": delta if command == "AdjustQuantity" else None,
                                     **({"add_qty": rnd.randint(0, 9), "add_vendor_id": f"v{len(rows)}", "add_name": f"n{len(rows)}",
                                         "add_price": rnd.random()} if command == "AddItem" else
                                        {"add_qty": None, "add_vendor_id": None, "add_name": None, "add_price": None})})
    schema = pa.schema([("member_id", pa.string()), ("product", pa.string()), ("epoch", pa.int64()), ("stretch", pa.int64()),
                        ("command", pa.string()), ("delta", pa.int32()), ("add_qty", pa.int32()), ("add_vendor_id", pa.string()),
                        ("add_name", pa.string()), ("add_price", pa.float64())])
    batches = pa.Table.from_pylist(rows, schema=schema).to_batches(max_chunksize=size)
    got = pa.Table.from_batches(list(_fold_partition(iter(batches))))
    assert [tuple(r[c] for c in _FOLD_COLS) for r in got.to_pylist()] == _scalar_fold(rows)
    assert len({v for v, *_ in _scalar_fold(rows)}) == 4
