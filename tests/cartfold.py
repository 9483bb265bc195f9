"""A plain Python fold of the cart rules: the brute-force check the
Spark operators are checked against."""


def fold(commands):
    """commands: iterable of dicts sorted by (member_id, seq).
    Returns (verdicts {(member, seq): verdict}, events [(member, type, product, quantity, amount)],
    final {(member, product): quantity})."""
    verdicts, events, carts = {}, [], {}
    for c in commands:
        cart = carts.setdefault(c["member_id"], {})
        k, v = c["command"], None
        if k == "AddItem":
            p = c["item"]["product_id"]
            if p in cart:
                v = "ItemAlreadyInCart"
            else:
                cart[p] = c["item"]["quantity"]
                events.append((c["member_id"], "ItemAdded", p, cart[p], None))
        elif k == "RemoveItem":
            p = c["product_id"]
            if p not in cart:
                v = "ItemNotInCart"
            else:
                events.append((c["member_id"], "ItemRemoved", p, cart.pop(p), None))
        elif k == "AdjustQuantity":
            p, d = c["product_id"], c["delta"]
            if p not in cart:
                v = "ItemNotInCart"
            elif cart[p] + d > 0:
                events.append((c["member_id"], "ItemQuantityIncreased" if d > 0 else "ItemQuantityDecreased",
                               p, cart[p], abs(d)))
                cart[p] += d
            else:
                v = "NegativeQuantity"
        elif k == "Checkout":
            if not cart:
                v = "EmptyCartCheckout"
            else:
                for p in sorted(cart):
                    events.append((c["member_id"], "ItemPurchased", p, cart[p], None))
                carts[c["member_id"]] = {}
        verdicts[(c["member_id"], c["seq"])] = v
    final = {(m, p): q for m, cart in carts.items() for p, q in cart.items()}
    return verdicts, events, final
