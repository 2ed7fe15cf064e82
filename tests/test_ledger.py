import datetime as dt
import random
from decimal import Decimal

from faultline.operators import ledger as L

REQ = "txn_id long, idempotency_key string, account_from long, account_to long, amount decimal(18,2), created_at timestamp, region string"
T0 = dt.datetime(2024, 1, 1)


def loop(requests, accounts):
    """The ledger request by request."""
    bal, done, out = dict(accounts), {}, {}
    for txn, key, f, t, amount, at, region in sorted(requests, key=lambda r: (r[5], r[6], r[0])):
        if key is not None and key in done:
            out[txn, region] = ("idempotent_hit", None, done[key])
            continue
        why = ("unknown_account_from" if f not in bal else "unknown_account_to" if t not in bal else
               "non_positive_amount" if amount is None or amount <= 0 else "insufficient_funds" if bal[f] < amount else None)
        if why is None:
            fee = max(Decimal("0.25"), round(amount * Decimal("0.001"), 2))
            bal[f] -= amount + fee
            bal[t] += amount
            if key is not None:
                done[key] = txn
        out[txn, region] = ("rejected", why, None) if why else ("processed", None, txn)
    return out, bal


def settled(spark, requests, accounts, **options):
    r = spark.createDataFrame(requests, REQ)
    a = spark.createDataFrame(list(accounts.items()), "account_id long, opening_balance decimal(18,2)")
    out = L.settle_transfers(r, a, **options).cache()
    bal = {x.account_id: x.balance for x in L.balances(a, out.where("action = 'processed'").withColumn("ledger_txn_id", out.txn_id)).collect()}
    return {(x.txn_id, x.region): (x.action, x.reason, x.ledger_txn_id) for x in out.collect()}, bal, out


def world(seed, n=240, people=12):
    rng = random.Random(seed)
    accounts = {i: Decimal(rng.randrange(0, 40000)) / 100 for i in range(people)}
    rows = []
    for i in range(n):
        amount = rng.choice([Decimal(rng.randrange(1, 30000)) / 100] * 9 + [Decimal(0), None])
        # one account sends a third of all; keys repeat, also with other amounts and accounts
        rows.append((i, rng.choice([f"k{rng.randrange(n // 2)}", None]), 0 if rng.random() < .33 else rng.randrange(people + 1), rng.randrange(people + 1),
                     amount, T0 + dt.timedelta(minutes=rng.randrange(40)), rng.choice("ab")))
    return rows, accounts


def test_equals_the_ledger_run_request_by_request(spark):
    for seed, options in ((1, {}), (2, {"replay_rows": 90})):
        requests, accounts = world(seed)
        want, bal = loop(requests, accounts)
        got, balances, out = settled(spark, requests, accounts, **options)
        assert got == want and balances == bal
        assert {w[1] for w in want.values()} == {None, "unknown_account_from", "unknown_account_to", "non_positive_amount", "insufficient_funds"}
        assert min(balances.values()) > -5  # only a fee may overdraw
        low = {(r.txn_id, r.region): r.balance_before for r in out.where("reason = 'insufficient_funds'").collect()}
        asked = {(r[0], r[6]): r[4] for r in requests}
        assert low and all(low[k] < asked[k] for k in low)


def test_chain_of_a_thousand_transfers_each_paid_by_the_one_before(spark):
    n = 1000
    accounts = {i: Decimal("1.00") for i in range(n + 1)} | {0: Decimal("5000.00")}
    requests = [(i, f"k{i}", i, i + 1, Decimal(5000 - 4 * i), T0 + dt.timedelta(seconds=i), "a") for i in range(n)]
    requests += [(5000, "k999", 999, 0, Decimal(1), T0 + dt.timedelta(days=1), "b")]
    want, bal = loop(requests, accounts)
    assert sum(w[0] == "processed" for w in want.values()) > 100 and len({w[0] for w in want.values()}) > 1
    got, balances, _ = settled(spark, requests, accounts, replay_rows=600)
    assert got == want and balances == bal


def test_no_requests(spark):
    assert settled(spark, [], {1: Decimal(5)})[0] == {}


def test_accounts_cut_to_slices_and_short_replays_equal_the_ledger(spark):
    for seed, options in ((4, {"slice_rows": 25, "replay_rows": 30}), (5, {"slice_rows": 40, "replay_rows": 3000})):
        requests, accounts = world(seed, n=200, people=6)
        want, bal = loop(requests, accounts)
        got, balances, _ = settled(spark, requests, accounts, **options)
        assert got == want and balances == bal


def test_order_within_an_account_is_decided_without_replay(spark, monkeypatch):
    """Senders that receive nothing: one pass tells all, however many are rejected."""
    def never(batches):
        raise AssertionError("replayed")

    monkeypatch.setattr(L, "_replay", never)
    rng = random.Random(9)
    accounts = {i: Decimal("500.00") for i in range(10)}
    requests = [(i, f"k{i // 2}", i // 2 % 5, 5 + i % 5, Decimal(rng.randrange(1, 30000)) / 100, T0 + dt.timedelta(minutes=i), "a") for i in range(200)]
    want, bal = loop(requests, accounts)
    assert len({w[0] for w in want.values()}) == 3
    got, balances, _ = settled(spark, requests, accounts, replay_rows=0)
    assert got == want and balances == bal


def test_accounts_listed_twice_or_without_a_balance(spark):
    requests = [(i, f"k{i}", i % 3, (i + 1) % 3, Decimal(40), T0 + dt.timedelta(minutes=i), "a") for i in range(9)]
    r = spark.createDataFrame(requests, REQ)
    a = spark.createDataFrame([(0, None), (1, Decimal(50)), (1, Decimal(50)), (2, Decimal(0)), (None, Decimal(7))], "account_id long, opening_balance decimal(18,2)")
    got = {x.txn_id: (x.action, x.balance_before) for x in L.settle_transfers(r, a).collect()}
    # 0 pays 1 whatever it has; 1 pays 2; 2 pays 0
    assert got == {i: ("processed", None) for i in (0, 3, 6)} | {1: ("processed", Decimal(90)), 4: ("processed", Decimal("89.75")), 7: ("processed", Decimal("89.50"))} | {
        2: ("processed", Decimal(40)), 5: ("rejected", Decimal("39.75")), 8: ("processed", Decimal("79.75"))}
