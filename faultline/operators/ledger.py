"""Ledger analytics (LED-01..06), re-aimed from the transactional service:
append-only requests are resolved with deduplication, joins and aggregations
instead of in-place row updates.  Money is DECIMAL(18,2) end to end."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.operators import series
from faultline.session import broadcast_if_small, reliable_checkpoint, ship_package

MONEY = "decimal(18,2)"
#: Cents that stand for an unknown opening balance: more than MONEY holds.
NO_BALANCE = 1 << 61


def post_transfers(requests: DataFrame, key: str = "idempotency_key",
                   order=("created_at", "region", "txn_id")) -> DataFrame:
    """LED-01: the first request per idempotency key is processed; later
    ones are ``idempotent_hit`` and carry the first request's txn id."""
    w = Window.partitionBy(key).orderBy(*order)
    first = F.first("txn_id").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return requests.select("*", F.row_number().over(w).alias("_rn"), first.alias("ledger_txn_id")) \
        .withColumn("action", F.when(F.col("_rn") == 1, "processed").otherwise("idempotent_hit")).drop("_rn")


def fees(df: DataFrame, amount: str = "amount") -> DataFrame:
    """LED-03: fee = max(0.25, round_half_even(0.001 * amount, 2)); net amount."""
    fee = F.greatest(F.lit(0.25).cast(MONEY),
                     F.bround(F.col(amount) * F.lit(0.001).cast("decimal(4,3)"), 2).cast(MONEY)).cast(MONEY)
    return df.withColumn("fee", fee).withColumn("net_amount", (F.col(amount) - F.col("fee")).cast(MONEY))


def legs(transfers: DataFrame) -> DataFrame:
    """Debit (amount + fee) and credit (amount) legs of processed transfers."""
    deb = transfers.select(F.col("account_from").alias("account_id"), "created_at", "ledger_txn_id",
                           (-(F.col("amount") + F.col("fee"))).cast(MONEY).alias("delta"))
    cre = transfers.select(F.col("account_to").alias("account_id"), "created_at", "ledger_txn_id",
                           F.col("amount").cast(MONEY).alias("delta"))
    return deb.unionByName(cre)


#: Rows of an account's course, whole numbers without nulls: its base (_pos -1) and, of a
#: sliced account, what earlier slices leave (_pos -2), then debits (_leg 0) and credits
#: (_leg 1) by position.  _what: 0 stays for the next pass, 1 is a verdict on its way to an
#: account, 2 is settled with the balance before, 3 went through with a key that occurs
#: again.  _hit and _moved: 0 no, 1 yes, 2 not known yet.  _key: the first position of a key
#: that occurs again, or -1.  _oslice: the receiver's slice, or -2 if the sender receives.
COURSE = ["_acc", "_slice", "_pos", "_leg", "_cents", "_take", "_give", "_key", "_hit", "_moved", "_other", "_oslice", "_what"]


def _course_rows(batch) -> list:
    """The batch's rows as tuples."""
    import pyarrow as pa

    columns = [batch.column(batch.schema.get_field_index(c)) for c in COURSE]
    return list(zip(*[c.to_numpy(zero_copy_only=False).tolist() if pa.types.is_integer(c.type) else c.to_pylist() for c in columns]))


def _course_batch(rows: list, schema):
    import numpy as np
    import pyarrow as pa

    kinds = [schema.field(c).type for c in COURSE]
    return pa.RecordBatch.from_arrays([pa.array(np.array(c, t.to_pandas_dtype()) if pa.types.is_integer(t) else c, t) for c, t in zip(zip(*rows), kinds)], names=COURSE)


def _follow(batches, decide: bool):
    """Accounts' courses, one after the other, each in order.  The balance is held
    between ``lo`` and ``hi``; a request that both allow, or both forbid, is decided, and
    one that stays open leaves the least and the most of both outcomes.  What comes before
    the first open row is summed into the base; later rows stay, debits with the settled
    part of their balance as ``_give``."""
    acc = cut = None
    known = base = entry = lo = hi = last = 0
    is_open, done, keys, batch = False, None, {}, None
    for batch in batches:
        out: list = []
        for row in _course_rows(batch):
            who, part, pos, leg, cents, take, give, key, hit, moved, other, oslice, what = row
            if who != acc or part != cut:
                if acc is not None and (is_open or cut >= 0):
                    out.append((acc, cut, -1, -1, base if is_open else known - entry, last, 0, -1, 0, 2, acc, -2, 0))
                acc, cut, is_open, done, keys = who, part, False, None, {}
                known = lo = hi = entry = 0
                last = -1 if cut < 0 else 1 << 62
            if pos < 0:
                if pos == -2:
                    entry, is_open, base = cents, take > 0 or give > 0, 0
                    known, lo, hi = cents, cents - take, cents + give
                else:
                    base, known, lo, hi = cents, known + cents, lo + cents, hi + cents
                    last = take if cut < 0 else last
                continue
            if pos > last or done == (pos, leg):
                continue  # no request of the account comes after it, or its verdict came before it
            done = (pos, leg) if what else None
            if leg:
                if moved == 2:
                    if not is_open:
                        is_open, base = True, known - entry
                    hi += give
                elif moved:
                    known, lo, hi = known + give, lo + give, hi + give
                if is_open and moved:
                    out.append((*row[:12], 0))
                continue
            was = known
            if moved == 2:
                if key >= 0 and keys.get(key):
                    hit = 1
                fresh = hit == 0 and key not in keys  # no earlier request of its key is open
                if decide:
                    moved = 0 if hit == 1 or hi < cents else 1 if fresh and lo >= cents else 2
                    if moved != 2:
                        if oslice > -2:
                            out.append((other, oslice, pos, 1, 0, 0, cents, -1, 0, moved, other, -2, 1))
                        if moved and key >= 0:
                            out.append((who, cut, pos, 3, 0, 0, 0, key, 0, 1, who, -2, 3))
            if moved == 2:
                if not is_open:
                    is_open, base = True, known - entry
                if hit != 1:
                    lo, hi = min(lo, max(lo, cents) - take), max(hi - take, min(hi, cents - 1) if fresh else hi)
                    if key >= 0:
                        keys.setdefault(key, False)
            elif moved:
                known, lo, hi = known - take, max(lo, cents) - take, hi - take
                if key >= 0:
                    keys[key] = True
            if is_open:
                out.append((who, cut, pos, 0, cents, take, was, key, hit, moved, other, oslice, 0))
            else:
                out.append((who, cut, pos, 0, was, 0, 0, -1, 0, moved, who, -2, 2))
        if out:
            yield _course_batch(out, batch.schema)
    if acc is not None and (is_open or cut >= 0):
        yield _course_batch([(acc, cut, -1, -1, base if is_open else known - entry, last, 0, -1, 0, 2, acc, -2, 0)], batch.schema)


def _replay(batches):
    """Open requests in order, each with the settled part of its sender's balance: what
    goes through here moves the balances of those after it.  Verdicts for both accounts."""
    gained, through = {}, set()
    for batch in batches:
        out = []
        for who, cut, pos, leg, cents, take, give, key, hit, _, other, oslice, _ in _course_rows(batch):
            ok = hit != 1 and key not in through and give + gained.get(who, 0) >= cents
            if ok:
                if key >= 0:
                    through.add(key)
                    out.append((who, cut, pos, 3, 0, 0, 0, key, 0, 1, who, -2, 3))
                gained[who] = gained.get(who, 0) - take
                if oslice > -2:
                    gained[other] = gained.get(other, 0) + cents
            out.append((who, cut, pos, 0, cents, take, give, key, hit, int(ok), other, oslice, 1))
            if oslice > -2:
                out.append((other, oslice, pos, 1, 0, 0, cents, -1, 0, int(ok), other, -2, 1))
        if out:
            yield _course_batch(out, batch.schema)


def _course_frame(df: DataFrame, types: dict, **have) -> DataFrame:
    none = {"_key": -1, "_moved": 2, "_oslice": -2}
    return df.select(*[have.get(c, have["_acc"] if c == "_other" else F.lit(none.get(c, 0))).cast(types.get(c, "long")).alias(c) for c in COURSE])


def _slices_before(course: DataFrame) -> DataFrame:
    """What the earlier slices of sliced accounts leave: settled, taken and given at most."""
    debit, credit, verdict = F.col("_leg") == 0, F.col("_leg") == 1, F.col("_what") == 1
    waits, sign = (F.col("_moved") == 2) | verdict, F.when(verdict, -1).otherwise(1)  # a verdict replaces its open row
    per = course.where("_slice >= 0").groupBy("_acc", "_slice").agg(
        F.sum(F.when(F.col("_pos") == -1, F.col("_cents")).when(credit & (F.col("_moved") == 1), F.col("_give"))
              .when(debit & (F.col("_moved") == 1), -F.col("_take")).otherwise(0)).alias("k"),
        F.sum(F.when(debit & waits, sign * F.col("_take")).otherwise(0)).alias("t"),
        F.sum(F.when(credit & waits, sign * F.col("_give")).otherwise(0)).alias("g"))
    w = Window.partitionBy("_acc").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    k, t, g = (F.coalesce(F.sum(c).over(w), F.lit(0)) for c in "ktg")
    return _course_frame(per, dict(course.dtypes), _acc=F.col("_acc"), _slice=F.col("_slice"), _pos=F.lit(-2), _leg=F.lit(-1), _cents=k, _take=t, _give=g)


def _keys_before(course: DataFrame, through: DataFrame) -> DataFrame:
    """Open requests whose key several accounts or slices share, told of the earlier
    ones: ``_hit`` is 1 if one went through, 2 if one is still open."""
    waits = F.expr("_leg = 0 and _moved = 2 and _what = 0 and _key >= 0")
    asks = waits & (F.col("_hit") == 2)
    told = course.where("_what = 1 and _leg = 0").select(F.col("_pos").alias("_told"))
    first = course.where(waits).join(told, F.col("_pos") == F.col("_told"), "left_anti").groupBy("_key").agg(F.min("_pos").alias("_open_first"))
    seen = first.join(through.groupBy("_key").agg(F.min("_pos").alias("_first")), "_key", "full")
    hit = F.when(F.col("_first") < F.col("_pos"), 1).when(F.col("_open_first") < F.col("_pos"), 2).otherwise(0)
    out = course.where(asks).join(seen, "_key", "left").withColumn("_hit", hit.cast(dict(course.dtypes)["_hit"])).select(*COURSE)
    return course.where(~asks).unionByName(out)


def _course(slim: DataFrame, accounts: DataFrame, slice_rows: int) -> tuple[DataFrame, bool, bool]:
    """Both legs of the requests and the senders' bases; whether an account is cut
    to slices (of ``slice_rows`` positions, if it has more rows) and whether a key
    is shared between accounts or slices."""
    legs = slim.select(F.col("account_from").alias("_acc"), F.col("_pos").alias("_last")).unionByName(
        slim.select(F.col("account_to").alias("_acc"), F.lit(None).cast("long").alias("_last")))
    stats = reliable_checkpoint(legs.groupBy("_acc").agg(F.count(F.lit(1)).alias("_n"), F.max("_last").alias("_last")))
    large = stats.where(F.col("_n") > slice_rows).select(F.col("_acc").alias("_large"))
    sliced = not large.isEmpty()
    slim = slim.withColumn("_fs", F.lit(-1)).withColumn("_ts", F.lit(-1))
    if sliced:
        large, part = reliable_checkpoint(large), F.floor(F.col("_pos") / slice_rows).cast("long")
        for account, name in (("account_from", "_fs"), ("account_to", "_ts")):
            slim = slim.join(broadcast_if_small(large), F.col(account) == F.col("_large"), "left").withColumn(
                name, F.when(F.col("_large").isNotNull(), part).otherwise(-1)).drop("_large")
    mine = F.col("account_from") == F.col("account_to")
    shared = (F.col("_key") >= 0) & (~F.col("_one_sender") | (F.col("_fs") >= 0))
    account = dict(stats.dtypes)["_acc"]
    types = {"_acc": account, "_other": account, "_leg": "int", "_hit": "int", "_moved": "int", "_what": "int"}
    debits = _course_frame(slim, types, _acc=F.col("account_from"), _slice=F.col("_fs"), _pos=F.col("_pos"), _cents=F.col("_cents"),
                           _take=F.col("_fee") + F.when(mine, 0).otherwise(F.col("_cents")), _key=F.col("_key"), _hit=F.when(shared, 2).otherwise(0),
                           _other=F.col("account_to"), _oslice=F.when(mine, -2).otherwise(F.col("_ts")))
    credits = _course_frame(slim.where(~mine), types, _acc=F.col("account_to"), _slice=F.col("_ts"), _pos=F.col("_pos"), _leg=F.lit(1), _give=F.col("_cents"))
    opening = accounts.groupBy(F.col("account_id").alias("_id")).agg(F.coalesce((F.min("opening_balance") * 100).cast("long"), F.lit(NO_BALANCE)).alias("_cents"))
    bases = stats.where("_last is not null").join(opening, F.col("_acc") == F.col("_id"))
    bases = _course_frame(bases, types, _acc=F.col("_acc"), _slice=F.when(F.col("_n") > slice_rows, 0).otherwise(-1), _pos=F.lit(-1), _leg=F.lit(-1),
                          _cents=F.col("_cents"), _take=F.col("_last"))
    return debits.unionByName(credits).unionByName(bases), sliced, not slim.where(shared).isEmpty()


def settle_transfers(requests: DataFrame, accounts: DataFrame, key: str = "idempotency_key", order=("created_at", "region", "txn_id"),
                     replay_rows: int = 200_000, slice_rows: int = 500_000) -> DataFrame:
    """LED-01/02 exactly, in the order of ``order`` (unique): a request whose key
    has gone through before is an ``idempotent_hit``; others are rejected if an
    account is unknown, the amount is not positive, or the sender's balance at that
    moment, after all transfers that did go through, is below the amount.  A key
    whose request was rejected may try again.

    A rejection changes later balances, so no single prefix sum tells.  Each pass
    follows every account through its open rows with the least and the greatest balance
    it can have, and sends what it decides to the receivers; what comes before an
    account's first open row is settled and leaves the job, so passes get smaller.  An
    account with more than ``slice_rows`` rows is cut to slices, entered with the sums of
    the earlier ones, so no task holds it whole.  The earliest open request is always
    decided.  A pass that decides less than a tenth, or leaves ``replay_rows`` or fewer, is
    followed by a replay of the earliest ``replay_rows`` open ones in order in one task of that
    bound, so a chain of dependent transfers takes its length over ``replay_rows``
    rounds.  Null keys are keys of their own request; a null account is unknown, a
    null amount not positive.  An account without an opening balance lacks no funds, and has
    no balance; one that is listed again counts once."""
    spark = requests.sparkSession
    ship_package(spark)
    place = series.cumulative(requests.withColumn("_one", F.lit(1).cast("long")), None, list(order), ["_one"])
    base = place.withColumn("_pos", F.col("cum__one")).drop("_one", "cum__one")
    known = accounts.select("account_id").distinct()
    base = (base.join(known.select(F.col("account_id").alias("_f")), F.col("account_from") == F.col("_f"), "left")
            .join(known.select(F.col("account_id").alias("_t")), F.col("account_to") == F.col("_t"), "left"))
    reason = (F.when(F.col("_f").isNull(), "unknown_account_from").when(F.col("_t").isNull(), "unknown_account_to")
              .when(~F.coalesce(F.col("amount") > 0, F.lit(False)), "non_positive_amount"))
    base = reliable_checkpoint(fees(base.withColumn("_static", reason).drop("_f", "_t")).withColumn("_k", F.col(key).cast("string")))
    # a key that occurs again is known by its first position
    sender = F.when(F.col("_static").isNull(), F.col("account_from"))
    again = reliable_checkpoint(base.where("_k is not null").groupBy("_k").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_pos").alias("_key"), F.min(sender).eqNullSafe(F.max(sender)).alias("_one_sender")).where("_n > 1").drop("_n"))
    slim = base.select("_pos", "_k", "_static", "txn_id", "account_from", "account_to", (F.col("amount") * 100).cast("long").alias("_cents"),
                       (F.col("fee") * 100).cast("long").alias("_fee")).join(again, "_k", "left").drop("_k")
    slim = reliable_checkpoint(slim.withColumn("_key", F.coalesce("_key", F.lit(-1))).withColumn("_one_sender", F.coalesce("_one_sender", F.lit(True))))
    valid = slim.where("_static is null")
    course, sliced, shared = _course(valid, accounts, slice_rows)
    schema = ", ".join(f"{c} {t}" for c, t in course.dtypes)
    settled, through, decide, left = [], [], True, valid.count()
    while left:
        if shared:
            course = _keys_before(course, reduce(DataFrame.unionByName, through) if through else course.where("_what = 3"))
        if sliced:
            course = course.unionByName(_slices_before(course))
        course = reliable_checkpoint(course.repartition("_acc", "_slice").sortWithinPartitions("_acc", "_slice", "_pos", "_leg", F.col("_what").desc())
                                     .mapInArrow(lambda batches, decide=decide: _follow(batches, decide), schema))
        debit = F.expr("_what = 0 and _leg = 0")
        open_ = debit & (F.col("_moved") == 2)
        n = course.agg(F.count(F.when(debit, 1)).alias("kept"), F.count(F.when(open_, 1)).alias("open")).first()
        settled.append(course.where("_what = 2").select("_pos", "_cents", "_moved"))
        through.append(course.where("_what = 3").select("_key", "_pos"))
        rest = course.where("_what < 2")
        if not decide and n.open:
            # balances as they are after the last pass, then the earliest in order
            first = course.where(open_)
            if n.open > replay_rows:
                first = first.where(F.col("_pos") <= max(series.kth_values(first, "_pos", [replay_rows - 1]).values()))
            said = reliable_checkpoint(first.repartition(1).sortWithinPartitions("_pos").mapInArrow(_replay, schema))
            through.append(said.where("_what = 3").select("_key", "_pos"))
            rest, decide = rest.unionByName(said.where("_what = 1")), True
        else:
            decide = not (n.open and (n.open <= replay_rows or left - n.open < left // 10))
        course, left = rest, n.open or n.kept
    at = reduce(DataFrame.unionByName, settled) if settled else spark.createDataFrame([], "_pos long, _cents long, _moved int")
    # of keys that occur again, the request that went through
    keyed = slim.where("_key >= 0").select("_key", "_pos", "txn_id")
    first = keyed.join(at.where("_moved = 1").select("_pos"), "_pos", "left_semi").select("_key", F.col("_pos").alias("_done_pos"), F.col("txn_id").alias("_done_txn"))
    hits = keyed.drop("txn_id").join(first, "_key").where("_done_pos < _pos").select("_pos", "_done_txn", F.lit(True).alias("_was"))
    out = base.join(at.withColumnRenamed("_cents", "_at"), "_pos", "left").join(hits, "_pos", "left")
    mine = F.col("_moved") == 1
    out = out.withColumn("balance_before", (F.when(F.col("_at") < NO_BALANCE // 2, F.col("_at")) / F.lit(100).cast("decimal(3,0)")).cast(MONEY))
    out = out.withColumn("ledger_txn_id", F.when(mine, F.col("txn_id")).when(F.col("_was"), F.col("_done_txn")))
    out = out.withColumn("action", F.when(mine, "processed").when(F.col("_was"), "idempotent_hit").otherwise("rejected"))
    return (out.withColumn("reason", F.when(F.col("action") == "rejected", F.coalesce("_static", F.lit("insufficient_funds"))))
            .drop("_pos", "_k", "_static", "_at", "_moved", "_done_txn", "_was"))


def validate_transfers(posted: DataFrame, accounts: DataFrame) -> DataFrame:
    """LED-02 on the first request of each key (``action`` of :func:`post_transfers`):
    rejected when an account is unknown, the amount is not positive, or the sender's
    balance just before, after all transfers that went through, is below the amount."""
    first = posted.filter(F.col("action") == "processed").drop("action", "ledger_txn_id")
    out = settle_transfers(first, accounts, key="txn_id")
    return out.withColumn("ledger_txn_id", F.col("txn_id")).withColumn(
        "status", F.when(F.col("action") == "processed", "completed").otherwise("rejected"))


def balances(accounts: DataFrame, completed: DataFrame) -> DataFrame:
    """LED-04: opening - sum(amount+fee) sent + sum(amount) received."""
    d = legs(completed).groupBy("account_id").agg(F.sum("delta").alias("_d"))
    return (accounts.join(d, "account_id", "left")
            .select("account_id", "opening_balance",
                    (F.col("opening_balance") + F.coalesce(F.col("_d"), F.lit(0).cast(MONEY))).cast(MONEY)
                    .alias("balance")))


def reconcile(posted: DataFrame, key: str = "idempotency_key") -> DataFrame:
    """LED-05: every key debited exactly once, whichever region served it."""
    return posted.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_requests"),
        F.sum(F.when(F.col("action") == "processed", 1).otherwise(0)).alias("n_processed"),
        F.count_distinct("region").alias("n_regions"),
        F.count_distinct("ledger_txn_id").alias("n_txn_ids")) \
        .withColumn("debited_once", (F.col("n_processed") == 1) & (F.col("n_txn_ids") == 1))


def audit_summary(posted: DataFrame) -> DataFrame:
    """LED-06: requests and amounts by action and region."""
    return posted.groupBy("action", "region").agg(F.count(F.lit(1)).alias("requests"),
                                                  F.sum("amount").cast(MONEY).alias("amount"))
