"""Registered queries: ledger analytics (LED-*) on orders/customer."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultline.operators import ledger as L
from faultline.plans.catalog import register
from faultline.sources import fixtures as FX

LW0 = FX.ledger_sql() + """,
posted AS (SELECT *, row_number() OVER w AS rn, first_value(txn_id) OVER w AS ledger_txn_id,
                  CASE WHEN row_number() OVER w = 1 THEN 'processed' ELSE 'idempotent_hit' END AS action
           FROM transfers WINDOW w AS (PARTITION BY idempotency_key ORDER BY created_at, region, txn_id
                                       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
p0 AS (SELECT p.*, CAST(greatest(CAST(0.25 AS DECIMAL(18,2)),
                   CAST(round_even(p.amount * CAST(0.001 AS DECIMAL(4,3)), 2) AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS fee,
              CASE WHEN af.account_id IS NULL THEN 'unknown_account_from'
                   WHEN ato.account_id IS NULL THEN 'unknown_account_to'
                   WHEN p.amount <= 0 THEN 'non_positive_amount' END AS reason0
       FROM posted p LEFT JOIN accounts af ON af.account_id = p.account_from
                     LEFT JOIN accounts ato ON ato.account_id = p.account_to WHERE p.action = 'processed'),
"""
VAL = """,
val AS (SELECT p0.*, l.reason, l.balance_before
        FROM p0 LEFT JOIN settled l ON l.txn_id = p0.txn_id AND l.region = p0.region)
"""


def _settled_sql(rows: str, key: str) -> str:
    """The ledger in waves: an account or a key serves its requests one by one
    (``n`` is the next), and a request runs when it is next at both accounts and at
    its key.  ``led`` keeps balances, the transfer that went through by key, and a
    verdict per request ('r')."""
    return f"""
req AS (SELECT q.*, row_number() OVER (ORDER BY created_at, region, txn_id) AS i, 'a' || account_from AS oa, 'a' || account_to AS ot, 'k' || {key} AS ok,
          CAST(amount * 100 AS BIGINT) AS c, CAST(greatest(25, 100 * round_even(amount * CAST(0.001 AS DECIMAL(4,3)), 2)) AS BIGINT) AS f,
          CASE WHEN af.account_id IS NULL THEN 'unknown_account_from' WHEN ato.account_id IS NULL THEN 'unknown_account_to'
               WHEN amount <= 0 THEN 'non_positive_amount' END AS reason0
        FROM {rows} q LEFT JOIN accounts af ON af.account_id = q.account_from LEFT JOIN accounts ato ON ato.account_id = q.account_to),
turn AS (SELECT i, o, row_number() OVER (PARTITION BY o ORDER BY i) AS n
         FROM (SELECT i, oa AS o FROM req UNION SELECT i, ot FROM req UNION SELECT i, ok FROM req)),
todo AS MATERIALIZED (SELECT req.*, x.n AS na, y.n AS nt, z.n AS nk FROM req JOIN turn x ON x.i = req.i AND x.o = oa
         JOIN turn y ON y.i = req.i AND y.o = ot JOIN turn z ON z.i = req.i AND z.o = ok),
led(k, v, n, s) USING KEY (k) AS (
  SELECT o, CAST(any_value(opening_balance) * 100 AS BIGINT), 1::BIGINT, '' FROM turn LEFT JOIN accounts ON o = 'a' || account_id GROUP BY o
  UNION
  SELECT u.k, u.v, u.n, u.s FROM (
    SELECT unnest([{{'k': 'r' || i, 'v': bal, 'n': 0::BIGINT, 's': said}}, {{'k': ok, 'v': CASE WHEN pass THEN txn_id ELSE hit END, 'n': nk + 1, 's': ''}},
      {{'k': oa, 'v': CASE WHEN pass THEN bal - c - f + CASE WHEN oa = ot THEN c ELSE 0 END ELSE bal END, 'n': na + 1, 's': ''}}]
      || CASE WHEN oa = ot THEN [] ELSE [{{'k': ot, 'v': CASE WHEN pass THEN tbal + c ELSE tbal END, 'n': nt + 1, 's': ''}}] END) AS u
    FROM (SELECT *, said = 'processed' AS pass
          FROM (SELECT todo.*, h.v AS hit, a.v AS bal, t.v AS tbal,
                  CASE WHEN h.v IS NOT NULL THEN 'idempotent_hit' WHEN reason0 IS NOT NULL THEN reason0
                       WHEN a.v < c THEN 'insufficient_funds' ELSE 'processed' END AS said
                FROM todo JOIN recurring.led a ON a.k = oa AND a.n = na JOIN recurring.led t ON t.k = ot AND t.n = nt
                JOIN recurring.led h ON h.k = ok AND h.n = nk)))),
settled AS (
  SELECT req.*, CASE WHEN l.s IN ('processed', 'idempotent_hit') THEN l.s ELSE 'rejected' END AS verdict,
    CASE WHEN l.s NOT IN ('processed', 'idempotent_hit') THEN l.s END AS reason,
    CASE WHEN l.s IN ('processed', 'idempotent_hit') THEN d.v END AS done_txn,
    CASE WHEN reason0 IS NULL THEN CAST(CAST(l.v AS DECIMAL(20,0)) / 100 AS DECIMAL(18,2)) END AS balance_before
  FROM req JOIN led l ON l.k = 'r' || req.i JOIN led d ON d.k = ok)"""


LW = ("WITH RECURSIVE " + LW0 + "first AS (SELECT idempotency_key, txn_id, account_from, account_to, amount, created_at, region FROM posted WHERE action = 'processed'),"
      + _settled_sql("first", "txn_id") + VAL)
ALL = "WITH RECURSIVE " + FX.ledger_sql() + ", " + _settled_sql("transfers", "idempotency_key")


def _posted(spark, sf):
    return L.post_transfers(FX.transfers(spark, sf))


@register("led_post_transfers", LW + "SELECT idempotency_key, region, txn_id, ledger_txn_id, action FROM posted")
def q_post(spark, sf):
    return _posted(spark, sf).select("idempotency_key", "region", "txn_id", "ledger_txn_id", "action")


@register("led_fees", LW + """SELECT txn_id, amount, fee, CAST(amount - fee AS DECIMAL(18,2)) AS net_amount FROM p0""")
def q_fees(spark, sf):
    p = _posted(spark, sf).filter(F.col("action") == "processed")
    return L.fees(p).select("txn_id", "amount", "fee", "net_amount")


@register("led_validate_transfers", LW + """
SELECT txn_id, reason, CASE WHEN reason IS NULL THEN 'completed' ELSE 'rejected' END AS status, balance_before FROM val""")
def q_validate(spark, sf):
    v = L.validate_transfers(_posted(spark, sf), FX.accounts(spark, sf))
    return v.select("txn_id", "reason", "status", "balance_before")


@register("led_settle_transfers", ALL + """
SELECT txn_id, region, verdict AS action, reason, CAST(done_txn AS VARCHAR) AS ledger_txn_id, balance_before FROM settled""")
def q_settle(spark, sf):
    """Every request, replays and retries included, in order of arrival."""
    return L.settle_transfers(FX.transfers(spark, sf), FX.accounts(spark, sf)).select(
        "txn_id", "region", "action", "reason", F.col("ledger_txn_id").cast("string").alias("ledger_txn_id"), "balance_before")


@register("led_balances", LW + """, done AS (SELECT * FROM val WHERE reason IS NULL),
d AS (SELECT account_id, sum(delta) AS d FROM (
        SELECT account_from AS account_id, CAST(-(amount + fee) AS DECIMAL(18,2)) AS delta FROM done
        UNION ALL SELECT account_to, CAST(amount AS DECIMAL(18,2)) FROM done) GROUP BY 1)
SELECT a.account_id, a.opening_balance, CAST(a.opening_balance + coalesce(d.d, 0) AS DECIMAL(18,2)) AS balance
FROM accounts a LEFT JOIN d USING (account_id)""")
def q_balances(spark, sf):
    v = L.validate_transfers(_posted(spark, sf), FX.accounts(spark, sf))
    return L.balances(FX.accounts(spark, sf), v.filter(F.col("status") == "completed"))


@register("led_reconcile", LW + """
SELECT idempotency_key, count(*) AS n_requests, sum(CASE WHEN action = 'processed' THEN 1 ELSE 0 END) AS n_processed,
       count(DISTINCT region) AS n_regions, count(DISTINCT ledger_txn_id) AS n_txn_ids,
       sum(CASE WHEN action = 'processed' THEN 1 ELSE 0 END) = 1 AND count(DISTINCT ledger_txn_id) = 1 AS debited_once
FROM posted GROUP BY 1""")
def q_reconcile(spark, sf):
    return L.reconcile(_posted(spark, sf))


@register("led_audit_summary", LW + """
SELECT action, region, count(*) AS requests, CAST(sum(amount) AS DECIMAL(18,2)) AS amount FROM posted GROUP BY 1, 2""")
def q_audit_summary(spark, sf):
    return L.audit_summary(_posted(spark, sf))
