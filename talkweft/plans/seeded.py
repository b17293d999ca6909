"""Registered queries over ``operators.seeds``, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import seeds as R
from .catalog import query

_OWNED = "list(struct_pack(k := o_orderkey, s := o_orderstatus, p := o_totalprice) ORDER BY o_orderkey)"


@query("", """SELECT 'customer' AS name, c_custkey AS customer_id, NULL AS item, NULL AS amount FROM customer
UNION ALL SELECT 'transfers', o_custkey, o_orderkey, round(o_totalprice * 100)::BIGINT FROM orders
UNION ALL SELECT 'service_cases', o_custkey, o_orderkey, NULL FROM orders WHERE o_orderstatus = 'O'""")
def seed_tables(spark: SparkSession, d: str) -> DataFrame:
    """Orders stand for a customer's transfers, open ones for cases; each seed row nests them."""
    orders = spark.read.parquet(f"{d}/orders.parquet")
    nested = orders.groupBy(F.col("o_custkey").alias("customer_id")).agg(
        F.collect_list(F.struct(F.col("o_orderkey").alias("transfer_id"), F.round(F.col("o_totalprice") * 100).cast("long").alias("amount_cents"))).alias("transfers"),
        F.collect_list(F.when(F.col("o_orderstatus") == "O", F.struct(F.col("o_orderkey").alias("case_id")))).alias("service_cases"),
    )
    payload = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("display_name")).join(nested, "customer_id", "left")
    t = R.bank_tables(payload)
    none = F.lit(None).cast("long")
    return (
        t["customer"].select(F.lit("customer").alias("name"), "customer_id", none.alias("item"), none.alias("amount"))
        .union(t["transfers"].select(F.lit("transfers"), "customer_id", "transfer_id", "amount_cents"))
        .union(t["service_cases"].select(F.lit("service_cases"), "customer_id", "case_id", none))
    )


_MONEY = "'$' || format('{{:,}}', {0} // 100) || '.' || lpad(({0} % 100)::VARCHAR, 2, '0')"


@query("orders", f"""WITH o AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, o_orderstatus AS s, round(o_totalprice * 100)::BIGINT AS c FROM orders),
g AS (SELECT o_custkey, string_agg('- **Account ' || o_orderkey || ' ····' || lpad((o_orderkey % 10000)::VARCHAR, 4, '0') || '** — ' || {_MONEY.format("c")} || ' available; ' || {_MONEY.format("(c + 5)")} || ' current', chr(10) ORDER BY n) AS a,
string_agg('- **Card ' || o_orderkey || ' ····' || lpad((o_orderkey % 10000)::VARCHAR, 4, '0') || '** — `' || s || '`', chr(10) ORDER BY n) FILTER (o_orderkey % 2 = 0) AS k,
string_agg('- To ' || o_orderkey || ' — ' || {_MONEY.format("c")} || ' `' || s || '`', chr(10) ORDER BY n) FILTER (n <= 3) AS t,
string_agg('- About ' || o_orderkey || ' — `' || s || '`', chr(10) ORDER BY n) FILTER (n <= 4) AS u FROM o GROUP BY 1)
SELECT o_custkey AS customer_id, sha256('### Synthetic backend state' || chr(10) || chr(10) || '#### Accounts' || chr(10) || a || chr(10) || chr(10) || '#### Cards' || chr(10) || coalesce(k, '- None') || chr(10) || chr(10) || '#### Transfers' || chr(10) || t || chr(10) || chr(10) || '#### Service cases' || chr(10) || u) AS state_key FROM g""")
def shown_states(df: DataFrame) -> DataFrame:
    """Orders stand for all parts of a customer's state; even ones have a card."""
    key = F.col("o_orderkey").cast("string")
    cents, last4 = F.round(F.col("o_totalprice") * 100).cast("long"), F.lpad((F.col("o_orderkey") % 10000).cast("string"), 4, "0")
    one = F.struct("o_orderkey", F.concat(F.lit("Account "), key).alias("name"), last4.alias("last4"), cents.alias("available_balance_cents"), (cents + 5).alias("current_balance_cents"), cents.alias("amount_cents"), F.col("o_orderstatus").alias("status"), F.concat(F.lit("To "), key).alias("recipient"), F.concat(F.lit("About "), key).alias("subject"))
    rows = df.groupBy(F.col("o_custkey").alias("customer_id")).agg(F.array_sort(F.collect_list(one)).alias("r"))
    cards = F.transform(F.filter("r", lambda x: x["o_orderkey"] % 2 == 0), lambda x: F.struct(F.replace(x["name"], F.lit("Account"), F.lit("Card")).alias("name"), x["last4"].alias("last4"), x["status"].alias("status")))
    return rows.select("customer_id", F.sha2(R.shown_state(F.col("r"), cards, F.col("r"), F.col("r")), 256).alias("state_key"))


@query("labels", """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '{"ok":true,"result":{"service_cases":[{"case_type":"address_update","created_at":"2026-06-18T14:00:00Z","status":"closed","subject":"Confirm mailing address update"}]}}'
WHEN 1 THEN '{"ok":true,"result":{"card":{"last4":"4821","name":"Everyday Visa Debit","status":"replacement_pending"}}}' WHEN 2 THEN '{"ok":true,"result":{"card":{"last4":"4821","name":"Everyday Visa Debit","status":"frozen"}}}'
ELSE '{"ok":true,"result":{"transaction":{"description":"North Harbor Market","disputed":true,"status":"posted"}}}' END AS content FROM labels""")
def canned_results(df: DataFrame) -> DataFrame:
    tool = F.element_at(F.array(*map(F.lit, ["list_service_cases", "replace_card", "freeze_card", "dispute_transaction"])), (F.col("doc_id") % 4 + 1).cast("int"))
    return df.select("doc_id", R.canned_result(tool).alias("content"))


@query("labels", """SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'sign-in secrets must be a JSON object' WHEN 1 THEN 'sign-in secrets must define exactly the demo users' WHEN 2 THEN 'each demo password must contain at least 12 characters' WHEN 3 THEN 'demo accounts must use different passwords' WHEN 4 THEN 'each demo password must contain at least 12 characters' END AS problem FROM labels""")
def secret_checks(df: DataFrame) -> DataFrame:
    k, long_ = F.col("doc_id") % 6, F.lpad(F.col("doc_id").cast("string"), 12, "p")
    pair = lambda a, b: F.concat(F.lit('{"one": "'), a, F.lit('", "two": '), b, F.lit("}"))
    other = F.concat(F.lit('"q'), long_, F.lit('"'))
    payload = F.when(k == 0, "{broken").when(k == 1, '{"one": "ppppppppppppp"}').when(k == 2, pair(F.lit("short"), other)).when(k == 3, pair(long_, F.concat(F.lit('"'), long_, F.lit('"')))).when(k == 4, pair(long_, F.lit("123456789012"))).otherwise(pair(long_, other))
    return df.select("doc_id", R.secret_problems(payload, ("one", "two")).alias("problem"))
