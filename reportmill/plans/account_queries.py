"""Registered queries: accounts and limits (U)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.clients import client_ip
from ..operators import accounts as U
from . import inputs as I
from .catalog import cte, query
from .event_queries import TS, ts_text

TODAY = "2024-01-31"


def users(spark, d):
    """Customers as accounts, created an hour apart in key order (four at a time)."""
    k = F.col("c_custkey")
    return I.table(spark, d, "customer").select(
        k.alias("user_id"), F.concat(F.lit("User "), "c_name").alias("full_name"),
        F.concat(F.lit("c"), k.cast("string"), F.lit("@mail.ma")).alias("email"),
        (F.lit("2023-01-01").cast("timestamp") + F.make_dt_interval(hours=F.floor(k / 4).cast("int"))).alias("created_at"),
        (k % 7).cast("int").alias("daily_msgs_used"),
        F.when(k % 2 == 0, F.lit(TODAY)).otherwise(F.lit("2024-01-30")).cast("date").alias("quota_date"),
    )


def history(spark, d):
    """Orders as questions of their customers."""
    return I.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("history_id"), F.col("o_custkey").alias("user_id"), F.col("o_orderdate").cast("timestamp").alias("created_at"),
        F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("question"), F.col("o_orderpriority").alias("answer"),
        F.lit(None).cast("string").alias("company_name"), F.year("o_orderdate").cast("string").alias("year"),
        F.array(F.struct(F.col("o_orderstatus").alias("label"))).alias("sources"),
    )


cte(
    "users",
    f"""SELECT c_custkey AS user_id, 'User ' || c_name AS full_name, 'c' || c_custkey || '@mail.ma' AS email, TIMESTAMP '2023-01-01' + INTERVAL 1 HOUR * (c_custkey // 4) AS created_at,
        CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 7 ELSE 0 END AS used FROM customer""",
)
USAGE_SQL = """SELECT user_id, full_name, email, created_at, coalesce(n, 0) AS messages_total, last_message_at, CAST(used AS INTEGER) AS quota_used_today,
   CAST(greatest(0, 5 - used) AS INTEGER) AS quota_left_today, 5 AS quota_day FROM (SELECT * FROM users ORDER BY created_at DESC, user_id LIMIT {0})
   LEFT JOIN (SELECT o_custkey, count(*) AS n, max(o_orderdate) AS last_message_at FROM orders GROUP BY 1) ON o_custkey = user_id"""


@query("u01_users_with_usage", f"SELECT * REPLACE ({TS.format('created_at')} AS created_at, {TS.format('last_message_at')} AS last_message_at) FROM ({USAGE_SQL.format(500)})", uses=("users",))
def _(spark, d):
    df = U.users_with_usage(users(spark, d), history(spark, d), TODAY)
    return df.select(*[ts_text(c)[0] if c in ("created_at", "last_message_at") else F.col(c) for c in df.columns])


@query(
    "u02_user_history",
    """SELECT o_custkey AS user_id, count(*) AS n, string_agg(CAST(epoch_ms(o_orderdate) AS VARCHAR) || '/order ' || o_orderkey || '/' || o_orderpriority || '/' || year(o_orderdate) || '/' || o_orderstatus, '|' ORDER BY o_orderdate, o_orderkey) AS messages
       FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn <= 5 GROUP BY 1""",
)
def _(spark, d):
    df = U.user_history(history(spark, d), 5)
    text = F.transform(
        "messages",
        lambda m: F.concat_ws("/", m["timestamp"].cast("string"), m["thread"][0]["content"], m["thread"][1]["content"], m["year"], m["sources"][0]["label"]),
    )
    return df.select("user_id", F.size("messages").cast("bigint").alias("n"), F.array_join(text, "|").alias("messages"))


def attempts(spark, d):
    return I.table(spark, d, "events").select("user_id", F.col("event_id").alias("attempt_id"), F.col("ts").cast("timestamp").alias("ts"))


@query(
    "u03_daily_quota",
    "SELECT user_id, event_id AS attempt_id, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) <= 2 AS accepted FROM events",
)
def _(spark, d):
    return U.quota_decisions(attempts(spark, d), quota=2).select("user_id", "attempt_id", "accepted")


@query(
    "u03_quota_usage",
    "SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS attempts, least(count(*), 5) AS used, greatest(0, 5 - count(*)) AS \"left\" FROM events GROUP BY user_id, CAST(ts AS DATE)",
)
def _(spark, d):
    return U.quota_usage(attempts(spark, d)).withColumn("day", F.col("day").cast("string"))


RATE_SQL = """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
   r AS (SELECT user_id, rn, event_id, true AS accepted, [us] AS st FROM e WHERE rn = 1
    UNION ALL SELECT user_id, rn, event_id, len(ev) < {limit}, CASE WHEN len(ev) < {limit} THEN list_append(ev, us) ELSE ev END
     FROM (SELECT e.user_id, e.rn, e.event_id, e.us, list_filter(r.st, lambda t: e.us - t <= {window} * 1000000::BIGINT) AS ev FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1))
   SELECT user_id AS key, event_id AS hit_id, accepted FROM r"""


def _hits(spark, d):
    return I.table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("hit_id"), F.col("ts").cast("timestamp").alias("ts"))


@query("u04_rate_limit", RATE_SQL.format(limit=20, window=60))
def _(spark, d):
    return U.rate_decisions(_hits(spark, d)).select("key", "hit_id", "accepted")


@query("u04_rate_limit_busy", RATE_SQL.format(limit=3, window=43200))
def _(spark, d):
    """A limit low enough to be hit: three in twelve hours."""
    return U.rate_decisions(_hits(spark, d), limit=3, window_seconds=43200).select("key", "hit_id", "accepted")


_FAMILIES = ", ".join(f"'{x}'" for x in U.DISPOSABLE_FAMILIES)
_DOMAINS = ", ".join(f"'{x}'" for x in U.DISPOSABLE_DOMAINS)


@query(
    "u05_signup_violations",
    f"""SELECT c_custkey, array_to_string(list_filter([CASE WHEN c_custkey % 3 = 0 THEN 'name incomplete' END, CASE WHEN domain = 'bad_domain' THEN 'email invalid' WHEN domain IN ({_DOMAINS}) OR len(list_filter([{_FAMILIES}], lambda f: contains(domain, f))) > 0 THEN 'email disposable' END], lambda x: x IS NOT NULL), '; ') AS violations
        FROM (SELECT c_custkey, list_extract(['mail.ma', 'bad_domain', 'x.yopmail.io', 'grr.la', 'gmail.com'], CAST(c_custkey % 5 AS INTEGER) + 1) AS domain FROM customer)""",
)
def _(spark, d):
    k = F.col("c_custkey")
    domain = F.get(F.array(*[F.lit(x) for x in ("Mail.ma", "bad_domain", "x.yopmail.io", "GRR.la", "gmail.com")]), (k % 5).cast("int"))
    rows = I.table(spark, d, "customer").select(
        "c_custkey", F.concat(F.lit(" c"), k.cast("string"), F.lit("@"), domain, F.lit(" ")).alias("email"),
        F.when(k % 3 == 0, F.concat("c_mktsegment", F.lit("  X"))).otherwise(F.concat("c_mktsegment", F.lit("  Xy"))).alias("full_name"),
    )
    return U.signup_violations(rows).select("c_custkey", F.array_join("violations", "; ").alias("violations"))


@query(
    "u06_client_ip",
    """SELECT event_id, CASE event_id % 5 WHEN 0 THEN '8.8.4.' || user_id % 250 WHEN 1 THEN '9.9.9.' || user_id % 250 WHEN 2 THEN '41.92.0.' || user_id % 250 WHEN 3 THEN '10.0.0.' || user_id % 250 ELSE '172.16.0.1' END AS ip FROM events""",
)
def _(spark, d):
    last = (F.col("user_id") % 250).cast("string")
    case = F.col("event_id") % 5
    first = F.when(case == 0, F.concat(F.lit(" 8.8.4."), last)).otherwise("  ")
    second = F.when(case == 1, F.concat(F.lit("9.9.9."), last))
    forwarded = F.when(case == 2, F.concat(F.lit("10.1.1.1, , 41.92.0."), last, F.lit(", 1.1.1.1"))).when(
        case == 3, F.concat(F.lit("10.0.0."), last, F.lit(",192.168.1.1"))
    )
    return I.table(spark, d, "events").select("event_id", client_ip([first, second], forwarded, F.lit("172.16.0.1")).alias("ip"))


@query(
    "u07_insert_users",
    "SELECT user_id, email FROM users WHERE user_id % 2 = 0 UNION ALL SELECT user_id + 1000000, 'c' || user_id || '@mail.ma' FROM users WHERE user_id % 2 = 1",
    uses=("users",),
)
def _(spark, d):
    all_users = users(spark, d)
    again = all_users.withColumn("user_id", F.col("user_id") + 1000000).withColumn("email", F.concat(F.lit(" "), F.upper("email")))
    twice = again.unionByName(again.withColumn("user_id", F.col("user_id") + 1000000))
    return U.insert_users(all_users.filter(F.col("user_id") % 2 == 0), twice).select("user_id", "email")


@query("u07_delete_history", "SELECT o_orderkey AS history_id, o_custkey AS user_id FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')")
def _(spark, d):
    gone = I.table(spark, d, "customer").filter(F.col("c_mktsegment") == "MACHINERY").select(F.col("c_custkey").alias("user_id"))
    return U.delete_history(history(spark, d), gone).select("history_id", "user_id")


@query(
    "u08_account_overview",
    f"""SELECT count(*) FILTER (WHERE messages_total > 0) AS users_with_messages, CAST(sum(messages_total) AS BIGINT) AS messages,
        (SELECT count(*) FROM ev WHERE event_type = 'chat_message' AND coalesce(role, '') <> 'admin') AS anonymous_questions FROM (SELECT user_id, (SELECT count(*) FROM orders WHERE o_custkey = user_id) AS messages_total FROM users)""",
    uses=("users", "ev"),
)
def _(spark, d):
    return U.account_overview(users(spark, d), history(spark, d), I.event_log(spark, d))
