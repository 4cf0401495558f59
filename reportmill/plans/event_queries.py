"""Registered queries: event analytics (A)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.clients import browser_of, device_of, is_private_ip, keyed_hash, normalise_ip, system_of
from ..operators import events as A
from ..operators import sketches as K
from ..session import scratch_path
from . import inputs as I
from .catalog import query

EV = ("ev",)
TS = "strftime({0}, '%Y-%m-%d %H:%M:%S.%f')"


def ts_text(*names):
    return [F.date_format(n, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(n) for n in names]


def with_ts_text(df, *names):
    return df.select(*[ts_text(c)[0] if c in names else F.col(c) for c in df.columns])


LABEL = """CASE WHEN coalesce(city, '') = '' AND coalesce(country, '') = '' THEN 'Unknown' WHEN coalesce(city, '') = '' THEN country
  WHEN coalesce(country, '') = '' OR lower(city) = lower(country) THEN city ELSE city || ', ' || country END"""


@query("a01_client_families", "SELECT seq, device, coalesce(browser, 'unknown') AS browser, coalesce(os, 'unknown') AS os FROM ev", uses=EV)
def _(spark, d):
    agent = F.col("agent")
    return I.raw_events(spark, d).select(
        "seq", device_of(agent).alias("device"), browser_of(agent).alias("browser"), system_of(agent).alias("os")
    )


@query("a02_normalise_ip", "SELECT seq, coalesce(ip, '') AS ip, coalesce(starts_with(ip, '192.168.'), false) AS private FROM ev", uses=EV)
def _(spark, d):
    return I.raw_events(spark, d).select("seq", normalise_ip(F.col("ip")).alias("ip"), is_private_ip(F.col("ip")).alias("private"))


@query("a03_keyed_hash", "SELECT seq, ip_hash FROM ev WHERE ip IS NOT NULL", uses=EV)
def _(spark, d):
    df = I.raw_events(spark, d).select("seq", normalise_ip(F.col("ip")).alias("ip")).filter("ip <> ''")
    return df.select("seq", keyed_hash(F.col("ip"), I.HASH_KEY).alias("ip_hash"))


@query("a04_geo_enrichment", "SELECT seq, city, country, country_code, isp FROM ev", uses=EV)
def _(spark, d):
    return I.event_log(spark, d).select("seq", "city", "country", "country_code", "isp")


@query(
    "a05_clean_meta",
    "SELECT seq, ok, email, question, company, year, sector, report, session, kind, path, error, latency_ms, CAST(sources AS DOUBLE) AS sources FROM ev",
    uses=EV,
)
def _(spark, d):
    names = "ok email question company year sector report session kind path error latency_ms sources".split()
    return I.event_log(spark, d).select("seq", *[F.col(f"meta.{n}").alias(n) for n in names])


@query("a06_location_label", f"SELECT seq, {LABEL} AS location FROM ev", uses=EV)
def _(spark, d):
    return I.event_log(spark, d).select("seq", A.location_label(F.col("city"), F.col("country")).alias("location"))


_LATEST = "arg_max({0}, struct_pack(a := ts, b := -seq)) FILTER (WHERE coalesce({0}, '') <> '')"
_COUNTS = ", ".join(f"count(*) FILTER (WHERE event_type = '{t}') AS {t}" for t in A.EVENT_TYPES)
VISITOR_SQL = f"""SELECT *, {LABEL} AS location FROM (SELECT ip_hash, {', '.join(f"coalesce({_LATEST.format(c)}, '') AS {c}" for c in ('ip', 'city', 'country', 'country_code', 'isp'))},
   coalesce({_LATEST.format('device')}, 'desktop') AS device, coalesce({_LATEST.format('browser')}, 'unknown') AS browser, coalesce({_LATEST.format('os')}, 'unknown') AS os,
   coalesce(arg_max(role, struct_pack(a := ts, b := seq)) FILTER (WHERE role IN ('demo', 'admin')), arg_min(coalesce(role, ''), struct_pack(a := ts, b := seq))) AS role,
   min(ts) AS first_seen, max(ts) AS last_seen, {_COUNTS}, count(*) FILTER (WHERE event_type = 'chat_message') AS questions, count(*) AS total_events,
   count(DISTINCT company) AS companies_explored, count(DISTINCT coalesce(session, CAST(ts AS VARCHAR))) FILTER (WHERE event_type = 'login_attempt') AS sessions,
   count(*) FILTER (WHERE event_type = 'login_attempt' AND ok) AS logins_ok, count(*) FILTER (WHERE event_type = 'login_attempt' AND NOT ok) AS logins_fail,
   CAST(floor(avg(latency_ms)) AS BIGINT) AS avg_latency_ms, CAST(floor(max(latency_ms)) AS BIGINT) AS max_latency_ms
   FROM ev WHERE ip_hash IS NOT NULL GROUP BY ip_hash)"""
_VISITOR_OUT = f"SELECT * REPLACE ({TS.format('first_seen')} AS first_seen, {TS.format('last_seen')} AS last_seen) FROM ({VISITOR_SQL})"


def visitor_rows(spark, d):
    return A.visitors(I.event_log(spark, d))


@query("a07_visitor_rollup", _VISITOR_OUT, uses=EV)
def _(spark, d):
    return with_ts_text(visitor_rows(spark, d), "first_seen", "last_seen")


@query("a07_visitors_day_by_day", _VISITOR_OUT, uses=EV)
def _(spark, d):
    """The log comes in pieces, newest first and some days twice; each piece adds its parts only."""
    log = I.event_log(spark, d)
    stored = A.visitor_table(spark, scratch_path(spark, "visitor-days"), A.visitor_parts(log))
    stored.fan = 2
    pieces = (("2024-01-21", "2024-12-31"), ("2000-01-01", "2024-01-07"), ("2024-01-14", "2024-01-21"), ("2024-01-07", "2024-01-14"))
    for number, (first, last) in enumerate(pieces):
        days = log.filter((F.col("ts") >= F.lit(first).cast("timestamp")) & (F.col("ts") < F.lit(last).cast("timestamp")))
        for half in (0, 1):
            stored.add(A.visitor_parts(days.filter(F.pmod("seq", F.lit(2)) == half)), 2 * number + half)
    return with_ts_text(A.visitors_of(stored.read()), "first_seen", "last_seen")


@query("a08_newest_visitors", f"{_VISITOR_OUT} ORDER BY last_seen DESC, ip_hash LIMIT 50", uses=EV)
def _(spark, d):
    return with_ts_text(A.newest_visitors(visitor_rows(spark, d), 50), "first_seen", "last_seen")


@query("a09_geo_totals", f"SELECT count(*) AS total_unique, count(*) FILTER (WHERE country <> '') AS located FROM ({VISITOR_SQL})", uses=EV)
def _(spark, d):
    return A.geo_totals(visitor_rows(spark, d))


@query(
    "a09_geo_countries",
    f"""SELECT coalesce(nullif(country_code, ''), country) AS country_key, coalesce(nullif(arg_max(country, struct_pack(a := last_seen, b := ip_hash)), ''), 'Unknown') AS country,
        any_value(country_code) AS country_code, count(*) AS visitors, count(*) FILTER (WHERE role = 'demo') AS demo_visitors
        FROM ({VISITOR_SQL}) WHERE coalesce(nullif(country_code, ''), country) <> '' GROUP BY 1 ORDER BY visitors DESC, country_key LIMIT 12""",
    uses=EV,
)
def _(spark, d):
    return A.geo_countries(visitor_rows(spark, d))


@query(
    "a09_geo_cities",
    f"""SELECT city, country_code, arg_max(country, struct_pack(a := last_seen, b := ip_hash)) AS country, count(*) AS visitors
        FROM ({VISITOR_SQL}) WHERE city <> '' GROUP BY 1, 2 ORDER BY visitors DESC, city, country_code LIMIT 12""",
    uses=EV,
)
def _(spark, d):
    return A.geo_cities(visitor_rows(spark, d))


@query(
    "a10_summary",
    f"""SELECT {', '.join(f"count(*) FILTER (WHERE event_type = '{t}') AS {n}" for t, n in (('visit', 'total_visits'), ('demo_login', 'total_demo_logins'), ('demo_message', 'total_demo_messages'), ('demo_exhausted', 'total_demo_exhausted')))},
        {', '.join(f"count(*) FILTER (WHERE event_type = 'visit' AND device = '{v}') AS device_{v}" for v in A.DEVICES)},
        count(DISTINCT ip_hash) FILTER (WHERE event_type = 'visit' AND ts >= TIMESTAMP '{I.NOW}' - INTERVAL 30 DAY) AS unique_visitors_30d,
        count(DISTINCT ip_hash) FILTER (WHERE event_type IN ('demo_login', 'demo_exhausted')) AS unique_demo_visitors FROM ev""",
    uses=EV,
)
def _(spark, d):
    return A.summary(I.event_log(spark, d), I.NOW)


@query(
    "a10_device_mix",
    'SELECT d AS device, count(seq) AS "count" FROM (VALUES (\'desktop\'), (\'mobile\'), (\'tablet\')) v(d) LEFT JOIN (SELECT * FROM ev WHERE event_type = \'visit\') e ON device = d GROUP BY 1',
    uses=EV,
)
def _(spark, d):
    return A.device_mix(I.event_log(spark, d))


@query(
    "a10_sketched_visitors",
    "SELECT event_type, count(DISTINCT ip_hash) AS visitors, TRUE AS within FROM ev WHERE event_type IN ('visit', 'chat_message', 'login_attempt') GROUP BY 1",
    uses=EV,
)
def _(spark, d):
    """Distinct addresses from merged daily sketches, held against the exact counts."""
    log = I.event_log(spark, d).filter(F.col("event_type").isin("visit", "chat_message", "login_attempt"))
    exact = log.select("event_type", "ip_hash").distinct().groupBy("event_type").agg(F.count("ip_hash").alias("visitors"))
    told = K.visitor_estimates(K.merged(K.daily_sketches(log), "event_type")).select("event_type", F.col("visitors").alias("about"))
    close = F.abs(F.col("about") - F.col("visitors")) <= K.VISITOR_ERROR * F.col("visitors") + 1
    return exact.join(told, "event_type").select("event_type", "visitors", close.alias("within"))


def _spine(days: int) -> str:
    return f"(SELECT CAST(unnest(generate_series(DATE '2024-01-31' - {days - 1}, DATE '2024-01-31', INTERVAL 1 DAY)) AS DATE) AS date)"


@query(
    "a11_daily_counts",
    f"""SELECT CAST(s.date AS VARCHAR) AS date, strftime(s.date, '%a') AS day, count(seq) AS "count" FROM {_spine(7)} s
        LEFT JOIN (SELECT * FROM ev WHERE event_type = 'visit') e ON CAST(e.ts AS DATE) = s.date GROUP BY 1, 2""",
    uses=EV,
)
def _(spark, d):
    df = A.daily_counts(I.event_log(spark, d), "visit", I.NOW)
    return df.withColumn("date", F.col("date").cast("string"))


@query(
    "a12_login_totals",
    """SELECT count(*) FILTER (WHERE l) AS total_attempts, count(*) FILTER (WHERE l AND ok) AS total_success, count(*) FILTER (WHERE l AND NOT ok) AS total_failed,
        CAST(round_even(100.0 * count(*) FILTER (WHERE l AND ok) / count(*) FILTER (WHERE l), 0) AS INTEGER) AS success_rate, count(*) FILTER (WHERE event_type = 'signup') AS signups
       FROM (SELECT *, event_type = 'login_attempt' AS l FROM ev)""",
    uses=EV,
)
def _(spark, d):
    return A.login_totals(I.event_log(spark, d))


@query(
    "a12_login_funnel",
    f"""SELECT coalesce(lower(email), '(vide)') AS email, count(*) AS attempts, count(*) FILTER (WHERE ok) AS success, count(*) FILTER (WHERE NOT ok) AS failed,
        count(DISTINCT ip_hash) AS unique_ips, CAST(round_even(100.0 * count(*) FILTER (WHERE ok) / count(*), 0) AS INTEGER) AS success_rate,
        {TS.format('min(ts)')} AS first_seen, {TS.format('max(ts)')} AS last_seen FROM ev WHERE event_type = 'login_attempt' GROUP BY 1""",
    uses=EV,
)
def _(spark, d):
    return with_ts_text(A.login_funnel(I.event_log(spark, d)), "first_seen", "last_seen")


@query(
    "a12_failing_addresses",
    f"""SELECT ip_hash, arg_min(ip, struct_pack(a := ts, b := seq)) AS ip, arg_min({LABEL}, struct_pack(a := ts, b := seq)) AS location, count(*) AS failed, {TS.format('max(ts)')} AS last_seen
        FROM ev WHERE event_type = 'login_attempt' AND NOT ok AND ip_hash IS NOT NULL GROUP BY 1 ORDER BY failed DESC, ip_hash LIMIT 10""",
    uses=EV,
)
def _(spark, d):
    return with_ts_text(A.failing_addresses(I.event_log(spark, d)), "last_seen")


@query(
    "a13_chat_stats",
    """SELECT n AS total_questions, askers AS unique_askers, CAST(floor(mean) AS BIGINT) AS avg_latency_ms, CAST(floor(l[len(l)]) AS BIGINT) AS max_latency_ms,
        CAST(floor(l[least(len(l), CAST(floor(len(l) * 0.5::DOUBLE) AS BIGINT) + 1)]) AS BIGINT) AS p50_latency_ms,
        CAST(floor(l[least(len(l), CAST(floor(len(l) * 0.95::DOUBLE) AS BIGINT) + 1)]) AS BIGINT) AS p95_latency_ms,
        round_even(100.0::DOUBLE * errs / n, 1) AS error_rate, round_even(100.0::DOUBLE * src / n, 1) AS source_rate, round_even(n::DOUBLE / askers, 2) AS questions_per_asker
       FROM (SELECT count(*) AS n, count(DISTINCT ip_hash) AS askers, avg(latency_ms) AS mean, list(latency_ms ORDER BY latency_ms) AS l,
        count(*) FILTER (WHERE error IS NOT NULL) AS errs, count(*) FILTER (WHERE sources > 0) AS src FROM ev WHERE event_type = 'chat_message')""",
    uses=EV,
)
def _(spark, d):
    return A.chat_stats(I.event_log(spark, d))


@query(
    "a13_sketched_latency",
    "SELECT unnest([0.5, 0.95])::DOUBLE AS share, n, TRUE AS within FROM (SELECT count(latency_ms) AS n FROM ev WHERE event_type = 'chat_message' AND latency_ms >= 0)",
    uses=EV,
)
def _(spark, d):
    """Latency percentiles from merged daily sketches: their ranks among the exact values."""
    log = I.event_log(spark, d).filter("event_type = 'chat_message'")
    told = K.latency_quantiles(K.merged(K.daily_sketches(log), "event_type"), (0.5, 0.95))
    values = log.select(F.col("meta.latency_ms").alias("v")).filter("v >= 0")
    out = []
    for share in (0.5, 0.95):
        rows = values.withColumn("q", told.filter(F.col("share") == share).select("value").scalar())
        ranks = rows.agg(F.count("v").alias("n"), F.count_if(F.col("v") < F.col("q")).alias("below"), F.count_if(F.col("v") <= F.col("q")).alias("upto"))
        wanted, slack = share * F.col("n"), K.RANK_ERROR * F.col("n") + 1
        out.append(ranks.select(F.lit(share).alias("share"), "n", ((F.col("below") - slack <= wanted) & (wanted <= F.col("upto") + slack)).alias("within")))
    return out[0].unionByName(out[1])


for _field, _kind, _limit in (("company", "chat_message", 40), ("year", "chat_message", 20), ("sector", "chat_message", 20), ("report", "chat_message", 20)):

    @query(
        f"a14_top_{_field}",
        f"""SELECT {_field} AS value, count(*) AS "count" FROM ev WHERE event_type = '{_kind}' AND {_field} IS NOT NULL GROUP BY 1 ORDER BY "count" DESC, value LIMIT {_limit}""",
        uses=EV,
    )
    def _(spark, d, _field=_field, _kind=_kind, _limit=_limit):
        return A.top_values(I.event_log(spark, d), _kind, _field, _limit)


@query(
    "a14_sketched_top_company",
    """SELECT company AS value, count(*) AS "count" FROM ev WHERE event_type = 'chat_message' AND company IS NOT NULL GROUP BY 1 ORDER BY "count" DESC, value LIMIT 40""",
    uses=EV,
)
def _(spark, d):
    """Frequent companies from merged daily sketches: exact while a sketch holds all values."""
    log = I.event_log(spark, d).filter("event_type = 'chat_message'")
    return K.top_values(K.merged(K.daily_sketches(log), "event_type"), "company", 40).select("value", "count")


@query(
    "a15_recent_questions",
    f"""SELECT seq, {TS.format('ts')} AS ts, coalesce(ip, '') AS ip, coalesce(ip_hash, '') AS ip_hash, {LABEL} AS location, coalesce(country_code, '') AS country_code, device, coalesce(role, '') AS role,
        coalesce(question, '') AS question, coalesce(company, '') AS company, coalesce(year, '') AS year, coalesce(sector, '') AS sector, '' AS scope, latency_ms, CAST(sources AS DOUBLE) AS sources, coalesce(error, '') AS error
        FROM ev WHERE event_type = 'chat_message' ORDER BY seq DESC LIMIT 60""",
    uses=EV,
)
def _(spark, d):
    return with_ts_text(A.recent_questions(I.event_log(spark, d)), "ts")


@query(
    "a15_recent_logins",
    f"""SELECT seq, {TS.format('ts')} AS ts, coalesce(ip, '') AS ip, {LABEL} AS location, coalesce(country_code, '') AS country_code, coalesce(email, '') AS email, ok, coalesce(kind, '') AS kind
        FROM ev WHERE event_type = 'login_attempt' ORDER BY seq DESC LIMIT 60""",
    uses=EV,
)
def _(spark, d):
    return with_ts_text(A.recent_logins(I.event_log(spark, d)), "ts")


def _conversation_sql(limit: int, keep: int) -> str:
    return f"""WITH chats AS (SELECT *, coalesce(session, ip_hash, CAST(ts AS VARCHAR)) AS key FROM ev WHERE event_type = 'chat_message' AND coalesce(role, '') <> 'admin'),
      ranked AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC, seq DESC) AS rn FROM chats)
      SELECT key, {TS.format('min(ts)')} AS first_seen, {TS.format('max(ts)')} AS last_seen, count(*) AS questions, coalesce({_LATEST.format('ip')}, '') AS ip, coalesce({_LATEST.format('browser')}, '') AS browser,
       arg_min({LABEL}, struct_pack(a := ts, b := seq)) AS location, arg_min(coalesce(role, ''), struct_pack(a := ts, b := seq)) AS role,
       string_agg(coalesce(question, '') || '@' || seq, '|' ORDER BY ts, seq) FILTER (WHERE rn <= {keep}) AS messages
      FROM ranked GROUP BY key ORDER BY max(ts) DESC, key LIMIT {limit}"""


def _conversations(spark, d, limit, keep):
    df = A.conversations(I.event_log(spark, d), limit, keep)
    messages = F.array_join(F.transform("messages", lambda m: F.concat(m["question"], F.lit("@"), m["seq"].cast("string"))), "|")
    return df.select(
        "key", *ts_text("first_seen", "last_seen"), "questions", A._blank("ip").alias("ip"), A._blank("browser").alias("browser"),
        "location", "role", messages.alias("messages"),
    )


@query("a16_conversations", _conversation_sql(200, 60), uses=EV)
def _(spark, d):
    return _conversations(spark, d, 200, 60)


@query("a16_conversation_tails", _conversation_sql(200, 2), uses=EV)
def _(spark, d):
    return _conversations(spark, d, 200, 2)


@query(
    "a17_activity_hours",
    """SELECT CAST(h AS INTEGER) AS hour, count(*) FILTER (WHERE event_type = 'visit') AS visits, count(*) FILTER (WHERE event_type = 'chat_message') AS questions,
        count(*) FILTER (WHERE event_type = 'login_attempt' AND NOT ok) AS failed_logins FROM range(24) r(h) LEFT JOIN ev ON hour(ts) = h GROUP BY 1""",
    uses=EV,
)
def _(spark, d):
    return A.activity_hours(I.event_log(spark, d))


@query(
    "a18_client_mix",
    """SELECT kind, name, "count" FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY "count" DESC, name) AS rn FROM (
        SELECT kind, name, count(*) AS "count" FROM (SELECT 'browser' AS kind, browser AS name FROM ev WHERE browser <> 'unknown' UNION ALL SELECT 'os', os FROM ev WHERE os <> 'unknown'
         UNION ALL SELECT 'device', device FROM ev) WHERE name <> '' GROUP BY 1, 2)) WHERE rn <= 10""",
    uses=EV,
)
def _(spark, d):
    return A.client_mix(I.event_log(spark, d))


@query(
    "a19_timeline",
    f"""SELECT CAST(s.date AS VARCHAR) AS date, strftime(s.date, '%a') AS day, {', '.join(f"count(*) FILTER (WHERE event_type = '{t}') AS {n}" for n, t in A.TIMELINE.items())}
        FROM {_spine(30)} s LEFT JOIN ev e ON CAST(e.ts AS DATE) = s.date GROUP BY 1, 2""",
    uses=EV,
)
def _(spark, d):
    df = A.timeline(I.event_log(spark, d), I.NOW)
    return df.withColumn("date", F.col("date").cast("string"))


@query(
    "a20_usage_totals",
    f"SELECT {', '.join(f"count(*) FILTER (WHERE event_type = '{t}') AS {n}" for t, n in (('pdf_open', 'pdf_opens'), ('company_select', 'company_selects'), ('logout', 'logouts'), ('error', 'errors')))} FROM ev",
    uses=EV,
)
def _(spark, d):
    return A.usage_totals(I.event_log(spark, d))


@query(
    "a20_error_kinds",
    """SELECT coalesce(kind, path, 'unknown') AS kind, count(*) AS "count" FROM ev WHERE event_type = 'error' GROUP BY 1 ORDER BY "count" DESC, kind LIMIT 20""",
    uses=EV,
)
def _(spark, d):
    return A.error_kinds(I.event_log(spark, d))


@query(
    "a20_top_companies_viewed",
    """SELECT company AS value, count(*) AS "count" FROM ev WHERE event_type = 'company_select' AND company IS NOT NULL GROUP BY 1 ORDER BY "count" DESC, value LIMIT 20""",
    uses=EV,
)
def _(spark, d):
    return A.top_values(I.event_log(spark, d), "company_select", "company")


@query(
    "a20_top_documents_opened",
    """SELECT report AS value, count(*) AS "count" FROM ev WHERE event_type = 'pdf_open' AND report IS NOT NULL GROUP BY 1 ORDER BY "count" DESC, value LIMIT 20""",
    uses=EV,
)
def _(spark, d):
    return A.top_values(I.event_log(spark, d), "pdf_open", "report")


@query(
    "a21_dashboard_views",
    f"""SELECT 'countries' AS view, least(12, count(DISTINCT coalesce(nullif(country_code, ''), country)) FILTER (WHERE coalesce(nullif(country_code, ''), country) <> '')) AS n_rows FROM ({VISITOR_SQL})
        UNION ALL SELECT 'visitors', least(300, count(*)) FROM ({VISITOR_SQL})
        UNION ALL SELECT 'login_funnel', count(DISTINCT coalesce(lower(email), '(vide)')) FROM ev WHERE event_type = 'login_attempt'
        UNION ALL SELECT 'hours', 24 UNION ALL SELECT 'timeline', 30 UNION ALL SELECT 'chat', 1 UNION ALL SELECT 'summary', 1""",
    uses=EV,
)
def _(spark, d):
    views = A.dashboard(I.event_log(spark, d), I.NOW)
    out = None
    for name in ("countries", "visitors", "login_funnel", "hours", "timeline", "chat", "summary"):
        row = views[name].agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("view"), "n_rows")
        out = row if out is None else out.unionByName(row)
    return out


_TOP = (
    ("top_companies", "chat_message", "company", 40), ("top_years", "chat_message", "year", 20), ("top_sectors", "chat_message", "sector", 20),
    ("top_reports", "chat_message", "report", 20), ("companies_viewed", "company_select", "company", 20), ("documents_opened", "pdf_open", "report", 20),
)
_BY_DAY = (("visits_by_day", "visit"), ("demo_logins_by_day", "demo_login"), ("exhausted_by_day", "demo_exhausted"))
_VALUES_SQL = [
    f"(SELECT '{view}' AS view, {field} AS name, count(*) AS n FROM ev WHERE event_type = '{kind}' AND {field} IS NOT NULL GROUP BY 2 ORDER BY n DESC, name LIMIT {limit})"
    for view, kind, field, limit in _TOP
] + [
    f"""(SELECT '{view}', strftime(day, '%Y-%m-%d'), (SELECT count(*) FROM ev WHERE event_type = '{kind}' AND CAST(ts AS DATE) = CAST(day AS DATE))
        FROM generate_series(TIMESTAMP '{I.NOW}' - INTERVAL 6 DAY, TIMESTAMP '{I.NOW}', INTERVAL 1 DAY) s(day))"""
    for view, kind in _BY_DAY
] + [
    "(SELECT 'devices', d, (SELECT count(*) FROM ev WHERE event_type = 'visit' AND coalesce(device, 'desktop') = d) FROM (VALUES ('desktop'), ('mobile'), ('tablet')) v(d))",
    "(SELECT 'error_kinds', coalesce(kind, path, 'unknown') AS name, count(*) AS n FROM ev WHERE event_type = 'error' GROUP BY 2 ORDER BY n DESC, name LIMIT 20)",
    f"(SELECT 'located', 'total_unique', count(*) FROM ({VISITOR_SQL}))",
    f"(SELECT 'located', 'located', count(*) FROM ({VISITOR_SQL}) WHERE country <> '')",
]


@query("a21_dashboard_values", " UNION ALL ".join(_VALUES_SQL), uses=EV)
def _(spark, d):
    """Names and numbers of the views that list them, all read from one snapshot."""
    views = A.dashboard(I.event_log(spark, d), I.NOW)
    pair = lambda view, name: views[view].select(F.lit(view).alias("view"), F.col(name).cast("string").alias("name"), F.col("count").alias("n"))
    parts = [pair(view, "value") for view, *_ in _TOP] + [pair(view, "date") for view, _ in _BY_DAY]
    parts += [pair("devices", "device"), pair("error_kinds", "kind")]
    located = views["located"].unpivot([], ["total_unique", "located"], "name", "n").select(F.lit("located").alias("view"), "name", "n")
    out = located
    for part in parts:
        out = out.unionByName(part)
    return out


@query(
    "a22_share_of_total",
    """SELECT device, "count", CAST(floor(100.0::DOUBLE * "count" / sum("count") OVER () + 0.5) AS INTEGER) AS pct FROM (SELECT device, count(*) AS "count" FROM ev GROUP BY 1)""",
    uses=EV,
)
def _(spark, d):
    counts = I.event_log(spark, d).groupBy("device").agg(F.count(F.lit(1)).alias("count"))
    return A.with_share(counts)


@query(
    "a23_find_visitors",
    f"""SELECT ip_hash, location, isp, browser, os, role, questions FROM ({VISITOR_SQL}) WHERE contains(lower(ip), 'city 1') OR contains(lower(location), 'city 1') OR contains(lower(isp), 'city 1')
        OR contains(lower(browser), 'city 1') OR contains(lower(os), 'city 1') OR contains(lower(role), 'city 1')""",
    uses=EV,
)
def _(spark, d):
    df = A.find_visitors(visitor_rows(spark, d), " City 1", "questions")
    return df.select("ip_hash", "location", "isp", "browser", "os", "role", "questions")


@query(
    "a24_question_events",
    """SELECT c.conv_id * 1000 + c.turn AS seq, c.text AS question, length(a.text) * 1.0::DOUBLE AS chars, 'all' AS scope, (c.turn + 1) * 250.0::DOUBLE AS latency_ms
       FROM conversations c JOIN conversations a ON a.conv_id = c.conv_id AND a.turn = c.turn + 1 AND a.role = 'assistant' WHERE c.role = 'user'""",
)
def _(spark, d):
    talk = I.table(spark, d, "conversations")
    asked = talk.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("message"))
    told = talk.filter(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    started = F.lit("2024-01-01 00:00:00").cast("timestamp")
    none = F.lit(None).cast("string")
    log = asked.join(told, ["conv_id", "turn"]).select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), started.alias("started"),
        (started + F.make_dt_interval(secs=(F.col("turn") + 1) * 0.25)).alias("finished"), "message", "answer",
        none.alias("company"), none.alias("year"), none.alias("sector"), none.alias("report"),
        F.lit(None).cast("int").alias("sources"), none.alias("error"), none.alias("agent"), none.alias("ip"), none.alias("role"),
    )
    return A.question_events(log).select("seq", "meta.question", "meta.chars", "meta.scope", "meta.latency_ms")
