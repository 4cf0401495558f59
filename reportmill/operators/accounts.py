"""Accounts: usage, history, quota, rate limit, sign-up rules."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import squeeze, strip
from ..session import beside

DAILY_QUOTA = 5
RATE_LIMIT, RATE_WINDOW_SECONDS = 20, 60
# A time slab of the rate limiter, in windows.
SLAB_WINDOWS = 10
# Form and length of an acceptable address.
EMAIL_PATTERN = r"^[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}$"
EMAIL_MAX = 320
# Throw-away mail domains, and name parts of their families.
DISPOSABLE_DOMAINS = (
    "mailinator.com", "mailinator.net", "mailinator.org",
    "guerrillamail.com", "guerrillamail.org", "guerrillamail.net",
    "guerrillamail.de", "grr.la", "pokemail.net", "spam4.me",
    "yopmail.com", "yopmail.fr", "yopmail.net", "yopmail.org",
    "temp-mail.org", "temp-mail.com", "temp-mail.net", "temp-mail.io",
    "tempmail.com", "tempmail.net", "tempmailo.com", "tempmail.dev",
    "tempinbox.com", "temporary-mail.net", "tempr.email",
    "10minutemail.com", "10minutemail.net", "10minutemail.org",
    "10mail.org", "10minut.net", "minutesmail.com",
    "trashmail.com", "trashmail.de", "trashmail.net", "trashmails.com",
    "throwawaymail.com", "throwawayemail.com", "throwaway.de",
    "maildrop.cc", "mailnesia.com", "dispostable.com", "spamgourmet.com",
    "mailcatch.com", "emailfake.com", "fakemail.net", "fakemailgenerator.com",
    "getairmail.com", "mailtemp.net", "emailondeck.com", "mytemp.email",
    "luxusmail.org", "fammail.xyz", "einrot.com", "noesdon.fun",
    "mytemp-mail.com", "maileater.com", "cellurl.com", "mail-eater.com",
    "jetable.org", "jetable.net", "meltmail.com", "deponi.online",
    "emailtemporario.com.br", "tmailweb.com", "tmpmail.org", "tmpmail.net",
    "0-mail.com", "0815.ru", "copy.sh", "kurzepost.de", "sellbe.com",
    "shitmail.de", "slopsbox.com", "sofort-mail.de", "mailimouse.com",
    "wikmailbox.com", "boun.cr", "mintemail.com", "nwytg.net",
    "spam.care", "moakt.com", "mailnox.com", "acme.com", "bumpylips.com",
    "dadamailservice.com", "fidmail.com", "figjs.com", "gawab.com",
)
DISPOSABLE_FAMILIES = (
    "mailinator", "guerrillamail", "yopmail", "10minutemail", "tempmail",
    "temp-mail", "trashmail", "throwaway", "emailfake", "fakemail",
    "maildrop", "mailnesia", "dispostable", "mailcatch", "jetable",
)


def users_with_usage(users: DataFrame, history: DataFrame, today: str, limit: int | None = 500) -> DataFrame:
    """Newest accounts with message count, last message and today's quota; None means all.

    Accounts are cut first; the history is then folded for those accounts only.
    """
    chosen = users if limit is None else users.orderBy(F.desc("created_at"), "user_id").limit(limit)
    counts = (
        history.join(chosen.select("user_id"), "user_id", "left_semi")
        .groupBy("user_id")
        .agg(F.count(F.lit(1)).alias("messages_total"), F.max("created_at").alias("last_message_at"))
    )
    used = F.when(F.col("quota_date") == F.lit(today).cast("date"), F.col("daily_msgs_used")).otherwise(0)
    return (
        chosen.join(counts, "user_id", "left")
        .select(
            "user_id", "full_name", "email", "created_at",
            F.coalesce("messages_total", F.lit(0)).alias("messages_total"), "last_message_at",
            used.alias("quota_used_today"), F.greatest(F.lit(0), F.lit(DAILY_QUOTA) - used).alias("quota_left_today"),
            F.lit(DAILY_QUOTA).alias("quota_day"),
        )
        .orderBy(F.desc("created_at"), "user_id")
    )


def user_history(history: DataFrame, limit: int = 100) -> DataFrame:
    """Newest questions and answers per user as an array, oldest first, with a two-turn thread.

    The ranked filter is cut in every partition before the shuffle, so a user of any size
    costs `limit` rows per partition.
    """
    newest = Window.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc("history_id"))
    blank = lambda c: F.coalesce(c, F.lit(""))
    none = F.array().cast(history.schema["sources"].dataType)
    sources = F.coalesce("sources", none)
    turn = lambda role, text, src: F.struct(F.lit(role).alias("role"), text.alias("content"), src.alias("sources"))
    entry = F.struct(
        F.unix_millis("created_at").alias("timestamp"), F.col("history_id"), F.col("question"), blank("answer").alias("answer"),
        blank("company_name").alias("company_name"), blank("year").alias("year"), sources.alias("sources"),
        F.array(turn("user", F.col("question"), none), turn("assistant", blank("answer"), sources)).alias("thread"),
    )
    return (
        history.withColumn("_rn", F.row_number().over(newest))
        .filter(F.col("_rn") <= limit)
        .groupBy("user_id")
        .agg(F.sort_array(F.collect_list(entry)).alias("messages"))
    )


def quota_usage(attempts: DataFrame, quota: int = DAILY_QUOTA) -> DataFrame:
    """Per (user, day): attempts, accepted messages and what is left. Rejected ones do not count."""
    return (
        attempts.groupBy("user_id", F.to_date("ts").alias("day"))
        .agg(F.count(F.lit(1)).alias("attempts"))
        .select(
            "user_id", "day", "attempts", F.least("attempts", F.lit(quota)).alias("used"),
            F.greatest(F.lit(0), F.lit(quota) - F.col("attempts")).alias("left"),
        )
    )


def quota_decisions(attempts: DataFrame, quota: int = DAILY_QUOTA) -> DataFrame:
    """Every attempt (user_id, attempt_id, ts) with `accepted`: the first `quota` of a user's day.

    The quota-th attempt of a day is found by a ranked filter (cut before the shuffle); all
    attempts are then joined with it, one row per user and day, where Spark splits skew.
    """
    rows = attempts.withColumn("day", F.to_date("ts"))
    first = Window.partitionBy("user_id", "day").orderBy("ts", "attempt_id")
    last = (
        rows.select("user_id", "day", "ts", "attempt_id")
        .withColumn("_rn", F.row_number().over(first))
        .filter(F.col("_rn") <= quota)
        .groupBy("user_id", "day")
        .agg(F.max(F.struct("ts", "attempt_id")).alias("_last"))
    )
    return rows.join(last, ["user_id", "day"]).withColumn("accepted", F.struct("ts", "attempt_id") <= F.col("_last")).drop("_last")


def _limit_stream(batches: Iterator[pd.DataFrame], limit: int, window_us: int) -> Iterator[pd.DataFrame]:
    """Decide hits that arrive sorted by (key, chain, us): state is one chain's last accepted times."""
    current, taken = None, []
    for pdf in batches:
        pdf = pdf.reset_index(drop=True)
        accepted = np.zeros(len(pdf), dtype=bool)
        us = pdf["us"].to_numpy()
        names = list(zip(pdf["key"], pdf["chain"]))
        edges = [0] + [i for i in range(1, len(names)) if names[i] != names[i - 1]] + [len(names)]
        for a, b in zip(edges, edges[1:]):
            if a == b:
                continue
            if names[a] != current:
                current, taken = names[a], []
            i = a
            while i < b:
                while taken and us[i] - taken[0] > window_us:
                    taken.pop(0)
                if len(taken) < limit:
                    accepted[i] = True
                    taken.append(us[i])
                    i += 1
                else:
                    # Nothing is accepted until the oldest accepted hit leaves the window.
                    i = a + int(np.searchsorted(us[a:b], taken[0] + window_us, side="right"))
        yield pdf.assign(accepted=accepted)


def rate_decisions(hits: DataFrame, limit: int = RATE_LIMIT, window_seconds: int = RATE_WINDOW_SECONDS) -> DataFrame:
    """Every hit (key, hit_id, ts) with `accepted`: fewer than `limit` accepted hits of the key in
    the window before it. Rejected hits do not count, so order matters.

    A hit with at most `limit` hits of any kind in its window is accepted whatever came
    before ("calm"). Time is cut into slabs; a slab that starts after a calm window has a
    known state, so the slabs of a key are independent except where traffic stays above the
    limit across a border. Only such chains, and only those with a busy hit at all, are
    walked one hit after another, streaming in bounded memory.
    """
    window_us = window_seconds * 1_000_000
    slab_us = window_us * SLAB_WINDOWS
    own = hits.select("key", "hit_id", F.unix_micros("ts").alias("us")).withColumn("slab", F.floor(F.col("us") / slab_us))
    # The last window of a slab is context for the next one.
    late = F.col("us") >= (F.col("slab") + 1) * slab_us - window_us
    halo = own.filter(late).withColumn("slab", F.col("slab") + 1).withColumn("halo", F.lit(True))
    rows = own.withColumn("halo", F.lit(False)).unionByName(halo)
    recent = Window.partitionBy("key", "slab").orderBy("us").rangeBetween(-window_us, 0)
    busy = F.count(F.lit(1)).over(recent) > limit
    slabs = (
        rows.withColumn("busy", busy)
        .filter(~F.col("halo"))
        .groupBy("key", "slab")
        .agg(F.max("busy").alias("busy"), F.max(F.col("busy") & late).alias("busy_end"))
    )
    by_time = Window.partitionBy("key").orderBy("slab")
    follows = (F.lag("slab").over(by_time) == F.col("slab") - 1) & F.lag("busy_end").over(by_time)
    chains = (
        slabs.withColumn("starts", ~F.coalesce(follows, F.lit(False)))
        .withColumn("chain", F.max(F.when(F.col("starts"), F.col("slab"))).over(by_time.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("walk", F.max("busy").over(Window.partitionBy("key", "chain")))
        .select("key", "slab", "chain", "walk", "starts")
    )
    placed = rows.join(chains, ["key", "slab"])
    calm = placed.filter(~F.col("walk") & ~F.col("halo")).select("key", "hit_id", "us", F.lit(True).alias("accepted"))
    # Context rows are needed only where a chain begins; there they are all accepted hits.
    walk = placed.filter(F.col("walk") & (~F.col("halo") | F.col("starts"))).select("key", "chain", "us", "hit_id", "halo")
    schema = walk.schema.add("accepted", "boolean")
    walked = (
        walk.repartition("key", "chain")
        .sortWithinPartitions("key", "chain", "us", "hit_id")
        .mapInPandas(lambda it: _limit_stream(it, limit, window_us), schema)
        .filter(~F.col("halo"))
        .select("key", "hit_id", "us", "accepted")
    )
    return calm.unionByName(walked).withColumn("ts", F.timestamp_micros("us")).drop("us")


def email_problem(email: Column) -> Column:
    """Null for an acceptable address, else "invalid" or "disposable"."""
    text = F.lower(strip(F.coalesce(email, F.lit(""))))
    domain = F.regexp_extract(text, "@([^@]*)$", 1)
    family = F.lit(False)
    for part in DISPOSABLE_FAMILIES:
        family = family | F.contains(domain, F.lit(part))
    return F.when((F.length(text) > EMAIL_MAX) | ~F.regexp_like(text, F.lit(EMAIL_PATTERN)), "invalid").when(
        domain.isin(*DISPOSABLE_DOMAINS) | family, "disposable"
    )


def name_problem(name: Column) -> Column:
    """Null for a full name: two words or more, each of two letters or more."""
    words = F.filter(F.split(squeeze(name), " "), lambda w: w != "")
    short = F.exists(words, lambda w: F.length(w) < 2)
    return F.when((F.size(words) < 2) | short, "incomplete")


def signup_violations(signups: DataFrame) -> DataFrame:
    """Sign-ups (email, full_name) with the list of broken rules; empty when there is none."""
    problems = F.array_compact(
        F.array(
            F.concat(F.lit("name "), name_problem(F.col("full_name"))),
            F.concat(F.lit("email "), email_problem(F.col("email"))),
        )
    )
    return signups.withColumn("violations", problems)


def insert_users(users: DataFrame, new: DataFrame) -> DataFrame:
    """Users plus new ones whose address is unknown; case does not count, the first new one wins."""
    key = F.lower(strip(F.col("email")))
    rest = new.columns
    fresh = new.withColumn("_key", key).groupBy("_key").agg(F.min_by(F.struct(*rest), F.struct("created_at", "user_id")).alias("_u"))
    known = users.select(key.alias("_key"))
    added = fresh.join(known, "_key", "left_anti").select(*[F.col(f"_u.{c}").alias(c) for c in rest])
    return users.unionByName(added.withColumn("email", F.lower(strip(F.col("email")))))


def delete_history(history: DataFrame, users: DataFrame) -> DataFrame:
    return history.join(users.select("user_id"), "user_id", "left_anti")


def account_overview(users: DataFrame, history: DataFrame, events: DataFrame) -> DataFrame:
    """One row: accounts with messages, their messages, anonymous questions. No limit."""
    per_user = history.join(users.select("user_id"), "user_id", "left_semi").groupBy("user_id").agg(F.count(F.lit(1)).alias("m"))
    totals = per_user.agg(F.count(F.lit(1)).alias("users_with_messages"), F.coalesce(F.sum("m"), F.lit(0)).alias("messages"))
    anonymous = events.filter((F.col("event_type") == "chat_message") & (F.coalesce("role", F.lit("")) != "admin"))
    return beside(totals, anonymous.agg(F.count(F.lit(1)).alias("anonymous_questions")))
