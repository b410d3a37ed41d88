"""Provider quotas as windows over a usage log, and routing under them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lithic.operators import scans
from lithic.operators.folds import fold
from lithic.settings import DEFAULTS
from lithic.sources import workspace


@dataclass(frozen=True)
class Limits:
    requests_minute: int
    requests_day: int
    tokens_minute: int
    tokens_day: int


def usage(log: DataFrame, provider: str, at: str, tokens: str, unit: str) -> DataFrame:
    """(provider, bucket, requests, tokens) per minute or UTC day."""
    return log.groupBy(provider, F.date_trunc(unit, at).alias("bucket")).agg(F.count("*").alias("requests"), F.sum(tokens).alias("tokens"))


def binding(minute_limit: Column, minute_used: Column, day_limit: Column, day_used: Column) -> tuple[Column, Column]:
    """(remaining, limit) of the tighter of two windows; the minute's among equals."""
    minute, day = F.greatest(F.lit(0), minute_limit - minute_used), F.greatest(F.lit(0), day_limit - day_used)
    return F.least(minute, day), F.when(minute <= day, minute_limit).otherwise(day_limit)


def allows(remaining: Column, limit: Column, tokens_left: Column, token_limit: Column, estimate: Column, margin: Column) -> Column:
    share = lambda x: F.floor(x * margin / 100)
    return (remaining > share(limit)) & (tokens_left - estimate > share(token_limit))


def margin(interactive: Column) -> Column:
    """A batch call leaves the reserve to interactive ones."""
    return F.when(interactive, DEFAULTS.quota_margin_percent).otherwise(DEFAULTS.quota_margin_percent + DEFAULTS.batch_reserve_percent)


def route(calls: DataFrame, ladder: list[str], quotas: DataFrame) -> DataFrame:
    """For each call (call_id, estimate, interactive, tried) the first provider of the ladder that was not
    tried and has quota; null if there is none. quotas: provider, remaining, limit, tokens_left, token_limit."""
    steps = calls.select("*", F.posexplode(F.array(*[F.lit(p) for p in ladder])).alias("step", "provider"))
    open_ = steps.where(~F.array_contains("tried", F.col("provider"))).join(F.broadcast(quotas.where(F.col("provider").isin(ladder)).dropDuplicates(["provider"])), "provider").where(allows(F.col("remaining"), F.col("limit"), F.col("tokens_left"), F.col("token_limit"), F.col("estimate"), margin(F.col("interactive"))))
    first = open_.groupBy("call_id").agg(F.min_by("provider", "step").alias("provider"))
    return calls.join(first, "call_id", "left")


def breaker(fetches: DataFrame, host: str, at: str, seq: str, failed: str, most: int = DEFAULTS.breaker_failures, open_seconds: int = DEFAULTS.breaker_open_seconds, hot: int = scans.HOT) -> DataFrame:
    """fetches with ``allowed``: whether a host's circuit lets this one through. More than ``most`` failures in a row
    open it; while it is open nothing goes through or counts; after that one fetch is tried, and closes it or
    opens it anew. What follows depends on every verdict before, so it is a fold over a host's rows in order; a
    host of more than ``hot`` rows is gone through by many tasks."""

    def step(state, row):
        fails, until = state or (0, None)
        at, bad = row
        if until is not None and at < until:
            return (fails, until), False
        if not bad:
            return (0, None), True
        if until is not None or fails + 1 > most:
            return (0, at + open_seconds * 1_000_000), True
        return (fails + 1, None), True

    few, many = scans.parted(fetches, host, hot)
    told = fold(few, host, [at, seq], [at, failed], step, "allowed boolean")
    return told if many is None else told.unionByName(_broken(many, at, seq, failed, most, open_seconds * 1_000_000).select(*told.columns))


def _broken(fetches: DataFrame, at: str, seq: str, failed: str, most: int, pause: int) -> DataFrame:
    """The breaker as a path: each fetch at which the circuit may open points to the next such one, whatever was before. Behind
    an opening the first fetch after the pause is tried; if it fails it opens the circuit again, else the next opening is
    the first fetch, ``most`` or more behind the trial, that ends more than ``most`` failures in a row."""
    key = scans.KEY
    rows = workspace.cut(scans.placed(fetches.withColumn("at_", scans.micros(fetches, at)), key, ["at_", seq]))
    bad = F.coalesce(F.col(failed), F.lit(False))
    good = rows.where(~bad).select(key, (-F.col("place")).alias("x"), "place")
    runs = scans.following(good, rows.where(bad).select(key, (-F.col("place")).alias("x"), F.col("place").alias("node"), F.col("at_").alias("t")), key, "x", {"last": F.col("place")})
    ends = runs.where(F.col("node") - F.coalesce("last", F.lit(-1)) > most).select(key, F.col("node").alias("y"), F.col("node").alias("place"))
    # the fetch that is tried after each possible opening; only failures open
    tried = scans.following(rows.select(key, F.col("at_").alias("x"), "place", bad.alias("bad")), runs.select(key, (F.col("t") + pause).alias("x"), "node"), key, "x", {"trial": F.struct("place", "bad")}, ["place"])
    starts = tried.where("trial is not null and not trial.bad").select(key, (F.col("trial.place") + 1 + most).alias("y"), "node")
    first = rows.select(key).distinct().select(key, F.lit(most).cast("long").alias("y"), F.lit(-1).cast("long").alias("node"))
    opened = scans.following(ends, starts.unionByName(first), key, "y", {"next": F.col("place")}).select(key, "node", "next").where("next is not null")
    again = tried.where("trial.bad").select(key, "node", F.col("trial.place").alias("next"))
    edges = workspace.cut(opened.where("node >= 0").unionByName(again))
    path = scans.path(edges, opened.where("node < 0").select(key, F.col("next").alias("node")))
    openings = rows.join(path.withColumnRenamed("node", "place"), [key, "place"], "left_semi").select(key, (-F.col("place")).alias("x"), (F.col("at_") + pause).alias("until"))
    under = scans.following(openings, rows.select("*", (1 - F.col("place")).alias("x")), key, "x", {"until_": F.col("until")})
    return under.withColumn("allowed", F.coalesce(F.col("at_") >= F.col("until_"), F.lit(True)))


def metrics(outcomes: DataFrame, keys: list[str], value: str) -> DataFrame:
    return outcomes.groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.avg(value), 6).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"))


def park_until(at: Column, window: Column) -> Column:
    """When an exhausted provider returns: a minute's quota at the next minute, a day's at the next Pacific
    midnight; a balance never by itself (null)."""
    return F.when(window == "minute", next_minute(at)).when(window == "day", next_pacific_midnight(at))


def parked(exhausted: DataFrame, now: Column) -> DataFrame:
    """(provider, until) of the providers parked now, by the log (provider, at, window): the latest return counts,
    and a spent balance (until null) goes over any."""
    until = F.struct((F.col("window") == "balance").alias("for_good"), park_until(F.col("at"), F.col("window")).alias("until"))
    last = exhausted.where(F.col("at") <= now).groupBy("provider").agg(F.max(until).alias("u"))
    return last.where(F.col("u.for_good") | (F.col("u.until") > now)).select("provider", F.when(~F.col("u.for_good"), F.col("u.until")).alias("until"))


def paced(fetches: DataFrame, host: str, seq: str, seconds: float, lanes: int = 2) -> DataFrame:
    """fetches with ``wait``, the seconds after which each may start: a host has so many lanes and every lane
    pauses between two fetches."""
    place = F.row_number().over(Window.partitionBy(host).orderBy(seq)) - 1
    return fetches.withColumn("wait", F.floor(place / lanes) * F.lit(seconds))


def next_daily(at: Column, hour: int = DEFAULTS.daily_hour) -> Column:
    """The next time of day at which the daily runs start, in UTC."""
    today = F.date_trunc("day", at) + F.make_dt_interval(hours=F.lit(hour))
    return F.when(at < today, today).otherwise(today + F.expr("INTERVAL 1 DAY"))


def stalled(progress: DataFrame, now: Column, minutes: int) -> DataFrame:
    """Consumers (consumer, at, rows) whose last progress is longer ago."""
    return progress.groupBy("consumer").agg(F.max("at").alias("last")).withColumn("stalled", F.col("last") < now - F.make_interval(mins=F.lit(minutes)))


def next_minute(at: Column) -> Column:
    return F.date_trunc("minute", at) + F.expr("INTERVAL 1 MINUTE")


def next_pacific_midnight(at: Column) -> Column:
    local = F.from_utc_timestamp(at, "America/Los_Angeles")
    return F.to_utc_timestamp(F.date_trunc("day", local) + F.expr("INTERVAL 1 DAY"), "America/Los_Angeles")


def distribution(outcomes: DataFrame, keys: list[str], value: str, edges: list[float]) -> DataFrame:
    """(keys, below, n, share): how many values lie below each edge and not below the one before; the last row, below
    null, has the rest. Null values are in none."""
    at = F.array_position(F.transform(F.array(*[F.lit(float(e)) for e in edges]), lambda e: F.col(value) < e), True)
    rows = outcomes.where(F.col(value).isNotNull()).groupBy(*keys, at.alias("at_")).agg(F.count("*").alias("n"))
    whole = rows.groupBy(*keys).agg(F.sum("n").alias("all_"))
    below = F.when(F.col("at_") > 0, F.element_at(F.array(*[F.lit(float(e)) for e in edges]), F.greatest("at_", F.lit(1)).cast("int")))
    return rows.join(whole, keys).select(*keys, below.alias("below"), "n", (F.col("n") / F.col("all_")).alias("share"))


def gauges(log: DataFrame, provider: str, at: str, tokens: str, limits: DataFrame, now: Column) -> DataFrame:
    """(provider, window, requests_left, tokens_left) of each of limits (provider, window: minute or day, requests, tokens) at a
    time: what its current minute or UTC day has left, all of it where nothing was used."""
    found = None
    for unit in ("minute", "day"):
        inside = log.where((F.date_trunc(unit, at) == F.date_trunc(unit, now)) & (F.col(at) <= now))
        used = inside.groupBy(F.col(provider).alias("provider")).agg(F.count("*").alias("used_"), F.sum(tokens).alias("spent_"))
        left = lambda limit, spent: F.greatest(F.lit(0), F.col(limit) - F.coalesce(F.col(spent), F.lit(0)))
        rows = limits.where(F.col("window") == unit).join(used, "provider", "left").select("provider", "window", left("requests", "used_").alias("requests_left"), left("tokens", "spent_").alias("tokens_left"))
        found = rows if found is None else found.unionByName(rows)
    return found
