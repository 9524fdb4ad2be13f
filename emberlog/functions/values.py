"""Time, statistics, counts and levels, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberlog import rules
from emberlog.functions.text import first_match, full

WINDOW_SECONDS = 900
ALPHA = 0.3
COUNTS = "map<string,bigint>"


# --- time ---


def bucket(ts: Column, seconds: int = WINDOW_SECONDS) -> Column:
    """Start of the window that holds ``ts``; for 15 minutes this is the quarter of the hour."""
    return F.timestamp_seconds(F.floor(F.unix_micros(ts) / (seconds * 1_000_000)) * seconds)


def window_index(ts: Column, base: Column, seconds: int = WINDOW_SECONDS) -> Column:
    return F.floor((F.unix_micros(ts) - F.unix_micros(base)) / (seconds * 1_000_000)).cast("long")


def slot(ts: Column) -> tuple[Column, Column, Column]:
    """Weekday (0 is Monday), hour and quarter."""
    return F.weekday(ts).alias("dow"), F.hour(ts).alias("hour"), F.floor(F.minute(ts) / 15).cast("int").alias("quarter")


def shifted(ts: Column, hours: int = 1) -> Column:
    """Time patterns are kept in a fixed offset, without daylight saving."""
    return ts + F.expr(f"INTERVAL {int(hours)} HOURS")


def shown_time(ts: Column, zone: str = "Europe/Prague", fmt: str = "dd-MM-yyyy HH:mm") -> Column:
    return F.date_format(F.from_utc_timestamp(ts, zone), fmt)


# --- statistics of arrays and groups ---


def ewma(values: Column, alpha: float = ALPHA) -> Column:
    """Exponentially weighted mean in the array's order, seeded with its first value; 0 for an empty one."""
    v = values.cast("array<double>")
    return F.when(F.size(v) > 0, F.aggregate(F.slice(v, 2, F.greatest(F.size(v), F.lit(1))), F.get(v, F.lit(0)), lambda acc, x: F.lit(alpha) * x + F.lit(1 - alpha) * acc)).otherwise(F.lit(0.0))


def array_median(values: Column) -> Column:
    """Median of an array, interpolated; 0 for an empty one."""
    s, n = F.sort_array(values.cast("array<double>")), F.size(values)
    low, high = F.get(s, F.floor((n - 1) / 2).cast("int")), F.get(s, F.floor(n / 2).cast("int"))
    return F.when(n > 0, (low + high) / 2).otherwise(F.lit(0.0))


def array_mad(values: Column) -> Column:
    m = array_median(values)
    return array_median(F.transform(values.cast("array<double>"), lambda x: F.abs(x - m)))


def array_mean(values: Column) -> Column:
    total = F.aggregate(values.cast("array<double>"), F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(values) > 0, total / F.size(values)).otherwise(F.lit(0.0))


def floor_percentile(values: Column, p: float) -> Column:
    """``sorted[min(int(n * p), n - 1)]`` of an array."""
    n = F.size(values)
    return F.get(F.sort_array(values), F.least(F.floor(n * F.lit(p)), n - 1).cast("int"))


def upper_median(values: Column) -> Column:
    """``sorted[n // 2]`` of an array."""
    return F.get(F.sort_array(values), F.floor(F.size(values) / 2).cast("int"))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is null or zero."""
    return F.try_divide(a.cast("double"), b.cast("double"))


# --- levels ---


def severity(score: Column) -> Column:
    return first_match(((score >= least, name) for least, name in rules.SEVERITY_STEPS), "info")


def severity_rank(name: Column) -> Column:
    return first_match(((name == s, F.lit(i)) for i, s in enumerate(["info", "low", "medium", "high", "critical"])), F.lit(0))


def health_score(errors: Column, baseline: Column, critical: Column, high: Column) -> Column:
    """100 less a penalty for errors above the baseline (50 at most) and for severe ones. Fewer errors than the baseline raise it above 100."""
    excess = F.least(F.lit(50.0), F.when(baseline > 0, (errors - baseline) / baseline * 30).otherwise(errors * F.lit(0.5)))
    return F.round(F.greatest(F.lit(0.0), F.lit(100.0) - excess - critical * 10 - high * 5), 2)


def trend_text(current: Column, base: Column, label: str, cap: float = 200.0, arrow_from: float = 200.0) -> Column:
    pct = (current - base) / base * 100
    capped = F.least(F.lit(cap), F.abs(pct))
    big = F.format_string(f"{label}: %s %s%.0f%%%s", F.when(pct > 0, "↑").otherwise("↓"), F.when(pct > 0, "+").otherwise("-"), F.bround(capped, 0), F.when(F.abs(pct) > cap, "+").otherwise(""))
    small = F.format_string(f"{label}: → %s%.0f%%", F.when(pct >= 0, "+").otherwise("-"), F.bround(F.abs(pct), 0))  # a small fall is -0%
    flat = F.when(current == 0, F.lit(f"{label}: → 0")).otherwise(F.format_string(f"{label}: ↑ %d", current.cast("long")))
    return F.when(base <= 0, flat).when(F.abs(pct) >= arrow_from, big).otherwise(small)


def log_score(enriched: Column, daily: Column) -> Column:
    scaled = F.least(F.lit(100.0), F.log10(F.greatest(daily, F.lit(1)).cast("double")) / 3 * 100)
    return F.when(enriched > 0, F.bround(enriched, 1)).when(daily <= 0, F.lit(0.0)).otherwise(F.bround(scaled, 1))


def priority_score(score: Column, occurrences: Column, n_apps: Column, confidence: Column, new: Column, cross: Column, spike: Column, burst: Column) -> Column:
    volume = F.when(occurrences > 0, F.least(F.lit(20.0), F.log10(occurrences + F.lit(1.0)) * 6)).otherwise(F.lit(0.0))
    fan_out = F.least(F.lit(10), F.greatest(n_apps - 1, F.lit(0)) * 2)
    sure = F.when(confidence == "high", 10).when(confidence == "medium", 5).otherwise(0)
    flag = lambda c, w: F.coalesce(c, F.lit(False)).cast("int") * w
    return F.least(F.lit(150.0), score + volume + fan_out + sure + flag(new, 8) + flag(cross, 5) + flag(spike, 5) + flag(burst, 3))


def scope(n_namespaces: Column, n_apps: Column) -> Column:
    return F.when((n_namespaces >= 4) | (n_apps >= 8), "SYSTEMIC").when(n_namespaces >= 2, "CROSS_NS").otherwise("LOCAL")


def derived_severity(enriched: Column, scope_name: Column, category: Column, namespaces: Column) -> Column:
    """An enriched severity, else one by scope and category; a step lower where all namespaces are not for production."""
    by_scope = first_match(((scope_name == k, v) for k, v in rules.SCOPE_SEVERITY.items()), "low")
    base = F.when((by_scope == "low") & category.isin(rules.BOOSTED_CATEGORIES), "medium").otherwise(by_scope)
    level = F.when(enriched.isNotNull() & ~full(enriched).isin("", "info", "unknown"), enriched).otherwise(base)
    inner = lambda n: n.contains(rules.NON_PROD[0]) | n.contains(rules.NON_PROD[1])
    damped = F.when(level == "critical", "high").when(level == "high", "medium").when(level.isin("medium", "low"), "low").otherwise(level)
    return F.when((F.size(namespaces) > 0) & F.forall(namespaces, inner), damped).otherwise(level)


def day_status(error_change: Column, incident_change: Column, critical: Column) -> Column:
    both = lambda c: c(error_change) & c(incident_change)
    return (
        F.when((critical > 0) | (error_change > 50) | (incident_change > 50), "CRITICAL").when(both(lambda x: x > 10), "DEGRADING")
        .when(both(lambda x: x < -10), "IMPROVING").otherwise("STABLE")
    )


# --- maps of counts ---


def clean_counts(counts: Column) -> Column:
    return F.map_filter(F.coalesce(counts, F.create_map().cast(COUNTS)), lambda k, v: (k != "") & (v > 0))


def merged_counts(a: Column, b: Column) -> Column:
    return F.map_zip_with(clean_counts(a), clean_counts(b), lambda _, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))


def ranked_counts(counts: Column) -> Column:
    """Entries by count falling, then key."""
    e = F.transform(F.map_entries(clean_counts(counts)), lambda x: F.struct((-x["value"]).alias("down"), x["key"].alias("key"), x["value"].alias("value")))
    return F.transform(F.array_sort(e), lambda x: F.struct(x["key"].alias("key"), x["value"].alias("value")))


def dominant(counts: Column) -> Column:
    """Entry of the largest count; of several, the one with the largest key."""
    e = F.transform(F.map_entries(clean_counts(counts)), lambda x: F.struct(x["value"].alias("value"), x["key"].alias("key")))
    return F.array_max(e)


def counts_total(counts: Column) -> Column:
    return F.aggregate(F.map_values(clean_counts(counts)), F.lit(0).cast("long"), lambda a, x: a + x)


def is_test_traffic(originators: Column, total: Column, known: list[str] = rules.TEST_ORIGINATORS, least: float = rules.TEST_MIN_SHARE) -> Column:
    top = dominant(originators)
    return F.coalesce(F.lower(F.trim(top["key"])).isin(known) & (top["value"] / F.greatest(total, counts_total(originators), F.lit(1)) >= least), F.lit(False))


def counts_text(counts: Column, limit: int = 5) -> Column:
    """``a (3), b (1), +2 more``."""
    r = ranked_counts(counts)
    items = F.transform(F.slice(r, 1, limit), lambda x: F.concat(x["key"], F.lit(" ("), x["value"].cast("string"), F.lit(")")))
    more = F.when(F.size(r) > limit, F.array(F.concat(F.lit("+"), (F.size(r) - limit).cast("string"), F.lit(" more")))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(items, more), ", ")


def counts_lines(counts: Column, limit: int = 5) -> Column:
    return F.array_join(F.transform(F.slice(ranked_counts(counts), 1, limit), lambda x: F.concat(x["key"], F.lit(" ("), F.format_number(x["value"], 0), F.lit(")"))), "\n")


def volume_between(times: Column, now: Column, start: int, end: int) -> Column:
    """Counts of an array of (ts, n) with ``start <= now - ts < end`` seconds."""
    age = lambda x: (F.unix_micros(now) - F.unix_micros(x["ts"])) / 1e6
    return F.aggregate(F.filter(times, lambda x: (age(x) >= start) & (age(x) < end)), F.lit(0).cast("long"), lambda a, x: a + x["n"])
