"""Pieces of SQL that the queries' counterparts are put together from, made of the same ordered lists as the operators."""

from __future__ import annotations

from collections.abc import Iterable

from emberlog import rules
from emberlog.sources.logs import LOG_VIEW


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def replaced(expr: str, pairs: Iterable[tuple[str, str]]) -> str:
    for pattern, by in pairs:
        expr = f"regexp_replace({expr}, {quoted(pattern)}, {quoted(by)}, 'g')"
    return expr


def case(rows: Iterable[tuple[str, str]], otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in rows) + f" ELSE {otherwise} END"


def has(expr: str, needle: str) -> str:
    return f"starts_with({expr}, {quoted(needle[1:])})" if needle[:1] == "^" else f"contains({expr}, {quoted(needle)})"


def has_all(expr: str, needles: Iterable[str]) -> str:
    return "(" + " AND ".join(has(expr, n) for n in needles) + ")"


def has_any(expr: str, needles: Iterable[str]) -> str:
    return "(" + " OR ".join(has(expr, n) for n in needles) + ")"


def matches(expr: str, pattern: str) -> str:
    return f"regexp_matches({expr}, {quoted(pattern)})"


def extract(expr: str, pattern: str, group: int = 1) -> str:
    return f"nullif(regexp_extract({expr}, {quoted(pattern)}, {group}), '')"


def bucket(us: str = "us", seconds: int = 900) -> str:
    """Start of a window in epoch seconds."""
    return f"CAST(floor({us} / {seconds * 1_000_000}.0) * {seconds} AS BIGINT)"


def weekday(bucket_seconds: str) -> str:
    """0 is Monday; the first of January 1970 was a Thursday."""
    return f"(({bucket_seconds} // 86400 + 3) % 7)"


def ctes(*names: str) -> str:
    """``WITH`` the named tables and all they need, in order."""
    needed: list[str] = []

    def add(name: str) -> None:
        for other in NEEDS[name]:
            add(other)
        if name not in needed:
            needed.append(name)

    for n in names:
        add(n)
    return "WITH " + ",\n".join(f"{n} AS ({TABLES[n]})" for n in needed)


_LOW = "lower(message)"
ERROR_TYPE = "coalesce({named}, {stack}, nullif({of_message}, 'UnknownError'), nullif({domain}, 'UnknownError'), {status}, 'UnknownError')".format(
    named="regexp_extract(exception_type, '([^.]*)$', 1)", stack=extract("stack_trace", r"(\w+(?:Exception|Error))"),
    of_message="coalesce({}, {})".format(
        ", ".join(extract("message", p) for p in rules.ERROR_TYPE_PATTERNS), case(((has_all(_LOW if low else "message", n), quoted(k)) for n, low, k in rules.ERROR_TYPE_SUBSTRINGS), "'UnknownError'")
    ),
    domain=case(((has_all(_LOW, n), quoted(k)) for n, k in rules.DOMAIN_TYPES), "'UnknownError'"),
    status=case(((f"http_status = {c}", quoted(k)) for c, k in rules.HTTP_TYPES), "NULL"),
)
ENVIRONMENT = "coalesce(" + case(((matches("lower(namespace)", p), quoted(e)) for p, e in rules.ENVIRONMENTS), "'unknown'") + ", 'unknown')"

TABLES = {
    "logs": "SELECT epoch_us(ts) AS us, " + ", ".join(f"{v} AS {k}" for k, v in LOG_VIEW.items()) + " FROM events",
    "errs": "SELECT * FROM logs WHERE level = 'ERROR'",
    "typed": f"SELECT *, substring({replaced('message', rules.NORMALISATION)}, 1, 500) AS normalized_message, {ERROR_TYPE} AS error_type FROM errs",
    "rec": f"""SELECT seq, us, coalesce(namespace, 'unknown') AS namespace, app_name, app_version AS raw_version, trace_id, span_id, parent_span_id, originator, message AS raw_message,
        CASE WHEN regexp_matches(CASE WHEN lower(app_version[1]) = 'v' THEN app_version[2:] ELSE app_version END, {quoted(rules.SEMVER)}) THEN CASE WHEN lower(app_version[1]) = 'v' THEN app_version[2:] ELSE app_version END END AS app_version,
        {ENVIRONMENT} AS environment, normalized_message, error_type, substring(md5(error_type || ':' || normalized_message), 1, 16) AS fingerprint, {bucket()} AS w FROM typed""",
    "facts": """SELECT w, namespace, app_name, fingerprint, count(*) AS n, min(us) AS first_us, max(us) AS last_us, min(error_type) AS error_type, min(seq) AS first_seq
        FROM rec GROUP BY ALL""",
    "monitored": "SELECT unnest(['shop-prod-01', 'shop-prod-02', 'cards-uat-01', 'cards-dev-04', 'core-sit']) AS namespace",
    "ns_counts": "SELECT namespace, w, CAST(sum(n) AS BIGINT) AS n FROM facts GROUP BY ALL",
    "dense": """SELECT g.w, g.namespace, coalesce(c.n, 0) AS n FROM (
        SELECT unnest(range((SELECT min(w) FROM facts), (SELECT max(w) FROM facts) + 900, 900)) AS w, namespace FROM monitored) g LEFT JOIN ns_counts c ON c.w = g.w AND c.namespace = g.namespace""",
    "p93": f"""SELECT namespace, {weekday('w')} AS dow, list_sort(list(CAST(n AS DOUBLE)))[least(CAST(floor(count(*) * 0.93::DOUBLE) AS BIGINT), count(*) - 1) + 1] AS p93,
        count(*) AS samples, list_sort(list(CAST(n AS DOUBLE)))[count(*) // 2 + 1] AS median, avg(n) AS mean, CAST(max(n) AS DOUBLE) AS max FROM dense GROUP BY ALL""",
    "caps": """SELECT namespace, list_sort(list(p93))[count(*) // 2 + 1] AS median_p93, avg(p93) AS avg_p93, min(p93) AS min_p93, max(p93) AS max_p93, CAST(sum(samples) AS BIGINT) AS total_samples,
        (list_sort(list(p93))[count(*) // 2 + 1] + avg(p93)) / 2 AS cap FROM p93 GROUP BY namespace""",
}
NEEDS = {"logs": [], "errs": ["logs"], "typed": ["errs"], "rec": ["typed"], "facts": ["rec"], "monitored": [], "ns_counts": ["facts"], "dense": ["ns_counts", "monitored"], "p93": ["dense"], "caps": ["p93"]}
