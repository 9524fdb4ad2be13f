"""Message functions: normalisation, error types, fingerprints, keys and scores, as Column expressions.

All are built-in string expressions driven by the ordered lists of :mod:`emberlog.rules`, so that they
stay in generated code. Null messages count as empty unless a function says otherwise.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberlog import rules


def first_match(cases: Iterable[tuple[Column, Column | str]], otherwise: Column | str | None) -> Column:
    """``CASE WHEN`` over the conditions in order."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    out = None
    for cond, value in cases:
        out = F.when(cond, lit(value)) if out is None else out.when(cond, lit(value))
    return lit(otherwise) if out is None else out.otherwise(lit(otherwise))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body names it."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def replaced(text: Column, pairs: Iterable[tuple[str, str]]) -> Column:
    return reduce(lambda c, p: F.regexp_replace(c, p[0], p[1]), pairs, text)


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the pattern's first match, null if there is none or it is empty."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def has_any(text: Column, needles: Iterable[str]) -> Column:
    return reduce(lambda a, b: a | b, (text.contains(x) for x in needles))


def has_all(text: Column, needles: Iterable[str]) -> Column:
    return reduce(lambda a, b: a & b, (text.startswith(x[1:]) if x[0] == "^" else text.contains(x) for x in needles))


def full(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


# --- parsing ---


def _replaced_where(text: Column, pattern: str, by: str, needs: list[str]) -> Column:
    """A replacement that searches only texts with one of ``needs``, which a search for plain text tells sooner."""
    return let(text, lambda t: F.when(has_any(t, needs), F.regexp_replace(t, pattern, by)).otherwise(t)) if needs else F.regexp_replace(text, pattern, by)


def normalised_message(msg: Column) -> Column:
    """The message without what varies (ids, addresses, times, ...), at most 500 characters."""
    steps = zip(rules.NORMALISATION, rules.NORMALISATION_NEEDS, strict=True)
    return F.substring(reduce(lambda c, step: _replaced_where(c, *step[0], step[1]), steps, full(msg)), 1, 500)


def error_type_of_message(msg: Column) -> Column:
    msg = full(msg)
    low = F.lower(msg)
    fallback = first_match(((has_all(low if lowered else msg, needles), kind) for needles, lowered, kind in rules.ERROR_TYPE_SUBSTRINGS), "UnknownError")
    suffix = lambda p: p.removeprefix(r"(\w+").removesuffix(")")  # noqa: E731  # a plain text, sooner found than the words before it
    return F.coalesce(*(F.when(msg.contains(suffix(p)), found(msg, p)) for p in rules.ERROR_TYPE_PATTERNS), fallback)


def domain_error_type(msg: Column) -> Column:
    low = F.lower(full(msg))
    return first_match(((has_all(low, needles), kind) for needles, kind in rules.DOMAIN_TYPES), "UnknownError")


def error_type(msg: Column, exception_type: Column, stack_trace: Column, http_status: Column, declared: Column | None = None) -> Column:
    """From the exception, a declared type, the stack trace, the message, known message families, the HTTP status; the first that says something."""
    unknown = F.lit("UnknownError")
    named = F.substring_index(F.nullif(exception_type, F.lit("")), ".", -1)
    by_status = first_match(((http_status.cast("int") == code, kind) for code, kind in rules.HTTP_TYPES), None)
    return F.coalesce(
        named, *([F.nullif(declared, F.lit(""))] if declared is not None else []), found(stack_trace, r"(\w+(?:Exception|Error))"),
        F.nullif(error_type_of_message(msg), unknown), F.nullif(domain_error_type(msg), unknown), by_status, unknown,
    )


def fingerprint(error_type: Column, normalised: Column) -> Column:
    return F.substring(F.md5(F.concat(error_type, F.lit(":"), normalised)), 1, 16)


def guessed_category(error_type: Column, msg: Column) -> Column:
    text = F.lower(F.concat(full(error_type), F.lit(" "), full(msg)))
    return first_match(((has_any(text, words), c) for words, c in rules.GUESSES), "unknown")


def guessed_subcategory(category: Column, error_type: Column, msg: Column) -> Column:
    text = F.lower(F.concat(full(error_type), F.lit(" "), full(msg)))
    cases = [((category == c) & has_any(text, words), sub) for c, words, sub in rules.SUBGUESSES]
    return first_match([*cases, (category == "auth", "unauthorized")], "general")


def grouped_fingerprint(error_type: Column, msg: Column) -> Column:
    """Fingerprint of the problem's kind: category, subcategory and the first 100 characters without numbers."""
    category = guessed_category(error_type, msg)
    plain = replaced(full(msg), [(r"\b\d+\b", "N"), (r"(?i)\b[0-9a-f]{8,}\b", "ID"), (r"\s+", " ")])
    return F.substring(F.md5(F.concat_ws("|", category, guessed_subcategory(category, error_type, msg), F.substring(F.trim(plain), 1, 100))), 1, 16)


def parsed_time(text: Column) -> Column:
    return F.try_to_timestamp(F.nullif(text, F.lit("")))


def environment(namespace: Column) -> Column:
    low = F.lower(namespace)
    return F.coalesce(first_match(((low.rlike(p), env) for p, env in rules.ENVIRONMENTS), "unknown"), F.lit("unknown"))


def plain_environment(namespace: Column) -> Column:
    """Four environments by an inner part or the last part of the name."""
    low = F.lower(full(namespace))
    return first_match(((low.contains(f"-{e}-") | low.endswith(f"-{e}"), e) for e in ("prod", "uat", "sit", "dev")), "unknown")


def semantic_version(*sources: Column) -> Column:
    """The first filled source if it is X.Y.Z (with pre-release and build parts), a leading v dropped; else null."""
    v = F.trim(F.coalesce(*(F.nullif(s, F.lit("")) for s in sources)))
    bare = F.when(F.lower(F.substring(v, 1, 1)) == "v", F.substring(v, 2, 1000)).otherwise(v)
    return F.when(bare.rlike(rules.SEMVER), bare)


def loose_version(*sources: Column) -> Column:
    return F.coalesce(*(F.when(s.rlike(r"^\d+\.\d+"), s) for s in sources))


def version_numbers(version: Column) -> Column:
    """All digit groups as numbers; arrays of them compare as versions do. No digits: [0]."""
    digits = F.transform(F.regexp_extract_all(full(version), F.lit(r"\d+"), F.lit(0)), lambda d: d.cast("long"))
    return F.when(F.size(digits) == 0, F.array(F.lit(0).cast("long"))).otherwise(digits)


def version_at_least(version: Column, other: Column) -> Column:
    return version_numbers(version) >= version_numbers(other)


def latest_version(versions: Column) -> Column:
    """The highest of an array of versions, by numbers and then as a string; those without digits don't count."""
    ranked = F.transform(F.filter(versions, lambda v: v.isNotNull() & v.rlike(r"\d")), lambda v: F.struct(version_numbers(v).alias("n"), v.alias("v")))
    return F.array_max(ranked)["v"]


def semver(version: Column) -> Column:
    """(major, minor, patch) of ``v?X.Y.Z``, or null."""
    p = r"^v?(\d+)\.(\d+)\.(\d+)"
    return F.when(version.rlike(p), F.struct(*(F.regexp_extract(version, p, i).cast("long").alias(n) for i, n in ((1, "major"), (2, "minor"), (3, "patch")))))


def sorted_versions(versions: Column) -> Column:
    """An array of versions in order: ``release-YYYY.MM`` and semantic versions by their numbers, a pre-release before its release."""
    key = lambda v: F.struct(version_numbers(F.regexp_replace(v, r"-(?!\d{4}).*$", "")).alias("n"), (~v.rlike(r"\d-[A-Za-z]")).alias("final"), v.alias("v"))
    return F.transform(F.array_sort(F.transform(versions, key)), lambda s: s["v"])


# --- what a message says ---


def _inner(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(text), r"\]+$", ""))


def _of_fault(text: Column, fault: Column) -> Column:
    """What an error model says: its message, or its detail where the message is generic."""
    said, detail = _inner(fault), _inner(full(found(text, r"detail=([^,\]]+)")))
    generic = lambda s: F.lower(s).isin("", "null", "<null>", "service exception")
    none = lambda d: F.lower(d).isin("", "null", "<null>")
    return let(F.struct(said.alias("said"), detail.alias("detail")), lambda x: F.when(~generic(x["said"]) | none(x["detail"]), x["said"]).when(x["said"] == "", x["detail"]).otherwise(F.concat(x["said"], F.lit(" / "), x["detail"])))


def _of_code(text: Column) -> Column:
    """A structured code as ``Class#method → status (rest)``."""
    part = lambda i: F.regexp_extract(text, rules.STRUCTURED_CODE, i)
    known = lambda c: F.nullif(F.nullif(c, F.lit("n/a")), F.lit(""))
    trail = F.trim(F.regexp_replace(F.trim(part(9)), r"#+$", ""))
    return F.concat(
        let(F.concat_ws("#", known(part(6)), known(part(7))), lambda names: F.when(names == "", part(1)).otherwise(names)), F.coalesce(F.concat(F.lit(" → "), known(part(8))), F.lit("")),
        let(trail, lambda t: F.when(t != "", F.concat(F.lit(" ("), F.substring(t, 1, 120), F.lit(")"))).otherwise(F.lit(""))),
    )


def useful_content(msg: Column) -> Column:
    """The part of a message that says what happened; empty for mere wrappers."""

    def of(text: Column) -> Column:
        wrapper = text.rlike("(?i)" + rules.WRAPPER_HANDLED) | text.rlike("(?i)" + rules.WRAPPER_CASE)
        return (
            F.when(wrapper, F.lit("")).when(text.rlike(rules.HANDLE_FAULT), _of_fault(text, found(text, rules.HANDLE_FAULT))).when(text.rlike(rules.STRUCTURED_CODE), _of_code(text))
            .otherwise(F.rtrim(F.substring_index(text, "\n", 1)))
        )

    return let(F.regexp_replace(full(msg), r"^\s+|\s+$", ""), of)


def useful_or(msg: Column, other: Column) -> Column:
    return let(useful_content(msg), lambda u: F.when(u != "", u).otherwise(other))


def smart_trim(msg: Column, limit: int = 250) -> Column:
    """Useful content of at most ``limit`` characters, cut at the last space or full stop if that keeps more than half."""

    def short(head: Column) -> Column:
        cut = F.length(F.regexp_extract(head, r"(?s)^(.*)[ .]", 1))
        return F.concat(F.when((cut > limit // 2) & head.rlike("[ .]"), F.substring(head, F.lit(1), cut)).otherwise(head), F.lit("..."))

    return let(useful_content(msg), lambda text: F.when(F.length(text) <= limit, text).otherwise(let(F.substring(text, 1, limit - 3), short)))


def signal_score(msg: Column) -> Column:
    """How much a message says: wrappers are negative, messages that name a cause positive."""

    def of(low: Column) -> Column:
        count = lambda patterns: reduce(lambda a, b: a + b, (low.rlike(p).cast("int") for p in patterns))
        score = (F.length(low) >= 40).cast("int") + 3 * count(rules.SIGNAL_GOOD) - 3 * count(rules.SIGNAL_BAD)
        return F.when(low == "", 0).when(F.trim(low).rlike("(?i)" + rules.WRAPPER_HANDLED), -10).when(low.rlike(rules.WRAPPER_CASE), -5).when(low.contains("anonymize original error detail"), -8).otherwise(score)

    return let(F.lower(full(msg)), of)


def trace_message(msg: Column) -> Column:
    """A message without ids and times, white space collapsed."""
    return F.trim(F.regexp_replace(replaced(full(msg), rules.TRACE_NORMALISATION), r"\s+", " "))


def event_error_class(error_type: Column, normalised: Column) -> Column:
    """The error type if it says something, else the first four longer words of the message."""
    text = F.lower(trace_message(useful_or(normalised, normalised)))
    words = F.slice(F.filter(F.split(text, r"\s+"), lambda w: F.length(w) > 3), 1, 4)
    of_message = let(F.array_join(words, "_"), lambda w: F.when(w != "", w).otherwise(F.lit("unknown")))
    return let(F.trim(full(error_type)), lambda kind: F.when(~F.lower(kind).isin(rules.UNINFORMATIVE_TYPES), kind).otherwise(of_message))


# --- problem keys, in the dialects of the aggregator and of the registry ---


def _parts(app: Column, skip: list[str], least: int) -> Column:
    return F.filter(F.split(F.translate(F.lower(app), "_", "-"), "-"), lambda p: ~p.isin(skip) & ~p.rlike(r"^\d+$") & (F.length(p) >= least))


def _named_by_parts(apps: Column, skip: list[str], least: int) -> Column:
    return F.nullif(F.array_join(F.slice(_parts(F.get(apps, F.lit(0)), skip, least), 1, 2), "_"), F.lit(""))


def flow(apps: Column) -> Column:
    """Aggregator: the first app that a pattern fits names the flow; else the first app's first two meaningful parts."""
    of_app = lambda a: first_match(((F.lower(a).contains(p), f) for p, f in rules.FLOWS), None)
    fits = F.get(F.filter(F.transform(apps, of_app), lambda x: x.isNotNull()), F.lit(0))
    return F.coalesce(fits, _named_by_parts(apps, rules.FLOW_SKIP, 3), F.lit("unknown"))


def registry_flow(apps: Column, namespaces: Column | None = None) -> Column:
    """Registry: the first pattern that fits any app; else the first app's first two meaningful parts; without apps, the first part of the first namespace."""
    safe = F.filter(F.coalesce(apps, F.array().cast("array<string>")), lambda a: a.isNotNull() & (F.trim(a) != ""))
    joined = F.lower(F.array_join(safe, " "))
    fits = first_match(((joined.rlike(p), f) for p, f in rules.REGISTRY_FLOWS), None)
    of_apps = F.coalesce(fits, _named_by_parts(safe, rules.REGISTRY_FLOW_SKIP, 0), F.lit("unknown"))
    if namespaces is None:
        return F.when(F.size(safe) > 0, of_apps).otherwise(F.lit("unknown"))
    spaces = F.filter(namespaces, lambda n: n.isNotNull() & (F.trim(n) != ""))
    return F.when(F.size(safe) > 0, of_apps).otherwise(F.coalesce(F.get(F.split(F.translate(F.lower(F.get(spaces, F.lit(0))), "_", "-"), "-"), F.lit(0)), F.lit("unknown")))


def app_flow(app: Column) -> Column:
    return flow(F.array(app))


def error_class(error_type: Column, normalised: Column) -> Column:
    """Aggregator: a keyword class of the type, else the type itself; a type that says nothing leaves it to the message."""
    kind, low = F.lower(full(error_type)), F.lower(full(normalised))
    of_type = first_match(((has_any(kind, words), c) for words, c in rules.TYPE_CLASSES), F.substring(F.lower(F.replace(full(error_type), F.lit(" "), F.lit("_"))), 1, 50))
    of_message = first_match(((has_any(low, words), c) for words, c in rules.MESSAGE_CLASSES), "unknown_error")
    return F.when(kind.isin(rules.UNINFORMATIVE_TYPES), of_message).otherwise(of_type)


def registry_error_class(error_type: Column, normalised: Column) -> Column:
    text = F.concat(full(error_type), F.lit(" "), full(normalised))
    snake = F.lower(F.regexp_replace(F.regexp_replace(error_type, "(.)([A-Z][a-z]+)", "$1_$2"), "([a-z0-9])([A-Z])", "$1_$2"))
    unnamed = F.coalesce(error_type, F.lit("")).isin("", "UnknownError")
    return first_match(((text.rlike(f"(?i){p}"), c) for p, c in rules.REGISTRY_CLASSES), F.when(unnamed, F.lit("unclassified")).otherwise(snake))


def registry_key(category: Column, apps: Column, error_type: Column, normalised: Column, namespaces: Column | None = None) -> Column:
    name = F.upper(F.coalesce(F.nullif(category, F.lit("")), F.lit("UNKNOWN")))
    return F.concat_ws(":", name, registry_flow(apps, namespaces), registry_error_class(error_type, normalised))


def discriminator(normalised: Column) -> Column:
    """The first five words of four letters or more of what the message says, at most 50 characters; empty for wrappers."""
    text = replaced(useful_content(normalised), [(rules.FQCN_PREFIX, ""), (rules.BARE_PREFIX, "")])
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-zA-Z]{4,}"), F.lit(0))
    return F.substring(F.array_join(F.slice(words, 1, 5), "_"), 1, 50)


def is_generic_class(name: Column, generic: list[str] = rules.GENERIC_CLASSES) -> Column:
    return F.lower(full(name)).isin(generic)


def problem_key(category: Column, apps: Column, error_type: Column, normalised: Column, generic: list[str] = rules.GENERIC_CLASSES) -> Column:
    """Aggregator: ``category:flow:class``, with words of the message added to classes that say little."""
    cls, words = error_class(error_type, normalised), discriminator(normalised)
    vague = (cls == "unknown_error") | is_generic_class(cls, generic) | is_generic_class(error_type, generic)
    return F.concat_ws(":", category, flow(apps), F.when(vague & (words != ""), F.concat(cls, F.lit("__"), words)).otherwise(cls))


# --- texts for people ---


def http_status_of(msg: Column) -> Column:
    return F.regexp_extract(F.trim(full(msg)), rules.STRUCTURED_STATUS, 1)


def without_stack(text: Column) -> Column:
    """One line, cut before the first stack frame."""
    line = F.trim(F.regexp_replace(full(text), r"\s+", " "))
    return F.trim(F.regexp_replace(line, rules.STACK_FRAME + ".*$", ""))


def clean_stack(text: Column) -> Column:
    """As :func:`without_stack`; a text without a whole frame is cut before `` at `` and a well-known package; a trailing ``...`` goes."""
    line = F.trim(F.regexp_replace(full(text), r"\s+", " "))
    cut = F.when(line.rlike(rules.STACK_FRAME), F.regexp_replace(line, rules.STACK_FRAME + ".*$", "")).otherwise(F.regexp_replace(line, r"\s+at\s+(?:org|cz|java|javax|jakarta|com)\..*$", ""))
    return F.trim(F.regexp_replace(F.trim(cut), r"\.\.\.$", ""))


def collapsed_ids(text: Column) -> Column:
    """Runs of three or more placeholders as the first one and their number."""
    run = r"<(?:ID|UUID|TS|N)>(?:\s*[,;]\s*<(?:ID|UUID|TS|N)>){2,}"
    runs = F.regexp_extract_all(text, F.lit(run), F.lit(0))
    short = lambda r: F.concat(F.substring_index(r, ">", 1), F.lit(">×"), (F.length(r) - F.length(F.replace(r, F.lit("<"), F.lit("")))).cast("string"))
    between = F.split(text, run)
    pieces = F.transform(between, lambda piece, i: F.concat(piece, F.coalesce(F.get(F.transform(runs, short), i), F.lit(""))))
    return F.array_join(pieces, "")


def short_exceptions(text: Column) -> Column:
    """Exception names without their packages, a doubled name once."""
    kinds = "(?:Exception|Error|Fault|Failure)"
    out = replaced(text, [(rf"\b(?:[a-z_][\w$]*\.)+([A-Z][\w$]+{kinds})(?=[:\s#;]|$)", "$1"), (r"\b(?:[a-z_][\w$]*\.)+([A-Z][\w$]+)(?=@)", "$1")])
    return F.regexp_replace(out, rf"^([A-Z][\w$]+{kinds}):\s+\1:\s+", "$1: ")


def without_unknown(text: Column) -> Column:
    t = F.trim(full(text))
    return F.when(F.lower(t).isin("unknown", "unknownerror", "unclassified", "n/a", "none", "null"), F.lit("")).otherwise(t)


def operator_text(text: Column) -> Column:
    """A text as operators read it: no generic prefix, the error model's message, no stack, short names, runs of ids collapsed."""
    t = F.regexp_replace(without_unknown(text), r"(?i)^(?:Unknown(?:Error|Exception)|Throwable|Exception)\s*:\s*", "")
    said = F.trim(F.regexp_replace(F.regexp_extract(t, r"message=([^,\]]+)", 1), r"\s+", " "))
    t = F.when(said != "", said).otherwise(t)
    return F.trim(F.regexp_replace(collapsed_ids(short_exceptions(clean_stack(t))), r"\s+", " "))


def exception_message(cause: Column, behaviour: Column) -> Column:
    """What an exception says, where the cause is only its bare name."""
    said = F.regexp_extract(full(behaviour), r"(?s)[A-Z][A-Za-z]+(?:Exception|Error|Denied|Fault|Failure)[^:]*:\s*(.+?)(?:\s+at\s+[a-z]|\s*$)", 1)
    said = F.trim(F.substring(F.regexp_replace(said, r"\s+", " "), 1, 200))
    return F.when((full(cause) == "") | F.trim(cause).contains(" ") | (F.length(said) <= 5), cause).otherwise(said)


def is_low_signal(text: Column) -> Column:
    t = F.trim(F.regexp_replace(full(text), r"\s+", " "))
    low = F.lower(t)
    bare = ~(t.contains("|") | t.contains(";") | t.contains("->")) & low.endswith("exception")
    return (t == "") | has_any(low, ["error handled", "unknownerror", "unknown error", "classified as unknown"]) | (F.length(t) < 40) | bare


def alert_text(msg: Column) -> Column:
    return F.lower(F.trim(replaced(full(msg), [(r"[0-9a-fA-F]{8,}", "<ID>"), (r"\d+", "<ID>"), (r"\s+", " ")])))


def alert_signal(msg: Column) -> Column:
    low = F.lower(full(msg))
    count = lambda words: reduce(lambda a, b: a + b, (low.contains(w).cast("int") for w in words))
    return F.when(low == "", 0).otherwise((F.length(low) >= 40).cast("int") + 3 * count(rules.ALERT_GOOD) - 3 * count(rules.ALERT_BAD))


def quality_score(msg: Column, error_type: Column) -> Column:
    low = F.lower(full(msg))
    count = lambda words: reduce(lambda a, b: a + b, (low.contains(w).cast("int") for w in words))
    typed = ~F.lower(full(error_type)).isin("", "unknownerror", "simpleerror")
    return F.when(low == "", 0).otherwise(2 * count(rules.QUALITY_GOOD) - 3 * count(rules.QUALITY_BAD) + F.least(F.floor(F.length(low) / 80), F.lit(5)).cast("int") + 2 * typed.cast("int"))


def _tokens(text: Column, stop: list[str]) -> Column:
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    return F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(stop))


def cause_tokens(msg: Column) -> Column:
    return _tokens(trace_message(useful_or(msg, full(msg))), rules.CAUSE_STOP_WORDS)


def step_tokens(msg: Column) -> Column:
    return F.array_distinct(_tokens(trace_message(msg), rules.STEP_STOP_WORDS))


def longest_shared_run(a: Column, b: Column) -> Column:
    """Length of the longest run of tokens that both arrays have. One fold over the rows of the usual table of lengths."""
    n = F.size(b)
    zero = F.array_repeat(F.lit(0), n + 1)
    start = F.struct(zero.alias("row"), F.lit(0).alias("best"))

    def step(acc: Column, token: Column) -> Column:
        row = F.concat(F.array(F.lit(0)), F.transform(b, lambda t, j: F.when(t == token, F.get(acc["row"], j) + 1).otherwise(F.lit(0))))
        return F.struct(row.alias("row"), F.greatest(acc["best"], F.array_max(row)).alias("best"))

    return F.aggregate(a, start, step, lambda acc: acc["best"])


def same_steps(app_a: Column, count_a: Column, msg_a: Column, app_b: Column, count_b: Column, msg_b: Column) -> Column:
    """Two views of one set of events: same app and count, and three quarters of the shorter token set shared."""
    a, b = step_tokens(msg_a), step_tokens(msg_b)
    share = F.size(F.array_intersect(a, b)) / F.least(F.size(a), F.size(b))
    return (app_a == app_b) & (count_a == count_b) & (F.size(a) > 0) & (F.size(b) > 0) & (share >= 0.75)


def stored_message(msg: Column) -> Column:
    """The fact tables' own normalisation: UUIDs, long numbers, addresses, times, hex numbers; 500 characters."""
    return F.substring(replaced(msg, rules.STORED_MESSAGE), 1, rules.STORED_LENGTH)


def plain_token(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(full(text)), r"[^\p{L}\p{N}]", "_"), F.lit("_"))


def error_id(msg: Column) -> Column:
    """What stands before the first # of a structured message, else null."""
    return F.when(msg.contains("#"), F.substring_index(msg, "#", 1))


def query_contract(index: Column, namespaces: Column) -> Column:
    """SHA-256 of the canonical JSON of what a run read."""
    return F.sha2(F.to_json(F.struct(index.alias("index"), F.array_sort(namespaces).alias("namespaces"))), 256)


def duration_text(seconds: Column) -> Column:
    """45s, 23m 5s or 5h 12m 3s."""
    s = seconds.cast("long")
    h, m, rest = F.floor(s / 3600).cast("long"), F.floor(s % 3600 / 60).cast("long"), s % 60
    return F.when(s < 60, F.format_string("%ds", s)).when(s < 3600, F.format_string("%dm %ds", m, rest)).otherwise(F.format_string("%dh %dm %ds", h, m, rest))


def peak_id(evidence: Column) -> Column:
    """The peak's id in a piece of evidence, or null."""
    return found(evidence, r"peak_id=([^,)\s]+)")
