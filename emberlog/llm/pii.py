"""Personal data with offset-preserving deobfuscation.

Transducers read a whole text and write its plain form, one after the other:

1. characters that are not one for one: character references (``&#64;``) become their character, zero-width characters,
   soft hyphens and combining marks go, and compatibility characters become what they stand for (``\u2488`` is ``1.``);
2. homoglyphs and full-width or styled letters and digits become ASCII, one character for one;
3. runs of spelled digits (with ``double`` and ``triple``) become digits; at/dot disguises, in brackets, bare or between underscores or
   hyphens, become ``@`` and ``.``.

Each keeps for every piece of its output the piece of its input it came from, and the maps are composed. Identifiers are
found in the text as it is (base spans) and in its plain form; a span found in the plain form is mapped back to source
characters and added unless it lies within a base span. Texts go through an Arrow UDF one by one; there is no shuffle.

All scans are linear in the length of the text, also for long runs of digits or address characters.

Defined results: null and empty texts have no spans; offsets are code points, end exclusive; repeated rows are read each;
other columns are ignored; a very long text is worked on whole, in memory that is a small multiple of its size.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("email", "ip", "card", "phone")

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Letters of other scripts that look like ASCII letters, and the ASCII letters they look like.
_LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "У": "Y", "І": "I", "Ј": "J", "Ѕ": "S",
    "ο": "o", "α": "a", "ν": "v", "ρ": "p", "ι": "i", "κ": "k", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ɑ": "a", "ɡ": "g", "ı": "i", "∂": "d", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "․": ".", "。": ".", "٠": "0", " ": " ", " ": " ", " ": " ",
}
# Spelled digits.
_SPELLED = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
#: Spelled digits count from so many in a row on (the shortest phone number has eight digits, the shortest address four).
_MIN_SPELLED = 4

_TIMES = {"double": 2, "triple": 3}
_DIGIT = "|".join(_SPELLED)
_ONE = rf"(?:(?:{'|'.join(_TIMES)})[\x20-]{{1,3}})?(?:{_DIGIT})"
_SPELLED_RUN = re.compile(rf"(?<![A-Za-z0-9])(?:plus[\x20-]{{1,3}})?{_ONE}(?:[\x20,-]{{1,3}}(?:{_ONE}|dot|point|dash|[0-9](?![0-9A-Za-z]))(?![A-Za-z0-9])){{{_MIN_SPELLED - 1},}}(?![A-Za-z0-9])", re.I)
_SPELLED_PART = re.compile(rf"({_DIGIT}|[0-9])|(dot|point)|(plus)|(dash)|({'|'.join(_TIMES)})", re.I)
_BRACKETED = re.compile(r"\s{0,2}[\[({<]\s?(?:(at|@)|(dot|period|point|\.))\s?[\])}>]\s{0,2}", re.I)
#: An at between underscores or hyphens, with a domain behind it that has a dot of the same make.
_JOINED_AT = re.compile(r"([_-])at\1(?=([A-Za-z0-9]+(?:(?:\1dot\1|\.)[A-Za-z0-9]+)+))", re.I)
# What bracketed marks become while bare ones are looked for, as that asks which at and dot the writer disguised.
_AT, _DOT = "\ufdd0", "\ufdd1"
_MARKS = str.maketrans(_AT + _DOT, "@.")
_NO_MARKS = str.maketrans(_AT + _DOT, "\ufffd\ufffd")
# References by name to the signs that identifiers have.
_NAMED = {"commat": "@", "period": ".", "plus": "+", "lowbar": "_", "percnt": "%", "nbsp": " ", "hyphen": "-", "dash": "-", "shy": "", "ZeroWidthSpace": ""}
_REFERENCE = re.compile(rf"&(?:#([0-9]{{1,7}})|#[xX]([0-9A-Fa-f]{{1,6}})|({'|'.join(_NAMED)}));")
_BARE_DOT = re.compile(r"\sdot\s", re.I)
_AT_DOMAIN = re.compile(rf"(\sat\s|[@{_AT}])([A-Za-z0-9-]+(?:(?:\sdot\s|[.{_DOT}])[A-Za-z0-9-]+)*)", re.I)
_BEFORE_LOCAL = frozenset("[({<,;:\"'")


def _form(ch: str) -> str:
    """What a character that is not ASCII stands for: ASCII, nothing, or itself."""
    if ch in _LOOKALIKES:
        return _LOOKALIKES[ch]
    if unicodedata.category(ch) in ("Cf", "Mn", "Me") or ch == "\u3164":
        return ""  # formats (zero width, soft hyphen, directions), marks above or around another character, and the empty letter
    form = "".join(_LOOKALIKES.get(c, c) for c in unicodedata.normalize("NFKC", ch))
    if form.isascii() and form:
        return form
    return str(unicodedata.decimal(ch)) if ch.isdecimal() else ch


class _Forms(dict):
    """Characters' forms, made as they are met; bounded."""

    def __missing__(self, code: int):
        ch = chr(code)
        out = ch if code < 128 else _form(ch)
        if len(self) < 100_000:
            self[code] = out
        return out


class _Plain(dict):
    """One-to-one map of characters to ASCII for str.translate."""

    def __missing__(self, code: int):
        form = _FORMS[code]
        out = ord(form) if len(form) == 1 else code
        if len(self) < 100_000:
            self[code] = out
        return out


_FORMS = _Forms()
_PLAIN = _Plain()


def _uneven(text: str) -> list[tuple[int, int, str]]:
    """Replacements of what is not one character for one: references, and characters that stand for none or for several."""
    found = []
    if "&" in text:
        for m in _REFERENCE.finditer(text):
            code = int(m.group(1)) if m.group(1) else int(m.group(2), 16) if m.group(2) else -1
            if code < 0:
                found.append((m.start(), m.end(), _NAMED[m.group(3)]))
            elif 32 <= code < 0x110000 and not 0xD800 <= code < 0xE000:
                found.append((m.start(), m.end(), _FORMS[code]))
    if not text.isascii() and (odd := [c for c in set(text) if len(_FORMS[ord(c)]) != 1]):
        found += [(m.start(), m.end(), _FORMS[ord(m.group())]) for m in re.finditer("[" + "".join(map(re.escape, odd)) + "]", text)]
    return sorted(found)


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Each ``@`` with the longest run of local characters before it (not before the last match's end) and a domain after it."""
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        if at >= done:
            start = at
            while start > done and text[start - 1] in _LOCAL_CHARS:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                found.append((start, m.end()))
                done = m.end()
            else:
                done = max(done, start)
        at = text.find("@", at + 1)
    return found


def identifiers(text: str) -> list[tuple[int, int, int]]:
    """(kind's index, start, end) of the base rules, leftmost and without overlap in each kind, by kind and start."""
    out = [(0, a, b) for a, b in _emails(text)] if "@" in text else []
    out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(p) < 4 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m.group().split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := m.group().replace(" ", "").replace("-", "")) <= 19 and _luhn(d):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m.group()) <= 15]
    return out


def _applied(text: str, replacements: list[tuple[int, int, str]]) -> tuple[str, list[tuple[int, int, int, bool]]]:
    """The text with its replacements, and its pieces in order: (start in it, start in the source, end in the source, is a replacement)."""
    pieces, parts, at, done = [], [], 0, 0
    for a, b, w in replacements:
        if a > done:
            pieces.append((at, done, a, False))
            parts.append(text[done:a])
            at += a - done
        pieces.append((at, a, b, True))
        parts.append(w)
        at += len(w)
        done = b
    pieces.append((at, done, len(text), False))
    parts.append(text[done:])
    return "".join(parts), pieces


def _apart(found: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    out, done = [], 0
    for a, b, w in sorted(found, key=lambda x: (x[0], -x[1])):
        if a >= done:
            out.append((a, b, w))
            done = b
    return out


def _word_start(text: str, end: int, floor: int) -> int:
    """Start of the run of local characters, or marks of dots, that ends at ``end``."""
    while end > floor and (text[end - 1] in _LOCAL_CHARS or text[end - 1] == _DOT):
        end -= 1
    return end


def _opens(text: str, at: int) -> bool:
    return at == 0 or text[at - 1].isspace() or text[at - 1] in _BEFORE_LOCAL


def _bare(text: str) -> list[tuple[int, int, str]]:
    """Bare at and dot of addresses in ``text``, whose bracketed ones are marks.

    A bare at needs a spelled or marked dot after it. After a literal ``@`` bare dots count only where the domain has no literal
    dot before them, and before it only where there is a spelled or marked dot after it.
    """
    found, at, floor = [], 0, 0
    while m := _AT_DOMAIN.search(text, at):
        sign, domain = m.group(1), m.group(2)
        dots = [(m.start(2) + d.start(), m.start(2) + d.end()) for d in _BARE_DOT.finditer(domain)]
        if sign == "@" and dots and "." in text[m.start(2) : dots[0][0]]:
            dots = []
        spelled = bool(dots) or _DOT in domain
        start = _word_start(text, m.start(), floor)
        bare = len(sign) > 1
        if start < m.start() and (spelled and _opens(text, start) if bare else spelled or sign == _AT):
            if bare:
                found.append((m.start(1), m.end(1), "@"))
            found += [(a, b, ".") for a, b in dots]
            while start - 5 >= floor and _BARE_DOT.fullmatch(text, start - 5, start):
                word = _word_start(text, start - 5, floor)
                if word == start - 5 or not _opens(text, word):
                    break
                found.append((start - 5, start, "."))
                start = word
            at = floor = max(m.end(1), dots[-1][1] if dots else 0)
        else:
            at = m.end(1) - bare  # its last space can open the next one
            floor = at
    return found


def _joined(text: str) -> list[tuple[int, int, str]]:
    """At and dot between underscores or hyphens: ``john_at_site_dot_org``. The domain must have such a dot."""
    found, floor = [], 0
    for m in _JOINED_AT.finditer(text):
        sign, dot = m.group(1), m.group(1) + "dot" + m.group(1)
        domain = m.group(2).lower()
        if m.start() <= floor or dot not in domain or not text[m.start() - 1].isalnum():
            continue
        found.append((m.start(), m.end(), _AT))
        at = domain.find(dot)
        while at >= 0:
            found.append((m.start(2) + at, m.start(2) + at + len(dot), _DOT))
            at = domain.find(dot, at + len(dot))
        start = m.start()
        while True:  # words before it that such dots join
            while start > floor and text[start - 1] in _LOCAL_CHARS and text[start - 1] not in "_-":
                start -= 1
            if start - len(dot) <= floor or text[start - len(dot) : start].lower() != dot:
                break
            found.append((start - len(dot), start, _DOT))
            start -= len(dot)
        floor = m.end(2)
    return sorted(found)


def _replacements(text: str) -> list[tuple[int, int, str]]:
    """Disguises in ``text`` (already one-to-one plain): (start, end, what it stands for), by start, without overlap."""
    if _AT in text or _DOT in text:
        text = text.translate(_NO_MARKS)
    found: list[tuple[int, int, str]] = []
    low = text.lower()
    for m in _SPELLED_RUN.finditer(text):
        out, times = [], 1
        for p in _SPELLED_PART.finditer(m.group()):
            kind, w = p.lastindex, p.group().lower()
            if kind == 5:
                times = _TIMES[w]
                continue
            out.append(_SPELLED.get(w, w) * times if kind == 1 else {2: ".", 3: "+", 4: "-"}[kind])
            times = 1
        found.append((m.start(), m.end(), "".join(out)))
    if "_at_" in low or "-at-" in low:
        found += _joined(text)
    if any(c in text for c in "[({<"):
        found += [(m.start(), m.end(), _AT if m.group(1) else _DOT) for m in _BRACKETED.finditer(text)]
    found = _apart(found)
    marked = any(w in (_AT, _DOT) for _, _, w in found)
    if marked or " dot " in low or "\tdot" in low or "\ndot" in low:
        shown, pieces = _applied(text, found)
        at = [p[0] for p in pieces]
        found = _apart(found + [(*_source(pieces, at, a, b), w) for a, b, w in _bare(shown)])
    return [(a, b, w.translate(_MARKS)) for a, b, w in found] if marked else found


def _source(pieces: list[tuple[int, int, int, bool]], at: list[int], start: int, end: int) -> tuple[int, int]:
    """The source span of a span of the plain form; a replacement that is met is covered whole."""
    p, q = pieces[bisect_right(at, start) - 1], pieces[bisect_right(at, end - 1) - 1]
    return (p[1] if p[3] else p[1] + start - p[0]), (q[2] if q[3] else q[1] + end - q[0])


def plain_form(text: str) -> tuple[str, list[list[tuple[int, int, int, bool]]]]:
    """The plain form, and the maps that lead from it back to the source, one after the other: pieces in order,
    (start in the output, start in the input, end in the input, is a replacement)."""
    maps = []
    if uneven := _uneven(text):
        text, pieces = _applied(text, uneven)
        maps.append(pieces)
    shown = text if text.isascii() else text.translate(_PLAIN)
    if found := _replacements(shown):
        shown, pieces = _applied(shown, found)
        maps.insert(0, pieces)
    return shown, maps


def spans(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans (with those that only the plain form shows), each by kind and start."""
    if not text:
        return [], []
    base = identifiers(text)
    plain, maps = plain_form(text)
    if plain == text:
        return base, base
    maps = [(pieces, [p[0] for p in pieces]) for pieces in maps]
    taken = sorted((a, -b) for _, a, b in base)
    starts, reach, far = [a for a, _ in taken], [], -1
    for _, b in taken:
        reach.append(far := max(far, -b))  # the furthest end of the base spans up to here
    added = []
    for kind, a, b in identifiers(plain):
        for pieces, at in maps:
            a, b = _source(pieces, at, a, b)
        i = bisect_right(starts, a) - 1
        if i < 0 or reach[i] < b:
            added.append((kind, a, b))
    return base, sorted({*base, *added})


def written(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in found)


_COLUMNS = ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added")


@F.pandas_udf(T.StructType([T.StructField(c, T.LongType() if c[:2] == "n_" else T.StringType()) for c in _COLUMNS]))
def _digest(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for t in texts:
        base, everything = spans(t)
        counts = [sum(k == i for k, _, _ in base) for i in range(4)]
        rows.append((*counts, hashlib.sha256(written(base).encode()).hexdigest(), written(everything), len(everything) - len(base)))
    return pd.DataFrame(rows, columns=list(_COLUMNS))


def find_personal_data(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, base counts, ``base_sha256``, ``spans`` (all, as kind:start:end) and ``n_added`` (spans only the plain form shows)."""
    return docs.select(F.col(doc_id).alias("doc_id"), _digest(F.col(text)).alias("d")).select("doc_id", "d.*")


def masked(text: str | None, mask: str = "<{kind}>") -> str | None:
    """The text with every span replaced by its kind's mask."""
    if not text:
        return text
    out, done = [], 0
    for kind, a, b in sorted(spans(text)[1], key=lambda s: (s[1], -s[2])):
        if a >= done:
            out += [text[done:a], mask.format(kind=KINDS[kind].upper())]
            done = b
    return "".join([*out, text[done:]])


@F.pandas_udf(T.StringType())
def mask_personal_data(texts: pd.Series) -> pd.Series:
    return pd.Series([masked(t) for t in texts])
