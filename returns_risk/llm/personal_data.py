r"""Personal data, in DataFrame operations only.

Regular expressions propose spans. Their positions come from matches that are tied to the end of the one before
(``\G``) and take the gap in front along: the lengths of gaps and hits add up to positions in code points. Checksums
confirm: Luhn for cards, mod 97 and the country's length for account numbers (IBAN), areas, groups and serials that are
given out for national ids. Every span has a score between 0 and 1; telling words in the ``NEAR`` characters before or
after it raise the score, whatever other spans lie between. A telling word counts as a whole word (an s may follow it),
if all of it lies within these characters: neither "hotel" nor the end of a cut "hotel" tells of a telephone. These characters are put
together from the gaps and hits around a span, so many spans in a long text don't cost their square. The base kinds are
always listed; the others from ``LEAST`` on.
Quantifiers are possessive, so no text makes a match run back and forth.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from returns_risk.llm.common import documents

NEAR, LEAST = 40, 50
#: Characters that are looked at: one more, which shows whether a word is cut off.
WIDE = NEAR + 1
#: Hits on one side that surely reach over them: none is shorter than four.
AROUND = -(-WIDE // 4)
STEP = 64  # hits whose lengths are added up at a time

#: Fixed patterns of the base kinds, written so that they never run back; then the added kinds.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
    "local_phone": r"(?<![A-Za-z0-9+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![A-Za-z0-9.-])",
    "national_id": (  # social security numbers, and tax numbers beginning with 9
        r"(?<![A-Za-z0-9-])(?:(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}|9[0-9]{2}-(?:5[0-9]|6[0-5]|7[0-9]|8[0-8]|9[0-24-9]))"
        r"-(?!0000)[0-9]{4}(?![A-Za-z0-9-])"
    ),
}
BASE = ("email", "ip", "card", "phone")
KINDS = tuple(PATTERNS)
#: A text without this has no hit of the kind.
HINTS = {"email": "@", "phone": "+"}
#: Score of a span by itself, the telling words, and what they add; in hundredths.
SCORES = {
    "email": (90, "mail|email|contact|write|reach", 10),
    "ip": (60, "ip|address|host|server|login", 20),
    "card": (70, "card|visa|credit|debit|payment", 25),
    "phone": (70, "phone|telephone|tel|call|mobile|fax", 25),
    "iban": (80, "iban|account|bank|transfer|konto|compte|cuenta", 15),
    "local_phone": (30, "phone|telephone|tel|call|mobile|fax", 45),
    "national_id": (30, "ssn|social|security|national|passport|insured", 45),
}
#: Characters of an account number by country. Numbers of other countries need mod 97 only.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21,
    "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27,
    "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26,
    "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27,
    "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25,
    "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23,
    "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}
_PARTS = r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"


def _literal(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(name: str, value: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def _total(array: str) -> str:
    return f"aggregate({array}, 0, (s, v) -> s + v)"


def _ends(lengths: str) -> str:
    """SQL: running totals of an array of lengths, in two levels so that many hits don't cost their square."""
    sums = f"transform(sequence(0, cast(size(l) div {STEP} AS int)), c -> {_total(f'slice(l, c * {STEP} + 1, {STEP})')})"
    bases = f"transform(sums, (v, c) -> {_total('slice(sums, 1, c)')})"
    ends = f"transform(l, (v, i) -> bases[i div {STEP}] + {_total(f'slice(l, cast(i div {STEP} AS int) * {STEP} + 1, i % {STEP} + 1)')})"
    return _let("l", lengths, _let("sums", sums, _let("bases", bases, ends)))


def _valid(kind: str, hit: str) -> str:
    """SQL: the hit passes what its kind asks for."""
    digits = f"regexp_replace({hit}, '[^0-9]', '')"
    if kind == "ip":
        return f"{hit} RLIKE '{_PARTS}'"
    if kind == "card":
        place = "cast(substring(d, i, 1) AS int)"
        twice = f"CASE WHEN (length(d) - i) % 2 = 0 THEN {place} ELSE cast(2 * {place} div 10 AS int) + 2 * {place} % 10 END"
        luhn = f"aggregate(sequence(1, length(d)), 0, (s, i) -> s + {twice}) % 10 = 0"
        return _let("d", digits, f"length(d) BETWEEN 12 AND 19 AND {luhn}")
    if kind == "phone":
        return f"length({digits}) BETWEEN 9 AND 15"
    if kind == "iban":
        plain = f"replace({hit}, ' ', '')"
        step = "CASE WHEN c BETWEEN '0' AND '9' THEN (s * 10 + cast(c AS int)) % 97 ELSE (s * 100 + ascii(c) - 55) % 97 END"
        moved = "split(concat(substring(p, 5), substring(p, 1, 4)), '')"
        cases = " ".join(
            f"WHEN substring(p, 1, 2) IN ({', '.join(repr(k) for k, n in IBAN_LENGTHS.items() if n == length)}) THEN length(p) = {length}"
            for length in sorted(set(IBAN_LENGTHS.values()))
        )
        return _let("p", plain, f"length(p) BETWEEN 15 AND 34 AND CASE {cases} ELSE true END AND aggregate(filter({moved}, c -> c <> ''), 0, (s, c) -> {step}) = 1")
    return "true"


def _spans(kind: str) -> str:
    """SQL: array of (start, kind, end, score) of one kind in ``text``; positions in code points, end exclusive."""
    pattern = PATTERNS[kind]
    tied = _literal(rf"\G((?s:.*?))({pattern})")
    own, words, more = SCORES[kind]
    hits = f"zip_with(regexp_extract_all(text, {tied}, 1), regexp_extract_all(text, {tied}, 2), (g, h) -> struct(g, h))"
    ends = _ends("transform(hits, x -> length(x.g) + length(x.h))")
    # what is cut off a gap or hit is farther away than WIDE
    former = f"transform(slice(hits, greatest(i - {AROUND}, 0) + 1, least(i, {AROUND})), y -> concat(right(y.g, {WIDE}), right(y.h, {WIDE})))"
    latter = f"transform(slice(hits, i + 2, {AROUND}), y -> concat(left(y.g, {WIDE}), left(y.h, {WIDE})))"
    before = f"right(concat(array_join({former}, ''), right(x.g, {WIDE})), {WIDE})"
    after = f"left(concat(array_join({latter}, ''), tail), {WIDE})"
    whole = _literal(rf"(?<!\p{{L}})(?:{words})s?(?!\p{{L}})")
    parts = ((before, r"^\p{L}+"), (after, r"\p{L}+$"))
    near = " OR ".join(
        _let("c", f"lower({part})", f"if(length(c) > {NEAR}, regexp_replace(c, {_literal(cut)}, ''), c) RLIKE {whole}") for part, cut in parts
    )
    near = f"({near})"
    span = (
        f"struct(ends[i] - length(x.h) AS start, {KINDS.index(kind)} AS kind, ends[i] AS end,"
        f" CASE WHEN {near} THEN {own + more} ELSE {own} END AS score, {_valid(kind, 'x.h')} AS valid)"
    )
    least = 0 if kind in BASE else LEAST
    found = f"filter(transform(hits, (x, i) -> {span}), x -> x.valid AND x.score >= {least})"
    tail = f"substring(text, coalesce(get(ends, size(ends) - 1), 0) + 1, {WIDE})"
    found = _let("hits", hits, _let("ends", ends, _let("tail", tail, found)))
    hint = f"instr(text, '{HINTS[kind]}') > 0 AND " if kind in HINTS else ""
    none = "cast(array() AS array<struct<start: int, kind: int, end: int, score: int, valid: boolean>>)"
    return f"CASE WHEN {hint}text RLIKE {_literal(pattern)} THEN {found} ELSE {none} END"


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, ``found`` (array of start, kind, end, score, in order), and the text as ``text``.

    ``kind`` counts in ``KINDS``. Null and empty texts have no spans. Rows without an id and repeated rows are treated
    like others; other columns are left out.
    """
    rows = docs.selectExpr(f"cast({id_col} AS bigint) AS doc_id", f"coalesce({text_col}, '') AS text")
    spans = ", ".join(_spans(kind) for kind in KINDS)
    return rows.selectExpr("doc_id", "text", f"array_sort(concat({spans})) AS found")


def op10_pii(spark: SparkSession, folder: str) -> DataFrame:
    """All of ``documents``."""
    names = f"array({', '.join(repr(k) for k in KINDS)})"
    text = f"array_join(transform({{0}}, x -> concat({names}[x.kind], ':', x.start, ':', x.end)), ',')"
    base = f"filter(found, x -> x.kind < {len(BASE)})"
    counts = [f"cast(size(filter(found, x -> x.kind = {k})) AS bigint) AS n_{name}" for k, name in enumerate(BASE)]
    return personal_data(documents(spark, folder)).selectExpr(
        "doc_id", *counts, f"sha2({text.format(base)}, 256) AS base_sha256", f"{text.format('found')} AS spans",
        "array_join(transform(found, x -> cast(x.score AS string)), ',') AS scores",
    )
