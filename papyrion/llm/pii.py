"""Personal data: patterns propose spans, checksums confirm them, nearby words move the score.

Each text is searched on its own inside its Arrow batch: no shuffle, and a task
holds one batch. All patterns are linear in the length of the text: those that
could start again inside a run they have already failed on are bound to the
start of that run.

Kinds
* base kinds, always reported: ``email``, ``ip`` (each part at most 255),
  ``card`` (12 to 19 digits, Luhn), ``phone`` (``+`` and 9 to 15 digits);
* added by the method: ``iban`` (mod-97 over the rearranged letters and digits,
  and the length of its country) and ``ssn`` (a number of that form, which
  alone scores too low and needs a context word nearby).
A match that fails its check is dropped and not tried again in part. Matches of
one kind do not overlap; those of two kinds may.

Defined results: null text counts as empty and has no spans; nulls elsewhere,
repeated rows and extra columns are carried through; the spans are one column,
``out``, which replaces a column of that name; empty table in, empty table out.
Offsets count code points, the end is exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE = frozenset(("email", "ip", "card", "phone"))
PRIORITY = {kind: i for i, kind in enumerate(KINDS)}

#: Score of a confirmed match without context, what a context word adds, and the least score of an added kind.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.8, "ssn": 0.3}
CONTEXT_BONUS = 0.3
THRESHOLD = 0.5
#: Code points before and after a match in which context words count.
CONTEXT_REACH = 48

# Context words by kind.
CONTEXT = {
    "email": "email mail e-mail contact courriel correo",
    "ip": "ip address host server adresse",
    "card": "card visa mastercard amex credit carte karte tarjeta",
    "phone": "phone tel call fax mobile telefon téléphone teléfono",
    "iban": "iban account bank konto compte cuenta",
    "ssn": "ssn social security",
}

# IBAN lengths by country, of the whole IBAN registry.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27,
    "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DJ": 27, "DK": 18, "DO": 28,
    "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FK": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23,
    "GL": 18, "GR": 27, "GT": 28, "HN": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26,
    "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21,
    "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MN": 20, "MR": 27, "MT": 31, "MU": 30, "NI": 28,
    "NL": 18, "NO": 15, "OM": 23, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22,
    "RU": 33, "SA": 24, "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "SO": 23, "ST": 25,
    "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20, "YE": 30,
}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile("[0-9]")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?= ?[A-Z0-9])")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_WORDS = {kind: frozenset(words.split()) for kind, words in CONTEXT.items()}
_SPLIT = re.compile(r"[\w-]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from their @: the part before it is the run of letters that ends there."""
    low, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > low and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            low = domain.end()
            at = text.find("@", low)
        else:
            low, at = at + 1, text.find("@", at + 1)


@lru_cache
def _iban_rest(n: int) -> re.Pattern:
    return re.compile(rf"(?: ?[A-Z0-9]){{{n}}}(?![A-Za-z0-9])")


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """Confirmed numbers, each as long as its country has it; a number may follow another at once."""
    low = 0
    for m in _IBAN.finditer(text):
        n = IBAN_LENGTHS.get(m[0][:2], 0)
        if not n or m.start() < low:
            continue
        rest = _iban_rest(n - 4).match(text, m.end())
        if rest and mod97(text[m.start() : rest.end()].replace(" ", "")):
            low = rest.end()
            yield m.start(), low


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _ip_ok(s: str) -> bool:
    parts = [p.lstrip("0") for p in s.split(".")]
    return all(len(p) <= 3 and int(p or "0") <= 255 for p in parts)


def _score(text: str, kind: str, start: int, end: int) -> float:
    near = text[max(0, start - CONTEXT_REACH) : start] + " " + text[end : end + CONTEXT_REACH]
    bonus = CONTEXT_BONUS if _WORDS[kind].intersection(_SPLIT.findall(near.lower())) else 0.0
    return round(min(1.0, SCORES[kind] + bonus), 2)


def find_spans(text: str) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by start, then kind."""
    found: list[tuple[str, int, int]] = []
    if "@" in text:
        found += [("email", s, e) for s, e in _emails(text)]
    if _DIGIT.search(text):
        found += [("ip", *m.span()) for m in _IP.finditer(text) if _ip_ok(m[0])]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                found.append(("card", *m.span()))
        if "+" in text:
            found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
        found += [("iban", s, e) for s, e in _ibans(text)]
        found += [("ssn", *m.span()) for m in _SSN.finditer(text)]
    found.sort(key=lambda x: (x[1], PRIORITY[x[0]]))
    scored = [(kind, s, e, _score(text, kind, s, e)) for kind, s, e in found]
    return [x for x in scored if x[0] in BASE or x[3] >= THRESHOLD]


def mask(text: str, spans: list[tuple[str, int, int, float]]) -> str:
    """``text`` with each span, or run of overlapping spans, replaced by its kind in brackets."""
    out, done = [], 0
    for kind, start, end, _ in spans:
        if start >= done:
            out += [text[done:start], f"[{kind.upper()}]"]
        done = max(done, end)
    return "".join(out) + text[done:]


_SPAN = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("base", T.BooleanType()),
    ]
)
_ARROW_SPAN = pa.list_(
    pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("base", pa.bool_())])
)


def _search(masked: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, texts = [], []
            for value in batch.column("__text"):
                text = value.as_py() or ""
                found = find_spans(text)
                spans.append([dict(zip(("kind", "start", "end", "score"), x), base=x[0] in BASE) for x in found])
                if masked:
                    texts.append(mask(text, found) if found else value.as_py())
            arrays = [batch.column("__row"), pa.array(spans, _ARROW_SPAN)] + ([pa.array(texts, pa.string())] if masked else [])
            yield pa.RecordBatch.from_arrays(arrays, ["__row", "__spans"] + ["__masked"] * masked)

    return run


def with_pii(
    docs: DataFrame, text: str = "text", out: str = "pii", masked: str | None = None, keep: list[str] | None = None
) -> DataFrame:
    """``docs`` with the array of spans; ``masked`` names the column that gets the text without them.

    ``keep`` lists the columns to carry through; without ``text`` among them,
    texts travel to the Python workers once and do not come back.
    """
    names = [c for c in (docs.columns if keep is None else keep) if c not in (out, masked)]
    df = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row"), F.col(f"`{text}`").cast("string").alias("__text")
    )
    fields = [df.schema["__row"], T.StructField("__spans", T.ArrayType(_SPAN))]
    if masked:
        fields.append(T.StructField("__masked", T.StringType()))
    made = df.mapInArrow(_search(bool(masked)), T.StructType(fields))
    more = [F.col("__masked").alias(masked)] if masked else []
    return made.select("__row.*", F.col("__spans").alias(out), *more)


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the spans of ``text`` masked, and ``n_chars``, if there is one, counted anew where that changed."""
    names = list(docs.columns)
    # All columns but the text travel as one, so no name of theirs can clash with those made here.
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names if c != text]).alias("row"), F.col(f"`{text}`").alias("text"))
    made = with_pii(packed, "text", "spans", "masked", ["row"])
    columns = []
    for c in names:
        if c == text:
            columns.append(F.col("masked").alias(c))
        elif c == "n_chars":
            kind = docs.schema[c].dataType
            columns.append(F.when(F.size("spans") > 0, F.length("masked").cast(kind)).otherwise(F.col("row.n_chars")).alias(c))
        else:
            columns.append(F.col(f"row.`{c}`"))
    return made.select(*columns)


def _of(kind: str):
    return lambda s: s["kind"] == kind


def _listed(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op8_pii(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = with_pii(docs, keep=["doc_id"])
    base = F.filter("pii", lambda s: s["base"])
    counts = [F.size(F.filter("pii", _of(kind))).cast("long").alias(f"n_{kind}") for kind in KINDS[:4]]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"),
        _listed(F.col("pii")).alias("spans"),
        F.array_join(F.transform("pii", lambda s: s["score"].cast("string")), ",").alias("scores"),
        F.size("pii").cast("long").alias("n_spans"),
    )


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in row) + ")" for row in rows)


# What DuckDB searches for each kind; of the last two, a character before them is part of the match.
_SQL_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([ -]?[0-9])+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": r"(^|[^A-Za-z0-9])[A-Z]{2}[0-9]{2}",
    "ssn": r"(^|[^0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}",
}

#: DuckDB SQL of the same rows.
OP8_SQL = f"""
WITH doc AS (SELECT row_number() OVER () AS d, doc_id, coalesce(text, '') AS t FROM documents),
kinds(kind, rank, score) AS (VALUES {_values((k, i, SCORES[k]) for k, i in PRIORITY.items())}),
about(kind, context) AS (VALUES {", ".join(f"('{k}', {sorted(w.split())})" for k, w in CONTEXT.items())}),
raw AS ({" UNION ALL ".join(f"SELECT d, t, '{k}' AS kind, regexp_extract_all(t, '{p}') AS m, regexp_split_to_array(t, '{p}') AS parts FROM doc" for k, p in _SQL_PATTERNS.items())}),
found AS (
  SELECT d, t, kind, m[i] AS x, (list_sum(list_transform(parts[1:i], lambda y: length(y))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda y: length(y))), 0))::BIGINT AS s
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM raw)),
digit AS (SELECT *, regexp_replace(x, '[^0-9]', '', 'g') AS g FROM found),
country(code, n) AS (VALUES {_values(IBAN_LENGTHS.items())}),
longer AS (
  SELECT d, t, s + length(x) - 4 AS s, regexp_extract(substr(t, s + length(x) - 3), '^[A-Z]{{2}}[0-9]{{2}}( ?[A-Z0-9]){{' || (n - 4) || '}}') AS x
  FROM digit JOIN country ON code = right(x, 4)[1:2] WHERE kind = 'iban'),
iban AS (
  SELECT *, replace(x[5:] || x[1:4], ' ', '') AS moved FROM longer WHERE x <> '' AND NOT regexp_matches(substr(t, s + length(x) + 1, 1), '[A-Za-z0-9]')),
span AS (
  SELECT d, t, kind, s, s + length(x) AS e FROM digit WHERE CASE kind
    WHEN 'email' THEN true
    WHEN 'ip' THEN len(list_filter(string_split(x, '.'), lambda y: length(ltrim(y, '0')) > 3 OR coalesce(try_cast(ltrim(y, '0') AS INTEGER), 0) > 255)) = 0
    WHEN 'card' THEN length(g) BETWEEN 12 AND 19 AND list_sum(list_transform(range(1, length(g) + 1), lambda k:
      CASE WHEN k % 2 = 1 THEN substr(g, length(g) + 1 - k, 1)::INTEGER ELSE substr(g, length(g) + 1 - k, 1)::INTEGER * 2 // 10 + substr(g, length(g) + 1 - k, 1)::INTEGER * 2 % 10 END)) % 10 = 0
    WHEN 'phone' THEN length(g) BETWEEN 9 AND 15 END
  UNION ALL SELECT d, t, 'iban', s, s + length(x) FROM iban
    WHERE list_reduce(list_transform(string_split(moved, ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END),
                      lambda a, v: (a * CASE WHEN v > 9 THEN 100 ELSE 10 END + v) % 97, 0) = 1
  UNION ALL SELECT d, t, 'ssn', s + length(x) - 11, s + length(x) FROM digit
    WHERE kind = 'ssn' AND NOT regexp_matches(substr(t, s + length(x) + 1, 1), '[0-9-]') AND right(x, 11)[1:3] NOT IN ('000', '666') AND right(x, 11)[1] <> '9'
      AND right(x, 7)[1:2] <> '00' AND right(x, 4) <> '0000'),
near AS (SELECT *, substr(t, greatest(0, s - {CONTEXT_REACH}) + 1, s - greatest(0, s - {CONTEXT_REACH})) || ' ' || substr(t, e + 1, {CONTEXT_REACH}) AS w FROM span),
scored AS (
  SELECT d, kind, rank, s, e, round(least(1.0, score + CASE WHEN list_has_any(regexp_extract_all(lower(w), '[\\pL\\pN_-]+'), context) THEN {CONTEXT_BONUS} ELSE 0 END), 2)::DOUBLE AS score
  FROM near JOIN kinds USING (kind) JOIN about USING (kind)),
kept AS (SELECT * FROM scored WHERE rank < 4 OR score >= {THRESHOLD}),
told AS (
  SELECT d, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
         coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (rank < 4), '') AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans,
         string_agg(score::VARCHAR, ',' ORDER BY s, rank) AS scores, count(*) AS n_spans FROM kept GROUP BY d)
SELECT doc_id, coalesce(n_email, 0)::BIGINT AS n_email, coalesce(n_ip, 0)::BIGINT AS n_ip, coalesce(n_card, 0)::BIGINT AS n_card, coalesce(n_phone, 0)::BIGINT AS n_phone,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scores, '') AS scores, coalesce(n_spans, 0)::BIGINT AS n_spans
FROM doc LEFT JOIN told ON told.d = doc.d
"""
