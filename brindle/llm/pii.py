"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust the score."""

from __future__ import annotations

import bisect
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import numbered, plain

#: A text without a match of this has no span, so it never leaves the JVM.
POSSIBLE = r"[\p{Nd}@=:]|AKIA|gh[pousr]_"
NEAR = 48  # characters on either side in which context words count
THRESHOLD = 0.5


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    turned = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _card(s: str) -> float | None:
    d = re.sub(r"\D", "", s)
    if not 13 <= len(d) <= 19 or not luhn(d) or len(set(d)) == 1:
        return None
    issuer = re.match(r"4|5[1-5]|2(?:22[1-9]|2[3-9]|[3-6]|7[01]|720)|3[47]|3(?:0[0-5]|[68])|6(?:011|4[4-9]|5)|35(?:2[89]|[3-8])", d)
    return 0.75 if issuer else 0.4


_IBAN_LENGTH = {"AD": 24, "AE": 23, "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TR": 26}


def _iban(s: str) -> float | None:
    c = re.sub(r"\s", "", s)
    return 0.9 if _IBAN_LENGTH.get(c[:2]) == len(c) and mod97(c) else None


def _ip(s: str) -> float | None:
    parts = s.split(".")
    if any(len(p) > 1 and p[0] == "0" or int(p) > 255 for p in parts) or parts[0] == "0":
        return None
    return 0.4 if parts[0] in ("127", "255") else 0.65


def _ssn(s: str) -> float | None:
    area, group, serial = s.split("-")
    return 0.65 if area not in ("000", "666") and area[0] != "9" and group != "00" and serial != "0000" else None


def _dni(s: str) -> float | None:
    return 0.7 if "TRWAGMYFPDXBNJZSQVHLCKE"[int(s[:8]) % 23] == s[-1] else None


def _phone(s: str) -> float | None:
    d = re.sub(r"\D", "", s)
    return 0.7 if s[0] == "+" and 8 <= len(d) <= 15 else 0.6 if len(d) == 10 else None


def _secret(s: str) -> float | None:
    value = re.split(r"[:=]\s*[\"']?", s, maxsplit=1)[-1]
    bits = -sum(p * math.log2(p) for p in (value.count(c) / len(value) for c in set(value)))
    return 0.9 if len(value) >= 16 and bits > 3 else 0.6 if bits > 2.3 else None


def _email(s: str) -> float | None:
    return 0.9 if ".." not in s else 0.55


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    check: object
    context: str


#: In the order in which they win where spans overlap with the same score.
KINDS = (
    Kind("SECRET", r"(?i:\b(?:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key))\s*[:=]\s*[\"']?(?!\[(?:SECRET|EMAIL|IBAN|CARD|SSN|PHONE|IP|DNI)\])[^\s\"']{6,}|\bAKIA[0-9A-Z]{16}\b|\bgh[pousr]_[0-9A-Za-z]{36}\b", _secret, "token secret key password login credential"),
    Kind("EMAIL", r"(?<![\w.+-])[A-Za-z0-9_.+-]+@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,24}(?![\w-])", _email, "mail email e-mail contact kontakt correo courriel"),
    Kind("IBAN", r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b", _iban, "iban account konto compte cuenta bank banque banco"),
    Kind("CARD", r"(?<![\w.-])(?:\d{13,19}|\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{4}(?:[ -]?\d{3})?|\d{4}[ -]?\d{6}[ -]?\d{4,5})(?![\w-])", _card, "card visa mastercard amex credit debit karte carte tarjeta payment"),
    Kind("SSN", r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])", _ssn, "ssn social security"),
    Kind("PHONE", r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){1,4}(?![\w-])|(?<![\w.+-])(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[.-]\d{4}(?![\w-])", _phone, "phone tel telephone mobile call cell fax telefon telefono téléphone anruf"),
    Kind("IP", r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d)", _ip, "ip address host server adresse dirección"),
    Kind("DNI", r"(?<![\w-])\d{8}-?[TRWAGMYFPDXBNJZSQVHLCKE](?![\w-])", _dni, "dni nif identidad documento"),
)
_COMPILED = [(k, re.compile(k.pattern), re.compile(r"(?i)(?<!\w)(?:" + "|".join(map(re.escape, k.context.split())) + r")(?!\w)")) for k in KINDS]
_AGAINST = re.compile(r"(?i)(?<![\w.@-])(?:example|sample|dummy|isbn|order|version|serial|invoice)(?!\w|[.@-]\w)")


#: Where a number may end short of what its pattern takes: before no letter, digit or hyphen.
_END = re.compile(r"(?<=[^\W_])(?![\w-])")
_GOES_ON = re.compile(r"[.]\d")
#: Kinds whose pattern can take in words that follow.
_CUT = {"IBAN", "CARD", "PHONE"}


def _ends(kind: str, pattern: re.Pattern, text: str, m: re.Match) -> list[int]:
    """The ends to try for a match, best first: the longest that doesn't split a dotted number, then the others; a +1 number
    with its 11 digits goes before both."""
    if kind not in _CUT:
        return [m.end()]
    a = m.start()
    ends = [m.end(), *(b for b in range(m.end() - 1, a + 7, -1) if _END.match(text, b) and pattern.fullmatch(text, a, b))]
    if len(ends) > 1:
        nanp = kind == "PHONE" and re.match(r"\+1(?!\d)", m[0])
        ends.sort(key=lambda b: (not (nanp and len(re.sub(r"\D", "", text[a:b])) == 11), bool(_GOES_ON.match(text, b)), -b))
    return ends


def _proposed(kind: Kind, pattern: re.Pattern, text: str) -> Iterator[tuple[int, int, float]]:
    """(start, end, score) of what passes the kind's check. Where no end of a match does, the search goes on inside it."""
    at = 0
    while m := pattern.search(text, at):
        at = m.start() + 1 if kind.name in _CUT else m.end()
        for b in _ends(kind.name, pattern, text, m):
            if (score := kind.check(text[m.start() : b])) is not None:
                at = b
                yield m.start(), b, score
                break


def spans(text: str | None) -> list[tuple[int, int, str, float]]:
    """(start, end, kind, score) of each confirmed span, in order, without overlaps; offsets are characters."""
    if not text:
        return []
    found = []
    for rank, (kind, pattern, context) in enumerate(_COMPILED):
        if kind.name == "EMAIL" and "@" not in text:
            continue
        for a, b, score in _proposed(kind, pattern, text):
            around = text[max(0, a - NEAR) : a] + "\n" + text[b : b + NEAR]
            score = round(min(1.0, score + 0.2 * bool(context.search(around))) - 0.2 * bool(_AGAINST.search(around)), 4)
            if score >= THRESHOLD:
                found.append((-score, rank, a, b))
    taken: list[tuple[int, int, str, float]] = []  # in order of place
    for score, rank, a, b in sorted(found):
        i = bisect.bisect_left(taken, (a,))
        if (i == 0 or taken[i - 1][1] <= a) and (i == len(taken) or taken[i][0] >= b):
            taken.insert(i, (a, b, KINDS[rank].name, -score))
    return taken


def redact(text: str) -> str:
    """Each span is replaced by its kind in square brackets."""
    out, at = [], 0
    for a, b, kind, _ in spans(text):
        out += [text[at:a], f"[{kind}]"]
        at = b
    return "".join(out) + text[at:]


_SPAN = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("score", T.DoubleType())]))


@F.pandas_udf(_SPAN)
def _spans_udf(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in it:
        yield s.map(lambda t: [dict(zip(("start", "end", "kind", "score"), x, strict=True)) for x in spans(t)] if t else [])


@F.pandas_udf(T.StringType())
def _redact_udf(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in it:
        yield s.map(lambda t: redact(t) if t else t, na_action="ignore")


def _worth(text: Column) -> Column:
    return F.when(text.rlike(POSSIBLE), text)


def pii_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, start, end, kind, value, score): a row for each span of personal data in the whole of each text.

    A proposed span whose checksum or shape fails is cut to a shorter one that passes, or is none; otherwise its score starts from its kind, gains 0.2 if a word of its
    context stands within 48 characters and loses 0.2 if a word like "example" or "invoice" does; from 0.5 it counts. Where
    spans overlap the higher score wins, then the order of ``KINDS``, then the earlier start. Null and empty texts have none.
    Repeated rows give repeated spans, a null doc_id is carried as it is, extra columns are ignored."""
    rows = plain(docs, "doc_id", "text").where(F.col("text").rlike(POSSIBLE))
    rows = rows.select("doc_id", "text", F.explode(_spans_udf("text")).alias("s"))
    return rows.select("doc_id", "s.start", "s.end", "s.kind", F.expr("substring(text, s.start + 1, s.end - s.start)").alias("value"), "s.score")


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of ``pii_spans`` replaced in text; n_chars, if there is one, is counted anew for changed texts.
    Texts without a span, and null ones, stay as they are. No row goes."""
    rows, (text,) = numbered(docs, "text")
    rows = rows.withColumn("new", F.coalesce(_redact_udf(_worth(F.col(text))), F.col(text)))
    if "n_chars" in docs.columns:
        chars = f"c{docs.columns.index('n_chars')}"
        same = F.col("new").eqNullSafe(F.col(text))
        rows = rows.withColumn(chars, F.when(same, F.col(chars)).otherwise(F.length("new").cast(docs.schema["n_chars"].dataType)))
    return rows.withColumn(text, F.col("new")).drop("new").toDF(*docs.columns)
