"""Personal data in texts: patterns propose, checksums confirm, nearby words adjust the score.

The base patterns (e-mail, IPv4, card, phone) hold as they are. The method looks further:
cards of 13 to 15 digits, cards inside a longer row of digits that fails as a whole, phones
without a plus sign, IBANs and social security numbers. Each of those proposals has a score
that starts from its pattern's prior, grows by a passed checksum, and grows or falls by the
words around it; it is reported from LEAST_SCORE on. Every scan is linear in the text:
patterns start only where a run starts, so a long run of digits or letters is read once.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import slices, table

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn")
#: Score from which a proposal of the method is reported.
LEAST_SCORE = 0.7
#: Code points around a span in which its context words are looked for.
BEFORE, AFTER = 48, 24

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# possessive forms and "not after a digit": the same matches as the plain patterns, found in linear time
_IP = re.compile(r"(?<![0-9])[0-9]++\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?+[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NATIONAL = re.compile(r"(?<![0-9A-Za-z+.,/-])\(?+(?:00|0)?+[1-9][0-9]{1,4}+\)?+(?:[\x20./-]?+[0-9]{2,8}+){1,5}+(?![0-9A-Za-z])")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=[\x20]?[A-Z0-9])")
_SSN = re.compile(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
_DIGITS = re.compile(r"[0-9]+")
_DOUBLED = [0, 2, 4, 6, 8, 1, 3, 5, 7, 9]

# Lengths of IBANs by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18,
    "DO": 28, "EE": 20, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23,
    "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31,
    "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TN": 24,
    "TR": 26, "UA": 29, "VG": 24, "XK": 20,
}

# Words that speak for or against a kind, in the languages of the corpus.
SPEAKS_FOR = {
    "email": "e-?mail|mail|contact|kontakt|correo|courriel",
    "ip": "ip|host|server|address|adresse|dirección",
    "card": "card|visa|mastercard|amex|credit|debit|payment|karte|kreditkarte|carte|tarjeta|cvv|expir\\w*",
    "phone": "tel|phone|telephone|mobile|cell|call|fax|telefon|handy|anruf|rufnummer|téléphone|portable|appelez|teléfono|móvil|llame|whatsapp",
    "iban": "iban|account|bank|konto|compte|cuenta|bic|swift",
    "ssn": "ssn|social\\s+security|social\\s+insurance",
}
SPEAKS_AGAINST = {
    "email": "example\\s+format",
    "ip": "version|release|chapter|section|firmware|build",
    "card": "isbn|issn|order|invoice|serial|part|sku|barcode|ean|tracking",
    "phone": "isbn|issn|order|invoice|serial|part|sku|version|page|pages|year|id",
    "iban": "serial|part|sku|model",
    "ssn": "part|serial|order|invoice|isbn",
}
_FOR = {k: re.compile(rf"(?<!\w)(?:{v})(?!\w)", re.IGNORECASE) for k, v in SPEAKS_FOR.items()}
_AGAINST = {k: re.compile(rf"(?<!\w)(?:{v})(?!\w)", re.IGNORECASE) for k, v in SPEAKS_AGAINST.items()}
#: Score of a proposal before its context, by kind; base spans have passed their checks.
PRIOR = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.7}
FOR, AGAINST = 0.3, -0.3

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    """Whether the digits' Luhn sum is divisible by ten."""
    total = sum(map(int, digits[-1::-2])) + sum(_DOUBLED[int(d)] for d in digits[-2::-2])
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """Whether an IBAN, four characters moved to its end and letters read as 10 to 35, leaves 1 over 97."""
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or (len(part) == 3 and part <= "255")


def digits_of(text: str) -> str:
    return "".join(_DIGITS.findall(text))


def emails(text: str) -> Iterator[tuple[int, int]]:
    """A run of local characters up to each @ that a domain with a dot follows."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = free + len(text[free:at].rstrip(_LOCAL))
        free = at + 1  # no local part reaches back over an @
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            free = domain.end()
        at = text.find("@", free)


def base_spans(text: str) -> tuple[list[Span], list[tuple[int, int]], list[tuple[int, int]]]:
    """The base spans, the rows of digits that are no base card, and the matches that are no base phone."""
    spans: list[Span] = [("email", a, b) for a, b in emails(text)]
    for m in _IP.finditer(text):
        if all(map(octet, m.group().split("."))):
            spans.append(("ip", m.start(), m.end()))
    others, long_phones = [], []
    for m in _CARD.finditer(text):
        # the longest card with separators has 37 characters
        digits = m.group().replace(" ", "").replace("-", "") if m.end() - m.start() < 38 else ""
        if 16 <= len(digits) <= 19 and luhn(digits):
            spans.append(("card", m.start(), m.end()))
        else:
            others.append(m.span())
    for m in _PHONE.finditer(text):
        if 8 <= len(digits_of(m.group())) <= 15:
            spans.append(("phone", m.start(), m.end()))
        else:
            long_phones.append(m.span())
    return spans, others, long_phones


def context(text: str, kind: str, start: int, end: int) -> float:
    """What the words before and after a span add to its score."""
    around = text[max(0, start - BEFORE) : start] + "\n" + text[end : end + AFTER]
    return (FOR if _FOR[kind].search(around) else 0.0) + (AGAINST if _AGAINST[kind].search(around) else 0.0)


def issuer(digits: str) -> bool:
    """Whether a number starts as those of the large card schemes do and has their length."""
    n, two, four = len(digits), int(digits[:2]), int(digits[:4])
    if n == 15:
        return two in (34, 37)
    if n == 14:
        return two in (36, 38, 39) or 300 <= four // 10 <= 305
    if n == 16:
        return digits[0] == "4" or 51 <= two <= 55 or 2221 <= four <= 2720 or four == 6011 or two == 65
    return n in (13, 19) and digits[0] == "4"


def card_proposals(text: str, rows: list[tuple[int, int]]) -> Iterator[tuple[float, int, int]]:
    """Cards of 13 to 15 digits, and cards that whole groups of a longer row of digits make up."""
    for a, b in rows:
        if b - a < 13:
            continue
        groups = [(a + m.start(), a + m.end()) for m in _DIGITS.finditer(text[a:b])]
        for i, (start, _) in enumerate(groups):
            digits = ""
            if start and text[start - 1].isalnum():
                continue
            for s, e in groups[i : i + 19]:
                if len(digits) + e - s > 19:
                    break
                digits += text[s:e]
                if len(digits) >= 13 and issuer(digits) and luhn(digits) and not text[e : e + 1].isalnum():
                    yield 0.75 if s == start else 0.6 if (start, e) == (a, b) else 0.4, start, e


def iban_proposals(text: str) -> Iterator[tuple[float, int, int]]:
    for m in _IBAN.finditer(text):
        left = IBAN_LENGTHS.get(m.group()[:2], 0) - 4
        at, found = m.end(), [m.group()]
        while left > 0 and at < len(text):
            if text[at] == " " and text[at - 1] != " ":
                at += 1
                continue
            if not (text[at].isascii() and (text[at].isdigit() or text[at].isupper())):
                break
            found.append(text[at])
            at, left = at + 1, left - 1
        ends = at == len(text) or not (text[at].isalnum())
        if left == 0 and ends and mod97("".join(found)):
            yield 0.8, m.start(), at


def ssn_proposals(text: str) -> Iterator[tuple[float, int, int]]:
    for m in _SSN.finditer(text):
        area, group, serial = m.groups()
        if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
            yield 0.4, m.start(), m.end()


def cut_phones(text: str, matches: list[tuple[int, int]], taken: list[int]) -> Iterator[tuple[float, int, int]]:
    """Phones that run on into other numbers: whole groups of up to 15 digits, before the next of the sorted span starts `taken`."""
    for a, b in matches:
        after = bisect_left(taken, a + 1)
        stop = min(b, taken[after]) if after < len(taken) else b
        n, end = 0, 0
        for m in _DIGITS.finditer(text, a, stop):
            n += m.end() - m.start()
            if n > 15:
                break
            end = m.end() if n >= 8 else 0
        if end:
            yield 0.7, a, end


def national_proposals(text: str) -> Iterator[tuple[float, int, int]]:
    """Phones without a plus sign: by themselves they are below the least score, context decides."""
    for m in _NATIONAL.finditer(text):
        found = m.group()
        if 8 <= len(digits_of(found)) <= 15:
            yield 0.45 if found.lstrip("(").startswith("0") else 0.4, m.start(), m.end()


def scored_spans(text: str) -> list[tuple[Span, float, bool]]:
    """((kind, start, end), score, whether base) of all personal data, by kind as listed, then start.

    What the method proposes over a base span, or over an earlier proposal that it takes, is left out.
    """
    base, rows, long_phones = base_spans(text)
    out = [((k, a, b), min(1.0, max(0.0, PRIOR[k] + context(text, k, a, b))), True) for k, a, b in base]
    taken = sorted((a, b) for _, a, b in base)

    def accept(kind: str, found: Iterator[tuple[float, int, int]]) -> None:
        """Take proposals of a kind from left to right where they are free, the higher score first."""
        nonlocal taken
        scored = sorted((a, -(prior + context(text, kind, a, b)), b) for prior, a, b in found)
        starts, ends, free, new = [a for a, _ in taken], [0], 0, []
        for _, b in taken:
            ends.append(max(ends[-1], b))  # the farthest end of the spans up to each
        for a, score, b in scored:
            if -score >= LEAST_SCORE - 1e-9 and a >= free and ends[bisect_left(starts, b)] <= a:
                new.append((a, b))
                out.append(((kind, a, b), min(1.0, -score), False))
                free = b
        if new:
            taken = sorted(taken + new)

    accept("card", card_proposals(text, rows))
    accept("iban", iban_proposals(text))
    accept("ssn", ssn_proposals(text))
    accept("phone", cut_phones(text, long_phones, [a for a, _ in taken]))
    accept("phone", national_proposals(text))
    return sorted(out, key=lambda x: (KINDS.index(x[0][0]), x[0][1]))


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, scores string"


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id with the personal data of each text: counts and digest of the base spans, all spans and their scores.

    n_email to n_phone count base spans, n_added what the method adds; `scores` has a score
    for each of `spans`, two decimals. Null and empty texts have none. Every row gives a
    row, repeated rows too, a null doc_id is kept; an empty table gives no rows. Columns
    other than doc_id and text are not read. Memory follows a slice of 4 MB or the longest
    text.
    """
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                columns: list[list] = [[] for _ in names[1:]]
                for text in piece.column(1).to_pylist():
                    found = scored_spans(text or "")
                    written = [":".join(map(str, s)) for s, _, _ in found]
                    base = [w for w, (_, _, is_base) in zip(written, found, strict=True) if is_base]
                    counts = [sum(is_base and s[0] == k for s, _, is_base in found) for k in BASE_KINDS]
                    row = [*counts, hashlib.sha256(",".join(base).encode()).hexdigest(), ",".join(written), len(found) - len(base), ",".join(f"{x:.2f}" for _, x, _ in found)]
                    for column, value in zip(columns, row, strict=True):
                        column.append(value)
                kinds = [pa.int64() if x.split()[1] == "long" else pa.string() for x in SCHEMA.split(", ")[1:]]
                yield pa.RecordBatch.from_arrays([piece.column(0), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, SCHEMA)


def op12_personal_data(spark, sf_dir: str) -> DataFrame:
    """Personal data of all `documents`; see personal_data."""
    return personal_data(table(spark, sf_dir, "documents"))
