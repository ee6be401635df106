"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs, digits, ``://``, country codes, ends of street
names and the cues that announce an identifier. From each anchor a local parser expands to the boundaries and validates
what it has: e-mail addresses, IP addresses (parts up to 255), card numbers (16 to 19 digits, Luhn) and phone numbers (8 to
15 digits) are the base kinds. Added are IBANs (by their country's length and ISO 7064 check, with or without a cue), logins
in URLs, and after a cue (and such words as "number is") social security, account and passport numbers; and streets with a
house number.

Spans of a kind are leftmost and do not overlap; a span that fails its check is dropped together with the text it
covered, as when a regular expression's matches are filtered. Starts and ends count code points, ends are exclusive.

What bounds the added kinds is what they are, not how far is looked: a cue's number stands right after it or after fillers
(any number of them); a street's name has one or two words before its end where the number follows, and a number and one
to four words where it precedes; words may have any length.

Defined results: null text is empty and has no spans; repeated rows and null ids are rows like any others; texts are
read whole, one row at a time; an empty table gives an empty result; input columns named like a result are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.llm.shared import text_column

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("iban", "login", "ssn", "account", "passport", "street")
KINDS = BASE_KINDS + ADDED_KINDS

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DIGITS = re.compile(r"[0-9]+")
IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: What may stand between a cue and its number, however much of it: it is taken whole, as no number begins within it.
FILLER = re.compile(r"s?(?:[\x20:=#().,-]|\b(?:numbers?|no|nr|num|code|card|account|is|was|are|of|the|my|your|his|her|ist|lautet|est)\b)*+", re.I)
#: Cue (in small letters; its other usual spellings follow) -> kind.
CUES = {
    "iban": "iban",
    "ssn": "ssn", "social security": "ssn", "soc. sec": "ssn", "social insurance": "ssn",
    "account number": "account", "account no": "account", "account #": "account", "account:": "account", "acct": "account", "a/c": "account", "bank account": "account",
    "kontonummer": "account", "numéro de compte": "account", "número de cuenta": "account", "routing number": "account",
    "passport": "passport", "reisepass": "passport", "passeport": "passport", "pasaporte": "passport",
}
AFTER_CUE = {
    "ssn": re.compile(r"(?<![0-9-])([0-9]{3}([\x20-]?)[0-9]{2}\2[0-9]{4})(?![0-9-])", re.I),
    "account": re.compile(r"(?<![0-9A-Za-z-])([0-9](?:[\x20-]?[0-9]){5,16})(?![0-9A-Za-z-])", re.I),
    "passport": re.compile(r"(?<![0-9A-Za-z])([A-Z]{0,2}[0-9]{6,9}|[CFGHJKLMNPRTVWXYZ0-9]{9}(?<=[0-9]))(?![0-9A-Za-z])", re.I),
}
#: Lengths of IBANs by country (fixed values).
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29,
    "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20,
    "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29,
    "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}
#: Ends of street names: the house number stands before the name, or after it.
NUMBER_FIRST = ("Street", "Avenue", "Road", "Boulevard", "Lane", "Drive", "Court", "Square", "Terrace", "Crescent", "St.", "Ave", "Rd.", "Blvd")
NUMBER_LAST = ("straße", "strasse", "Straße", "Strasse", "gasse", "allee", "platz")
STREET_BEFORE = re.compile(r"(?<![\w.,-])[0-9]{1,5}[A-Za-z]?\x20(?:[A-Z0-9][\w.'’-]*\x20){1,4}\Z")
STREET_AFTER = re.compile(r"\x20[0-9]{1,4}(?:\x20?[a-z])?\b")
STREET_NAME = re.compile(r"(?<!\w)[A-ZÄÖÜ][\w-]*(?:\x20[A-ZÄÖÜ]?[\w-]+)?\Z")
#: Words before the end of a street's name: the number and up to four more.
WORDS_BEFORE = 5
LOGIN = re.compile(r"[A-Za-z0-9._~%-]+:[^\s/@]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*")
SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2])
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def iban_holds(text: str) -> bool:
    code = text.replace(" ", "").upper()
    return 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


@cache
def iban_shape(length: int) -> re.Pattern:
    return re.compile(rf"[A-Za-z]{{2}}[0-9]{{2}}(?:[\x20-]?[A-Za-z0-9]){{{length - 4}}}(?![A-Za-z0-9])")


def iban_at(text: str, start: int) -> int | None:
    """The end of the IBAN that begins here."""
    length = IBAN_LENGTHS.get(text[start : start + 2].upper())
    m = iban_shape(length).match(text, start) if length else None
    return m.end() if m and iban_holds(m[0].replace("-", "")) else None


def street_at(text: str, start: int, end: int) -> tuple[int, int] | None:
    """The street and house number around the end of a street's name at start..end; words may have any length.

    What is read backwards is the words that can belong to it, so that every word is read a few times at most.
    """
    if text[start:end] in NUMBER_LAST:
        number = STREET_AFTER.match(text, end)
        if not number:
            return None
        at = start
        for step in (0, 1):
            if step and at and text[at - 1] == " ":
                at -= 1
            while at and (text[at - 1].isalnum() or text[at - 1] in "_-"):
                at -= 1
        name = STREET_NAME.search(text, at, end)
        return (name.start(), number.end()) if name else None
    if text[end : end + 1].isalnum():
        return None
    at = start
    for _ in range(WORDS_BEFORE + 1):
        at = max(0, text.rfind(" ", 0, at))
    before = STREET_BEFORE.search(text, at, start)
    return (before.start(), end) if before else None


def ssn_holds(text: str) -> bool:
    digits = re.sub("[^0-9]", "", text)
    return digits[:3] not in ("000", "666") and digits[:3] < "900" and digits[3:5] != "00" and digits[5:] != "0000"


@cache
def anchors() -> ahocorasick.Automaton:
    """An anchor's value is (what it announces, how long it is)."""
    found = ahocorasick.Automaton()
    words = {"@": "at", "+": "plus", "://": "scheme"} | dict.fromkeys("0123456789", "digit") | dict.fromkeys(IBAN_LENGTHS, "country") | dict.fromkeys((*NUMBER_FIRST, *NUMBER_LAST), "street")
    for cue, kind in CUES.items():
        words |= dict.fromkeys((cue, cue.upper(), cue.capitalize(), cue.title()), f"after {kind}")
    for word, kind in words.items():
        found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


def find_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end), by kind as listed, then start."""
    if not text:
        return []
    spans: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    free = dict.fromkeys(KINDS, 0)  # where the next span of a kind may begin
    filler = (0, -1)  # the last stretch of fillers: cues within it lead to its end
    for end, (anchor, size) in anchors().iter(text):
        if anchor == "digit":
            if end >= free["card"]:
                m = CARD.match(text, end)
                free["card"] = m.end() if m else end + 1
                if m and len(m[0]) >= 16:
                    digits = m[0].replace(" ", "").replace("-", "")
                    if 16 <= len(digits) <= 19 and luhn(digits):
                        spans["card"].append(m.span())
            if end >= free["ip"]:
                m = IP.match(text, end)
                free["ip"] = m.end() if m else DIGITS.match(text, end).end()
                if m and all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
                    spans["ip"].append(m.span())
        elif anchor == "at":
            start = end
            while start > free["email"] and text[start - 1] in LOCAL:
                start -= 1
            if start < end and (m := DOMAIN.match(text, end + 1)):
                spans["email"].append((start, m.end()))
                free["email"] = m.end()
        elif anchor == "plus":
            if end >= free["phone"] and (m := PHONE.match(text, end)):
                if 8 <= sum(map(len, DIGITS.findall(m[0]))) <= 15:
                    spans["phone"].append(m.span())
                free["phone"] = m.end()
        elif anchor == "scheme":
            start = end - 2
            while start > free["login"] and text[start - 1] in SCHEME:
                start -= 1
            if start < end - 2 and (m := LOGIN.match(text, end + 1)):
                spans["login"].append((start, m.end()))
                free["login"] = m.end()
        elif anchor == "country":
            start = end - 1
            if start >= free["iban"] and not (start and text[start - 1].isalnum()) and (stop := iban_at(text, start)):
                spans["iban"].append((start, stop))
                free["iban"] = stop
        elif anchor == "street":
            found = street_at(text, end + 1 - size, end + 1)
            if found and found[0] >= free["street"]:
                spans["street"].append(found)
                free["street"] = found[1]
        elif end + 1 >= free[kind := anchor.removeprefix("after ")] and not text[end + 1 - size - 1 : end + 1 - size].isalnum():
            if not filler[0] <= end + 1 <= filler[1]:
                filler = FILLER.match(text, end + 1).span()
            if kind == "iban":
                start, stop = filler[1], iban_at(text, filler[1])
            else:
                m = AFTER_CUE[kind].match(text, filler[1])
                start, stop = m.span(1) if m and (kind != "ssn" or ssn_holds(m[1])) else (0, None)
            if stop:
                spans[kind].append((start, stop))
                free[kind] = stop
    return [(k, a, b) for k in KINDS for a, b in spans[k]]


def mask(text: str | None, spans: Sequence[tuple[str, int, int]]) -> str | None:
    """The text with every span replaced by its kind in angle brackets; overlapping spans are replaced as one."""
    if text is None:
        return None
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def _scan(masked: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        struct = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            found, texts = [], []
            for value in batch.column(0):
                text = value.as_py()
                spans = find_spans(text)
                found.append([{"kind": k, "start": a, "end": b} for k, a, b in spans])
                if masked:
                    texts.append(mask(text, spans))
            out = [batch.column(1), pa.array(found, struct), *([pa.array(texts, pa.string())] if masked else [])]
            yield pa.RecordBatch.from_arrays(out, names=["row", "spans", *(["masked"] if masked else [])])

    return run


def find_personal_data(docs: DataFrame, *, text_col: str = "text", keep: Sequence[str] | None = None, masked: bool = False) -> DataFrame:
    """The ``keep`` columns (all by default), spans: array of (kind, start, end), and the masked text if asked for."""
    made = ["spans", "masked"] if masked else ["spans"]
    kept = [c for c in (docs.columns if keep is None else keep) if c not in made]
    rows = docs.select(text_column(docs, text_col).alias("text"), F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"))
    schema = T.StructType([rows.schema["row"], *T.StructType.fromDDL("spans array<struct<kind:string,start:long,end:long>>" + ", masked string" * masked)])
    found = rows.mapInArrow(_scan(masked), schema)
    return found.select(*[F.col("row").getField(c).alias(c) for c in kept], *made)
