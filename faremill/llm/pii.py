"""Personal data: expressions propose spans, checksums confirm them, and context
words nearby adjust their scores.

The expressions are anchored where a proposal can begin (an at sign, a plus sign, the
head of a run of digits), so a long run without a match is read once.  Texts are
scanned as bytes; positions are turned into code points for the spans found.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .secret_scan import code_points, joined

#: Kinds in the order that breaks ties; the first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE = 4
_LOCAL = re.compile(rb"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(rb"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(rb"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(rb"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(rb"(?<![A-Za-z0-9])([A-Z]{2})[0-9]{2}")
# The length of an IBAN by country, ISO 13616.
IBAN_LENGTH = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28,
    "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18,
    "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32,
    "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15,
    "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25,
    "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}
_IBAN_REST = {n: re.compile(rb"(?:\x20?[A-Z0-9]){%d}(?![A-Za-z0-9])" % (n - 4)) for n in set(IBAN_LENGTH.values())}
_SSN = re.compile(rb"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
_NOT_DIGIT = bytes(x for x in range(256) if x not in b"0123456789")
_LOCAL_BYTES = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A proposal's score without context, and whole words that raise it within NEAR bytes.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.5, "iban": 0.9, "ssn": 0.4}
CONTEXT = {
    "email": (b"mail", b"email", b"contact", b"kontakt", b"correo"),
    "ip": (b"ip", b"address", b"host", b"server"),
    "card": (b"card", b"visa", b"mastercard", b"credit", b"payment", b"karte", b"kreditkarte", b"carte", b"tarjeta"),
    "phone": (b"phone", b"telephone", b"call", b"tel", b"telefon", b"mobile", b"fax"),
    "iban": (b"iban", b"bank", b"account", b"konto", b"compte", b"cuenta"),
    "ssn": (b"ssn", b"social", b"security"),
}
NEAR, BONUS = 40, 0.3
_LETTERS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_CONTEXT_WORD = re.compile(rb"[a-z]+")


def luhn(digits: bytes) -> bool:
    total = 0
    for i, x in enumerate(reversed(digits)):
        d = (x - 48) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(iban: bytes) -> bool:
    """ISO 13616: the rearranged number, letters as 10 to 35, leaves 1."""
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(chr(c), 36)) for c in moved)) % 97 == 1


def _emails(text: bytes):
    end, at = 0, text.find(b"@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_BYTES:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            yield start, 0, end
        at = text.find(b"@", max(end, at + 1))


def _octet(x: bytes) -> bool:
    x = x.lstrip(b"0")
    return len(x) <= 3 and int(x or b"0") <= 255


def propose(text: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) in bytes of confirmed spans, by start, then kind."""
    found = list(_emails(text))
    found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(map(_octet, m.groups()))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].translate(None, _NOT_DIGIT)
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
    if b"+" in text:
        found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(m[0].translate(None, _NOT_DIGIT)) <= 15]
    end = 0
    for m in _IBAN.finditer(text):
        rest = _IBAN_REST.get(IBAN_LENGTH.get(m[1].decode()))
        tail = rest.match(text, m.end()) if rest and m.start() >= end else None
        if tail and mod97((m[0] + tail[0]).replace(b" ", b"")):
            end = tail.end()
            found.append((m.start(), 4, end))
    found += [(m.start(), 5, m.end()) for m in _SSN.finditer(text) if m[1] not in (b"000", b"666") and m[1] < b"900" and m[2] != b"00" and m[3] != b"0000"]
    found.sort()
    return found


def score(text: bytes, span: tuple[int, int, int]) -> float:
    kind = KINDS[span[1]]
    before, after = text[max(0, span[0] - NEAR - 1) : span[0]], text[span[2] : span[2] + NEAR + 1]
    # A word cut by the window's edge is none.
    before = before if len(before) <= NEAR else before.lstrip(_LETTERS)
    after = after if len(after) <= NEAR else after.rstrip(_LETTERS)
    around = set(_CONTEXT_WORD.findall((before + b" " + after).lower()))
    return min(1.0, PRIOR[kind] + BONUS * any(w in around for w in CONTEXT[kind]))


def _find(batches, least):
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("text", pa.string())]))
    for batch in batches:
        data, offs = common.text_buffer(batch["text"])
        view, counts, digests, all_spans, details = memoryview(data), [[] for _ in range(BASE)], [], [], []
        for a, b in zip(offs[:-1], offs[1:]):
            text = bytes(view[a:b])
            raw = [(s, sc) for s in propose(text) for sc in [score(text, s)] if s[1] < BASE or sc >= least]
            spans = code_points(text, [s for s, _ in raw])
            for k in range(BASE):
                counts[k].append(sum(s[1] == k for s in spans))
            digests.append(hashlib.sha256(joined([s for s in spans if s[1] < BASE], KINDS).encode()).hexdigest())
            all_spans.append(joined(spans, KINDS))
            details.append([{"kind": KINDS[k], "start": s, "end": e, "score": sc, "text": text[x:y].decode("utf-8", "replace")} for (s, k, e), ((x, _, y), sc) in zip(spans, raw)])
        yield pa.RecordBatch.from_arrays([batch["doc_id"], *[pa.array(c, pa.int64()) for c in counts], pa.array(digests, pa.string()), pa.array(all_spans, pa.string()), pa.array(details, kind)], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "findings"])


def find_pii(docs: DataFrame, least: float = 0.6) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_email, n_ip, n_card, n_phone,
    base_sha256, spans, findings (kind, start, end, score and text of each).

    Base kinds are reported at any score, added ones (iban, ssn) from ``least`` on.
    Kinds are matched leftmost and without overlap within a kind.  Null text is empty
    and has none.  Rows are independent, so repeated rows and null ids come out as
    they go in; other columns are not read; an empty table gives an empty result.
    """
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, findings array<struct<kind:string,start:int,end:int,score:double,text:string>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda it: _find(it, least), schema)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(common.documents(spark, sf_dir)).withColumn("scores", F.transform("findings", lambda x: x["score"])).drop("findings")
