"""Secret scans: an Aho-Corasick keyword prefilter, anchored expressions near its
hits, and checksum validation where a credential embeds one.

Kinds with fixed prefixes (assign, access, github, npm, jwt, pem) are matched only
where the automaton met their keyword; hex has no keyword, so it is searched for as
a run of sixteen or more.  Texts are scanned as bytes; positions are turned into
code points for the spans found.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Kinds in the order that breaks ties; the first three are the base kinds.
KINDS = ("assign", "access", "hex", "github", "npm", "jwt", "pem")
BASE = 3
#: Keywords are matched in lower case; (kind, whether the keyword's case counts).
KEYWORDS = {"password": 0, "passwd": 0, "secret": 0, "token": 0, "apikey": 0, "api_key": 0, "akia": 1, "ghp_": 3, "gho_": 3, "ghs_": 3, "ghu_": 3, "ghr_": 3, "npm_": 4, "eyj": 5, "-----begin ": 6}
_ASSIGN = re.compile(rb"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]{16,}")
_GITHUB = re.compile(rb"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
_NPM = re.compile(rb"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
_JWT = re.compile(rb"(eyJ[A-Za-z0-9_-]{8,})\.([A-Za-z0-9_-]{8,})\.([A-Za-z0-9_-]{8,})")
_JWT_RUN = re.compile(rb"eyJ[A-Za-z0-9_-]*")
_PEM = re.compile(rb"-----BEGIN ((?:[A-Z]+ )?PRIVATE KEY)-----([A-Za-z0-9+/=\s]{16,}?)-----END \1-----")
_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def base62_crc32(body: bytes) -> str:
    """CRC-32 of a token's body as six base-62 digits, as such tokens embed it."""
    n, out = zlib.crc32(body), ""
    for _ in range(6):
        n, r = divmod(n, 62)
        out = _BASE62[r] + out
    return out


def _is_jwt(header: bytes) -> bool:
    try:
        return isinstance(json.loads(base64.urlsafe_b64decode(header + b"=" * (-len(header) % 4))), dict)
    except ValueError:
        return False


def _is_key(body: bytes) -> bool:
    """Base64 of one DER sequence of just that length, or of an OpenSSH key."""
    try:
        der = base64.b64decode(b"".join(body.split()), validate=True)
    except ValueError:
        return False
    if der.startswith(b"openssh-key-v1\0"):
        return True
    if len(der) < 2 or der[0] != 0x30:
        return False
    more = der[1] & 0x7F if der[1] & 0x80 else 0
    return len(der) == 2 + more + (int.from_bytes(der[2 : 2 + more], "big") if more else der[1])


def _anchored(kind: int, text: bytes, at: int):
    """(end, holds) of the expression of a kind anchored at a hit, or None."""
    if kind == 0:
        m = _ASSIGN.match(text, at)
        return m and (m.end(), len(m[1]) >= 12)
    if kind == 1:
        m = _ACCESS.match(text, at)
        return m and (m.end(), m.end() - at >= 18)
    if kind in (3, 4):
        m = (_GITHUB if kind == 3 else _NPM).match(text, at)
        return m and (m.end(), base62_crc32(m[1]) == m[2].decode())
    if kind == 5:
        m = _JWT.match(text, at)
        if m:
            return m.end(), _is_jwt(m[1])
        # What fails here fails for every later hit in the same run of characters.
        run = _JWT_RUN.match(text, at)
        return run and (run.end(), False)
    m = _PEM.match(text, at)
    return m and (m.end(), _is_key(m[2]))


def automaton():
    words = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        words.add_word(word, (len(word), kind))
    words.make_automaton()
    return words


def scan(text: bytes, words) -> list[tuple[int, int, int]]:
    """(start, kind, end) in bytes, by start, then kind."""
    found, ends = [], [0] * len(KINDS)
    hits = [(last - size + 1, kind) for last, (size, kind) in words.iter(text.lower().decode("latin-1"))]
    for at, kind in sorted(hits):
        if at >= ends[kind]:
            m = _anchored(kind, text, at)
            if m:
                ends[kind] = m[0]
                if m[1]:
                    found.append((at, kind, m[0]))
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    found.sort()
    return found


def code_points(text: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans by byte (ascending starts) as spans by code point."""
    if not spans or text.isascii():
        return spans
    marks = sorted({x for s in spans for x in (s[0], s[2])})
    at, n, to = 0, 0, {}
    for x in marks:
        n += len(text[at:x].decode("utf-8", "replace"))
        at, to[x] = x, n
    return [(to[a], k, to[b]) for a, k, b in spans]


def joined(spans, kinds) -> str:
    return ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in spans)


def _scan(batches):
    words = automaton()
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("text", pa.string())]))
    for batch in batches:
        data, offs = common.text_buffer(batch["text"])
        view, counts, digests, all_spans, secrets = memoryview(data), [[], [], []], [], [], []
        for a, b in zip(offs[:-1], offs[1:]):
            text = bytes(view[a:b])
            raw = scan(text, words)
            spans = code_points(text, raw)
            for k in range(BASE):
                counts[k].append(sum(s[1] == k for s in spans))
            digests.append(hashlib.sha256(joined([s for s in spans if s[1] < BASE], KINDS).encode()).hexdigest())
            all_spans.append(joined(spans, KINDS))
            secrets.append([{"kind": KINDS[k], "start": s, "end": e, "text": text[x:y].decode("utf-8", "replace")} for (s, k, e), (x, _, y) in zip(spans, raw)])
        yield pa.RecordBatch.from_arrays([batch["doc_id"], *[pa.array(c, pa.int64()) for c in counts], pa.array(digests, pa.string()), pa.array(all_spans, pa.string()), pa.array(secrets, kind)], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "secrets"])


def find_secrets(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_assign, n_access, n_hex,
    base_sha256, spans, secrets (kind, start, end and text of each).

    Kinds are matched leftmost and without overlap within a kind; spans of different
    kinds may overlap.  Null text is empty and has none.  Rows are independent, so
    repeated rows and null ids come out as they go in; other columns are not read; an
    empty table gives an empty result.
    """
    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, secrets array<struct<kind:string,start:int,end:int,text:string>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scan, schema)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(common.documents(spark, sf_dir)).drop("secrets")
