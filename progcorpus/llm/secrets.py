"""Secret scan: an Aho-Corasick keyword prefilter, anchored patterns near its
hits, then the checksum some key formats carry.

``find_secrets(docs)`` takes any table with ``doc_id`` and ``text`` (other
columns are ignored) and returns one row per input row:

``doc_id, n_assign, n_access, n_hex, base_sha256, spans``

* One pass of the automaton over the ASCII-lower-cased text finds every
  keyword; a pattern is tried only at a hit, anchored there.  Runs of
  hexadecimal digits have no keyword: every run of 32 covers two neighbouring
  multiples of 16, so only those positions are looked at and the run is grown
  from there.
* Formats with an embedded checksum (``github`` and ``npm`` tokens: CRC-32 in
  base 62; ``xprv`` extended keys: double SHA-256 in base 58) are reported only
  when the checksum holds.  They are extra spans; the base spans stay.
* Spans are ``kind:start:end`` in code points, end exclusive, sorted by start
  and then by the kind's place in ``KINDS``, joined by commas.

Nulls: a null text is an empty one (no spans, hash of the empty string), a null
``doc_id`` is passed through.  Repeated rows give repeated rows; an empty table
gives no rows.  A text is scanned whole, whatever its length; memory is bounded
by one Arrow batch plus a few copies of its longest text.  The job is one map
step: no shuffle, nothing kept between rows.
"""

from __future__ import annotations

import hashlib
import re
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from progcorpus.llm.common import ship, utf8

SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"

# fixed values: the kinds in order, their keywords and patterns
KINDS = ("assign", "access", "hex", "github", "npm", "xprv")
KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("akia",),
    "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "npm": ("npm_",),
    "xprv": ("xprv",),
}
ASSIGN = re.compile(rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]+")
GITHUB = re.compile(rb"gh[pousr]_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
NPM = re.compile(rb"npm_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
XPRV = re.compile(rb"xprv[1-9A-HJ-NP-Za-km-z]{107}(?![1-9A-HJ-NP-Za-km-z])")
BASE62 = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BASE58 = b"123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"


def _crc62_ok(m) -> bool:
    """The last six characters are the CRC-32 of the 30 before them, base 62."""
    value = 0
    for c in m[2]:
        value = value * 62 + BASE62.index(c)
    return value == zlib.crc32(m[1])


def _base58_ok(m) -> bool:
    """78 bytes of key followed by the first four of their double SHA-256."""
    value = 0
    for c in m[0]:
        value = value * 58 + BASE58.index(c)
    if value >> (82 * 8):
        return False
    raw = value.to_bytes(82, "big")
    return hashlib.sha256(hashlib.sha256(raw[:78]).digest()).digest()[:4] == raw[78:]


def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for kind, words in KEYWORDS.items():
        for w in words:
            a.add_word(w, (kind, len(w)))
    a.make_automaton()
    return a


# kind -> (anchored pattern, group whose length counts, least length, checksum test)
_RULES = {
    "assign": (ASSIGN, 1, 8, None),
    "access": (ACCESS, 0, 16, None),
    "github": (GITHUB, 0, 0, _crc62_ok),
    "npm": (NPM, 0, 0, _crc62_ok),
    "xprv": (XPRV, 0, 0, _base58_ok),
}


def _hex_spans(raw: bytes):
    """Maximal runs of 32 or more of ``[0-9a-f]``, found at every 16th byte."""
    import numpy as np

    step = np.frombuffer(raw, dtype=np.uint8)[::16]
    is_hex = ((step >= 48) & (step <= 57)) | ((step >= 97) & (step <= 102))
    done = 0
    for i in np.flatnonzero(is_hex[1:] & is_hex[:-1]):
        at = int(i) * 16
        if at < done:
            continue
        end = HEX.match(raw, at).end()
        start = at
        while start > 0 and raw[start - 1] in b"0123456789abcdef":
            start -= 1
        done = end
        if end - start >= 32:
            yield "hex", start, end


def _scan(raw: bytes, ac) -> list[tuple[int, int, str, int]]:
    """Byte spans ``(start, kind's place, kind, end)``, sorted."""
    hits = sorted((end - n + 1, kind) for end, (kind, n) in ac.iter(raw.lower().decode("latin-1")))
    past = dict.fromkeys(_RULES, 0)       # where the kind's last match ended
    found = [(s, KINDS.index(k), k, e) for k, s, e in _hex_spans(raw)]
    for start, kind in hits:
        if start < past[kind]:
            continue
        pattern, group, least, valid = _RULES[kind]
        m = pattern.match(raw, start)
        if not m:
            continue
        past[kind] = m.end()
        if len(m[group]) >= least and (valid is None or valid(m)):
            found.append((start, KINDS.index(kind), kind, m.end()))
    return sorted(found)


def _row(raw: bytes, ac):
    spans, at, chars = [], 0, 0
    edges = {}
    found = _scan(raw, ac)
    for p in sorted({x for s, _, _, e in found for x in (s, e)}):
        chars += len(raw[at:p].decode("utf-8"))       # code points up to the edge
        at = p
        edges[p] = chars
    spans = [(k, f"{k}:{edges[s]}:{edges[e]}") for s, _, k, e in found]
    base = [t for k, t in spans if k in KINDS[:3]]
    count = [sum(k == b for k, _ in spans) for b in KINDS[:3]]
    return (*count, hashlib.sha256(",".join(base).encode()).hexdigest(), ",".join(t for _, t in spans))


def _scan_batches(batches):
    import pyarrow as pa

    ac = automaton()
    types = [pa.int64()] * 3 + [pa.string()] * 2
    for batch in batches:
        rows = [_row(raw, ac) for raw in utf8(batch.column(1))]
        cols = list(zip(*rows)) or [()] * 5
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types))],
            names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def find_secrets(docs: DataFrame) -> DataFrame:
    """One row of counts and spans per document (see the module docstring)."""
    ship(__name__, "progcorpus.llm.common")
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_scan_batches, SCHEMA)
