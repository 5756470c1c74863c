"""Secrets in text: fixed patterns, and strings that a primed compressor cannot shorten.

A random key next to a word like "token" does not occur in the text around it nor in any list
of identifiers: compressed with both as dictionary it keeps nearly all its bytes.
Ordinary names and repeated values nearly vanish.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsgauge.llm.shared import bounded_batches, col

# Fixed patterns, searched from the left without overlap within a kind; then too short matches are dropped.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "novel")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24

# Novel strings: this long, with letters and digits, this near to a sensitive word, this incompressible.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
SENSITIVE = re.compile(
    r"passw(or)?d|secret|token|api.?key|auth|bearer|credential|private.?key|signature|session.?(id|key)|access.?key",
    re.IGNORECASE | re.ASCII,
)
NEAR_CHARS, AROUND_CHARS = 48, 400
MIN_NOVELTY = 0.85
# Compressed in blocks of fewer bytes than zstd's entropy coding starts at: a random string keeps all its
# bytes whatever its length and alphabet, and only what was seen before becomes shorter.
BLOCK_BYTES, BLOCK_HEADER = 63, 3

# Words of code and configuration that are no secrets.
IDENTIFIERS = (
    b"abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 "
    b"application/json Content-Type Authorization Bearer Basic access_token refresh_token client_id client_secret "
    b"session_id sessionId user_id userId username password passphrase credentials secretKey secret_key apiKey api_key "
    b"access_key_id secret_access_key private_key public_key signature certificate environment variable config settings "
    b"development production staging localhost example.com https://www. http:// return function class import export "
    b"const static public private protected string integer boolean default undefined null true false None self this "
    b"placeholder changeme your_token_here xxxxxxxxxxxxxxxx 1234567890 0000000000000000"
)

_LOWER = bytes(byte + 32 if 65 <= byte <= 90 else byte for byte in range(256))
_HEXED = bytes(1 if 48 <= byte <= 57 or 97 <= byte <= 102 else 0 for byte in range(256))
_ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_SENSITIVE_PARTS = (b"passw", b"secret", b"token", b"api", b"auth", b"bearer", b"credential", b"private", b"signature", b"session", b"access")

_SPANS = "array<struct<kind:string,start:bigint,end:bigint,novelty:double>>"
_SPANS_ARROW = pa.list_(
    pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("novelty", pa.float64())])
)


def novelty(candidate: bytes, around: bytes) -> float:
    """The compressed bytes that a string adds to its surroundings and the identifiers, per byte of it."""
    primed = zstandard.ZstdCompressionDict(IDENTIFIERS + b" " + around, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    press = zstandard.ZstdCompressor(
        level=3, dict_data=primed, write_checksum=False, write_content_size=False, write_dict_id=False
    )
    blocks = -(-len(candidate) // BLOCK_BYTES)
    if blocks <= 1:
        return (len(press.compress(candidate)) - len(press.compress(b""))) / len(candidate)
    # Blocks of equal size; each sees all bytes before it.
    size = -(-len(candidate) // blocks)
    stream, added = press.compressobj(size=len(candidate)), -len(press.compress(b""))
    for at in range(0, len(candidate), size):
        added += len(stream.compress(candidate[at : at + size]))
        added += len(stream.flush(zstandard.COMPRESSOBJ_FLUSH_BLOCK)) - BLOCK_HEADER
    return (added + len(stream.flush())) / len(candidate)


def find_spans(raw: bytes | None, min_novelty: float = MIN_NOVELTY) -> list[tuple[str, int, int, float | None]]:
    """``(kind, start, end, novelty)`` of all secrets, in code points, by start and then kind."""
    raw = raw or b""
    lower = raw.translate(_LOWER)
    # Cheap tests on bytes first: most texts have none of the needed parts.
    assign = any(word in lower for word in _ASSIGN_WORDS)
    access = b"AKIA" in raw
    hexes = b"\x01" * MIN_HEX in raw.translate(_HEXED)
    sensitive = any(part in lower for part in _SENSITIVE_PARTS)
    if not (assign or access or hexes or sensitive):
        return []
    text = raw.decode("utf-8", "replace")
    found: list[tuple[int, int, int, float | None]] = []
    if assign:
        found += [(m.start(), 0, m.end(), None) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    if access:
        found += [(m.start(), 1, m.end(), None) for m in ACCESS.finditer(text) if len(m[0]) >= MIN_ACCESS]
    if hexes:
        found += [(m.start(), 2, m.end(), None) for m in HEX.finditer(text) if len(m[0]) >= MIN_HEX]
    if sensitive:
        base = sorted((start, end) for start, _, end, _ in found)
        at = 0
        for m in CANDIDATE.finditer(text):
            while at < len(base) and base[at][1] <= m.start():
                at += 1
            if at < len(base) and base[at][0] < m.end():
                continue
            own = m[0]
            if not (re.search("[0-9]", own) and re.search("[A-Za-z]", own)):
                continue
            if not SENSITIVE.search(text, max(0, m.start() - NEAR_CHARS), m.start()):
                continue
            around = text[max(0, m.start() - AROUND_CHARS) : m.start()] + " " + text[m.end() : m.end() + AROUND_CHARS]
            score = novelty(own.encode(), around.encode("utf-8", "replace"))
            if score >= min_novelty:
                found.append((m.start(), 3, m.end(), score))
    return [(KINDS[kind], start, end, score) for start, kind, end, score in sorted(found, key=lambda x: x[:3])]


def secrets(
    docs: DataFrame, text_column: str = "text", name: str = "secrets", min_novelty: float = MIN_NOVELTY
) -> DataFrame:
    """``docs`` with a column ``name``: the ``kind, start, end, novelty`` of every secret in a text.

    Kinds are ``assign`` (a value set to a sensitive name), ``access`` (access key ids), ``hex`` (long
    hexadecimal runs) and ``novel`` (other strings near a sensitive word that cannot be compressed).
    Places are code points of the original text, the end exclusive; spans of different kinds may overlap,
    but novel ones overlap no other.  NULL and empty texts have none.  Other columns are kept, an existing
    column ``name`` is replaced.
    """

    bounded_batches(docs.sparkSession)
    def read(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        keys = ("kind", "start", "end", "novelty")
        for texts in batches:
            rows = texts.cast(pa.binary()).to_pylist()
            yield pa.array(
                [[dict(zip(keys, span, strict=True)) for span in find_spans(raw, min_novelty)] for raw in rows],
                _SPANS_ARROW,
            )

    read.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return docs.withColumn(name, F.arrow_udf(read, _SPANS)(col(text_column)))


def listed(spans, kinds: tuple[str, ...] = KINDS):
    """``kind:start:end`` of the spans of some kinds, joined by commas."""
    own = F.filter(spans, lambda x: x["kind"].isin(list(kinds)))
    return F.array_join(F.transform(own, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
