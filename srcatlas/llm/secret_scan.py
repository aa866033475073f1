"""Secret scan with structural confirmation (operator 4).

Three base kinds are plain patterns (leftmost, non-overlapping per kind): ``assign`` (a credential name, a
separator and a value), ``access`` (access key ids) and ``hex`` (long lower-case hex runs).  Further kinds
are reported only after their structure is confirmed by decoding:

* ``pem``      an armoured private key whose base64 body decodes to a key encoding, or, where its headers say that
               the body is encrypted, to whole cipher blocks; lines end in line breaks, escaped or not;
* ``key``      a base64 or hex run, on one line or wrapped over several, that decodes to a key encoding: DER
               (PKCS#1, DSA, SEC1, PKCS#8 plain or encrypted) in which every nested length fits exactly, or the
               binary private-key container of SSH whose length-prefixed fields add up;
* ``signed``   a token of three base64url parts whose header decodes to a JSON object naming an algorithm and whose
               payload decodes to a JSON object (its signature may be empty where the algorithm is ``none``), or of
               five parts whose header names an encryption too;
* ``encoded``  such a run that decodes to printable text in which a base credential stands, or a run that does so in
               turn, up to ``DEPTH`` layers; the shortest such credential has 12 bytes, which is 16 base64 or 24 hex
               digits.

A run may be glued to a path or a name: where the whole does not decode to a secret, what follows each ``/``, ``-``
or ``_`` is tried, up to the run's end or the next such sign, if its first bytes can begin one, and so are hex
digits inside the run.

One task holds one text at a time; there is no shuffle.  Defined results: a null or empty text has no spans;
every row gives one row, repeated rows included; spans are sorted by start, then kind as listed above; an
empty table gives an empty result; columns other than the id and the text are passed by or not read.
"""

from __future__ import annotations

import base64
import binascii
import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..session import ship_package, sliced
from .common import released

KINDS = ("assign", "access", "hex", "pem", "key", "signed", "encoded")
BASE = KINDS[:3]

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
PEM = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ ){0,3}PRIVATE KEY)-----([A-Za-z0-9+/=\s:,.\\-]*?)-----END \1-----")
#: A brace in base64 begins so; three parts or five.
SIGNED = re.compile(r"(?<![A-Za-z0-9_.-])e[w-z0-9_-][A-Za-z0-9_-]+\.[A-Za-z0-9_-]*\.[A-Za-z0-9_-]*(?:\.[A-Za-z0-9_-]*\.[A-Za-z0-9_-]+)?")
GLUE = re.compile(r"[/_-]")
HEX_INSIDE = re.compile(r"[0-9a-fA-F]{24,}")
#: Layers of encoding that are taken off.
DEPTH = 3
RUN = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
HEX_RUN = re.compile(r"(?:[0-9a-fA-F]{2}){12,}")
#: A line end in the text or escaped, and the next line's indent.
LINE_END = re.compile(r"(?:\r?\n|(?:\\r)?\\n)[\x20\t]*")
WRAPPED = re.compile(rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{{16,}}(?:{LINE_END.pattern}[A-Za-z0-9+/_-]+)+={{0,2}}")
PEM_HEADER = re.compile(r"[A-Za-z0-9-]+:")


def from_base64(s: str) -> bytes | None:
    """Bytes of standard or url-safe base64, padded or not; None if it isn't base64."""
    body = s.rstrip("=").translate({45: "+", 95: "/"})
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_items(data: bytes) -> list[tuple[int, bytes]] | None:
    """(tag, content) of the DER items that fill ``data`` exactly, or None."""
    items, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, size, at = data[at], data[at + 1], at + 2
        if size & 0x80:
            width = size & 0x7F
            if not 1 <= width <= 4 or at + width > len(data):
                return None
            size, at = int.from_bytes(data[at:at + width], "big"), at + width
        if at + size > len(data):
            return None
        items.append((tag, data[at:at + size]))
        at += size
    return items


def is_der_key(data: bytes) -> bool:
    """A private key in DER.

    PKCS#1 (nine integers), DSA (0 and five integers), SEC1 (1, octets), PKCS#8 (0 or 1, algorithm, octets) or
    encrypted PKCS#8 (algorithm with parameters, octets).
    """
    outer = der_items(data)
    if not outer or len(outer) != 1 or outer[0][0] != 0x30:
        return False
    parts = der_items(outer[0][1])
    if not parts or len(parts) < 2:
        return False
    tags = [t for t, _ in parts]
    if tags == [0x30, 0x04]:
        algorithm = der_items(parts[0][1])
        return bool(algorithm) and [t for t, _ in algorithm] == [0x06, 0x30] and len(parts[1][1]) >= 16
    if tags[0] != 0x02 or parts[0][1] not in (b"\0", b"\1"):
        return False
    if len(parts) >= 9 and set(tags[:9]) == {0x02}:
        return True
    if tags == [0x02] * 6:
        return parts[0][1] == b"\0" and len(parts[1][1]) >= 64 and len(parts[2][1]) >= 20
    if tags[:2] == [0x02, 0x04]:
        return len(parts[1][1]) >= 16
    if tags[:3] == [0x02, 0x30, 0x04]:
        algorithm = der_items(parts[1][1])
        return bool(algorithm) and algorithm[0][0] == 0x06 and len(parts[2][1]) >= 16
    return False


def is_ssh_key(data: bytes) -> bool:
    """The binary private-key container of SSH: magic, cipher, kdf, options, count, public and private parts."""
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return False
    at = len(magic)

    def field():
        nonlocal at
        size = int.from_bytes(data[at:at + 4], "big")
        if at + 4 + size > len(data):
            return None
        at += 4 + size
        return data[at - size:at]

    if field() is None or field() is None or field() is None or at + 4 > len(data):
        return False
    count = int.from_bytes(data[at:at + 4], "big")
    at += 4
    return 1 <= count <= 16 and all(field() is not None for _ in range(count + 1)) and at == len(data)


def is_key(data: bytes | None) -> bool:
    return bool(data) and (is_der_key(data) or is_ssh_key(data))


def is_pem_key(body: str) -> bool:
    """Whether the lines between the armour are a key, or whole cipher blocks under headers that say so."""
    lines = [x.strip() for x in LINE_END.sub("\n", body.replace("\\/", "/")).strip().split("\n")]
    head = 0
    if PEM_HEADER.match(lines[0]):
        head = lines.index("") if "" in lines else next((i for i, x in enumerate(lines) if ":" not in x), len(lines))
    data = from_base64("".join("".join(lines[head:]).split()))
    if is_key(data):
        return True
    encrypted = any(x.startswith("Proc-Type:") and "ENCRYPTED" in x for x in lines[:head])
    return encrypted and bool(data) and len(data) >= 32 and len(data) % 8 == 0


def wrapped_runs(text: str):
    """(start, end, digits) of runs wrapped over lines of one width, with and without a shorter last line."""
    for m in WRAPPED.finditer(text):
        breaks = [k.span() for k in LINE_END.finditer(text, m.start(), m.end())]
        starts, ends = [m.start(), *[b for _, b in breaks]], [*[a for a, _ in breaks], m.end()]
        lines = [text[a:b] for a, b in zip(starts, ends)]
        first = 0
        while first < len(lines):
            last = first
            while last + 1 < len(lines) and len(lines[last + 1]) == len(lines[first]):
                last += 1
            if last + 1 < len(lines) and len(lines[last + 1]) < len(lines[first]):
                yield starts[first], ends[last + 1], "".join(lines[first:last + 2])
            if last > first:
                yield starts[first], ends[last], "".join(lines[first:last + 1])
            first = last + 1


def is_signed(token: str) -> bool:
    """Whether the header names an algorithm and the other parts fit it."""
    parts = token.split(".")

    def opened(part):
        raw = from_base64(part)
        try:
            found = json.loads(raw.decode("utf-8")) if raw else None
        except (ValueError, RecursionError):
            return None
        return found if isinstance(found, dict) else None

    header = opened(parts[0])
    if header is None or not isinstance(header.get("alg"), str):
        return False
    if len(parts) == 5:
        return isinstance(header.get("enc"), str)
    return opened(parts[1]) is not None and (parts[2] != "" or header["alg"].lower() == "none")


def _credential(text: str) -> bool:
    return any(len(m[2]) >= 6 for m in ASSIGN.finditer(text)) or any(len(m[0]) >= 20 for m in ACCESS.finditer(text))


def _printable(data: bytes) -> str | None:
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        return None
    return text if all(c.isprintable() or c in "\r\n\t" for c in text) else None


def _hides_credential(data: bytes | None, depth: int) -> bool:
    text = _printable(data) if data else None
    if not text:
        return False
    return _credential(text) or depth > 1 and any(_decoded(m[0], depth - 1) for m in RUN.finditer(text))


def _kind(run: str, depth: int) -> int | None:
    """The kind of secret that a run of digits decodes to as a whole."""
    for data in (from_base64(run), binascii.unhexlify(run) if HEX_RUN.fullmatch(run) else None):
        if is_key(data):
            return KINDS.index("key")
        if _hides_credential(data, depth):
            return KINDS.index("encoded")
    return None


def _can_begin(start: str) -> bool:
    """Whether sixteen base64 digits can begin a key or printable text (a character may be cut off at their end)."""
    data = from_base64(start)
    if not data:
        return False
    return data[0] == 0x30 or data.startswith(b"openssh") or any(_printable(data[:len(data) - k]) for k in range(4))


def _decoded(run: str, depth: int = DEPTH) -> tuple[int, int, int] | None:
    """(start, end, kind) of the secret in a run: the whole of it, or a part behind a sign that glues."""
    kind = _kind(run, depth)
    if kind:
        return 0, len(run), kind
    glue = [m.end() for m in GLUE.finditer(run)]
    for i, start in enumerate(glue):
        if len(run) - start >= 16 and _can_begin(run[start:start + 16]):
            following = next((g - 1 for g in glue[i + 1:] if g - 1 - start >= 16), len(run))
            for end in dict.fromkeys((len(run), following)):
                kind = _kind(run[start:end], depth)
                if kind:
                    return start, end, kind
    for m in HEX_INSIDE.finditer(run):
        for start in (m.start(), m.start() + 1):
            part = run[start:start + (m.end() - start) // 2 * 2]
            kind = _kind(part, depth) if len(part) >= 24 and len(part) < len(run) else None
            if kind:
                return start, start + len(part), kind
    return None


def spans_of(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of every secret in ``text``, by start, then kind."""
    out = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    if "PRIVATE KEY" in text:
        out += [(m.start(), m.end(), 3) for m in PEM.finditer(text)
                if is_pem_key(m[2])]
    out += [(m.start(), m.end(), 5) for m in SIGNED.finditer(text) if is_signed(m[0])]
    for m in RUN.finditer(text):
        found = _decoded(m[0])
        if found:
            out.append((m.start() + found[0], m.start() + found[1], found[2]))
    for start, end, run in wrapped_runs(text):
        kind = _kind(run, DEPTH)
        if kind:
            out.append((start, end, kind))
    return sorted(set(out), key=lambda s: (s[0], s[2], s[1]))


def _find(batches):
    import pyarrow as pa

    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        found = [[{"kind": KINDS[k], "start": a, "end": b} for a, b, k in spans_of(t or "")]
                 for at in range(0, len(batch), 500) for t in batch.column("text").slice(at, 500).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, kind)], names=["doc_id", "spans"])


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, spans (array of kind, start, end in code points, end exclusive)."""
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_find, "doc_id long, spans array<struct<kind:string,start:int,end:int>>")


def listed(spans):
    """Column: spans as ``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"),
                                                                 s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, the number of spans of each base kind, the hash of the base spans and all spans as text."""
    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *[count(kind) for kind in BASE], F.sha2(listed(base), 256).alias("base_sha256"),
                        listed(F.col("spans")).alias("spans"))


def masked(text: str, mask: str = "[SECRET]") -> str:
    """``text`` with every secret replaced; overlapping spans become one mask."""
    out, at = [], 0
    for a, b, _ in spans_of(text):
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], mask]
        at = b
    return "".join(out) + text[at:] if out else text


def mask_secrets(docs: DataFrame, text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """``docs`` with the secrets in its text replaced by a mask; null texts stay null.

    Where the text has changed and there is a ``size_col``, that becomes the new number of characters.
    """
    ship_package(docs.sparkSession)
    at = docs.columns.index(text_col)

    @released
    def clean(batches):
        import pyarrow as pa

        for part in sliced(batches, 500):
            texts = pa.array([t if t is None else masked(t) for t in part.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*part.columns, texts], names=[*part.schema.names, "__clean"])

    done = docs.mapInArrow(clean, StructType([*docs.schema.fields, StructField("__clean", StringType())]))
    if size_col in docs.columns:
        changed = ~F.col("__clean").eqNullSafe(F.col(text_col))
        size = F.length("__clean").cast(docs.schema[size_col].dataType)
        done = done.withColumn(size_col, F.when(changed, size).otherwise(F.col(size_col)))
    return done.withColumn(text_col, F.col("__clean")).select(*docs.columns)
