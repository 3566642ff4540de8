"""Secret scans: patterns first, then structural confirmation of encoded keys and signed tokens."""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

#: Kinds in the order that breaks ties between spans with one start.
KINDS = ("assign", "access", "hex", "pem_key", "der_key", "ssh_key", "signed_token")

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # the runs of [0-9a-f]+ with 32 characters or more
MARKER = re.compile(r"-----(BEGIN|END) ((?:[A-Z0-9]+ ){0,4}PRIVATE KEY)-----")
HEADER = re.compile(r"([A-Za-z][A-Za-z0-9-]*):(.*)")
# In JSON and source strings a line end is written as backslash n, a slash as backslash slash.
LINE_END = re.compile(r"\\+[nr]|[\r\n]+")
BASE64 = re.compile(r"(?:(?<=\\[nr])|(?<![A-Za-z0-9+/_-])(?!(?<=\\)[nr]))[A-Za-z0-9+/_-]{40,}={0,2}")
NEXT_LINE = re.compile(r"(?:[\x20\t]*\r?\n[\x20\t]*|(?:\\+[nr])+)([A-Za-z0-9+/_-]+={0,2})")
HEX_BYTES = re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{64,}")
# A JSON object opens with a brace, then a quote or white space: in base64 ey or ew.
TOKEN = re.compile(r"(?<![A-Za-z0-9_-])(e[wy][A-Za-z0-9_-]{8,})\.([A-Za-z0-9_-]*)\.([A-Za-z0-9_-]*)")
#: A run of 32 hex digits or 40 characters of base64 is part of a word of at least so many characters.
LONG_WORD = 32
#: No encoded private key has more bytes (one of 16,384 bits has about 9,500).
LARGEST_KEY = 1 << 16
URL_SAFE = str.maketrans("-_", "+/")
SSH_MAGIC = b"openssh-key-v1\0"
#: Ciphers of OpenSSH keys after whose private part a tag of 16 bytes stands.
AEAD = (b"aes128-gcm@openssh.com", b"aes256-gcm@openssh.com", b"chacha20-poly1305@openssh.com")


def der_children(data: bytes) -> list[tuple[int, bytes]] | None:
    """(tag, content) of the elements that tile ``data`` exactly; None if lengths do not add up."""
    found, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, n = data[at], data[at + 1]
        at += 2
        if n >= 0x80:
            width = n & 0x7F
            if not 1 <= width <= 4 or at + width > len(data):
                return None
            n = int.from_bytes(data[at:at + width], "big")
            if n < 0x80 or width > 1 and not data[at]:
                return None  # not the shortest form
            at += width
        if at + n > len(data):
            return None
        found.append((tag, data[at:at + n]))
        at += n
    return found


def is_der_key(data: bytes) -> bool:
    """A private key in PKCS#1, traditional DSA, PKCS#8 (plain or encrypted) or SEC1 form, with lengths that nest exactly."""
    top = der_children(data)
    if not top or len(top) != 1 or top[0][0] != 0x30:
        return False
    parts = der_children(top[0][1])
    if not parts:
        return False
    tags = [t for t, _ in parts]
    if tags[:1] == [0x02] and parts[0][1] in (b"\0", b"\1"):
        if len(tags) >= 9 and set(tags[:9]) == {0x02}:  # version and eight integers
            return True
        if tags == [0x02] * 6 and parts[0][1] == b"\0":  # DSA: version and five integers
            return True
        if tags[1:3] == [0x30, 0x04]:  # algorithm, key
            algorithm = der_children(parts[1][1])
            return bool(algorithm) and algorithm[0][0] == 0x06
        if tags[1:2] == [0x04] and parts[0][1] == b"\1":  # scalar, then tagged parameters
            return len(parts[1][1]) >= 16 and all(t in (0xA0, 0xA1) for t in tags[2:])
    if tags == [0x30, 0x04]:
        algorithm = der_children(parts[0][1])
        return bool(algorithm) and algorithm[0][0] == 0x06 and len(parts[1][1]) >= 16
    return False


def is_ssh_key(data: bytes) -> bool:
    """An OpenSSH private key: magic, three length-prefixed strings, a key count, that many public keys, the private part, a tag under AEAD ciphers."""
    if not data.startswith(SSH_MAGIC):
        return False
    at = len(SSH_MAGIC)

    def string() -> bytes | None:
        nonlocal at
        if at + 4 > len(data):
            return None
        n = int.from_bytes(data[at:at + 4], "big")
        at += 4 + n
        return data[at - n:at] if at <= len(data) else None

    head = [string() for _ in range(3)]
    if None in head or at + 4 > len(data):
        return False
    keys = int.from_bytes(data[at:at + 4], "big")
    at += 4
    return 1 <= keys <= 16 and all(string() is not None for _ in range(keys + 1)) and at + 16 * (head[0] in AEAD) == len(data)


def decode64(text: str) -> bytes | None:
    """Bytes of base64, standard or url-safe, with or without its padding; None if it is none."""
    bare = "".join(text.split()).rstrip("=")
    if "+" not in bare and "/" not in bare:
        bare = bare.translate(URL_SAFE)
    if len(bare) % 4 == 1:
        return None
    try:
        return base64.b64decode(bare + "=" * (-len(bare) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def is_token_header(part: str) -> bool:
    """A base64url JSON object that names a signing algorithm."""
    try:
        header = json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4)))
    except (ValueError, RecursionError):
        return False
    return isinstance(header, dict) and isinstance(header.get("alg"), str)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost, non-overlapping spans of each base kind (code points, end exclusive), too short ones dropped."""
    found = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    if max(map(len, text.split()), default=0) >= LONG_WORD:
        found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def is_pem_body(body: str) -> bool:
    """What stands between the lines of a PEM block: headers, then base64 of a private key. An encrypted key in
    the traditional form has no structure of its own: its headers must name cipher and start vector,
    and its bytes must be whole blocks."""
    lines = [x.strip() for x in LINE_END.split(body.replace("\\/", "/"))]
    lines = [x for x in lines if x]
    headers, at = {}, 0
    while at < len(lines) and (m := HEADER.fullmatch(lines[at])):
        headers[m[1].lower()] = m[2].strip()
        at += 1
    data = decode64("".join(lines[at:]))
    if not data:
        return False
    if "ENCRYPTED" in headers.get("proc-type", "") and (m := re.fullmatch(r"[A-Za-z0-9-]+,([0-9A-Fa-f]+)", headers.get("dek-info", ""))):
        return len(m[1]) >= 16 and len(data) >= 32 and len(data) % 8 == 0
    return is_der_key(data) or is_ssh_key(data)


def pem_spans(text: str) -> list[tuple[str, int, int]]:
    """Blocks from a BEGIN line to the END line of the same label with no such line in between: one pass."""
    found, begin = [], None
    for m in MARKER.finditer(text):
        if m[1] == "END" and begin is not None and begin[2] == m[2] and is_pem_body(text[begin.end():m.start()]):
            found.append(("pem_key", begin.start(), m.end()))
        begin = m if m[1] == "BEGIN" else None
    return found


def wanted(code: str) -> int:
    """Characters of base64, without padding, that the key which ``code`` opens has by its own lengths;
    0 if it opens none. For OpenSSH keys, whose lengths lie further on, the most that a key may have."""
    if code.startswith(base64.b64encode(SSH_MAGIC).decode()[:18]):
        return LARGEST_KEY * 4 // 3
    head = decode64(code[:12]) if code[0] == "M" else None
    if not head or head[0] != 0x30:
        return 0
    width = head[1] & 0x7F if head[1] >= 0x80 else 0
    if width > 4:
        return 0
    n = 2 + width + (int.from_bytes(head[2:2 + width], "big") if width else head[1])
    return -(-n * 4 // 3) if n <= LARGEST_KEY else 0


def key_at(text: str, first: re.Match) -> tuple[str, int] | None:
    """(kind, end) of the key that the run of base64 opens, alone or joined with the lines under it, which
    are as wide but for the last; its own lengths tell how many lines to join."""
    most = wanted(first[0])
    if not most:
        return None
    width, end, parts, held = len(first[0]), first.end(), [first[0]], len(first[0].rstrip("="))
    ends = [end]
    while held < most and len(parts[-1]) == width and not parts[-1].endswith("=") and (m := NEXT_LINE.match(text, ends[-1])) and len(m[1]) <= width:
        parts.append(m[1])
        ends.append(m.end())
        held += len(m[1].rstrip("="))
    # A word under the last line of an OpenSSH key may look like one more line.
    for k in (len(parts), len(parts) - 1):
        data = decode64("".join(parts[:k])) if k else None
        if data and data[0] == 0x30 and is_der_key(data):
            return "der_key", ends[k - 1]
        if data and is_ssh_key(data):
            return "ssh_key", ends[k - 1]
    return None


def structural_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans whose decoded bytes have the structure of a key, or whose header names a signature. The time
    goes with the length of the text."""
    found = pem_spans(text) if "-----BEGIN " in text else []
    found += [("signed_token", *m.span()) for m in TOKEN.finditer(text) if is_token_header(m[1])]
    if max(map(len, text.split()), default=0) < LONG_WORD:
        return found
    until, blocks = 0, iter([*(s[1:] for s in found if s[0] == "pem_key"), (len(text), len(text))])
    low, high = next(blocks)
    for m in BASE64.finditer(text):
        while high <= m.start() and high < len(text):
            low, high = next(blocks)
        if m.start() < until or low <= m.start() < high:
            continue
        if m[0][0] in "Mb" and (key := key_at(text, m)):
            found.append((key[0], m.start(), key[1]))
            until = key[1]
    for m in HEX_BYTES.finditer(text):
        if m[0][:2] == "30" and len(m[0]) % 2 == 0 and is_der_key(bytes.fromhex(m[0])):
            found.append(("der_key", *m.span()))
    return found


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan_secrets(documents: DataFrame) -> DataFrame:
    """Secrets of every whole text: (doc_id, n_assign, n_access, n_hex, base_sha256, spans).

    Null or empty text: no spans, the hash of the empty string. A null doc_id stays null, repeated
    rows give repeated results, other columns are not read. One pass over the scan, no shuffle.
    """
    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"

    def run(batches):
        for batch in common.steps(batches):
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), common.texts(batch), strict=True):
                base = base_spans(text)
                kinds = [k for k, _, _ in base]
                every = sorted({*base, *structural_spans(text)}, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
                rows.append((doc, kinds.count("assign"), kinds.count("access"), kinds.count("hex"), hashlib.sha256(joined(base).encode()).hexdigest(), joined(every)))
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k < 4 else pa.string()) for k, c in enumerate(columns)],
                                             ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return documents.select("doc_id", "text").mapInArrow(run, schema)


def redact(text: str, mark: str = "[SECRET]") -> str:
    """``text`` with every secret, overlapping ones as one, replaced by ``mark``."""
    spans = sorted((a, b) for _, a, b in [*base_spans(text), *structural_spans(text)])
    out, at = [], 0
    for a, b in spans:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact_secrets(documents: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``documents`` with secrets replaced by ``mark`` in ``text`` and ``n_chars`` brought up to date.

    All columns and rows stay, repeated ones too; a null text stays null with its n_chars, an empty text is
    kept, an empty table gives none. ``n_chars`` is only written if it is a column of whole numbers.
    Other columns pass unread, whatever their names. No shuffle.
    """
    def run(batches):
        for batch in common.steps(batches):
            at = batch.schema.get_field_index("text")
            texts = [None if t is None else redact(t, mark) for t in batch.column(at).to_pylist()]
            batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
            n = batch.schema.get_field_index("n_chars")
            if n >= 0 and pa.types.is_integer(batch.schema.field(n).type):
                old = batch.column(n).to_pylist()
                batch = batch.set_column(n, batch.schema.field(n), pa.array([o if t is None else len(t) for o, t in zip(old, texts, strict=True)], batch.schema.field(n).type))
            yield batch

    rows = common.plain(documents, "text", "n_chars")
    return rows.mapInArrow(run, rows.schema).toDF(*documents.columns)
