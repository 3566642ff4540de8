"""Rules for records that built-in functions do not state: strict and canonical JSON, checksums, addresses, tool calls.

Plain functions of one value; ``marlstone.plans.records`` runs them over Arrow batches.
"""

from __future__ import annotations

import functools
import hashlib
import ipaddress
import json
import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# The limits of a strict JSON body.
MAX_JSON_BYTES = 1_048_576
MAX_NODES = 16_384
MAX_DEPTH = 32


def json_scalars(line: str) -> Iterator[tuple[str, str]]:
    """(path, text) of every scalar of a line that is a JSON object; other lines have none.

    Keys are joined by dots, elements of arrays are written as []. Numbers keep their text.
    """
    line = line.strip("\r")
    if not (line.startswith("{") and line.endswith("}")):
        return
    try:
        top = json.loads(line, parse_float=str, parse_int=_Number, parse_constant=str, object_pairs_hook=_Pairs)
    except (ValueError, RecursionError):
        return
    todo = [("", top)]
    while todo:
        path, value = todo.pop()
        if isinstance(value, _Pairs):
            todo += [(f"{path}.{k}" if path else k, v) for k, v in reversed(value)]
        elif isinstance(value, list):
            todo += [(f"{path}.[]" if path else "[]", v) for v in reversed(value)]
        else:
            yield path, {True: "true", False: "false", None: "null"}[value] if value is None or isinstance(value, bool) else str(value)


class _Pairs(list):
    """The pairs of an object, repeated keys too."""


class _Number(str):
    """The text of a whole number."""


def _once(pairs):
    found = dict(pairs)
    if len(found) != len(pairs):
        raise ValueError("duplicate JSON key")
    return found


def _refuse(name):
    raise ValueError(f"{name} is no JSON value")


_strict_decode = json.JSONDecoder(object_pairs_hook=_once, parse_constant=_refuse).decode


def parse_strict(text: str | bytes):
    """A JSON value without repeated keys, of bounded size, depth and number of nodes; else ValueError."""
    raw = text.encode() if isinstance(text, str) else text
    if len(raw) > MAX_JSON_BYTES:
        raise ValueError("JSON body exceeds limit")

    try:
        value = _strict_decode(raw.decode(json.detect_encoding(raw), "surrogatepass"))
    except RecursionError:
        raise ValueError("over-budget JSON") from None
    level, depth, nodes = [value], 0, 0
    while level:
        nodes += len(level)
        if nodes > MAX_NODES or depth > MAX_DEPTH:
            raise ValueError("over-budget JSON")
        level = [x for v in level for x in (v.values() if isinstance(v, dict) else v if isinstance(v, list) else ())]
        depth += 1
    return value


#: An encoder made once; json.dumps makes one a call when it is given options.
_dumps = json.JSONEncoder(ensure_ascii=False).encode


@functools.lru_cache(1 << 16)
def _plain_number(x: float) -> str:
    """A double as ECMAScript writes it: the fewest digits that give it back, an exponent below 1e-6 and from 1e21 on."""
    if not math.isfinite(x):
        raise ValueError("not a finite number")
    if x == 0:
        return "0"
    if "e" not in (plain := repr(x)):  # Python writes no exponent from 1e-4 to 1e16: the same digits, but for ".0"
        return plain.removesuffix(".0")
    sign, digits, point = "-" if x < 0 else "", *re.fullmatch(r"-?(\d(?:\.\d+)?)e([+-]\d+)", plain).groups()
    digits, point = digits.replace(".", "").rstrip("0") or "0", int(point) + 1
    n = len(digits)
    if n <= point <= 21:
        return sign + digits + "0" * (point - n)
    if 0 < point <= 21:
        return f"{sign}{digits[:point]}.{digits[point:]}"
    if -6 < point <= 0:
        return sign + "0." + "0" * -point + digits
    return f"{sign}{digits[0]}{'.' + digits[1:] if n > 1 else ''}e{'+' if point > 0 else '-'}{abs(point - 1)}"


@functools.lru_cache(1 << 12)
def _plain_key(k: str) -> tuple[bytes, str]:
    """What a key is sorted by, and the key as JSON writes it with its colon."""
    return k.encode("utf-16-be"), json.dumps(k, ensure_ascii=False) + ":"


def canonical_json(value) -> str:
    """JSON with keys sorted by UTF-16 code units, no white space, and numbers as ECMAScript writes them (RFC 8785)."""
    if isinstance(value, dict):
        return "{" + ",".join([name + canonical_json(v) for (_, name), v in sorted([(_plain_key(k), v) for k, v in value.items()], key=lambda x: x[0])]) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(canonical_json, value)) + "]"
    if isinstance(value, int) and not isinstance(value, bool) and -(1 << 53) < value < 1 << 53:
        return str(value)
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return _plain_number(float(value))
    return _dumps(value)


def canonical_digest(value, field: str) -> str:
    """SHA-256 of an object's canonical JSON without the field that holds the digest; ValueError if that is not there."""
    if not isinstance(value, dict) or field not in value:
        raise ValueError("missing self digest")
    return hashlib.sha256(canonical_json({k: v for k, v in value.items() if k != field}).encode()).hexdigest()


def py_dumps(value) -> str:
    """JSON as Python's library writes it without ASCII escapes: ", " and ": " between items."""
    return json.dumps(value, ensure_ascii=False)


def ragged(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The bytes of many texts column by column: (which texts have a k-th byte, those bytes), longest texts first."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    order = np.argsort(-lengths, kind="stable")
    flat = np.frombuffer(b"".join(texts), np.uint8)
    begin = (np.cumsum(lengths) - lengths)[order]
    alive = lengths[order]
    for k in range(int(lengths.max(initial=0))):
        n = int(np.searchsorted(-alive, -k, "left"))
        yield order[:n], flat[begin[:n] + k]


def fnv1a(texts: list[bytes]) -> np.ndarray:
    """64-bit FNV-1a of each text, all texts a byte at a time."""
    h = np.full(len(texts), 0xCBF29CE484222325, np.uint64)
    for who, byte in ragged(texts):
        h[who] = (h[who] ^ byte) * np.uint64(0x100000001B3)
    return h


def _crc_table(poly: int) -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, table >> np.uint32(1) ^ np.uint32(poly), table >> np.uint32(1))
    return table


_CASTAGNOLI = _crc_table(0x82F63B78)


def crc32c(texts: list[bytes]) -> np.ndarray:
    """CRC-32C (Castagnoli) of each text, all texts a byte at a time."""
    c = np.full(len(texts), 0xFFFFFFFF, np.uint32)
    for who, byte in ragged(texts):
        c[who] = _CASTAGNOLI[(c[who] ^ byte) & np.uint32(255)] ^ c[who] >> np.uint32(8)
    return ~c


# Blocks of addresses that are not public unicast.
_RESERVED4 = [ipaddress.ip_network(x) for x in (
    "0.0.0.0/32", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24",
    "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4")]
_RESERVED6 = [ipaddress.ip_network(x) for x in ("::/96", "2001:db8::/32", "fc00::/7", "fe80::/10", "ff00::/8")]


def public_address(text: str | None) -> bool | None:
    """Whether an IPv4 or IPv6 address is public unicast; null for what is no address."""
    try:
        address = ipaddress.ip_address((text or "").strip("[]"))
    except ValueError:
        return None
    if address.version == 6 and address.ipv4_mapped:
        address = address.ipv4_mapped
    return not any(address in block for block in (_RESERVED4 if address.version == 4 else _RESERVED6))


class Tags(NamedTuple):
    """How a format of nested blocks writes calls: block, function, end of its name, parameter, end of its key."""

    block: str
    block_end: str
    function: str
    named: str
    function_end: str
    parameter: str
    keyed: str
    parameter_end: str


# The tags of the formats.
TAGS = {
    "xml": Tags("<tool_call>", "</tool_call>", "<function=", ">", "</function>", "<parameter=", ">", "</parameter>"),
    "dsml": Tags("<｜DSML｜tool_calls>", "</｜DSML｜tool_calls>", '<｜DSML｜invoke name="', '">', "</｜DSML｜invoke>", '<｜DSML｜parameter name="', '">', "</｜DSML｜parameter>"),
    "atem": Tags("<atem:function_calls>", "</atem:function_calls>", '<atem:invoke name="', '">', "</atem:invoke>", '<atem:parameter name="', '">', "</atem:parameter>"),
}
FORMATS = ("hermes", "xml", "dsml", "glm", "atem")
_STRINGS, _BOOLEANS = {"string", "str", "text", "varchar", "char", "enum"}, {"boolean", "bool", "binary"}


def typed(text: str, schema: dict | None) -> str:
    """A parameter's text as JSON of the type that its schema declares; text that does not fit stays text."""
    if text.lower() == "null":
        return "null"
    if schema is None:
        return py_dumps(text)
    kind = schema.get("type", "object" if "anyOf" in schema else "string")
    kind = kind.strip().lower() if isinstance(kind, str) else py_dumps(kind).lower()
    try:
        if kind in _STRINGS:
            return py_dumps(text)
        if kind.startswith(("int", "uint", "long", "short", "unsigned")):
            return str(int(re.fullmatch(r"\s*([+-]?[0-9]+)\s*", text)[1]))
        if kind.startswith(("num", "float")):
            x = float(text)
            if not math.isfinite(x):
                return py_dumps(text)
            return str(int(x)) if x == int(x) else repr(x)
        if kind in _BOOLEANS:
            return "true" if text.lower() == "true" else "false"
        return py_dumps(json.loads(text))
    except (ValueError, TypeError):
        return py_dumps(text)


class Calls(NamedTuple):
    """A reply's calls as (name, JSON of the arguments), and its text without them; no calls: all is text."""

    calls: list[tuple[str, str]]
    content: str | None


def _blocks(text: str, begin: str, end: str) -> list[tuple[int, str]]:
    """(place, inside) of each block; one without an end runs to the end of the text."""
    return [(m.start(), m[1]) for m in re.finditer(f"{re.escape(begin)}(.*?)(?:{re.escape(end)}|\\Z)", text, re.S)]


def _known(name: str, tools: dict[str, dict]) -> str:
    """The name without the namespace ``functions.`` where only that is a tool's."""
    bare = name.removeprefix("functions.")
    return bare if name not in tools and bare in tools else name


def _object(items: dict[str, str]) -> str:
    return "{" + ", ".join(f"{py_dumps(k)}: {v}" for k, v in items.items()) + "}"


def _hermes(inside: str, tools: dict[str, dict]) -> list[tuple[str, str]] | None:
    try:
        call = json.loads(inside)
    except ValueError:
        return None
    if not isinstance(call, dict) or not isinstance(call.get("name"), str) or "arguments" not in call:
        return None
    return [(_known(call["name"], tools), py_dumps(call["arguments"]))]


def _glm(inside: str, tools: dict[str, dict]) -> list[tuple[str, str]] | None:
    name, _, rest = inside.partition("<arg_key>")
    name = name.strip()
    if not name or "<" in name:
        return None
    name, items = _known(name, tools), {}
    for part in rest.split("<arg_key>") if rest else ():
        m = re.match(r"(.*?)</arg_key>.*?<arg_value>(.*?)</arg_value>", part, re.S)
        if not m:
            return None
        items[m[1].strip()] = typed(m[2].strip("\n"), tools.get(name, {}).get(m[1].strip()))
    return [(name, _object(items))]


def _parameter(style: str, part: str, tags: Tags, schema: dict[str, dict]) -> tuple[str, str] | None:
    """Key and JSON value of a parameter's text after its opening."""
    if style == "dsml":
        m = re.match(r'(.*?)" string="(.*?)">(.*)', part, re.S)
        if not m:
            return None
        try:
            return m[1], py_dumps(json.loads(m[3])) if m[2] == "false" else py_dumps(m[3])
        except ValueError:
            return m[1], py_dumps(m[3])
    key, found, value = part.partition(tags.keyed)
    if not found:
        return None
    if style == "xml":
        value = value.removeprefix("\n").removesuffix("\n")
    return key, typed(value, schema.get(key))


def _nested(style: str, inside: str, tools: dict[str, dict]) -> list[tuple[str, str]] | None:
    tags, calls = TAGS[style], []
    for _, body in _blocks(inside, tags.function, tags.function_end):
        name, found, body = body.partition(tags.named)
        if not found:
            continue
        name, items = _known(name, tools), {}
        for part in body.split(tags.parameter)[1:]:
            whole, ended, _ = part.partition(tags.parameter_end)
            pair = _parameter(style, whole if ended else part.removesuffix("\n"), tags, tools.get(name, {}))
            if pair is None:
                return None
            items[pair[0]] = pair[1]
        calls.append((name, _object(items)))
    return calls


def tool_calls(text: str, style: str, tools: dict[str, dict] | None = None) -> Calls:
    """The calls of a whole reply in one of FORMATS; ``tools``: each tool's parameters with their schemas.

    A block that is not a call makes the whole reply text. The text before the first block is content, unless blank.
    """
    tools, plain = tools or {}, Calls([], text)
    begin, end = (TAGS[style].block, TAGS[style].block_end) if style in TAGS else ("<tool_call>", "</tool_call>")
    blocks = _blocks(text, begin, end)
    if not blocks and style in TAGS and TAGS[style].function in text:  # functions without a block round them
        blocks = [(text.index(TAGS[style].function), text)]
    read = {"hermes": _hermes, "glm": _glm}.get(style) or (lambda inside, tools: _nested(style, inside, tools))
    calls: list[tuple[str, str]] = []
    for _, inside in blocks:
        found = read(inside, tools)
        if found is None:
            return plain
        calls += found
    if not calls:
        return plain
    content = text[:blocks[0][0]]
    if style == "dsml":
        content = content.removesuffix("\n\n")
    return Calls(calls, content if content.strip() else None)


class ToolStream:
    """A reply read as it is written: ``feed`` gives what each piece adds as (kind, index, text).

    Content is given up to what may be the start of a block; a block's calls are given, name and arguments, when
    its end is written or the reply ends. The pieces add up to what ``tool_calls`` reads from the whole text.
    """

    def __init__(self, style: str, tools: dict[str, dict] | None = None):
        self.style, self.tools, self.text, self.sent, self.calls = style, tools, "", 0, 0
        self.begin, self.end = (TAGS[style].block, TAGS[style].block_end) if style in TAGS else ("<tool_call>", "</tool_call>")

    def feed(self, piece: str) -> list[tuple[str, int, str]]:
        self.text += piece
        at = self.text.find(self.begin)
        if at < 0:
            hold = max((k for k in range(1, len(self.begin)) if self.text.endswith(self.begin[:k])), default=0)
            safe = len(self.text) - hold
        else:
            safe = at
        # Blank text before a block is no content, and the two line ends before one may not be.
        safe = len(self.text[:safe].rstrip())
        out = [("content", -1, self.text[self.sent:safe])] if safe > self.sent else []
        self.sent = max(self.sent, safe)
        if at >= 0 and (stop := self.text.rfind(self.end)) >= 0:
            out += self._news(tool_calls(self.text[:stop + len(self.end)], self.style, self.tools).calls)
        return out

    def _news(self, calls: list[tuple[str, str]]) -> list[tuple[str, int, str]]:
        new = [(kind, k, text) for k, call in enumerate(calls) if k >= self.calls for kind, text in zip(("name", "arguments"), call, strict=True)]
        self.calls = max(self.calls, len(calls))
        return new

    def finish(self) -> list[tuple[str, int, str]]:
        """What was held back, and the calls of a block without an end."""
        whole = tool_calls(self.text, self.style, self.tools)
        rest = (whole.content or "")[self.sent:]
        return ([("content", -1, rest)] if rest else []) + self._news(whole.calls)


# Words that name a secret, and beginnings of tokens.
SECRET_WORDS = ("api-key", "api_key", "apikey", "hf-token", "hf_token", "token", "secret", "password", "passwd", "authorization")
TOKEN_PREFIXES = ("hf_", "sk-", "ghp_", "gho_", "github_pat_", "xoxb-", "xoxp-", "AIza")
# What may follow a secret's name and is no secret.
PLAIN_VALUES = ("null", "true", "false", "none", "found", "<set>", "<redacted>")

_MARK = "<redacted>"
_CREDENTIALS = re.compile(r"""(://)[^\s/"'\\<>]*@""")
_PREFIXED = re.compile(f"(?<![A-Za-z0-9])({'|'.join(map(re.escape, TOKEN_PREFIXES))})[A-Za-z0-9_-]{{8,}}")
_BEARER = re.compile(r"((?:bearer|basic) )[A-Za-z0-9_./+=-]{8,}", re.I)
_KEYED = re.compile(rf"""(?<![A-Za-z0-9])({'|'.join(SECRET_WORDS)})(?![A-Za-z0-9_])(</key>\s*<string>|[=: "'\\]*[=: ][=: "'\\]*)([^\s"',\\}}\];&]+)""", re.I)


def redact_private(text: str, home: str = r"/(?:home|Users)/[^/\s\"']+") -> str:
    """``text`` without what must not leave a machine: home folders as ~, credentials in URLs, tokens by their
    beginning (kept) and 8 characters or more, bearer and basic credentials, and values after a secret's name
    that are not plainly none (digits only, a word like null)."""
    def keyed(m: re.Match) -> str:
        value, rest = m[3], ""
        if m[2].lower().startswith("</key>"):
            value, _, rest = value.partition("<")
            rest = m[3][len(value):]
        bare = value in PLAIN_VALUES or value.lower() in ("bearer", "basic") or value.isdigit() or any(value == p + _MARK for p in TOKEN_PREFIXES)
        if not value or bare or m[1].lower() == "token" and len(value) < 8:
            return m[0]
        return f"{m[1]}{m[2]}{_MARK}{rest}"

    text = re.sub(home, "~", text)
    text = _CREDENTIALS.sub(rf"\1{_MARK}@", text)
    text = _PREFIXED.sub(rf"\1{_MARK}", text)
    text = _BEARER.sub(rf"\1{_MARK}", text)
    return _KEYED.sub(keyed, text)


# Directives of a time format, besides %e (a day padded with a blank) and %%; others are refused.
DIRECTIVES = {"Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "p": "a", "j": "DDD", "a": "EEE", "A": "EEEE", "b": "MMM", "B": "MMMM"}


def time_text(column: str, form: str) -> Column:
    """A time as a strftime format writes it, in built-in functions; ValueError for a directive that is not known."""
    parts = []
    for literal, directive in re.findall(r"([^%]+)|%(.?)", form, re.S):
        if literal or directive == "%":
            parts.append(F.lit(literal or "%"))
        elif directive == "e":
            parts.append(F.lpad(F.dayofmonth(column).cast("string"), 2, " "))
        elif directive in DIRECTIVES and directive:
            parts.append(F.date_format(column, DIRECTIVES[directive]))
        else:
            raise ValueError(f"unknown directive %{directive}")
    return F.concat(F.lit(""), *parts)
