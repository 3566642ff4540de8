"""Rules for records against known values, other libraries and whole-text parses."""

import hashlib
import json
import random
import struct

import pytest

from marlstone.functions import records as R


def test_json_scalars():
    line = '{"id": 12, "a": {"b": [1.50, "x\\"y", {"c": null}], "t": true}, "a": 7, "e": [], "f": [[-1e3]]}'
    assert list(R.json_scalars(line)) == [("id", "12"), ("a.b.[]", "1.50"), ("a.b.[]", 'x"y'), ("a.b.[].c", "null"), ("a.t", "true"), ("a", "7"), ("f.[].[]", "-1e3")]
    assert not list(R.json_scalars("[1]")) and not list(R.json_scalars("{broken}")) and not list(R.json_scalars(""))


def test_strict_json():
    assert R.parse_strict('{"a": [1, {"b": "c"}]}') == {"a": [1, {"b": "c"}]}
    for bad in ('{"a": 1, "a": 2}', "NaN", "[1,]", "", "[" * 34 + "]" * 34, "[" * 100_000, json.dumps(list(range(R.MAX_NODES))), '"' + "x" * R.MAX_JSON_BYTES + '"'):
        with pytest.raises(ValueError):
            R.parse_strict(bad)
    assert R.parse_strict("[" * 32 + "]" * 32) is not None


def test_canonical_json():
    # Examples of RFC 8785.
    value = json.loads('{"numbers": [333333333.33333329, 1E30, 4.50, 2e-3, 0.000000000000000000000000001], "string": "\\u20ac$\\u000F\\u000aA\'\\u0042\\u0022\\u005c\\\\\\"\\/", "literals": [null, true, false]}')
    assert R.canonical_json(value) == '{"literals":[null,true,false],"numbers":[333333333.3333333,1e+30,4.5,0.002,1e-27],"string":"€$\\u000f\\nA\'B\\"\\\\\\\\\\"/"}'
    assert list(json.loads(R.canonical_json({"€": 1, "\r": 2, "דּ": 3, "1": 4, "\U0001f600": 5, "\u0080": 6, "ö": 7}))) == ["\r", "1", "\u0080", "ö", "€", "\U0001f600", "דּ"]
    for bits, text in ((0x0000000000000001, "5e-324"), (0x7FEFFFFFFFFFFFFF, "1.7976931348623157e+308"), (0x4340000000000001, "9007199254740994"), (0x444B1AE4D6E2EF4F, "999999999999999900000"),
                       (0x444B1AE4D6E2EF50, "1e+21"), (0x3EB0C6F7A0B5ED8D, "0.000001"), (0x3EB0C6F7A0B5ED8C, "9.999999999999997e-7"), (0x8000000000000000, "0"), (0x41B3DE4355555553, "333333333.3333332")):
        assert R.canonical_json(struct.unpack(">d", bits.to_bytes(8, "big"))[0]) == text
    assert R.canonical_digest({"b": 1, "a": 2.0, "plan_digest": "x"}, "plan_digest") == hashlib.sha256(b'{"a":2,"b":1}').hexdigest()
    with pytest.raises(ValueError):
        R.canonical_digest({"a": 1}, "plan_digest")


def test_checksums():
    texts = [b"123456789", b"", b"a", b"foobar", bytes(range(256)) * 3]
    assert [f"{x:016x}" for x in R.fnv1a(texts)[:4].tolist()] == ["06d5573923c6cdfc", "cbf29ce484222325", "af63dc4c8601ec8c", "85944171f73967e8"]
    assert R.crc32c(texts)[:3].tolist() == [0xE3069283, 0, 0xC1D04330]
    c = 0xFFFFFFFF
    for b in texts[4]:
        c ^= b
        for _ in range(8):
            c = c >> 1 ^ 0x82F63B78 * (c & 1)
    assert int(R.crc32c(texts)[4]) == c ^ 0xFFFFFFFF


def test_public_addresses():
    public = ["8.8.8.8", "172.32.0.1", "100.128.0.1", "198.20.0.1", "192.0.1.1", "0.0.0.1", "2606:4700::1111", "[2606:4700::1]", "::ffff:8.8.8.8"]
    closed = ["0.0.0.0", "10.1.2.3", "127.9.9.9", "172.16.0.1", "172.31.255.255", "192.168.1.1", "169.254.1.1", "100.64.0.1", "198.18.0.1", "198.19.255.255", "192.0.2.1", "198.51.100.7",
              "203.0.113.9", "192.0.0.8", "224.0.0.1", "240.0.0.1", "255.255.255.255", "::", "::1", "fc00::1", "fe80::1", "ff02::1", "2001:db8::1", "::ffff:10.0.0.1", "::8.8.8.8"]
    assert all(map(R.public_address, public)) and not any(map(R.public_address, closed))
    assert [R.public_address(x) for x in (None, "", "host", "1.2.3", "256.1.1.1")] == [None] * 5


TOOLS = {"forecast": {"city": {"type": "string"}, "days": {"type": "integer"}, "exact": {"type": "boolean"}, "at": {"type": "number"}, "opts": {"type": "object"}}}
REPLIES = {
    "hermes": 'Sure.\n<tool_call>\n{"name": "functions.forecast", "arguments": {"city": "Paris", "days": 3}}\n</tool_call>',
    "xml": "Sure.\n<tool_call>\n<function=forecast>\n<parameter=city>\nParis\n</parameter>\n<parameter=days>\n3\n</parameter>\n</function>\n</tool_call>",
    "dsml": 'Sure.\n\n<｜DSML｜tool_calls>\n<｜DSML｜invoke name="forecast">\n<｜DSML｜parameter name="city" string="true">Paris</｜DSML｜parameter>\n<｜DSML｜parameter name="days" string="false">3</｜DSML｜parameter>\n</｜DSML｜invoke>\n</｜DSML｜tool_calls>',
    "glm": "Sure.\n<tool_call>forecast\n<arg_key>city</arg_key>\n<arg_value>Paris</arg_value>\n<arg_key>days</arg_key>\n<arg_value>3</arg_value>\n</tool_call>",
    "atem": 'Sure.\n<atem:function_calls><atem:invoke name="forecast"><atem:parameter name="city">Paris</atem:parameter><atem:parameter name="days">3</atem:parameter></atem:invoke></atem:function_calls>',
}


def test_tool_calls():
    for style, reply in REPLIES.items():
        got = R.tool_calls(reply, style, TOOLS)
        assert got.calls == [("forecast", '{"city": "Paris", "days": 3}')] and got.content.strip() == "Sure."
        assert R.tool_calls("no call", style, TOOLS) == ([], "no call")
        assert R.tool_calls("", style) == ([], "")
    assert R.tool_calls('<tool_call>{"name": "f", "arguments": {}}</tool_call><tool_call>garbage</tool_call>', "hermes").calls == []
    open_end = R.tool_calls("<function=f><parameter=a>1\n<parameter=a>2</function>", "xml", {"f": {"a": {"type": "int"}}})
    assert open_end.calls == [("f", '{"a": 2}')] and open_end.content is None
    for text, schema, want in (("NULL", None, "null"), ("x", None, '"x"'), (" 7 ", {"type": "int"}, "7"), ("7.5", {"type": "integer"}, '"7.5"'), ("2.0", {"type": "number"}, "2"), ("2.5", {"type": "float"}, "2.5"),
                               ("inf", {"type": "number"}, '"inf"'), ("True", {"type": "bool"}, "true"), ("yes", {"type": "boolean"}, "false"), ('{"a":1}', {"anyOf": []}, '{"a": 1}'), ("{a", {"type": "array"}, '"{a"'), ("3", {"type": "string"}, '"3"')):
        assert R.typed(text, schema) == want


def test_streamed_calls_add_up_to_the_whole_parse():
    draw = random.Random(3)
    for style, reply in REPLIES.items():
        for text in (reply, reply + reply, "  " + reply[:-5], "only text <tool", "", "a <tool_call>garbage</tool_call> b"):
            want = R.tool_calls(text, style, TOOLS)
            for step in (1, 2, 3, 7, 50, 0):
                stream, at, events = R.ToolStream(style, TOOLS), 0, []
                while at < len(text):
                    n = step or draw.randint(1, 20)
                    events += stream.feed(text[at:at + n])
                    at += n
                events += stream.finish()
                names = {k: t for kind, k, t in events if kind == "name"}
                arguments = {k: t for kind, k, t in events if kind == "arguments"}
                content = "".join(t for kind, _, t in events if kind == "content")
                assert [(names[k], arguments[k]) for k in sorted(names)] == want.calls, (style, text, step)
                assert content == (want.content or ""), (style, text, step)


def test_redact_private():
    for text, want in (("see /home/ann/x and /Users/bob", "see ~/x and ~"), ("http://u:p@h/x a@b", "http://<redacted>@h/x a@b"), ("http://h/x@y", "http://h/x@y"), ("hf_abcdefgh1 xhf_abcdefgh1", "hf_<redacted> xhf_abcdefgh1"),
                       ("hf_short", "hf_short"), ("Authorization: Basic abcdefgh12", "Authorization: Basic <redacted>"), ("bEaReR short", "bEaReR short"), ('"api-key": "k1"', '"api-key": "<redacted>"'),
                       ("token: abc", "token: abc"), ("TOKEN=abcdefgh", "TOKEN=<redacted>"), ("tokens=abcdefgh", "tokens=abcdefgh"), ("password 12345", "password 12345"), ("passwd=none;x", "passwd=none;x"),
                       ("secret='a,b'", "secret='<redacted>,b'"), ("mysecret=abc", "mysecret=abc"), ("", "")):
        assert R.redact_private(text) == want, text


def test_time_text(spark):
    row = spark.sql("select timestamp'2024-02-05 00:04:09' as t")
    forms = {"%Y at %H%% o'clock": "2024 at 00% o'clock", "%e|%d|%j|%I %p": " 5|05|036|12 AM", "%a %A %b %B %y": "Mon Monday Feb February 24", "": ""}
    assert list(row.select(*(R.time_text("t", f) for f in forms)).first()) == list(forms.values())
    for bad in ("%Q", "%", "%Y %"):
        with pytest.raises(ValueError):
            R.time_text("t", bad)
