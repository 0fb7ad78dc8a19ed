"""Payload decoding and detection on invented records."""

import base64
import bz2
import gzip
import hashlib
import io
import zipfile
import zlib

from pyspark.sql import functions as F

from privaudit.functions import payload as P
from privaudit.functions import scalars as S
from privaudit.operators import crypto, leaks


def zipped(*parts):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for i, p in enumerate(parts):
            z.writestr(f"{i}.txt", p)
    return b.getvalue()


def test_containers(spark):
    body = b'{"imei": "356938035643809", "pad": "xxxxxxxxxxxxxxxx"}'
    rows = [gzip.compress(body), bz2.compress(body), zlib.compress(body), zipped(body[:20], body[20:]), base64.b64encode(body), body, b"\x1f\x8b\x08broken", b"ab", None]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "id int, payload binary")
    got = {r.id: None if r.payload is None else bytes(r.payload) for r in P.unwrap_payload(df).collect()}
    assert [got[i] for i in range(6)] == [body] * 6 and got[6] == rows[6] and got[7] == b"ab" and got[8] is None


def test_flatten_forms(spark):
    rows = [(1, '{"a":{"b":[1,{"c":"hello"}]},"d":null,"s":"{\\"in\\":\\"nested\\"}"}'), (2, '<r><a x="1">foooo</a><c>bar</c><c>baz</c></r>'), (3, "k=v1&k=v2&e="), (4, "plain"), (5, "{broken")]
    df = spark.createDataFrame(rows, "id int, payload string").withColumn("meta", F.lit("H->x"))
    got = {(r.id, r.leaf_path, r.leaf) for r in P.flatten_payload(df).collect()}
    assert got == {(1, "H->x@j>a>b[0]", "1"), (1, "H->x@j>a>b[1]>c", "hello"), (1, "H->x@j>s>in", "nested"), (2, "H->x@x>r>a>#text", "foooo"), (2, "H->x@x>r>a>@x", "1"),
                   (2, "H->x@x>r>c[0]", "bar"), (2, "H->x@x>r>c[1]", "baz"), (3, "H->x", "k=v1&k=v2&e="), (3, "H->x@u>k[0]", "v1"), (3, "H->x@u>k[1]", "v2"), (4, "H->x", "plain"), (5, "H->x", "{broken")}


def test_depth_bound_is_reported(spark):
    deep = "[" * 12 + '"value"' + "]" * 12
    r = P.flatten_payload(spark.createDataFrame([('{"a":' + deep + "}", None)], "payload string, meta string")).collect()
    assert [x.too_deep for x in r] == [True]


def test_every_level_is_opened(spark):
    deep = '{"k": ' * 30 + '[1, {"in": "{\\"x\\": [\\"leaf value\\"]}"}]' + "}" * 30
    xml = "".join(f"<t{i}>" for i in range(12)) + "inner" + "".join(f"</t{i}>" for i in reversed(range(12)))
    escaped = r'{"a": "\u007b\"b\": \"\\u005b7, 8]\"}"}'
    df = spark.createDataFrame([(1, deep), (2, xml), (3, escaped), (4, '{"a": "[broken", "b": {}}')], "id int, payload string").withColumn("meta", F.lit(None).cast("string"))
    got = {(r.id, r.leaf_path, r.leaf) for r in P.flatten_payload(df).collect()}
    path = "j" + ">k" * 30
    assert got == {(1, path + "[0]", "1"), (1, path + "[1]>in>x[0]", "leaf value"), (2, "x" + "".join(f">t{i}" for i in range(12)), "inner"), (3, "j>a>b[0]", "7"), (3, "j>a>b[1]", "8"), (4, "j>a", "[broken")}
    assert {r.leaf for r in P.payload_leaves(df).collect()} >= {"leaf value", "inner"}


def test_detection_of_encoded_values_and_keywords(spark):
    v = "AA:bb:01:9f"
    forms = {"upper": v.upper(), "md5hex": hashlib.md5(v.encode()).hexdigest(), "base64": base64.b64encode(("id" * 3 + v).encode()).decode()[8:], "hexLower": v.lower().encode().hex()}
    leaves = [("p", i, f"x={t};") for i, t in enumerate(forms.values())] + [("q", 90, v), ("p", 91, "MyTOKEN here"), ("p", 92, "12345")]
    vals = [("p", "mac", v, False), ("p", "token-word", "token", True), ("p", "num-word", "123", True), ("p", "short", "ab1", False)]
    lf = spark.createDataFrame(leaves, "package string, leaf_id int, leaf string")
    vf = spark.createDataFrame(vals, "package string, field string, value string, is_keyword boolean")
    hits = {(r.leaf_id, r.privacy_field, r.encode_type) for r in leaks.detect_values(lf, vf).collect()}
    assert {(0, "mac", "upper"), (1, "mac", "md5hex"), (3, "mac", "hexLower")} <= hits and not any(h[0] in (90, 91, 92) for h in hits)
    assert {(r.leaf_id, r.privacy_field) for r in leaks.detect_keywords(lf, vf).collect()} == {(91, "token-word")}


def test_token_propagation_keeps_same_row_and_later(spark):
    lf = spark.createDataFrame([("p", 1, 1, "http", ">", "secret=abcdef99"), ("p", 2, 2, "http", "<", "secret=abcdef99"), ("p", 3, 3, "http", ">", "q?secret=abcdef99&z"), ("p", 4, 0, "http", ">", "secret=abcdef99"), ("p", 5, 9, "file", ">", "secret=abcdef99")],
                               "package string, leaf_id int, seq int, source string, direction string, leaf string")
    kw = lf.filter("leaf_id = 1").withColumn("privacy_field", F.lit("secret-word"))
    assert {(r.leaf_id, r.privacy_field) for r in leaks.propagate_tokens(kw, lf).collect()} == {(1, "secret-token"), (3, "secret-token")}


def test_base64_rules(spark):
    long = base64.b64encode(bytes(range(60, 150))).decode()
    cases = {long: True, "deadbeefdeadbeef": False, "short": False, "aaaaaaaaaaaa": False, long + "*": False}
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    assert {r.s: r.b for r in df.select("s", S.may_be_base64("s").alias("b")).collect()} == cases


def test_crypto_pieces(spark):
    fs = [("p", 1, 2, "write", 3, "/a", base64.b64encode(b"wor").decode()), ("p", 1, 1, "write", 3, "/a", base64.b64encode(b"hello ").decode()), ("p", 1, 3, "write", 3, "/a", None),
          ("p", 1, 4, "write", 3, "/a", "%%"), ("p", 1, 5, "read", 3, "/a", base64.b64encode(b"no").decode()), ("p", 1, 6, "write", 4, "/a", base64.b64encode(b"x").decode())]
    df = spark.createDataFrame(fs, "package string, stage int, line_no long, `function` string, fd int, path string, data string")
    assert {(r.fd, bytes(r.buffer)) for r in crypto.file_buffers(df).collect()} == {(3, b"hello wor"), (4, b"x")}
    part = "A" * 40 + "payload chunk that is long enough to count"
    t = spark.createDataFrame([(part, "zz" + part + "zz"), (part, "zz" + part[:66] + "zz"), ("=" * 70, "=" * 66), ("ab", "xxab")], "p string, w string")
    assert [r.b for r in t.select(crypto.is_part_of(F.col("p"), F.col("w")).alias("b")).collect()] == [True, True, False, False]
