"""Payloads opened to a fixed point, and the values found in them."""

import base64
import bz2
import gzip
import io
import json
import zipfile
import zlib

from pyspark.sql import functions as F

from privaudit.functions import payload as P
from privaudit.operators import detection

SECRET = "356938035643809"


def zipped(**members):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        for name, data in members.items():
            z.writestr(name, data)
    return held.getvalue()


def js(x):
    return json.dumps(x).encode()


def contents(spark, payloads):
    return spark.createDataFrame([(i, p) for i, p in enumerate(payloads)], "id int, payload binary").withColumn("digest", F.sha2("payload", 256))


def leaves_of(spark, payloads):
    c = contents(spark, payloads)
    leaves, known, rounds = detection.resolve(c.where("payload is not null").select("digest", "payload").dropDuplicates(["digest"]))
    rows = c.select("id", F.col("digest").alias("root")).join(leaves, "root").join(known, "digest").select("id", "leaf_path", "payload").collect()
    return {(r["id"], r["leaf_path"], bytes(r["payload"])) for r in rows}, rounds


def test_nested_payloads_are_opened_until_nothing_is_new(spark):
    inner = js({"in": SECRET + " text", "pad": "x" * 40})
    deep = base64.b64encode(gzip.compress(js({"c": base64.b64encode(bz2.compress(js({"b": base64.b64encode(zlib.compress(inner)).decode(), "n": "other text"}))).decode()})))
    got, rounds = leaves_of(spark, [deep, deep, zipped(**{"a.json": inner, "d/b.gz": gzip.compress(b"plain text here")}), b"<r><a>foo bar</a></r>", b"<r><broken", b"k=some%20value&t=1234567", b"\xff\xfe\x00binary", None, b"", b"\x1f\x8b\x08broken"])
    path = "j>c@j>b@j>in"
    assert {x for x in got if x[0] in (0, 1)} >= {(i, path, (SECRET + " text").encode()) for i in (0, 1)} | {(i, "j>c@j>n", b"other text") for i in (0, 1)}
    assert (2, "zip>a.json@j>in", (SECRET + " text").encode()) in got and (2, "zip>d/b.gz", b"plain text here") in got
    assert (3, "x>r>a", b"foo bar") in got and (4, None, b"<r><broken") in got and (6, None, b"\xff\xfe\x00binary") in got and (9, None, b"\x1f\x8b\x08broken") in got
    assert {(5, "u>k[0]", b"some value"), (5, "u>t[0]", b"1234567"), (5, None, b"k=some%20value&t=1234567")} <= got and not {x for x in got if x[0] == 7}
    assert rounds == 3  # the innermost text is also in the archive, so it is not expanded again


def test_pieces_overlap_and_keep_broken_streams_whole(spark, monkeypatch):
    monkeypatch.setattr(P, "PIECE_BYTES", 5000)
    monkeypatch.setattr(P, "OVERLAP", 100)
    body = bytes(range(256)) * 80
    for data in (gzip.compress(body), bz2.compress(body), zlib.compress(body), gzip.compress(body[:9000]) + gzip.compress(body[9000:])):
        pieces = [p for _, p in P._members(data)]
        assert len(pieces) > 3 and max(map(len, pieces)) <= 5000 and pieces[0] + b"".join(p[100:] for p in pieces[1:]) == body
        assert [p for _, p in P._members(data[:-9])] == [data[:-9]]
    names = [n for n, _ in P._members(zipped(a=body, b=b"x"))]
    assert names[0] == "zip>a" and names[1] == "zip>a[part 1]" and names[-1] == "zip>b"
    assert list(P._members(b"PK\x03\x04broken")) == [(None, b"PK\x03\x04broken")]


def test_values_of_all_encodings_and_keywords(spark):
    flow = [("p", 1, "https", "h", "/x", 1_700_000_000, None, {"Auth": "My-TOKEN here"}, None, gzip.compress(js({"hex": SECRET.encode().hex(), "raw": "id " + SECRET})), None, None)]
    flows = spark.createDataFrame(flow, "package string, side_id long, scheme string, host string, path string, req_ts long, res_ts long, req_headers map<string,string>, res_headers map<string,string>, req_body binary, res_body binary, ws array<struct<data:binary,dir:string>>").withColumn("flow_id", F.lit(1))
    from privaudit.sources import readers
    import hashlib
    digest = hashlib.sha256(SECRET.encode()).digest()
    files = spark.createDataFrame([("p", "/files-1/a", b"\x00\xff" + digest + b"\xfe"), ("q", "/files-1/b", SECRET.encode())], "package string, path string, content binary")
    values = spark.createDataFrame([("p", "imei", SECRET, False), ("p", "token-word", "token", True), ("q", "short", "ab1", False)], "package string, field string, value string, is_keyword boolean")
    rows = detection.detect(detection.probes(readers.flow_rows(flows), None, files), values).collect()
    got = {(r["package"], r["source"], r["privacy_field"], r["encode_type"], r["leaf_path"]) for r in rows}
    assert {("p", "https", "imei", "normal", "j>raw"), ("p", "https", "imei", "hexLower", "j>hex"), ("p", "https", "token-word", "normal", "H->auth"), ("p", "whole_file", "imei", "sha256", None)} <= got
    assert not any(g[0] == "q" for g in got)
    assert detection.detect(detection.probes(None, None, files.limit(0)), values).collect() == []


def test_containers_are_opened_in_batches(spark, monkeypatch):
    payloads = [gzip.compress(f"text {i}".encode()) for i in range(40)] + [zipped(a=b"x", b=b"y"), zipped(a=b"x")[:-3], b"plain"]
    df = contents(spark, payloads).coalesce(1)
    opened = P.open_containers(df, "id")
    got = sorted((r["id"], r["member"] or "", bytes(r["payload"])) for r in opened.collect())
    assert got == [*((i, "", f"text {i}".encode()) for i in range(40)), (40, "zip>a", b"x"), (40, "zip>b", b"y"), (41, "", payloads[41]), (42, "", b"plain")]
    passes, inflated = [], P._inflated
    monkeypatch.setattr(P, "_inflated", lambda data: passes.append(1) or inflated(data))
    assert list(P._members(payloads[3])) == [(None, b"text 3")] and len(passes) == 1


def test_an_empty_dictionary_reads_no_text(spark):
    from privaudit.operators.joins import text_contains
    docs = spark.createDataFrame([("p", "d1", "some text")], "package string, digest string, body string").withColumn("body", F.expr("raise_error('read')").cast("string"))
    values = spark.createDataFrame([("p", 1, "")], "package string, needle_id long, needle string")
    found = text_contains(docs, "digest", "body", values, "needle_id", "needle", on=["package"])
    assert found.collect() == [] and [(f.name, f.dataType.simpleString()) for f in found.schema] == [("package", "string"), ("digest", "string"), ("needle_id", "bigint")]
