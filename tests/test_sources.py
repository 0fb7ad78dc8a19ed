"""Readers and writers on small files."""

import json

import pytest
from pyspark.sql import functions as F

from privaudit.operators import policy
from privaudit.sources import readers, sinks


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")


def test_hook_logs(spark, tmp_path):
    good = {"ts": "20240101000005", "class": "android.x.T", "method": "getImei", "args": ["1"], "returnValue": "null", "calledFrom": "com.kit.A.b(SourceFile:23)"}
    put(tmp_path / "com.app" / "permission-1.txt", json.dumps(good) + "\n\nnot json\n" + json.dumps({**good, "ts": "bad", "ret": "r", "returnValue": None}) + "\n")
    put(tmp_path / "com.app" / "permission-2.txt", json.dumps({"class": "T", "method": "m"}) + "\n")
    rows = readers.time_ordered(readers.read_api_calls(spark, str(tmp_path)), "ts", "stage", "line_no").collect()
    assert [(r.package, r.stage, r.api, r.return_value, r.ts is None) for r in rows] == [
        ("com.app", 1, "android.x.T.getImei", "r", True), ("com.app", 2, "T.m", "", True), ("com.app", 1, "android.x.T.getImei", "null", False)]


def test_reports_and_sinks(spark, tmp_path):
    rec = {"privacy_field": "imei", "host": "a.com", "sdk": {"name": "K", "is_third_party": True}}
    put(tmp_path / "r" / "com.a" / "leak.json", json.dumps({"records": [rec, rec]}))
    put(tmp_path / "r" / "deep" / "com.b" / "leak.json", json.dumps({"package": "b2", "records": []}))
    put(tmp_path / "r" / "com.c" / "leak.json", "{broken")
    rep = readers.read_reports(spark, str(tmp_path / "r"))
    assert sorted(r.package for r in rep.collect()) == ["b2", "com.a"]
    recs = readers.report_records(rep).select("package", "privacy_field", "host")
    assert recs.count() == 2
    out = str(tmp_path / "t")
    sinks.write_table(recs, out)
    sinks.write_table(recs.limit(1).withColumnRenamed("host", "h").selectExpr("'new' package", "privacy_field", "h host"), out)
    assert {r.package for r in spark.read.parquet(out).collect()} == {"com.a", "new"}
    sinks.write_leak_reports(recs.groupBy("package").count(), recs, str(tmp_path / "lr"))
    assert spark.read.json(str(tmp_path / "lr" / "records")).count() == 2 and spark.read.json(str(tmp_path / "lr" / "summary")).first()["count"] == 2
    sinks.write_csv(recs, str(tmp_path / "csv"))
    text = "".join(p.read_text(encoding="utf-8") for p in (tmp_path / "csv").glob("*.csv"))
    assert text.startswith("﻿package")
    for _ in range(2):
        sinks.append_index(recs, str(tmp_path / "idx"))
    assert spark.read.json(str(tmp_path / "idx")).count() == 4


def test_lenient_and_strict(spark, tmp_path):
    assert readers.read_lenient(spark, str(tmp_path / "nope.json"), "a INT").count() == 0
    put(tmp_path / "x.jsonl", '{"a": 1}\nbad\n')
    good, bad = readers.split_rejects(readers.read_lenient(spark, str(tmp_path / "x.jsonl"), "a INT, _corrupt_record STRING").cache())
    assert ([r.a for r in good.collect()], bad.count()) == ([1], 1)
    with pytest.raises(Exception):
        readers.read_strict(spark, str(tmp_path / "x.jsonl"), "a INT").collect()


def test_policy_result_shapes(spark, tmp_path):
    item = {"text": "t", "id": [1], "label": ["身份", "处理者"]}
    put(tmp_path / "a.jsonl", json.dumps(item) + "\n" + json.dumps(item))
    put(tmp_path / "b.json", json.dumps([item]))
    put(tmp_path / "c.json", json.dumps({"keywords_found": ["身份"], "llm_entities": [{"text": "t", "label": ["处理者"], "entities": []}]}))
    for f in ("a.jsonl", "b.json", "c.json"):
        got = readers.policy_result_labels(readers.read_policy_result(spark, str(tmp_path / f), "p"))
        assert {r.label for r in got.collect()} == {"身份", "处理者"}


def test_dictionaries(spark, tmp_path):
    put(tmp_path / "it.json", json.dumps({"设备信息": ["IMEI", "MAC"], "网络信息": ["MAC"]}, ensure_ascii=False))
    tx = readers.read_taxonomy(spark, str(tmp_path / "it.json"))
    assert {r.child: r.parent for r in readers.single_parent(tx).collect()} == {"IMEI": "设备信息", "MAC": "网络信息"}
    dev = json.dumps({"_categories": {"imei": ["设备信息", "IMEI"], "x": ["a"]}, "imei": ["111", "222"], "tok-word": "token", "nest": {"a": 1}, "none": None})
    df = spark.createDataFrame([("p", dev)], "package string, value string")
    assert {(r.field, r.level1, r.level2) for r in readers.field_categories(df).collect()} == {("imei", "设备信息", "IMEI"), ("x", "a", None)}
    assert {(r.field, r.value, r.is_keyword) for r in readers.sensitive_values(df).collect()} == {("imei", "111", False), ("imei", "222", False), ("tok-word", "token", True)}
    put(tmp_path / "sdk.json", json.dumps([{"name": "A", "packages": ["com.a"]}, {"name": "B", "domains": ["b.com"], "company": "CB"}]))
    assert [(r.ord, r.name, r.company, r.domains) for r in readers.read_sdk_dictionary(spark, str(tmp_path / "sdk.json")).orderBy("ord").collect()] == [(0, "A", "", []), (1, "B", "CB", ["b.com"])]
    put(tmp_path / "labels.csv", "id,name\n1,处理者\n1.1,身份\n2,其他\n")
    lab = readers.read_label_csv(spark, str(tmp_path / "labels.csv"))
    assert [(r.label_idx, r.id, r.parent_id, r.depth) for r in lab.orderBy("label_idx").collect()] == [(0, "1", None, 1), (1, "1.1", "1", 2), (2, "2", None, 1)]
    assert [(r.label_idx, r.new_idx) for r in policy.label_index(lab, [1]).orderBy("new_idx").collect()] == [(0, 0), (2, 1)]


def test_corpus_formats(spark, tmp_path):
    ent = [{"text": "手机号", "label": "data"}]
    put(tmp_path / "n.json", json.dumps([{"doc_id": "d", "sentences": [{"sentence_text": "s", "entities": ent, "predicted_entities": []}]}]))
    put(tmp_path / "f.jsonl", json.dumps({"doc_id": "e", "sentence_text": "u", "ground_truth_entities": ent, "predicted_entities": ent}))
    a, b = readers.read_corpus(spark, str(tmp_path / "n.json"), "train"), readers.read_corpus(spark, str(tmp_path / "f.jsonl"), "test")
    got = {(r.doc_id, r.split, len(r.entities), len(r.predicted_entities)) for r in a.unionByName(b).collect()}
    assert got == {("d", "train", 1, 0), ("e", "test", 1, 1)}


def test_ui_dumps_and_files(spark, tmp_path):
    put(tmp_path / "d" / "com.a" / "20240101000000" / "textual_semantics.json", json.dumps({"op_text": "ok", "api_name_list": ["x"]}))
    put(tmp_path / "d" / "com.a" / "20240101000001_AGREE_0" / "textual_semantics.json", json.dumps({"pre_click_apis": ["getImei"]}))
    assert [(r.package, r.op_text) for r in readers.read_ui_events(spark, str(tmp_path / "d")).collect()] == [("com.a", "ok")]
    assert [(r.name, r.pre_click_apis) for r in readers.read_gate_dumps(spark, str(tmp_path / "d")).collect()] == [("com.a", ["getImei"])]
    put(tmp_path / "w" / "com.a" / "files-1" / "sub" / "x.txt", "hello")
    assert [(r.package, r.path, bytes(r.content)) for r in readers.read_whole_files(spark, str(tmp_path / "w")).collect()] == [("com.a", "/files-1/sub/x.txt", b"hello")]


def test_line_numbers_over_many_splits(spark, tmp_path):
    for name, n in (("a.txt", 4000), ("b.txt", 3)):
        put(tmp_path / "l" / name, "".join(f'{{"a": {i}}}\n' if i % 1000 else f"bad {i}\n" for i in range(1, n + 1)))
    keep = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        lines = readers.numbered_lines(spark, str(tmp_path / "l"))
        assert spark.read.text(str(tmp_path / "l")).rdd.getNumPartitions() > 10
        got = sorted((r.file.rsplit("/", 1)[1], r.line_no, r.value) for r in lines.collect())
        assert [g[:2] for g in got] == [("a.txt", i) for i in range(1, 4001)] + [("b.txt", i) for i in (1, 2, 3)]
        assert all(v in (f"bad {n}", f'{{"a": {n}}}') for _, n, v in got)
        assert sorted(r.line_no for r in readers.bad_lines(spark, str(tmp_path / "l"), "a INT").collect()) == [1000, 2000, 3000, 4000]
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)


def test_repeated_batch_replaces_itself(spark, tmp_path):
    path = str(tmp_path / "idx")
    for batch, hi in (("x", 3), ("y", 2), ("x", 3), ("y", 4)):
        sinks.append_index(spark.range(hi), path, batch)
    assert sorted((r.batch, r.id) for r in spark.read.json(path).collect()) == [("x", i) for i in range(3)] + [("y", i) for i in range(4)]


def test_long_report_keeps_its_order(spark, tmp_path):
    df = spark.range(5000).selectExpr("'p' package", "id ord", "concat('line ', id) line").repartition(7)
    sinks.write_lines(df, str(tmp_path / "t"), "ord")
    parts = sorted((tmp_path / "t" / "package=p").glob("part-*"))
    assert "".join(p.read_text() for p in parts) == "".join(f"line {i}\n" for i in range(5000))


def test_leak_records_are_compressed_and_written_without_a_sort(spark, tmp_path):
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name)
    recs = spark.range(2000).select(F.concat(F.lit("com.a"), (F.col("id") % 70).cast("string")).alias("package"), F.col("id"), F.repeat(F.lit("field"), 40).alias("text"))
    sinks.write_leak_reports(recs.groupBy("package").count(), recs, str(tmp_path / "lr"))
    files = [p for p in (tmp_path / "lr" / "records").glob("*/part-*")]
    assert files and all(p.name.endswith(".json.gz") for p in files) and sum(p.stat().st_size for p in files) < 2000 * 200 / 3
    back = spark.read.json(str(tmp_path / "lr" / "records"))
    assert sorted(map(tuple, back.select("package", "id", "text").collect())) == sorted(map(tuple, recs.collect()))
    assert spark.conf.get(name) == before
    with sinks.open_writers(spark):
        assert int(spark.conf.get(name)) >= sinks.WRITERS
