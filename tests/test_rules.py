"""Hand-written golden rows for the compliance rules and violations."""

from pyspark.sql import functions as F

from privaudit import dictionaries as D
from privaudit.operators import leaks, rules, violations
from privaudit.operators.policy import declaration_terms, normalize_declarations

ALL = ["处理者", "C1", "个人信息分享", "6", "投诉", "数据存储细节", "J1 个人信息安全"]


def labels(spark, per_package):
    rows = [(p, x) for p, xs in per_package.items() for x in xs]
    return rules.policy_labels(spark.createDataFrame(rows, "package string, label string"))


def verdict_map(df):
    return {(r.package, r.rule_id): (r.violated, r.reason) for r in df.collect()}


def test_label_rules(spark):
    per = {"full": ALL + ["政策更新", "获取权", "修改权", "删除权", "撤回同意权", "存储时长", "存储地点"], "c2": ALL + ["处理的个人信息类别"], "bare": ["其他"]}
    pk = spark.createDataFrame([(p,) for p in [*per, "empty"]], "package string")
    v = verdict_map(rules.label_rules(labels(spark, per), pk))
    assert [v["full", r][0] for r in ("R1", "R2", "R3", "R4", "R5")] == [False] * 5
    assert v["c2", "R2"] == (True, "C4") and v["c2", "R3"] == (True, "I2, I3") and v["c2", "R4"] == (True, "E6, E7, E8, E11") and v["c2", "R5"][0]
    assert v["bare", "R1"] == (True, "A1, C1, D1, E1, F1, I1, J1") and v["bare", "R3"][0] is False and v["bare", "R4"][0] is False
    assert v["empty", "R1"][0] and v["empty", "R5"][0] and not v["empty", "R2"][0]


def test_dotted_child_counts_as_its_parent_code(spark):
    got = {r.label: r.code for r in labels(spark, {"p": ["C2.1 x", "4.1", "c4 来源", "身份"]}).collect()}
    assert got == {"C2.1 x": "C2.1", "4.1": "C2", "c4 来源": "C4", "身份": None}


def test_three_valued_rules(spark):
    pk = spark.createDataFrame([("a",), ("b",), ("c",)], "package string")
    consent = spark.createDataFrame([("a", ["imei"]), ("b", []), ("c", None)], "package string, items array<string>")
    acc = spark.createDataFrame([("b", "GPS")], "package string, item string")
    none = spark.createDataFrame([], "package string, sdk string")
    broad = spark.createDataFrame([], "package string, item string, broad string")
    dec = spark.createDataFrame([("b",), ("c",)], "package string")
    und = spark.createDataFrame([("a", "KitX")], "package string, sdk string")
    v = rules.verdicts(pk, labels(spark, {"b": ALL}), consent, none.select("package"), und, acc, dec, broad)
    st = {(r.package, r.rule_id): r.status for r in v.collect()}
    assert [st[p, "R6"] for p in "abc"] == [D.STATUS_VIOLATED, D.STATUS_OK, D.STATUS_UNKNOWN]
    assert [st[p, "R7"] for p in "abc"] == [D.STATUS_VIOLATED, D.STATUS_OK, D.STATUS_UNKNOWN]
    assert [st[p, "R8"] for p in "abc"] == [D.STATUS_UNKNOWN, D.STATUS_OK, D.STATUS_UNKNOWN]


def test_overall_status_and_score(spark):
    v = spark.createDataFrame([("x", "R1", True), ("x", "R6", None), ("y", "R1", False), ("y", "R6", None), ("z", "R1", False)], "package string, rule_id string, violated boolean")
    sc = spark.createDataFrame([("x", 50.0, 80.0), ("y", 100.0, 33.3)], "package string, policy_score double, behaviour_score double")
    got = {r.package: (r.overall_status, r.overall_score) for r in rules.overall(v, sc).collect()}
    assert got == {"x": ("non_compliant", 68.0), "y": ("inconclusive", 60.0), "z": ("compliant", 0.0)}


def test_undisclosed_sdks(spark):
    sdks = spark.createDataFrame([("p", "PushKit", "Acme"), ("p", "MapKit", "Maps Inc"), ("p", "", ""), ("q", "PushKit", "")], "package string, name string, company string")
    pieces = spark.createDataFrame([("p", 1, "we share with acme."), ("q", 2, "pushkit is used")], "package string, piece_id long, piece string")
    sharing = spark.createDataFrame([("p", True), ("q", False)], "package string, sharing_declared boolean")
    got = {tuple(r) for r in rules.undisclosed_sdks(sdks, pieces, sharing).collect()}
    assert got == {("p", "MapKit"), ("p", "未知第三方SDK"), ("q", "PushKit")}


def test_broad_only_uses_aliases_and_smallest_term(spark):
    acc = spark.createDataFrame([("p", "IMEI", "设备信息"), ("p", "GPS", "位置信息"), ("p", "SN", "设备信息")], "package string, item string, category string")
    dec = spark.createDataFrame([("p", "唯一标识符"), ("p", "设备信息"), ("p", "设备sn号")], "package string, value string")
    tx = spark.createDataFrame([("设备信息", "imei")], "parent string, child string")
    assert {tuple(r) for r in rules.broad_only(acc, dec, tx).collect()} == {("p", "IMEI", "唯一标识符")}


def test_pre_consent_precedence_of_an_empty_gate(spark):
    u = spark.createDataFrame([("p", "imei", True)], "package string, item string, flagged boolean")
    gate = spark.createDataFrame([("p", None)], "package string, item string")
    run = spark.createDataFrame([("p", True)], "package string, before_consent boolean")
    r = rules.pre_consent(u, gate, u.select("package", "item"), u, run).first()
    assert (r.evidence, r["items"]) == ("gate", [])


def test_undeclared_match_levels(spark):
    items = ["IMEI", "MAC", "device id", "GPS", "OAID", "x-key"]
    col = spark.createDataFrame([("p", i, "广告数据" if i == "OAID" else "c", 1, "f") for i in items], "package string, standard_name string, category string, n int, behavior_field string")
    dec = spark.createDataFrame([("p", "your imei code", "IMEI"), ("p", "广告数据", "广告数据"), ("p", "the id", "the id"), ("p", "api key", "api key"), ("q", "gps", "GPS")],
                                "package string, raw string, standard_name string")
    assert {r.standard_name for r in violations.undeclared(col, dec).collect()} == {"MAC", "GPS"}


def test_first_own_source_and_every_sdk(spark):
    o = spark.createDataFrame([("p", "手机号", "个人信息", 3, "phone-word")], "package string, standard_name string, category string, n int, behavior_field string")
    src = spark.createDataFrame([("p", "手机号", "b.com", False, ""), ("p", "手机号", "a.com", False, ""), ("p", "手机号", "s1", True, "KitA"), ("p", "手机号", "s2", True, "")],
                                "package string, standard_name string, source string, is_third_party boolean, sdk_name string")
    assert [(r.source, r.severity) for r in violations.app_undeclared(o, src).collect()] == [("a.com", "高")]
    assert sorted((r.source, r.sdk_name) for r in violations.sdk_undeclared(o, src).collect()) == [("s1", "KitA"), ("s2", "s2")]


def test_declaration_normalisation(spark):
    tx = spark.createDataFrame([(0, "设备信息", "IMEI"), (1, "其他", "心率")], "ord int, parent string, child string")
    t = spark.createDataFrame([(x,) for x in ("imei", "设备ID", "您的心率数据", "Wi", "完全不同", "IMEI ")], "raw string")
    got = {r.raw: r.standard_name for r in normalize_declarations(t, "raw", declaration_terms(spark, tx)).collect()}
    assert got == {"imei": "IMEI", "设备ID": "device id", "您的心率数据": "心率", "Wi": "wifi", "完全不同": "完全不同", "IMEI ": "IMEI"}


def test_host_attribution_prefers_dictionary_order(spark):
    sdk = spark.createDataFrame([(0, "A", "ca", "k", [], ["ads.com"]), (1, "B", "cb", "k", [], ["x.ads.com"])], "ord int, name string, company string, category string, packages array<string>, domains array<string>")
    rec = spark.createDataFrame([("com.shop.app", h, "http", "f") for h in ("X.ADS.com", "api.shop.cn", "10.0.2.2", "other.org", "/data/x.db")], "package string, host string, source string, privacy_field string")
    n = {r.host: (r.sdk.name, r.sdk.category) for r in leaks.normalize_leaks(rec, sdk).collect()}
    assert n == {"X.ADS.com": ("A", "k"), "api.shop.cn": ("com.shop.app", "app_self"), "10.0.2.2": ("com.shop.app", "app_self"), "other.org": ("", "unknown"), "/data/x.db": ("", "unknown")}


def test_behaviour_falls_back_per_package(spark):
    rec = spark.createDataFrame([("a", 1, "imei-word", "c", "h", "http", ("S", "Co", True))], "package string, seq long, privacy_field string, category_level1 string, host string, source string, sdk struct<name:string,company:string,is_third_party:boolean>")
    cat = spark.createDataFrame([("a", "gps", "c"), ("b", "latitude", "c")], "package string, field string, category string")
    acc, sdks = rules.behaviour(rec, None, cat)
    assert {(r.package, r.item) for r in acc.collect()} == {("a", "IMEI"), ("b", "GPS")}
    assert [(r.name, r.fields) for r in rules.unique_sdks(sdks.select("*", F.lit(1).alias("k")).drop("k")).collect()] == [("S", ["IMEI"])]
