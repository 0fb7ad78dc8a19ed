"""Widget trees with deep nesting and static facts."""

import random
import re

from pyspark.sql import functions as F

from privaudit.operators import statics, widgets

COLS = ("dump_id string, node_id long, parent_id long, `class` string, resource_id string, text string, content_desc string, bounds string, clickable boolean, scrollable boolean, "
        "focusable boolean, long_clickable boolean, checkable boolean, enabled boolean, visible boolean")


def node(i, parent, cls, text="", bounds="[0,0][100,50]", clickable=False, visible=True, dump="d"):
    return (dump, i, parent, cls, "", text, "", bounds, clickable, False, False, False, False, True, visible)


def test_context_reaches_down_a_deep_tree(spark):
    chain = [node(0, None, "x.ListView")] + [node(i, i - 1, "Frame") for i in range(1, 40)] + [node(40, 39, "Custom", clickable=True), node(50, None, "Custom", clickable=True), node(60, 39, "Hidden", clickable=True, visible=False), node(61, 60, "Custom", clickable=True)]
    got = {r.node_id: (r.text_class, r.in_list) for r in widgets.widgets(spark.createDataFrame(chain, COLS)).collect()}
    assert got == {40: (24, True), 50: (0, False)}


def test_classes_bounds_and_inputs(spark):
    rows = [node(1, None, "android.widget.TextView", "a", clickable=True), node(2, None, "android.widget.TextView", "a"), node(3, None, "com.x.FancyEditText", bounds="[-5,-6][10,20]"), node(4, None, "CheckedTextView", clickable=True, bounds="[9,9][3,3]"), node(5, None, "View", "搜索")]
    got = {r.node_id: (r.text_class, r.operatable, tuple(r.box)) for r in widgets.widgets(spark.createDataFrame(rows, COLS), rounds=1).collect()}
    assert got == {1: (20, 1, (0, 0, 100, 50)), 2: (11, 0, (0, 0, 100, 50)), 3: (11, 1, (5, 6, 10, 20)), 4: (18, 1, (0, 0, 0, 0)), 5: (0, 0, (0, 0, 100, 50))}


def test_consent_text_wins_over_pager(spark):
    df = spark.createDataFrame([("d", 1, "ViewPager", "", (0.0, 0.1, 1.0, 0.9)), ("d", 2, "Button", "同意 并继续", (0.2, 0.4, 0.4, 0.6)), ("e", 1, "x.ViewPager", "", (0.0, 0.1, 1.0, 0.9)), ("f", 1, "View", "no", (0.0, 0.0, 1.0, 1.0))],
                               "dump_id string, node_id long, `class` string, text string, box struct<left:double,top:double,right:double,bottom:double>")
    got = {r.dump_id: (round(r.x), round(r.y), r.is_swipe) for r in widgets.gate_widgets(df, ["dump_id"]).collect()}
    assert got == {"d": (324, 960, False), "e": (540, 960, True)}


def test_exported_components(spark):
    c = spark.createDataFrame([("p", "A", "activity", "true", None), ("p", "B", "service", "", None), ("p", "C", "service", "", None), ("p", "D", "receiver", "true", "sig"), ("p", "E", "receiver", "true", "ok"), ("p", "F", "activity", "false", None)],
                              "package string, name string, type string, exported string, permission string")
    a = spark.createDataFrame([("p", "B", "android.intent.VIEW"), ("p", "C", "END_EMMA")], "package string, name string, action string")
    perms = spark.createDataFrame([("sig", "signature"), ("ok", "normal")], "permission string, level string")
    assert {r.name for r in statics.exported_components(c, a, perms).collect()} == {"A", "B", "E"}


def test_tls_history_needs_an_earlier_failure(spark):
    df = spark.createDataFrame([(1, "a.com", 1, False), (2, "a.com", 2, True), (3, "a.com", 3, False), (4, "x.qq.com", 1, False)], "id int, sni string, ts int, failed boolean")
    assert {r.id: r.passthrough for r in statics.tls_passthrough(df).select("id", F.col("passthrough")).collect()} == {1: False, 2: False, 3: True, 4: True}


def test_siblings_of_a_large_parent_are_dealt_to_chunks(spark):
    rows = [node(0, None, "Frame", "top")] + [node(i, 0, "x", f"t{i}") for i in range(1, 31)] + [node(40, 30, "x", "a"), node(40, 30, "x", "a"), node(41, 30, "x", "b")]
    nodes = spark.createDataFrame(rows, COLS)
    want = sorted([(0, "", "top")] + [(i, " ".join(f"t{j}" for j in range(1, 31)) + "  ", f"t{i}") for i in range(1, 31)] + [(40, "a a b  ", "a")] * 2 + [(41, "a a b  ", "b")])
    for crowd in (7, widgets.CROWD):
        assert sorted((r.node_id, r.context, r.own_text) for r in widgets.sibling_context(nodes, crowd=crowd).collect()) == want


def test_texts_of_siblings_are_gathered_in_runs(spark):
    r = random.Random(2)
    rows = [node(r.choice([None, *range(50)]), r.choice([None, 1, 2]), "x", r.choice(["", " ", "a", "b c", None]), dump=r.choice(["d", "e", None])) for _ in range(300)]
    rows = [(*x[:4], r.choice(["", None, "id/btn_1", "q"]), x[5], r.choice(["", "Close", None]), *x[7:]) for x in rows]
    words = lambda x: " ".join(re.findall("[A-Za-z]+", x or ""))
    first = lambda x: (x[1] is not None, x[1] or 0, x[5] or "", words(x[4]), x[6] or "")
    want = []
    for x in rows:
        kids = [first(y)[2:] for y in sorted((y for y in rows if y[0] == x[0] and y[2] == x[2]), key=first)]
        context = " ".join(" ".join(k[i] for k in kids if k[i].strip(" ")) for i in range(3)) if x[0] is not None and x[2] is not None else ""
        want.append((x[0], x[1], context, " ".join([x[5] or "", *(v for v in (words(x[4]), (x[6] or "").strip()) if v)])))
    key = lambda t: tuple((v is not None, v or 0 if i == 1 else v or "") for i, v in enumerate(t))
    nodes = spark.createDataFrame(rows, COLS).repartition(5)
    for run in (3, 1024):
        got = [(x.dump_id, x.node_id, x.context, x.own_text) for x in widgets.sibling_context(nodes, crowd=9, run=run).collect()]
        assert sorted(got, key=key) == sorted(want, key=key)
