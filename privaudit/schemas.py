"""Table schemas as DDL strings. ``package`` is the fleet key of every table."""

from __future__ import annotations

API_CALL_LINE = (
    "ts STRING, category STRING, `class` STRING, method STRING, args ARRAY<STRING>, returnValue STRING, ret STRING, "
    "calledFrom STRING, stack STRING, _corrupt_record STRING")
API_CALLS = (
    "package STRING, stage INT, line_no BIGINT, ts TIMESTAMP, category STRING, `class` STRING, method STRING, "
    "api STRING, args ARRAY<STRING>, return_value STRING, called_from STRING, stack STRING")
FLOWS = (
    "package STRING, flow_id BIGINT, side STRING, scheme STRING, host STRING, path STRING, ts STRING, "
    "headers MAP<STRING,STRING>, body BINARY, ws ARRAY<STRUCT<data: BINARY, dir: STRING>>")
FS_EVENTS = (
    "package STRING, stage INT, line_no BIGINT, `function` STRING, fd INT, path STRING, data STRING, ts STRING")
CRYPTO_LINE = (
    "ts STRING, category STRING, `class` STRING, class_name STRING, method STRING, method_name STRING, "
    "args ARRAY<STRING>, returnValue STRING, ret STRING, hashcode STRING, algorithm STRING, calledFrom STRING, "
    "stack STRING, _corrupt_record STRING")
UI_DUMP = (
    "op_widget_text STRING, op_text STRING, op_widget_bounds STRING, op_bounds STRING, api_name_list ARRAY<STRING>, "
    "pre_click_apis ARRAY<STRING>, action_type STRING, widget_class STRING, stage STRING")
LEAKS = (
    "package STRING, ts STRING, privacy_field STRING, category_level1 STRING, category_level2 STRING, "
    "direction STRING, host STRING, path STRING, source STRING, target STRING, meta STRING, encode_type STRING, "
    "encrypted BOOLEAN, is_key BOOLEAN, value_preview STRING, "
    "crypt STRUCT<stage: INT, algorithm: STRING, third_party: BOOLEAN, encrypt: BOOLEAN>, "
    "sdk STRUCT<name: STRING, company: STRING, category: STRING, is_third_party: BOOLEAN>")
LEAK_REPORT = (
    "package STRING, analysis_time STRING, records ARRAY<STRUCT<ts: STRING, privacy_field: STRING, "
    "category_level1: STRING, category_level2: STRING, direction: STRING, host: STRING, path: STRING, source: STRING, "
    "target: STRING, meta: STRING, encode_type: STRING, encrypted: BOOLEAN, is_key: BOOLEAN, value_preview: STRING, "
    "crypt: STRUCT<stage: INT, algorithm: STRING, third_party: BOOLEAN, encrypt: BOOLEAN>, "
    "sdk: STRUCT<name: STRING, company: STRING, category: STRING, is_third_party: BOOLEAN>>>")
SDK = "ord INT, name STRING, company STRING, category STRING, packages ARRAY<STRING>, domains ARRAY<STRING>"
SDK_ENTRY = "name STRING, company STRING, category STRING, packages ARRAY<STRING>, domains ARRAY<STRING>"
API_RULE_ENTRY = "`class` STRING, method STRING, field STRING, type STRING, category STRING, note STRING"
ENTITY = "STRUCT<text: STRING, label: STRING>"
SENTENCES = "doc_id STRING, sent_no INT, text STRING, label_ids ARRAY<INT>, labels ARRAY<STRING>"
PREDICTED_LINE = f"text STRING, id ARRAY<INT>, label ARRAY<STRING>, entities ARRAY<{ENTITY}>"
PARAGRAPH = (
    "doc_id STRING, sentences ARRAY<STRUCT<sentence_text: STRING, classification_labels: ARRAY<STRING>, "
    f"entities: ARRAY<{ENTITY}>, predicted_entities: ARRAY<{ENTITY}>, output: STRING>>")
FLAT_PREDICTION = (
    "doc_id STRING, sentence_text STRING, classification_labels ARRAY<STRING>, "
    f"ground_truth_entities ARRAY<{ENTITY}>, predicted_entities ARRAY<{ENTITY}>, raw_llm_output STRING")
UI_NODES = (
    "dump_id STRING, node_id BIGINT, parent_id BIGINT, `class` STRING, resource_id STRING, text STRING, "
    "content_desc STRING, bounds STRING, clickable BOOLEAN, scrollable BOOLEAN, focusable BOOLEAN, "
    "long_clickable BOOLEAN, checkable BOOLEAN, enabled BOOLEAN, visible BOOLEAN")
STEPS = (
    "run_id STRING, step INT, reward DOUBLE, api_list ARRAY<STRING>, activity STRING, state_id STRING, "
    "xml_score DOUBLE, img_same BOOLEAN, is_stuck BOOLEAN, recovered BOOLEAN")
PROCESSING_ACTS = (
    "processing_acts ARRAY<STRUCT<action_verb: STRING, action_type: STRING, controller: STRING, "
    "data_collected_or_shared: ARRAY<STRING>, purpose: STRING, condition: STRING, receiver: STRING>>")
HOOK_CONFIG = "Category STRING, HookType STRING, hooks ARRAY<STRUCT<clazz: STRING, method: STRING>>"
