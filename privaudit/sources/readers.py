"""Readers. Missing inputs become empty tables, bad rows are set aside and counted, schemas are fixed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.utils import AnalysisException

from privaudit import schemas
from privaudit.functions.scalars import (blank, is_skipped_host, is_static_script, keeps_response_body, parse_ts)

BAD = "_corrupt_record"


def read_lenient(spark: SparkSession, path, schema: str, multi_line: bool = False, **options) -> DataFrame:
    """JSON or JSONL with a fixed schema; a missing path gives an empty table."""
    try:
        return spark.read.schema(schema).options(multiLine=multi_line, mode="PERMISSIVE", **options).json(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise


def read_strict(spark: SparkSession, path, schema: str) -> DataFrame:
    """JSONL that fails on the first bad line and names it."""
    return spark.read.schema(schema).options(mode="FAILFAST").json(path)


def numbered_lines(spark: SparkSession, path) -> DataFrame:
    """Lines of text files as (file, line_no, value); ``line_no`` counts from 1 and is exact however the file is split.

    Splits are counted first (a row per file and split); a line's number is its place in its split plus the lines of
    the splits before, so no file is read by one task as a whole.
    """
    where = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start")]
    lines = spark.read.text(path).select(*where, F.monotonically_increasing_id().alias("_id"), "value")
    splits = lines.groupBy("file", "_start").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = W.partitionBy("file").orderBy("_start").rowsBetween(W.unboundedPreceding, -1)
    shift = splits.select("file", "_start", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    return lines.join(shift, ["file", "_start"]).select("file", (F.col("_id") + F.col("_shift")).alias("line_no"), "value")


def bad_lines(spark: SparkSession, path, schema: str) -> DataFrame:
    """File, number and text of the lines that do not parse: what :func:`read_strict` would fail on. Blank lines are no rows."""
    parsed = numbered_lines(spark, path).filter(~blank("value")).withColumn(
        "_bad", F.from_json("value", f"{schema}, {BAD} STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD})[BAD])
    return parsed.filter("_bad is not null").select("file", "line_no", "value")


def split_rejects(df: DataFrame, bad: str = BAD) -> tuple[DataFrame, DataFrame]:
    """Good rows, and the raw text of rows that did not parse."""
    return df.filter(F.col(bad).isNull()).drop(bad), df.filter(F.col(bad).isNotNull()).select(bad)


def parse_json_lines(lines: DataFrame, line: str, schema: str) -> DataFrame:
    """JSON text column to its fields; the raw text stays in ``_corrupt_record`` when it does not parse."""
    full = schema if BAD in schema else f"{schema}, {BAD} STRING"
    rest = [c for c in lines.columns if c != line]
    return (lines.filter(~blank(line)).withColumn("_j", F.from_json(line, full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD}))
            .select(*rest, "_j.*"))


def _with_origin(df: DataFrame) -> DataFrame:
    """File facts: stage from the ``-N.txt`` suffix and package from the parent folder; a log may be a folder of part files."""
    f = F.regexp_replace("_metadata.file_path", r"/part-[^/]*$", "")
    return (df.withColumn("source_file", F.col("_metadata.file_name"))
            .withColumn("package", F.regexp_extract(f, r"/([^/]+)/[^/]+$", 1))
            .withColumn("stage", F.regexp_extract(f, r"-([0-9]+)\.[a-z]+$", 1).try_cast("int")))


def text_lines(spark: SparkSession, path) -> DataFrame:
    """Lines of log files with package, stage and an order number inside the file.

    The number is the byte offset order Spark reads lines in; only its order means anything.
    """
    raw = spark.read.text(path, wholetext=False)
    return _with_origin(raw.select("value", "_metadata")).withColumn("line_no", F.monotonically_increasing_id()).drop("_metadata")


def api_calls(lines: DataFrame, line: str = "value") -> DataFrame:
    """Hook-log lines to API calls; ``lines``: package, stage, line_no, value. Blank and bad lines are dropped."""
    p = parse_json_lines(lines, line, schemas.API_CALL_LINE).filter(F.col(BAD).isNull())
    name = F.concat(F.coalesce("class", F.lit("")), F.lit("."), F.coalesce("method", F.lit("")))
    return p.select(
        "package", "stage", "line_no", parse_ts("ts").alias("ts"), F.coalesce("category", F.lit("")).alias("category"), "class", "method",
        F.regexp_replace(name, r"^\.+|\.+$", "").alias("api"), F.coalesce("args", F.array().cast("array<string>")).alias("args"),
        F.coalesce("returnValue", "ret", F.lit("")).alias("return_value"), F.coalesce("calledFrom", F.lit("")).alias("called_from"), "stack")


def read_api_calls(spark: SparkSession, root: str) -> DataFrame:
    """Both stage files of every app below ``root``."""
    return api_calls(text_lines(spark, f"{root}/*/permission-*.txt"))


def read_crypto_lines(spark: SparkSession, root: str) -> DataFrame:
    return parse_json_lines(text_lines(spark, f"{root}/*/crypt-*.txt"), "value", schemas.CRYPTO_LINE).filter(F.col(BAD).isNull())


def read_fs_events(spark: SparkSession, root: str) -> DataFrame:
    one = "`function` STRING, fd INT, path STRING, data STRING, ts STRING"
    return parse_json_lines(text_lines(spark, f"{root}/*/fs-*.txt"), "value", one).filter(F.col(BAD).isNull()).drop(BAD)


def read_reports(spark: SparkSession, root: str, pattern: str = "leak.json") -> DataFrame:
    """All reports below ``root``, files named by ``pattern``; unparsable files are skipped."""
    df = (spark.read.schema(f"{schemas.LEAK_REPORT}, {BAD} STRING").option("multiLine", True).option("recursiveFileLookup", True)
          .option("pathGlobFilter", pattern).json(root))
    folder = F.regexp_extract(F.col("_metadata.file_path"), r"/(?:package=)?([^/]+)/[^/]+$", 1)
    return df.withColumn("file", F.col("_metadata.file_path")).withColumn("package", F.coalesce("package", folder)).filter(F.col(BAD).isNull()).drop(BAD)


def report_records(reports: DataFrame) -> DataFrame:
    """Leak records of reports."""
    return reports.select("package", "file", F.explode("records").alias("r")).select("package", "file", "r.*")


def read_whole_files(spark: SparkSession, root: str) -> DataFrame:
    """Dumped files as (package, path, content)."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{root}/*/files-[12]")
    return df.select(F.regexp_extract("path", r"/([^/]+)/files-[12]/", 1).alias("package"), F.regexp_extract("path", r"(/files-[12]/.*)$", 1).alias("path"), "content")


# --- flows ----------------------------------------------------------------------------------------

def flow_rows(flows: DataFrame) -> DataFrame:
    """Request and response rows worth probing.

    ``flows``: package, flow_id, scheme, host, path, req_ts, res_ts (seconds), req_headers, res_headers, req_body,
    res_body, ws. Skip-listed hosts and script responses are dropped, bulky media bodies blanked.
    """
    ct = F.try_element_at("res_headers", F.lit("content-type"))
    f = flows.filter(~is_skipped_host("host") & ~is_static_script("path", ct))

    def stamp(c):
        return F.coalesce(F.date_format(F.timestamp_seconds(c), "yyyyMMddHHmmss"), F.lit(""))

    base = [F.col(c) for c in ("package", "flow_id", "scheme", "host", "path")]
    req = f.select(*base, F.lit("req").alias("side"), stamp("req_ts").alias("ts"), F.col("req_headers").alias("headers"), F.col("req_body").alias("body"), "ws")
    body = F.when(F.coalesce(keeps_response_body(ct, F.length("res_body")), F.lit(False)), F.col("res_body"))
    res = f.select(*base, F.lit("res").alias("side"), stamp("res_ts").alias("ts"), F.col("res_headers").alias("headers"), body.alias("body"),
                   F.lit(None).cast(f.schema["ws"].dataType).alias("ws"))
    return req.unionByName(res)


def flow_index(flows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Request and response index tables."""
    stamp = lambda c: F.date_format(F.timestamp_seconds(c), "yyyyMMddHHmmss").alias("timestamp")
    req = flows.select(F.col("package").alias("pkg"), "host", "path", "port", "scheme", "method", stamp("req_ts"))
    res = flows.filter("status_code is not null").select(F.col("package").alias("pkg"), "status_code", stamp("res_ts"))
    return req, res


# --- UI dumps -------------------------------------------------------------------------------------

def read_ui_events(spark: SparkSession, root: str) -> DataFrame:
    """Semantic dumps in folders named by a 14-digit time, with the time parsed."""
    df = read_lenient(spark, f"{root}/*/*/textual_semantics.json", schemas.UI_DUMP, multi_line=True)
    return ui_events(df.select("*", F.col("_metadata.file_path").alias("file")))


def ui_events(dumps: DataFrame) -> DataFrame:
    d = dumps.withColumn("dump_id", F.regexp_extract("file", r"/([0-9]{14})/", 1)).filter("dump_id <> ''")
    return d.select(F.regexp_extract("file", r"/([^/]+)/[0-9]{14}/", 1).alias("package"), "dump_id", parse_ts("dump_id").alias("ts"),
                    F.coalesce(F.nullif("op_widget_text", F.lit("")), "op_text", F.lit("")).alias("op_text"),
                    F.coalesce(F.nullif("op_widget_bounds", F.lit("")), "op_bounds", F.lit("")).alias("op_bounds"), "api_name_list", "action_type", "widget_class")


def read_gate_dumps(spark: SparkSession, root: str) -> DataFrame:
    """Consent-gate dumps: name, file, pre_click_apis."""
    df = read_lenient(spark, f"{root}/*/*_AGREE_0/textual_semantics.json", schemas.UI_DUMP, multi_line=True)
    f = F.col("_metadata.file_path")
    return df.select(F.regexp_extract(f, r"/([^/]+)/[^/]+/[^/]+$", 1).alias("name"), f.alias("file"), "pre_click_apis")


def time_ordered(df: DataFrame, ts: str = "ts", *ties: str) -> DataFrame:
    """Rows by time, missing times first. Meant for sinks; operators never rely on row order."""
    return df.orderBy(F.asc_nulls_first(ts), *ties)


# --- policy results -------------------------------------------------------------------------------

def policy_result_labels(items: DataFrame) -> DataFrame:
    """Distinct labels of a policy result, whatever file shape it came from; ``items``: package, label."""
    return items.select("package", F.explode("label").alias("label")).distinct()


def policy_documents(raw: DataFrame) -> DataFrame:
    """Items of result documents: rows of an array as they are, an object with ``keywords_found`` as its names and its entities."""
    other = [c for c in raw.columns if c not in ("keywords_found", "llm_entities", "text", "id", "label", "entities")]
    direct = raw.filter("keywords_found is null").select(*other, "text", "id", "label", "entities")
    whole = raw.filter("keywords_found is not null")
    names = whole.select(*other, F.lit(None).cast("string").alias("text"), F.lit(None).cast("array<int>").alias("id"), F.col("keywords_found").alias("label"),
                         F.lit(None).cast("array<struct<text:string,label:string>>").alias("entities"))
    inner = whole.select(*other, F.explode("llm_entities").alias("e")).select(*other, "e.*")
    return direct.unionByName(names).unionByName(inner.select(*other, "text", "id", "label", "entities"))


POLICY_OBJECT = "keywords_found ARRAY<STRING>, llm_entities ARRAY<STRUCT<text: STRING, id: ARRAY<INT>, label: ARRAY<STRING>, entities: ARRAY<STRUCT<text: STRING, label: STRING>>>>"


def read_policy_result(spark: SparkSession, path: str, package: str) -> DataFrame:
    """JSONL, JSON array or JSON object with ``keywords_found``."""
    if path.endswith(".jsonl"):
        items = read_strict(spark, path, schemas.PREDICTED_LINE)
    else:
        items = policy_documents(spark.read.schema(f"{schemas.PREDICTED_LINE}, {POLICY_OBJECT}").option("multiLine", True).json(path))
    return items.withColumn("package", F.lit(package))


def read_policy_results(spark: SparkSession, root: str, lines: bool) -> DataFrame:
    """Results of a fleet in one scan, ``root/package=…``: files of JSON lines, or files that hold one array or object each."""
    folder = F.regexp_extract("_metadata.file_path", r"/package=([^/]+)/[^/]+$", 1)
    if lines:
        return read_strict(spark, f"{root}/package=*", schemas.PREDICTED_LINE).select("text", "id", "label", "entities", folder.alias("package"))
    raw = spark.read.schema(f"{schemas.PREDICTED_LINE}, {POLICY_OBJECT}").option("multiLine", True).json(f"{root}/package=*")
    return policy_documents(raw.select("*", folder.alias("package")))


def behaviour_result(records: DataFrame, api_summary: DataFrame) -> DataFrame:
    """Reports with their optional API summary: package, report, api_summary."""
    return records.join(api_summary, "package", "left")


# --- dictionaries ---------------------------------------------------------------------------------

def taxonomy(text: DataFrame, col: str = "value") -> DataFrame:
    """``{parent: [child, …]}`` JSON to (ord, parent, child)."""
    m = text.select(F.from_json(col, "map<string,array<string>>").alias("m"))
    t = m.select(F.posexplode(F.map_entries("m")).alias("po", "e")).select("po", F.col("e.key").alias("parent"), F.posexplode("e.value").alias("co", "child"))
    return t.select(F.struct("po", "co").alias("ord"), "parent", "child")


def read_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    return taxonomy(spark.read.text(path, wholetext=True))


def single_parent(tx: DataFrame) -> DataFrame:
    """Last parent of every child."""
    return tx.groupBy("child").agg(F.max_by("parent", "ord").alias("parent"))


def field_categories(text: DataFrame, col: str = "value") -> DataFrame:
    """``_categories`` of a device description to (field, level1, level2)."""
    m = F.from_json(F.get_json_object(col, "$._categories"), "map<string,array<string>>")
    e = text.select(F.explode(m).alias("field", "levels")).filter(~F.col("field").startswith("_"))
    return e.select("field", F.try_element_at("levels", F.lit(1)).alias("level1"), F.try_element_at("levels", F.lit(2)).alias("level2"))


def sensitive_values(text: DataFrame, col: str = "value") -> DataFrame:
    """Device description to (package, field, value, is_keyword); ``_`` keys and nested objects are skipped."""
    m = text.select("package", F.explode(F.from_json(col, "map<string,string>")).alias("field", "raw"))
    m = m.filter(~F.col("field").startswith("_") & F.col("raw").isNotNull() & ~F.col("raw").startswith("{"))
    vals = F.when(F.col("raw").startswith("["), F.from_json("raw", "array<string>")).otherwise(F.array("raw"))
    return m.select("package", "field", F.explode(vals).alias("value"), F.col("field").endswith("-word").alias("is_keyword")).filter(~blank("value"))


def sdk_dictionary(entries: DataFrame) -> DataFrame:
    """Raw SDK entries with their list position to the SDK table; ``entries``: ord and the entry fields."""
    none = F.array().cast("array<string>")
    return entries.select("ord", F.coalesce("name", F.lit("")).alias("name"), F.coalesce("company", F.lit("")).alias("company"),
                          F.coalesce("category", F.lit("")).alias("category"), F.coalesce("packages", none).alias("packages"), F.coalesce("domains", none).alias("domains"))


def read_sdk_dictionary(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.text(path, wholetext=True)
    entry = "array<struct<name:string,company:string,category:string,packages:array<string>,domains:array<string>>>"
    return sdk_dictionary(text.select(F.posexplode(F.from_json("value", entry)).alias("ord", "e")).select("ord", "e.*"))


def monitored_apis(lines: DataFrame, col: str = "value") -> DataFrame:
    """``class,method|description`` lines."""
    head = F.split_part(col, F.lit("|"), F.lit(1))
    d = F.when(F.col(col).contains("|"), F.trim(F.regexp_replace(col, r"^[^|]*\|", "")))
    return lines.filter(head.rlike("^[^,]*,[^,]*$")).select(
        F.trim(F.split_part(head, F.lit(","), F.lit(1))).alias("class"), F.trim(F.split_part(head, F.lit(","), F.lit(2))).alias("method"), d.alias("description"))


def hook_list(configs: DataFrame) -> DataFrame:
    """Hook configurations (list or single object) to ``[Category] class.method()`` rows."""
    h = configs.select(*[c for c in configs.columns if c not in ("hooks", "Category", "HookType")], F.coalesce("Category", F.lit("Unknown")).alias("category"), F.explode("hooks").alias("h"))
    return h.withColumn("api", F.concat(F.lit("["), F.col("category"), F.lit("] "), F.col("h.clazz"), F.lit("."), F.col("h.method"), F.lit("()"))).drop("h")


def read_label_csv(spark: SparkSession, path: str) -> DataFrame:
    """``id,name`` CSV to the clause dimension; its row index is the model id. Small file, one partition."""
    df = spark.read.csv(path, header=True, schema="id STRING, name STRING").coalesce(1).withColumn("label_idx", F.monotonically_increasing_id().cast("int"))
    i = F.trim("id")
    parent = F.when(i.contains("."), F.regexp_replace(i, r"\.[^.]*$", ""))
    return df.select("label_idx", i.alias("id"), F.trim("name").alias("name"), parent.alias("parent_id"), F.size(F.split(i, r"\.")).alias("depth"))


# --- corpora --------------------------------------------------------------------------------------

def read_corpus(spark: SparkSession, path: str, split: str) -> DataFrame:
    """Labelled corpus, nested paragraphs or flat rows, JSON array or JSONL, to one row per sentence."""
    lines = spark.read.text(path).filter(F.ltrim("value") != "").select("_metadata.file_path", "_metadata.file_block_start", "value")
    first = lines.groupBy("file_path").agg(F.min_by("value", "file_block_start").alias("v"))
    shapes: dict[bool, list[str]] = {True: [], False: []}
    for r in first.select("file_path", F.ltrim("v").startswith("[").alias("array")).collect():  # a row per file, as in the reader's own listing
        shapes[r["array"]].append(r["file_path"])
    both = f"{schemas.PARAGRAPH}, sentence_text STRING, classification_labels ARRAY<STRING>, " \
           f"ground_truth_entities ARRAY<{schemas.ENTITY}>, predicted_entities ARRAY<{schemas.ENTITY}>"
    parts = [spark.read.schema(both).option("multiLine", multi).json(files) for multi, files in shapes.items() if files]
    df = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]) if parts else spark.createDataFrame([], both)
    nested = df.filter("sentences is not null").select("doc_id", F.posexplode("sentences").alias("sent_no", "s")).select(
        "doc_id", "sent_no", "s.sentence_text", "s.classification_labels", "s.entities", "s.predicted_entities")
    flat = df.filter("sentences is null").select(F.coalesce("doc_id", F.lit("default")).alias("doc_id"), F.monotonically_increasing_id().alias("sent_no"), "sentence_text",
                                                 "classification_labels", F.col("ground_truth_entities").alias("entities"), "predicted_entities")
    return nested.withColumn("sent_no", F.col("sent_no").cast("long")).unionByName(flat).withColumn("split", F.lit(split))


def host_from_url(c):
    """Host part of a URL."""
    return F.regexp_extract(c, r"^[a-zA-Z]+://([^/:?#]+)", 1)
