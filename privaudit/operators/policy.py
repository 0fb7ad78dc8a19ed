"""Policy pages to text, sentences, entities and data items."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from privaudit import dictionaries as D
from privaudit import schemas
from privaudit.functions.scalars import _col, any_of, blank, let, lookup
from privaudit.operators.joins import first_match, nearest, substring_pairs

# --- HTML -----------------------------------------------------------------------------------------

SKIPPED_TAGS = ["script", "style", "title", "head"]


def strip(c) -> Column:
    """Trim any white space, not only blanks."""
    return F.regexp_replace(_col(c), r"^\s+|\s+$", "")


def clean_entities(c) -> Column:
    return reduce(lambda acc, kv: F.replace(acc, F.lit(kv[0]), F.lit(kv[1])), D.TEXT_REPLACEMENTS, _col(c))


def html_text(c) -> Column:
    """Visible text of a page: one line per block element, table cells separated by tabs.

    Comments and head-like elements are dropped. The patterns use no lookaround or back-references.
    """
    s = _col(c)
    body = F.regexp_extract(s, r"(?is)<body[^>]*>(.*)</body>", 1)
    s = F.when(body != "", body).otherwise(s)
    s = F.regexp_replace(s, r"(?s)<!--.*?-->", "")
    for tag in SKIPPED_TAGS:
        s = F.regexp_replace(s, rf"(?is)<{tag}(\s[^>]*)?>.*?</{tag}\s*>", "")
    s = F.replace(s, F.lit("\t"), F.lit(" "))
    s = F.regexp_replace(s, r"(?i)</t[dh]\s*>", "\t")
    s = F.regexp_replace(s, r"(?i)</(p|h[1-6]|li|tr)\s*>", "\n")
    s = F.regexp_replace(s, r"<[^>]+>", "")
    for raw, new in D.TEXT_REPLACEMENTS[:-1]:
        s = F.replace(s, F.lit(raw), F.lit(new))
    s = F.regexp_replace(s, r"[ \t]*\n\s*", "\n")
    return strip(s)


def html_emphasis(c) -> Column:
    """Texts of bold elements, in page order."""
    found = F.regexp_extract_all(_col(c), F.lit(r"(?is)<(?:b|strong)(?:\s[^>]*)?>(.*?)</(?:b|strong)\s*>"), F.lit(1))
    return F.filter(F.transform(found, lambda x: strip(F.regexp_replace(x, r"<[^>]+>", ""))), lambda x: x != "")


def html_tables(c) -> Column:
    """Tables as arrays of rows of cells; a header row made of ``th`` cells stays where it stands."""
    tables = F.regexp_extract_all(_col(c), F.lit(r"(?is)<table(?:\s[^>]*)?>(.*?)</table\s*>"), F.lit(1))

    def cells(row):
        raw = F.regexp_extract_all(row, F.lit(r"(?is)<t[dh](?:\s[^>]*)?>(.*?)</t[dh]\s*>"), F.lit(1))
        return F.transform(raw, lambda x: strip(F.regexp_replace(x, r"<[^>]+>", "")))

    def rows(tbl):
        raw = F.regexp_extract_all(tbl, F.lit(r"(?is)<tr(?:\s[^>]*)?>(.*?)</tr\s*>"), F.lit(1))
        return F.filter(F.transform(raw, cells), lambda r: F.size(r) > 0)

    return F.transform(tables, rows)


def fallback_text(c) -> Column:
    """Quoted strings of at least 12 characters that contain CJK characters, for pages rendered by scripts."""
    quoted = F.regexp_extract_all(_col(c), F.lit("[\"']([^\"']{12,})[\"']"), F.lit(1))
    cleaned = F.transform(quoted, lambda x: strip(F.regexp_replace(F.regexp_replace(clean_entities(x), r"\\[nrt]", "\n"), r"<[^>]+>", "")))
    return F.array_join(F.filter(cleaned, lambda x: x.rlike("[一-鿿]")), "\n")


def page_text(c) -> Column:
    main = html_text(c)
    return F.when(main != "", main).otherwise(fallback_text(c))


# --- sentences ------------------------------------------------------------------------------------

def clean_line(c) -> Column:
    s = F.regexp_replace(_col(c), r"<[^>]+>", "")
    s = F.regexp_replace(s, "【[^】]+】", "")
    return strip(F.regexp_replace(s, " +", " "))


def merge_marker_lines(lines: Column) -> Column:
    """Put a bare number or list marker in front of the line it belongs to.

    The next line must not be a marker itself, so every line depends on its neighbours only.
    """
    def marker(x):
        return x.rlike(D.MARKER_LINE)

    def plain(x):
        return (x != "") & ~marker(x)

    def one(x, i):
        nxt = F.get(lines, i + 1)
        prev = F.get(lines, i - 1)
        joins = marker(x) & F.coalesce(plain(nxt), F.lit(False))
        consumed = plain(x) & F.coalesce(marker(prev), F.lit(False))
        return F.when(consumed, F.lit(None)).when(joins, F.concat(x, F.lit(" "), nxt)).otherwise(x)

    return F.array_compact(F.transform(lines, one))


def split_long(lines: Column, limit: int = D.MAX_SENTENCE_CHARS) -> Column:
    """Lines above ``limit`` characters become units ending in 。；！？; a longer unit becomes several of at most ``limit``."""
    def units(x):
        parts = F.split(F.regexp_replace(x, "([。；！？])", "$1\u0001"), "\u0001")

        def unit(p):
            mark = F.regexp_extract(p, "([。；！？])$", 1)
            content = strip(F.regexp_replace(p, "[。；！？]$", ""))
            return F.when(content != "", F.concat(content, mark)).otherwise("")

        kept = F.filter(F.transform(parts, unit), lambda u: u != "")
        pieces = F.transform(kept, lambda u: F.transform(F.regexp_extract_all(u, F.lit(f"(?s).{{1,{limit}}}"), F.lit(0)), strip))
        return F.filter(F.flatten(pieces), lambda u: u != "")

    return F.flatten(F.transform(lines, lambda x: F.when(F.length(x) <= limit, F.array(x)).otherwise(units(x))))


def sentence_array(text) -> Column:
    lines = F.transform(F.split(_col(text), "\n"), clean_line)
    merged = let(lines, merge_marker_lines)
    return F.filter(split_long(F.filter(merged, lambda x: x != "")), lambda x: x != "")


def sentences(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``(doc_id, sent_no, text)`` of whole documents; no shuffle, a document is one row."""
    return docs.select(doc_id, F.posexplode(sentence_array(text)).alias("sent_no", "text"))


def keeps_sentence(c) -> Column:
    """Bare markers up to five characters, lines with tabs (table rows) and blanks are not classified."""
    s = strip(c)
    return ~((s.rlike(D.BARE_MARKER) & (F.length(s) <= 5)) | s.contains("\t") | (s == ""))


# --- classification -------------------------------------------------------------------------------

def score_sentences(df: DataFrame, scorer: Callable[[list[str]], list[list[float]]], text: str = "text", batch: int = 64) -> DataFrame:
    """Add a ``scores`` array with a user-supplied model; it is called with up to ``batch`` texts at a time."""
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema.fields)}, scores array<double>"

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            texts = pdf[text].tolist()
            got: list[list[float]] = []
            for i in range(0, len(texts), batch):
                got.extend(scorer(texts[i:i + batch]))
            yield pdf.assign(scores=got)

    return df.mapInPandas(run, schema)


def labels_from_scores(df: DataFrame, label_index: DataFrame, scores: str = "scores") -> DataFrame:
    """Labels at or above their threshold; ``label_index``: new_idx, label_idx, name, threshold."""
    long = df.select("*", F.posexplode(scores).alias("new_idx", "score")).drop(scores)
    return long.join(label_index, "new_idx").filter(F.col("score") >= F.col("threshold"))


def label_index(labels: DataFrame, removed: list[int], default_threshold: float = D.DEFAULT_THRESHOLD) -> DataFrame:
    """Dense re-index of the retained labels. A fixed dimension, so one ordered partition is fine."""
    kept = labels.filter(~F.col("label_idx").isin(*removed)) if removed else labels
    return kept.withColumn("new_idx", F.row_number().over(W.orderBy("label_idx")) - 1) \
        .withColumn("threshold", F.lit(default_threshold))


def clause_labels(spark) -> DataFrame:
    """The clause dimension: label_idx, id, name, parent_id, depth, code."""
    code = dict((i, c) for c, i in D.CLAUSE_CODES)
    rows = [(n, i, name, i.rpartition(".")[0] or None, i.count(".") + 1, code.get(i)) for n, (i, name) in enumerate(D.CLAUSE_LABELS)]
    return spark.createDataFrame(rows, "label_idx int, id string, name string, parent_id string, depth int, code string")


# --- extraction requests and responses --------------------------------------------------------------

def needs_extraction(label_ids, labels, skip_ids=D.SKIP_LABEL_IDS, skip_words=D.SKIP_LABEL_WORDS) -> Column:
    """Sentences without an excluded label id or label word."""
    ids = F.coalesce(_col(label_ids), F.array().cast("array<int>"))
    names = F.coalesce(_col(labels), F.array().cast("array<string>"))
    by_word = F.exists(names, lambda x: F.lower(x).rlike(any_of([w.lower() for w in skip_words])))
    return ~F.arrays_overlap(ids, F.array(*[F.lit(i) for i in skip_ids])) & ~by_word


def entities_to_act(entities) -> Column:
    """Flat entities to one act: first verb, controller, purpose, condition and receiver, and all data items."""
    e = _col(entities)

    def first(*labels):
        hit = F.filter(e, lambda x: F.lower(x["label"]).isin(*labels) & (x["text"] != ""))
        return F.try_element_at(hit, F.lit(1))

    act = first(*D.ACTION_LABELS)
    return F.struct(
        act["text"].alias("action_verb"), F.initcap(act["label"]).alias("action_type"),
        first("controller")["text"].alias("controller"),
        F.transform(F.filter(e, lambda x: F.lower(x["label"]) == "data"), lambda x: x["text"]).alias("data_collected_or_shared"),
        first("purpose")["text"].alias("purpose"), first("condition")["text"].alias("condition"),
        first("receiver")["text"].alias("receiver"))


def extraction_requests(sents: DataFrame, instruction: str, examples: DataFrame | None = None) -> DataFrame:
    """Request table for an external extraction model: one prompt per sentence that needs one.

    ``sents``: doc_id, sent_no, text, label_ids, labels; ``examples``: doc_id, sent_no, examples (array of
    text and entities, best first), usually from :func:`adaptive_examples`.
    """
    req = sents.filter(needs_extraction("label_ids", "labels"))
    context = F.when(F.size("labels") > 0, F.array_join("labels", ",")).otherwise("未标注")
    if examples is None:
        shown = F.lit("")
    else:
        req = req.join(examples, ["doc_id", "sent_no"], "left")
        shown = F.coalesce(F.array_join(F.transform("examples", lambda x, i: F.concat_ws(
            "\n", F.concat(F.lit("# "), (i + 1).cast("string")), x["text"], F.to_json(entities_to_act(x["entities"])))), "\n"), F.lit(""))
    prompt = F.concat_ws("\n", F.lit(instruction), F.concat(F.lit("label: "), context), shown, F.col("text"))
    return req.select("doc_id", "sent_no", "text", context.alias("label_context"), prompt.alias("prompt"))


def response_entities(response, other_as_default: bool = False) -> Column:
    """Model response to typed entities: the outermost ``{…}`` block, acts in order; bad JSON gives none."""
    block = F.regexp_extract(_col(response), r"(?s)\{.*\}", 0)
    acts = F.from_json(F.nullif(block, F.lit("")), schemas.PROCESSING_ACTS)["processing_acts"]

    def entity(text, label):
        return F.struct(text.alias("text"), label.alias("label"))

    def one(a):
        kind = F.lower(a["action_type"])
        if other_as_default:
            kind = F.when(kind.isin("collection", "sharing"), kind).when(kind != "", F.lit("other"))
        else:
            kind = F.when(kind.isin(*D.ACTION_LABELS), kind)
        data = F.transform(F.coalesce(a["data_collected_or_shared"], F.array().cast("array<string>")), lambda d: entity(d, F.lit("data")))
        fixed = F.array(entity(a["controller"], F.lit("controller")), entity(a["action_verb"], kind),
                        *[entity(a[n], F.lit(n)) for n in ("purpose", "condition", "receiver")])
        return F.concat(fixed, data)

    flat = F.flatten(F.transform(acts, one))
    empty = F.array().cast("array<struct<text:string,label:string>>")
    return F.coalesce(F.filter(flat, lambda x: x["label"].isNotNull() & (x["text"] != "")), empty)


def attach_responses(sents: DataFrame, responses: DataFrame) -> DataFrame:
    """All sentences with their predicted entities; sentences that were not asked get an empty list."""
    empty = F.array().cast("array<struct<text:string,label:string>>")
    return sents.join(responses.select("doc_id", "sent_no", "predicted_entities"), ["doc_id", "sent_no"], "left") \
        .withColumn("predicted_entities", F.coalesce("predicted_entities", empty))


def response_mismatches(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Per document: requests without a response and responses nobody asked for."""
    a = requests.select("doc_id", "sent_no", F.lit(True).alias("asked"))
    b = responses.select("doc_id", "sent_no", F.lit(True).alias("answered"))
    return a.join(b, ["doc_id", "sent_no"], "full").groupBy("doc_id").agg(
        F.count_if(F.col("answered").isNull()).alias("missing"), F.count_if(F.col("asked").isNull()).alias("unexpected"))


# --- example retrieval ----------------------------------------------------------------------------

def knowledge_base(paragraphs: DataFrame) -> DataFrame:
    """Sentences that carry an ``output`` field, flagged positive when it is not empty."""
    s = paragraphs.select("doc_id", F.posexplode("sentences").alias("sent_no", "s")).filter("s.output is not null")
    return s.select("doc_id", "sent_no", F.col("s.sentence_text").alias("text"), F.col("s.entities").alias("entities"),
                    (F.col("s.output") != "").alias("is_positive"))


def adaptive_examples(queries: DataFrame, positives: DataFrame, negatives: DataFrame, high: float = D.EXAMPLE_HIGH,
                      low: float = D.EXAMPLE_LOW, n_pos: int = D.EXAMPLE_POSITIVES, n_neg: int = D.EXAMPLE_NEGATIVES,
                      same_id_excluded: bool = False) -> DataFrame:
    """Examples per query: the surer the best positive match, the more positives and the fewer negatives."""
    base = positives.select("match_id", "vec", F.lit(True).alias("is_positive")).unionByName(negatives.select("match_id", "vec", F.lit(False).alias("is_positive")))
    near = nearest(queries.filter("query_id is not null"), base, max(n_pos, n_neg), same_id_excluded=same_id_excluded, kind="is_positive")
    best = F.max(F.when(F.col("is_positive") & (F.col("rank") == 1), F.col("sim"))).over(W.partitionBy("query_id"))
    want_pos = F.when(F.col("best") > high, n_pos).when(F.col("best") > low, n_pos - 1).otherwise(1)
    want_neg = F.when(F.col("best") > high, 0).otherwise(n_neg)
    return near.withColumn("best", best).filter("best is not null").filter(F.col("rank") <= F.when(F.col("is_positive"), want_pos).otherwise(want_neg)) \
        .select("query_id", "match_id", "sim", "rank", "is_positive")


# --- data items -----------------------------------------------------------------------------------

def declaration_terms(spark, taxonomy: DataFrame) -> DataFrame:
    """Phrases that name a standard item, in matching order: fixed variants first, then taxonomy entries."""
    order: dict[str, tuple[int, str]] = {}
    for std, variants in D.DECLARATION_VARIANTS.items():
        for v in variants:
            for key in (v.lower(), v):
                order[key] = (order[key][0] if key in order else len(order), std)
    fixed = spark.createDataFrame([(o, k, s) for k, (o, s) in order.items()], "ord int, key string, standard string")
    tx = taxonomy.select((F.col("ord") + len(order)).alias("ord"), F.explode(F.array_distinct(F.array(F.lower("child"), "child"))).alias("key"),
                         F.col("child").alias("standard"))
    both = fixed.withColumn("src", F.lit(0)).unionByName(tx.withColumn("src", F.lit(1)))
    # a taxonomy entry takes over the meaning of a phrase but keeps its place in the order
    return both.groupBy("key").agg(F.min("ord").alias("ord"), F.max_by("standard", F.struct("src", "ord")).alias("standard"))


def normalize_declarations(texts: DataFrame, col: str, terms: DataFrame) -> DataFrame:
    """Standard item per distinct phrase: exact, then first term that contains it or is contained in it, else itself."""
    t = texts.select(col).filter(~blank(col)).distinct().withColumn("_low", strip(F.lower(col)))
    m = terms.select("ord", "key", "standard")
    by_low = m.select(F.col("key").alias("_low"), F.col("standard").alias("_s1"))
    by_raw = m.select(F.col("key").alias(col), F.col("standard").alias("_s2"))
    e = t.join(by_low, "_low", "left").join(by_raw, col, "left")
    rest = e.filter("_s1 is null and _s2 is null")
    near = first_match(substring_pairs(rest, "_low", m, "key", both_ways=True).join(m, "key"), ["_low"], ["standard"], ["ord"])
    return e.join(near, "_low", "left").select(col, F.coalesce("_s1", "_s2", "standard", col).alias("standard_name"))


def normalize_item(c) -> Column:
    """Item name without filler words and blanks."""
    s = strip(F.lower(_col(c)))
    s = reduce(lambda acc, w: F.replace(acc, F.lit(w), F.lit("")), D.ITEM_STOPWORDS, s)
    return F.regexp_replace(s, r"\s+", "")


def item_candidates(c) -> Column:
    """Parts of an item phrase that name something specific, with synonyms resolved."""
    parts = F.filter(F.transform(F.split(strip(c), "[，,、/;；|]+"), strip), lambda p: p != "")
    kept = F.filter(parts, lambda p: ~p.isin(*D.GENERIC_ITEM_TERMS) & ~F.lower(p).isin(*D.INVALID_ITEM_TERMS))
    return F.transform(kept, lambda p: F.coalesce(lookup(D.ITEM_SYNONYMS, p), p))


def classify_items(items: DataFrame, col: str, taxonomy: DataFrame, min_score: int = D.ITEM_MATCH_SCORE) -> DataFrame:
    """Category per distinct item: category name, exact or substring match, then edit similarity.

    ``taxonomy``: ord, standard, category. The similarity tier compares only names that share a character
    pair, on what the earlier tiers left over.
    """
    d = items.select(col).distinct()
    cand = d.select(col, F.posexplode(item_candidates(col)).alias("pos", "cand")).withColumn("norm", normalize_item("cand"))
    tx = taxonomy.select("ord", "category", normalize_item("standard").alias("std")).filter("std <> ''")
    cats = tx.select(F.col("category").alias("cand"), F.col("category").alias("c0")).distinct()
    tier0 = cand.join(cats, "cand").groupBy(col).agg(F.min_by("c0", "pos").alias("c0"))
    left = cand.join(tier0, col, "left_anti").filter("norm <> ''")
    hit = substring_pairs(left, "norm", tx, "std", both_ways=True).join(tx, "std")
    tier1 = first_match(left.join(hit, "norm"), [col], ["category"], ["pos", "ord"]).withColumnRenamed("category", "c1")
    rest = left.join(tier1, col, "left_anti")

    def pairs_of(c):
        n = F.length(c)
        return F.array_distinct(F.when(n < 2, F.array(F.col(c))).otherwise(
            F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substr(F.col(c), i, F.lit(2)))))

    near = (rest.select(col, "pos", "norm", F.explode(pairs_of("norm")).alias("bg"))
            .join(tx.select("ord", "std", "category", F.explode(pairs_of("std")).alias("bg")), "bg")
            .select(col, "pos", "norm", "ord", "std", "category").distinct()
            .withColumn("score", 100 * (1 - F.levenshtein("norm", "std") / F.greatest(F.length("norm"), F.length("std"))))
            .filter(F.col("score") >= min_score))
    tier2 = first_match(near.withColumn("_s", -F.col("score")), [col], ["category"], ["_s", "pos", "ord"]).withColumnRenamed("category", "c2")
    return (d.join(tier0, col, "left").join(tier1, col, "left").join(tier2, col, "left")
            .select(col, F.coalesce("c0", "c1", "c2", F.lit(D.UNCLASSIFIED_ITEM)).alias("category")))


def act_table(sents: DataFrame, item_category: DataFrame) -> DataFrame:
    """Per sentence with entities: action, categories, items and purpose.

    ``item_category``: item, category for every data item.
    """
    e = F.col("entities")

    def first_of(labels):
        return F.try_element_at(F.filter(e, lambda x: x["label"].isin(*labels)), F.lit(1))

    base = sents.filter(F.size("entities") > 0).select(
        "doc_id", "sent_no", F.coalesce(lookup(D.ACTION_NAMES, first_of(D.ACTION_LABELS)["label"]), F.lit("其他")).alias("action"),
        F.transform(F.filter(e, lambda x: x["label"] == "data"), lambda x: x["text"]).alias("_data"),
        F.coalesce(first_of(["purpose", "condition"])["text"], F.lit("-")).alias("purpose"))
    shown = F.filter("_data", lambda t: (t != "") & ~strip(t).isin(*D.GENERIC_ITEM_TERMS) & ~F.lower(strip(t)).isin("n/a", "na"))
    base = base.withColumn("items", F.when(F.size(shown) > 0, F.array_join(shown, "，")).otherwise("-"))
    subs = base.select("doc_id", "sent_no", F.explode("_data").alias("raw")).select(
        "doc_id", "sent_no", F.explode(F.split("raw", "[，、；;,]")).alias("item")).withColumn("item", strip("item")).filter("item <> ''")
    cats = (subs.join(item_category, "item").filter(F.col("category") != D.UNCLASSIFIED_ITEM)
            .groupBy("doc_id", "sent_no").agg(F.array_join(F.array_sort(F.collect_set("category")), "，").alias("_c")))
    return base.join(cats, ["doc_id", "sent_no"], "left").select(
        "doc_id", "sent_no", "action", F.coalesce("_c", F.lit(D.UNCLASSIFIED_ITEM)).alias("categories"), "items", "purpose")


# --- corpora --------------------------------------------------------------------------------------

def flatten_paragraphs(paragraphs: DataFrame) -> DataFrame:
    """Nested corpus to one row per sentence."""
    s = paragraphs.select("doc_id", F.posexplode("sentences").alias("sent_no", "s"))
    return s.select("doc_id", "sent_no", "s.sentence_text", "s.classification_labels", "s.entities", "s.predicted_entities")


def regroup_sentences(rows: DataFrame) -> DataFrame:
    """One row per sentence back to documents; a document is the unit of the corpus, so its size is bounded."""
    s = F.struct("sent_no", "sentence_text", "entities", "predicted_entities", "classification_labels")
    return rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("sent_no", s.alias("s")))).alias("_s")) \
        .select("doc_id", F.transform("_s", lambda x: x["s"]).alias("sentences"))


def entity_display(entities) -> Column:
    """``【text|label】`` list."""
    kept = F.filter(_col(entities), lambda x: (strip(x["text"]) != "") & (strip(x["label"]) != ""))
    return F.array_join(F.transform(kept, lambda x: F.concat(F.lit("【"), strip(x["text"]), F.lit("|"), F.lower(strip(x["label"])), F.lit("】"))), ", ")


def sentences_with_output(paragraphs: DataFrame) -> DataFrame:
    """Paragraphs with only the sentences whose ``output`` is not blank."""
    return paragraphs.withColumn("sentences", F.filter("sentences", lambda s: ~blank(s["output"])))
