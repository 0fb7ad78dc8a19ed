"""Payload expansion: encoded variants of a value, container decoding and structured flattening."""

from __future__ import annotations

import bz2
import gzip
import io
import zipfile
import zlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from privaudit.functions.scalars import (_col, capitalize, leaf_is_plausible, may_be_base64, to_base64, url_quote_plus)

#: Levels below which leaves are marked; all levels are opened.
MAX_DEPTH = 8


def encoded_variants(value) -> Column:
    """Map from encoding name to the bytes a value would show in a payload under that encoding.

    Hex forms are zero-padded. The base64 form loses its last four characters so that it still matches
    when the value is embedded in a longer encoded text; it is left out when fewer than six remain.
    """
    v = _col(value)
    up, low, cap = F.upper(v), F.lower(v), capitalize(v)

    def text(c):
        return F.encode(c, "UTF-8")

    def hexed(c):
        return F.lower(F.hex(F.encode(c, "UTF-8")))

    b64 = to_base64(F.encode(v, "UTF-8"))
    trimmed = F.left(b64, F.length(b64) - 4)
    pairs = {
        "normal": text(v), "capitalize": text(cap), "upper": text(up), "lower": text(low),
        "hexCapitalize": text(hexed(cap)), "hexUpper": text(hexed(up)), "hexLower": text(hexed(low)),
        "UpperHexUpper": text(F.upper(hexed(up))), "UpperHexLower": text(F.upper(hexed(low))),
        "urlUpper": text(url_quote_plus(up)), "urlLower": text(url_quote_plus(low)),
        "base64": F.when(F.length(trimmed) >= 6, text(trimmed)),
        "md5hex": text(F.md5(v)), "sha1hex": text(F.sha1(v)), "sha256hex": text(F.sha2(v, 256)),
        "md5": F.unhex(F.md5(v)), "sha1": F.unhex(F.sha1(v)), "sha256": F.unhex(F.sha2(v, 256)),
    }
    return F.create_map(*[x for k, c in pairs.items() for x in (F.lit(k), c)])


def encoding_fanout(values: DataFrame, value="value", is_keyword="is_keyword") -> DataFrame:
    """One row per value and encoding; keywords keep their plain form only."""
    variants = F.when(_col(is_keyword), F.create_map(F.lit("normal"), F.encode(F.lower(_col(value)), "UTF-8"))) \
        .otherwise(encoded_variants(value))
    return (values.select("*", F.explode(variants).alias("encode_type", "encoded"))
            .filter("encoded is not null and length(encoded) > 0"))


# --- containers ---------------------------------------------------------------------------------

def _unpack(data: bytes) -> bytes:
    try:
        if data[:3] == b"\x1f\x8b\x08":
            return gzip.decompress(data)
        if data[:3] == b"BZh":
            return bz2.decompress(data)
        if data[:2] in (b"\x78\x01", b"\x78\x9c", b"\x78\xda"):
            return zlib.decompress(data)
        if data[:4] in (b"PK\x03\x04", b"PK\x07\x08"):
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                return b"".join(_unpack(z.read(n)) for n in z.namelist())
    except (OSError, EOFError, ValueError, zlib.error, zipfile.BadZipFile):
        return data
    return data


@F.pandas_udf(T.BinaryType())
def _unpack_batch(data: pd.Series) -> pd.Series:
    return data.map(lambda b: None if b is None else _unpack(b))


def is_container(data) -> Column:
    """Starts like gzip, bzip2, zlib or zip."""
    head = F.hex(F.substring(_col(data), 1, 4))
    return F.coalesce(head.rlike("^(1F8B08|425A68|7801|789C|78DA|504B0304|504B0708)"), F.lit(False))


#: Bytes of a container's content in one row; what is longer comes in pieces that overlap, so that no value is cut twice.
PIECE_BYTES, OVERLAP = 16 << 20, 1 << 12
_READ = 1 << 20
#: Content of containers in one Arrow batch, unless one piece is longer.
BATCH_BYTES = 4 << 20


def _inflated(data: bytes):
    """Chunks of a gzip, bzip2 or zlib stream; raises where it is broken or ends early."""
    make = bz2.BZ2Decompressor if data[:3] == b"BZh" else lambda: zlib.decompressobj(31 if data[:2] == b"\x1f\x8b" else 15)
    while data:
        d, at = make(), 0
        while not d.eof:
            part = data[at: at + _READ] if at < len(data) else b""
            at += len(part)
            if isinstance(d, bz2.BZ2Decompressor):
                got = d.decompress(part, _READ)
                stuck = not part and not got and not d.eof
            else:
                got = d.decompress(d.unconsumed_tail + part, _READ)
                stuck = not part and not got and not d.unconsumed_tail and not d.eof
            if stuck:
                raise EOFError("the stream ends early")
            yield got
        data = d.unused_data + data[at:]
        if data[:2] not in (b"\x1f\x8b", b"BZ"):
            return


def _pieces(chunks):
    held = bytearray()
    for c in chunks:
        held += c
        while len(held) > PIECE_BYTES:
            yield bytes(held[:PIECE_BYTES])
            del held[: PIECE_BYTES - OVERLAP]
    yield bytes(held)


def _members(data: bytes):
    """(path or None, piece) of all a container holds, in memory of one piece; what is broken yields itself."""
    try:
        if data[:2] == b"PK":
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                if sum(i.file_size for i in z.infolist()) <= PIECE_BYTES:  # read once, which checks them too
                    for name, held in [(n, z.read(n)) for n in z.namelist()]:
                        if not name.endswith("/"):
                            yield f"zip>{name}", held
                    return
                bad = z.testzip()
                if bad is not None:
                    raise zipfile.BadZipFile(bad)
                named = [(f"zip>{n}", lambda n=n: iter(lambda f=z.open(n): f.read(_READ), b"")) for n in z.namelist() if not n.endswith("/")]
                for name, chunks in named:
                    for i, piece in enumerate(_pieces(chunks())):
                        yield (name if i == 0 else f"{name}[part {i}]"), piece
            return
        held: bytearray | None = bytearray()  # all of it, as long as it fits one piece
        for c in _inflated(data):  # whole and sound?
            if held is not None:
                held = held + c if len(held) + len(c) <= PIECE_BYTES else None
        if held is not None:
            yield None, bytes(held)
            return
        for i, piece in enumerate(_pieces(_inflated(data))):
            yield (None if i == 0 else f"[part {i}]"), piece
    except (OSError, EOFError, ValueError, NotImplementedError, RuntimeError, zlib.error, zipfile.BadZipFile):
        yield None, data


def open_containers(df: DataFrame, key: str, payload: str = "payload") -> DataFrame:
    """Rows (key, member, payload): what containers hold, one row per member or piece; other payloads as they are."""
    held = F.coalesce((F.length(payload) > 4) & is_container(payload), F.lit(False))
    kind = df.schema[key].dataType

    def run(batches):
        for b in batches:
            found: list[tuple] = []
            size = 0

            def batch():
                keys, members, held = zip(*found)
                return pa.RecordBatch.from_arrays([pa.array(keys, type=b.schema.field(0).type), pa.array(members, type=pa.string()), pa.array(held, type=pa.binary())], names=[key, "member", "payload"])

            for k, data in zip(b.column(0), b.column(1)):
                for member, piece in _members(data.as_py()):
                    if found and size + len(piece) > BATCH_BYTES:
                        yield batch()
                        found, size = [], 0
                    found.append((k.as_py(), member, piece))
                    size += len(piece)
            if found:
                yield batch()

    rows = df.select(key, F.col(payload).alias("payload"))
    schema = T.StructType([T.StructField(key, kind), T.StructField("member", T.StringType()), T.StructField("payload", T.BinaryType())])
    return rows.where(~held).select(key, F.lit(None).cast("string").alias("member"), "payload").unionAll(rows.where(held).mapInArrow(run, schema))


def unwrap_payload(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Undo base64, percent-encoding and compression of a binary column once, in that order.

    Only rows that start like a container are shipped to Python.
    """
    d = decode_layers(df, payload).withColumn("_u", _unpack_batch(F.when((F.length(payload) > 4) & is_container(payload), F.col(payload))))
    return d.withColumn(payload, F.coalesce("_u", payload)).drop("_u")


def decode_layers(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Undo base64 and then percent-encoding of a binary column once."""
    long = F.length(payload) > 4
    d = df.withColumn("_t", F.when(long, F.try_validate_utf8(F.col(payload).cast("string"))))
    d = d.withColumn("_p", F.when(may_be_base64("_t"), F.unbase64("_t")).otherwise(F.col(payload)))
    d = d.withColumn("_t", F.when(long, F.try_validate_utf8(F.col("_p").cast("string"))))
    escaped = (F.regexp_count("_t", F.lit("%[0-7][0-9a-fA-F]")) > 5) & ~F.col("_t").rlike(r"[^\x00-\x7f]")
    # '+' is literal in percent-encoded paths, so it is protected before the form decoder sees it
    decoded = F.try_url_decode(F.replace("_t", F.lit("+"), F.lit("%2B")))
    d = d.withColumn("_p", F.when(escaped, F.coalesce(F.encode(decoded, "UTF-8"), F.col("_p"))).otherwise(F.col("_p")))
    return d.withColumn(payload, F.col("_p")).drop("_t", "_p")


# --- structured payloads --------------------------------------------------------------------------

def _json_nodes(path: str, text: Column) -> Column:
    return F.array(F.struct(F.lit(path).alias("p"), text.alias("s")))


def _expanded(nodes: str) -> str:
    """All levels down: objects by key, arrays by position, until no node holds structure; nodes get their level.

    A loop inside the row: open nodes are parsed once each, the others are set aside, and a round without open nodes costs
    nothing. A chain of n levels needs n brackets, literal or escaped, in the text, so their count bounds the rounds.
    """
    opens = "(ltrim({0}) like '{{%' or ltrim({0}) like '[%')"
    child = "named_struct('p', {p}, 's', {s}, 'level', n.level + 1, 'open', coalesce(" + opens.format("{s}") .replace("{%", "{{%") + ", false))"
    closed = "array(named_struct('p', n.p, 's', n.s, 'level', n.level, 'open', false))"
    down = f"""flatten(transform(a.open, n -> case when ltrim(n.s) like '{{%' then coalesce(
            transform(map_entries(from_json(n.s, 'map<string,string>')), e -> {child.format(p="concat(n.p, '>', e.key)", s="e.value")}), {closed})
          else coalesce(
            transform(from_json(n.s, 'array<string>'), (y, k) -> {child.format(p="concat(n.p, '[', cast(k as string), ']')", s="y")}), {closed}) end))"""
    start = f"transform({nodes}, n -> named_struct('p', n.p, 's', n.s, 'level', 0, 'open', coalesce({opens.format('n.s')}, false)))"
    split = "named_struct('open', filter({0}, n -> n.open), 'done', {1})"
    rounds = f"aggregate({nodes}, 0, (m, n) -> m + coalesce(regexp_count(n.s, '[\\\\[{{]|u00[57][bB]'), 0))"
    first = f"transform(array({start}), s -> {split.format('s', 'filter(s, n -> not n.open)')})[0]"
    step = f"transform(array({down}), d -> {split.format('d', 'concat(a.done, filter(d, n -> not n.open))')})[0]"
    loop = f"aggregate(sequence(0, {rounds}), {first}, (a, i) -> case when size(a.open) = 0 then a else {step} end, a -> concat(a.done, a.open))"
    return f"case when {nodes} is not null then {loop} end"


def _query_nodes(text: Column) -> Column:
    """``a=1&b=2&a=3`` as ``U>a[0]``, ``U>b[0]``, ``U>a[1]``; pairs without a value are dropped."""
    pairs = F.filter(F.split(text, "&"), lambda x: x.rlike("^[^=]*=.+"))

    def key(x):
        return F.coalesce(F.try_url_decode(F.split_part(x, F.lit("="), F.lit(1))), F.split_part(x, F.lit("="), F.lit(1)))

    def val(x):
        v = F.regexp_replace(x, "^[^=]*=", "")
        return F.coalesce(F.try_url_decode(v), v)

    def node(x, i):
        seen = F.size(F.filter(F.slice(pairs, F.lit(1), i), lambda y: key(y) == key(x)))
        return F.struct(F.concat(F.lit("U>"), key(x), F.lit("["), seen.cast("string"), F.lit("]")).alias("p"),
                        val(x).alias("s"))

    return F.transform(pairs, node)


def flatten_payload(df: DataFrame, payload="payload", meta="meta", depth: int = MAX_DEPTH) -> DataFrame:
    """Leaves of JSON, XML and query-string payloads.

    Adds ``leaf_path`` (prefixed by ``meta@`` when there is one), ``leaf`` and ``too_deep``; a payload with no
    structure yields itself, and a query string yields itself as well as its pairs. JSON inside a JSON string is
    opened too. Every level is opened, in a loop inside the row; ``too_deep`` only marks leaves that lie more than ``depth``
    levels down, and text that starts like structure and is none.
    """
    out = df.withColumn("_text", F.try_validate_utf8(_col(payload).cast("string")))
    text, trimmed = F.col("_text"), F.trim("_text")
    looks_xml = trimmed.rlike(r"^(<\?xml[^>]*\?>\s*)?<[A-Za-z_][\w:.-]*[\s/>]") & trimmed.endswith(">")
    looks_json = trimmed.startswith("{") & trimmed.endswith("}") & F.from_json(trimmed, "map<string,string>").isNotNull()
    root = F.regexp_extract(F.regexp_replace(trimmed, r"^<\?xml[^>]*\?>\s*", ""), r"^<([A-Za-z_][\w:.-]*)", 1)
    # inside a lambda, since generated code of from_xml to a variant does not compile
    parsed = F.transform(F.when(looks_xml, F.array(trimmed)), lambda x: F.to_json(F.from_xml(x, "variant", {"attributePrefix": "@", "valueTag": "#text", "mode": "PERMISSIVE"})))
    out = out.withColumn("_json", parsed[0])
    out = out.withColumn("_kind", F.when(looks_json, "J").when(F.col("_json").isNotNull(), "X").when(text.rlike("^[^&=]*=[^&]") & ~F.coalesce(looks_xml, F.lit(False)), "U").otherwise("-"))
    out = out.withColumn("_nodes", F.when(F.col("_kind") == "J", _json_nodes("J", trimmed)).when(F.col("_kind") == "U", _query_nodes(text))
                         .when(F.col("_kind") == "X", F.array(F.struct(F.concat(F.lit("X>"), root).alias("p"), F.col("_json").alias("s")))))
    whole = F.array(F.struct(F.lit(None).cast("string").alias("p"), text.alias("s"), F.lit(0).alias("level"), F.lit(False).alias("open")))
    nodes = F.when(F.col("_kind").isin("J", "X"), F.col("_opened")).when(F.col("_kind") == "U", F.concat(whole, F.col("_opened"))).otherwise(whole)
    out = out.withColumn("_opened", F.expr(_expanded("_nodes")))
    tag = F.when(_col(meta).isNotNull() & F.col("_n.p").isNotNull(), F.concat(_col(meta), F.lit("@"), F.lower("_n.p"))) \
        .otherwise(F.coalesce(F.lower("_n.p"), _col(meta)))
    return (out.withColumn("_n", F.explode(nodes)).filter("_n.s is not null")
            .withColumn("leaf_path", tag).withColumn("leaf", F.col("_n.s"))
            .withColumn("too_deep", F.col("_n.p").isNotNull() & ((F.col("_n.level") > depth) | F.col("_n.s").rlike(r"^\s*[\[{]")))
            .drop("_text", "_kind", "_json", "_nodes", "_opened", "_n"))


def payload_leaves(df: DataFrame, payload="payload", meta="meta") -> DataFrame:
    """Plausible leaves of a payload column."""
    return flatten_payload(df, payload, meta).filter(leaf_is_plausible("leaf"))


def probe_rows(flows: DataFrame) -> DataFrame:
    """Flow rows to probe rows: one per header, websocket frame and body."""
    base = [c for c in ("package", "flow_id", "side", "scheme", "host", "path", "ts") if c in flows.columns]
    out = F.when(F.col("side") == "req", ">").otherwise("<")
    headers = (flows.select(*base, F.explode("headers").alias("_k", "_v"))
               .select(*base, out.alias("direction"), F.lit("headers").alias("target"),
                       F.concat(F.lit("H->"), F.lower("_k")).alias("meta"), F.encode("_v", "UTF-8").alias("payload")))
    # a single frame is a handshake, not a conversation
    frames = (flows.filter(F.size("ws") > 1).select(*base, F.explode("ws").alias("_w"))
              .filter(F.length("_w.data") >= 1)
              .select(*base, F.col("_w.dir").alias("direction"), F.lit("ws").alias("target"),
                      F.lit("W->").alias("meta"), F.col("_w.data").alias("payload")))
    bodies = (flows.filter(F.col("body").isNotNull())
              .select(*base, out.alias("direction"), F.lit("body").alias("target"),
                      F.lit(None).cast("string").alias("meta"), F.col("body").alias("payload")))
    return headers.unionByName(frames).unionByName(bodies)
