"""Scalar expressions. Each takes and returns a Column and stays inside the JVM."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from privaudit import dictionaries as D


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def regex_escape(text: str) -> str:
    """Escape for both Java and RE2 patterns."""
    return "".join("\\" + ch if ch in r"\.+*?()|[]{}^$" else ch for ch in text)


def any_of(terms) -> str:
    """Alternation of literal terms."""
    return "|".join(regex_escape(t) for t in terms)


def let(value, fn) -> Column:
    """``fn`` applied to a value that is computed once per row, however often ``fn`` mentions it."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def blank(c) -> Column:
    c = _col(c)
    return c.isNull() | (F.trim(c) == "")


# --- time -------------------------------------------------------------------------------------

def parse_ts(c) -> Column:
    """``yyyyMMddHHmmss`` to timestamp, NULL when malformed."""
    c = _col(c)
    return F.when(c.rlike("^[0-9]{14}$"), F.try_to_timestamp(c, F.lit("yyyyMMddHHmmss")))


def format_ts(c) -> Column:
    """Timestamp to ``yyyyMMddHHmmss``, empty string for NULL."""
    return F.coalesce(F.date_format(_col(c), "yyyyMMddHHmmss"), F.lit(""))


# --- hosts ------------------------------------------------------------------------------------

def is_real_host(c) -> Column:
    """True for a network name, false for file paths and API markers."""
    c = F.coalesce(_col(c), F.lit(""))
    local = c.rlike(any_of(D.LOCAL_HOST_MARKERS))
    return (c != "") & ~local & (c.contains(".") | (c == "localhost"))


def is_internal_host(host, package) -> Column:
    """Local address, or a host that carries the app's own name."""
    host, package = F.coalesce(_col(host), F.lit("")), F.coalesce(_col(package), F.lit(""))
    parts = F.split(package, r"\.")
    own = (F.size(parts) >= 3) & (
        host.contains(F.try_element_at(parts, F.lit(-2))) | host.contains(package)
    )
    local = host.rlike("^(" + any_of(D.INTERNAL_HOST_PREFIXES) + ")")
    known = ~host.isin("", *D.PLACEHOLDER_HOSTS)
    return known & (local | F.coalesce(own, F.lit(False)))


def is_skipped_host(c) -> Column:
    """Host ends with one of the suffixes that carry no app evidence."""
    return F.coalesce(_col(c).rlike("(" + any_of(D.SKIPPED_HOST_SUFFIXES) + ")$"), F.lit(False))


def is_static_script(path, content_type) -> Column:
    return F.coalesce(_col(path).endswith(".js") & (_col(content_type) == "text/javascript"), F.lit(False))


def is_media(path, content_type) -> Column:
    """Media or archive response, by content type or by path suffix."""
    by_type = F.lower(F.coalesce(_col(content_type), F.lit(""))).rlike(any_of(D.MEDIA_TYPES))
    by_path = F.lower(F.coalesce(_col(path), F.lit(""))).rlike("(" + any_of(D.MEDIA_SUFFIXES) + ")$")
    return by_type | by_path


def keeps_response_body(content_type, n_bytes) -> Column:
    """A response body is probed when its type is known and it is not a large media file."""
    ct = _col(content_type)
    return ct.isNotNull() & ~(ct.isin(*D.BULKY_RESPONSE_TYPES) & (_col(n_bytes) > 4 * 1024))


def strip_media_body(body, path, content_type) -> Column:
    return F.when(is_media(path, content_type), F.lit(D.STRIPPED_BODY).cast("binary")).otherwise(_col(body))


# --- encodings --------------------------------------------------------------------------------

def b64url_to_bytes(c) -> Column:
    """Decode base64url text with missing padding; NULL when it is not base64."""
    t = F.translate(F.trim(_col(c)), "-_", "+/")
    padded = F.concat(t, F.repeat(F.lit("="), F.pmod(-F.length(t), F.lit(4)).cast("int")))
    return F.when(t != "", F.try_to_binary(padded, F.lit("base64")))


def to_base64(c) -> Column:
    """Base64 on one line; Spark breaks long output into 76-character lines."""
    return F.translate(F.base64(_col(c)), "\r\n", "")


def char_entropy(c) -> Column:
    """Shannon entropy of a string in bits per character.

    The characters are sorted, so that equal ones are neighbours: an entry that differs from the one before it starts a
    run, and the run's length is the distance to the next start. The work is that of one sort, however many different
    characters a text has.
    """
    s = _col(c)
    n = F.length(s).cast("double")
    return let(F.array_sort(F.filter(F.split(s, ""), lambda ch: ch != "")), lambda chars: let(
        F.filter(F.sequence(F.lit(1), F.size(chars) + 1), lambda i: (i == 1) | (i > F.size(chars)) | (F.get(chars, i - 1) != F.get(chars, i - 2))),
        lambda starts: F.aggregate(F.sequence(F.lit(1), F.size(starts) - 1), F.lit(0.0), lambda acc, k: acc - ((F.get(starts, k) - F.get(starts, k - 1)) / n) * F.log2((F.get(starts, k) - F.get(starts, k - 1)) / n))))


def may_be_base64(c) -> Column:
    """Round-trips as base64, is padded as base64, is not plain hex and has text-like entropy."""
    s = F.rtrim(_col(c))
    body = F.rtrim(s, F.lit("="))
    padded_ok = F.when(s.endswith("="), F.length(body) % 4 != 0).otherwise(F.length(s) % 4 == 0)
    shape = s.rlike("^[A-Za-z0-9+/]+={0,2}$") & (F.length(s) > 6) & padded_ok
    hexish = s.rlike("^[0-9a-fA-F]+$")
    round_trip = to_base64(F.try_to_binary(s, F.lit("base64"))) == s
    # wrapped in an array so that the entropy is computed once
    texty = F.exists(F.array(char_entropy(s)), lambda ent: (ent > 4.1) & (ent < 6.0))
    checked = F.when(shape & ~hexish, round_trip & texty)
    return F.coalesce(checked, F.lit(False))


def signed_bytes_to_binary(c) -> Column:
    """``-28,67,-96`` to bytes; text that is not such a list becomes its UTF-8 bytes."""
    s = F.trim(_col(c))
    nums = F.filter(F.split(s, ","), lambda x: F.trim(x) != "")
    as_bytes = F.unhex(F.array_join(
        F.transform(nums, lambda x: F.lpad(F.hex(F.pmod(F.trim(x).try_cast("bigint"), F.lit(256))), 2, "0")), ""))
    listed = s.rlike(r"^\s*-?[0-9]+(\s*,\s*-?[0-9]+)*\s*,?\s*$") & s.contains(",")
    return F.when(listed, as_bytes).otherwise(F.encode(s, "UTF-8"))


def decode_double_base64(c) -> Column:
    """Base64 text that may hold a signed-byte list; undecodable text is returned as bytes."""
    s = F.trim(_col(c))
    once = F.try_to_binary(s, F.lit("base64"))
    text = F.try_validate_utf8(once.cast("string"))
    listed = text.rlike(r"^\s*-?[0-9]+(\s*,\s*-?[0-9]+)+\s*$")
    return (F.when(once.isNull(), F.encode(s, "UTF-8"))
            .when(F.coalesce(listed, F.lit(False)), signed_bytes_to_binary(text))
            .otherwise(once))


def url_quote_plus(c) -> Column:
    """Form encoding with ``+`` for blanks, ``~`` left alone and ``*`` escaped."""
    return F.replace(F.replace(F.url_encode(_col(c)), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def capitalize(c) -> Column:
    c = _col(c)
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substr(c, F.lit(2))))


def has_printable_run(c, n: int = 33) -> Column:
    """Some ``n``-byte chunk is all printable ASCII, or the data ends with four zero bytes."""
    text = F.decode(_col(c), "ISO-8859-1")
    p = r"[\x20-\x7e\t\n\r\x0b\x0c]"
    run = text.rlike(rf"^(?:[\s\S]{{{n}}})*?(?:{p}{{{n}}}|{p}{{1,{n - 1}}}\z)")
    return F.coalesce(run | text.endswith("\x00\x00\x00\x00"), F.lit(False))


def printable_ratio(c) -> Column:
    """Share of printable characters."""
    s = _col(c)
    return F.when(F.length(s) > 0, F.length(F.regexp_replace(s, r"[^\P{Cntrl}\n\r\t]", "")) / F.length(s))


# --- text -------------------------------------------------------------------------------------

def shorten(c, limit: int | None) -> Column:
    """Cut to ``limit`` characters, the last three being dots; whole without a limit."""
    c = F.coalesce(_col(c), F.lit(""))
    if limit is None:
        return c
    return F.when(F.length(c) > limit, F.concat(F.left(c, F.lit(max(0, limit - 3))), F.lit("..."))).otherwise(c)


def leaf_is_plausible(c) -> Column:
    """Drop values too short or too common to identify anybody."""
    s = F.coalesce(_col(c), F.lit(""))
    small_int = s.rlike("^[0-9]{1,4}$") | s.rlike("^0+[0-9]{1,4}$")
    small_fraction = s.rlike(r"^-*0*\.[0-9]+$") | s.rlike(r"^-*0+\.[0-9]*$")
    return ~((F.length(s) <= 3) | small_int | small_fraction | s.isin("true", "false", "null", "none"))


def standard_field(c) -> Column:
    """Field name without its ``-word``/``-token`` suffix, mapped to the policy vocabulary."""
    field = F.trim(F.coalesce(_col(c), F.lit("")))
    base = F.lower(F.regexp_replace(field, r"(?i)-(word|token)$", ""))
    return F.coalesce(lookup(D.FIELD_ALIASES, base), field)


def literal(x) -> str:
    """SQL literal of a fixed value."""
    if x is None or isinstance(x, (bool, int, float)):
        return "null" if x is None else str(x).lower()
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def lookup(mapping: dict, key) -> Column:
    """Value of a fixed dictionary; it travels inside the expression, so no join is planned."""
    pairs = ", ".join(f"{literal(k)}, {literal(v)}" for k, v in mapping.items())
    return F.try_element_at(F.expr(f"map({pairs})"), _col(key))


def flatten_declared(c) -> Column:
    """Non-blank entries of a list of declared values."""
    return F.filter(F.coalesce(_col(c), F.array().cast("array<string>")), lambda x: ~blank(x))


def stack_classes(c) -> Column:
    """Class names of a Java stack trace, top frame first."""
    return F.regexp_extract_all(_col(c), F.lit(r"at\s+([\w.$]+)\."), F.lit(1))


def caller_class(c) -> Column:
    """``com.x.Y.m(File:1)`` to ``com.x.Y``."""
    head = F.trim(F.split_part(_col(c), F.lit("("), F.lit(1)))
    cut = F.regexp_replace(head, r"\.[^.]*$", "")
    return F.when(head.contains(".") & ~head.endswith("."), cut).otherwise(head)


def keeps_api_call(method, return_value, args) -> Column:
    """Calls with nothing in and nothing out are kept only for methods that must be recorded."""
    empty_ret = F.coalesce(_col(return_value), F.lit("")).isin("null", "[]", "{}", "")
    empty_args = F.coalesce(F.size(_col(args)), F.lit(0)) <= 0
    return F.coalesce(_col(method).isin(*D.MUST_RECORD_METHODS), F.lit(False)) | ~(empty_ret & empty_args)


def permission_level(c) -> Column:
    return F.when(_col(c).rlike(any_of(D.DANGEROUS_PERMISSION_WORDS)), "dangerous").otherwise("normal")


def activity_name(act, package=None) -> Column:
    """Fully qualified activity name from ``pkg/.Act``, ``pkg/full.Act`` or ``.Act``."""
    a = F.trim(_col(act))
    pkg = F.split_part(a, F.lit("/"), F.lit(1))
    rest = F.regexp_replace(a, "^[^/]*/", "")
    expr = (F.when(blank(a), F.lit(None).cast("string"))
            .when(a.contains("/"), F.when(rest.startswith("."), F.concat(pkg, rest)).otherwise(rest)))
    if package is not None:
        expr = expr.when(a.startswith("."), F.concat(F.coalesce(_col(package), F.lit("")), a))
    return expr.otherwise(a)


def is_noise_package(package, target=None, keywords=D.NOISE_PACKAGE_WORDS) -> Column:
    p = F.lower(F.trim(F.coalesce(_col(package), F.lit(""))))
    noise = (p == "") | (p == "keyb") | p.rlike(any_of(keywords))
    if target is None:
        return noise
    return noise & ~((p != "") & F.coalesce(p == F.lower(_col(target)), F.lit(False)))


def activity_candidates(c) -> Column:
    """First ``package/activity`` pair of every line of a text dump, as qualified names."""
    found = F.transform(F.split(_col(c), r"\r?\n"), lambda ln: F.regexp_extract(ln, D.ACTIVITY_PATTERN, 0))
    return F.transform(F.filter(found, lambda x: x != ""), activity_name)


def split_camel(c) -> Column:
    """``getActiveHTTPInfo`` to its words."""
    s = F.regexp_replace(_col(c), "([a-z])([A-Z])", "$1 $2")
    return F.split(F.regexp_replace(s, "([A-Z])([A-Z][a-z])", "$1 $2"), " ")


def combined_score(*scores) -> Column:
    """Scores below 0.6 count as zero; the rest are summed in falling order with weights 0.7, 0.49, …"""
    kept = F.array(*[F.when(_col(s) < 0.6, F.lit(0.0)).otherwise(_col(s)) for s in scores])
    ranked = F.sort_array(kept, asc=False)
    return F.aggregate(F.transform(ranked, lambda s, i: s * F.pow(F.lit(0.7), i + 1)),
                       F.lit(0.0), lambda acc, x: acc + x)


def histogram_distance(a, b) -> Column:
    """Wasserstein distance between two equally long samples."""
    diffs = F.zip_with(F.array_sort(_col(a)), F.array_sort(_col(b)), lambda x, y: F.abs(x - y))
    return F.aggregate(diffs, F.lit(0.0), lambda acc, x: acc + x) / F.size(_col(a))


def safe_filename(c) -> Column:
    return F.trim(F.regexp_replace(_col(c), r'[\\/:*?"<>|]', "_"))


def any_contains(c, terms) -> Column:
    """Column contains one of a few fixed terms."""
    return reduce(or_, [_col(c).contains(t) for t in terms])


# --- compact leak strings -----------------------------------------------------------------------

def leak_to_string(field, value, encode_type, meta, outbound, host, websocket=None, limit: int | None = None) -> Column:
    """``field%value[enc]*meta>host`` as printed in leak listings, where ``limit`` may shorten the value."""
    parts = [
        _col(field), F.lit("%"), shorten(value, limit),
        F.when(_col(encode_type) != "normal", F.concat(F.lit("["), _col(encode_type), F.lit("]"))).otherwise(""),
        F.when(_col(meta).isNotNull(), F.concat(F.lit("*"), _col(meta))).otherwise(""),
        F.when(_col(outbound), ">").otherwise("<"), _col(host),
    ]
    if websocket is not None:
        parts.append(F.when(_col(websocket), "/ws").otherwise(""))
    return F.concat(*parts)


def parse_leak_string(c) -> Column:
    """Struct with the parts of a compact leak string; values stay whole."""
    s = _col(c)
    head = F.regexp_extract(s, "^([^><]*)", 1)
    field = (F.when(head.contains("|"), F.split_part(s, F.lit("|"), F.lit(1)))
             .when(s.contains("%"), F.split_part(s, F.lit("%"), F.lit(1))).otherwise(""))
    rest = F.when(head.contains("|"), F.regexp_replace(s, r"^[^|]*\|", "")) \
        .when(s.contains("%"), F.regexp_replace(s, "^[^%]*%", "")).otherwise(s)
    mark = F.regexp_extract(rest, r"^[^\[]*\[([^\]]*)\]", 1)
    crypt_mark = mark.contains(":")
    at_mark = rest.contains("@")
    out = rest.contains(">")
    host = F.when(out, F.regexp_extract(rest, "([^>]*)$", 1)) \
        .when(rest.contains("<"), F.regexp_extract(rest, "([^<]*)$", 1)).otherwise("")
    return F.struct(
        field.alias("privacy_type"),
        F.when(s.contains("%"), F.regexp_extract(s, r"^[^%]*%([^\[*@><]*)", 1)).otherwise("").alias("value"),
        F.when((mark != "") & ~crypt_mark, mark).otherwise("normal").alias("encode_type"),
        at_mark.alias("encrypted"),
        (crypt_mark | at_mark).alias("is_crypt"),
        F.when(~out & rest.contains("<"), "inbound").otherwise("outbound").alias("direction"),
        F.trim(F.replace(host, F.lit("/ws"), F.lit(""))).alias("host"),
        F.regexp_extract(rest, r"^[^*]*\*([^@><]*)", 1).alias("meta"),
    )
