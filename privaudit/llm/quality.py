"""Quality rules by weak supervision: rules vote good or bad or abstain, expectation-maximisation estimates how each rule
votes on good and on bad documents, and the posterior probability of good decides instead of "all rules must pass".

Votes are compressed before anything is gathered: documents are counted per pattern of votes, of which there are at most
3 ** rules, so the estimate sees all documents and the driver a table of bounded size.

Null and empty texts have no words and fail the base rule of length; a null id is carried along; repeated rows give
repeated rows; an empty table gives an empty result. Other columns of the input are ignored by ``judge`` and kept by
``keep_good``. Texts of any length are measured whole.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from privaudit.llm.tables import keyed, released, rows_and_texts, written

#: Characters that count as symbols, and common short words of the four languages.
SYMBOLS = "#*$%&|<>"
COMMON = [w.encode() for w in (
    "the of and to in a is that it for on was be with as by this at from are "
    "le la les de des du et un une que qui en dans pour par sur est au "
    "der die das und ist von zu den mit ein eine nicht sich auf für dem "
    "el los las del y se por con para una no al lo").split()]
#: A rule: name, when it votes bad, when it votes good; else it abstains.
RULES = [
    ("length", "n_words < 20", "n_words >= 60"),
    ("word_length", "word_chars > 12 * n_words or word_chars < 2 * n_words", "word_chars between 3 * n_words and 9 * n_words"),
    ("symbols", "10 * n_symbols > n_words", "50 * n_symbols < n_words"),
    ("marked", "10 * n_marked > n_words", "50 * n_marked < n_words"),
    ("lines", "10 * n_dup_lines > 3 * n_lines", "n_lines >= 3 and n_dup_lines = 0"),
    ("repeats", "5 * n_repeat_words > n_words", "n_words >= 60 and n_repeat_words = 0"),
    ("capitals", "n_upper > n_lower", "n_upper + n_lower >= 40 and 5 * n_upper < n_lower"),
    ("shouting", "5 * n_exclaims > n_words", "n_words >= 20 and 50 * n_exclaims < n_words"),
    ("prose", "n_words >= 40 and 50 * n_common < n_words", "20 * n_common >= n_words"),
]
#: Posterior from which a document is good.
THRESHOLD = 0.5
#: Largest share of good documents that a rule may hold bad.
FALSE_ALARMS = 0.01
WINDOW = 8

SPACE = b" \t\n\r\x0b\x0c"
UPPER, LOWER = bytes(range(65, 91)), bytes(range(97, 123))
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower", "n_exclaims", "n_common", "n_marked")
MARKED = re.compile(r"[#*$%&|<>=+~^_/\\](?=[\t-\r ]|\Z)").findall
HAS_WORD = re.compile(r"[^\t-\r ]").search


def repeat_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words in runs of ``window`` words that are found twice or more, the first occurrence included."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    with np.errstate(over="ignore"):
        h, step, power = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15), 1, np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        while step < window:
            h = h[: len(h) - step] * power + h[step:]
            power, step = power * power, step * 2
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    if not same.any():
        return 0
    pairs = np.flatnonzero(same)
    runs = np.lib.stride_tricks.sliding_window_view(ids, window)
    twice = np.zeros(n, dtype=bool)
    for k in range(0, len(pairs), 1 << 15):
        a, b = order[pairs[k: k + (1 << 15)]], order[pairs[k: k + (1 << 15)] + 1]
        equal = (runs[a] == runs[b]).all(axis=1)
        twice[a[equal]] = twice[b[equal]] = True
    edge = np.zeros(len(ids) + 1, dtype=np.int64)
    at = np.flatnonzero(twice)
    edge[at] += 1
    edge[at + window] -= 1
    return int((np.cumsum(edge[:-1]) > 0).sum())


def measure(text: str | None) -> tuple:
    """The features of one text, in the order of FEATURES."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()  # of bytes: splits at ASCII white space only
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], dtype=np.int64)
    count = np.bincount(ids, minlength=1)
    lines, known, doubles, filled = text.split("\n"), set(), 0, 0
    for line in lines:
        if HAS_WORD(line):
            filled += 1
            if line in known:
                doubles += 1
            else:
                known.add(line)
    return (len(words), len(text) - sum(map(data.count, (bytes([c]) for c in SPACE))), sum(map(text.count, SYMBOLS)), doubles, repeat_words(ids), filled,
            len(data) - len(data.translate(None, UPPER)), len(data) - len(data.translate(None, LOWER)), text.count("!"), sum(int(count[seen[w]]) for w in COMMON if w in seen),
            len(MARKED(text)))


def _table(texts: list) -> list[pa.Array]:
    rows = np.array([measure(t) for t in texts], dtype=np.int64).reshape(-1, len(FEATURES))
    return [pa.array(rows[:, i]) for i in range(len(FEATURES))]


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, one long per feature)."""
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), *_table(b.column(1).to_pylist())], names=["doc_id", *FEATURES])

    return keyed(docs, id_col, text_col).mapInArrow(run, "doc_id long, " + ", ".join(f"{f} long" for f in FEATURES))


def pattern(rules=RULES) -> Column:
    """One character per rule: b, g or - for abstaining."""
    return F.concat(*(F.when(F.expr(bad), "b").when(F.expr(good), "g").otherwise("-") for _, bad, good in rules))


def estimate(counts: dict[str, int], n_rules: int, rounds: int = 200, prior: float = 0.8, false_alarms: float = FALSE_ALARMS) -> tuple[dict[str, float], np.ndarray, float]:
    """Posterior of good per pattern, P(bad vote | class, no abstaining) as an array (rule, class bad or good), and P(good).

    Votes are independent given the class, and abstaining says nothing. A rule may fire on at most ``false_alarms`` of
    the good documents it judges, which tells the two classes apart; the rest is estimated. Pseudo counts of the start's
    shape, a thousandth of the documents, keep a rule that hardly votes from running off.
    """
    names = sorted(counts)
    if not names:
        return {}, np.zeros((n_rules, 2)), prior
    n = np.array([counts[p] for p in names], dtype=float)
    bad, cast = np.array([[c == "b" for c in p] for p in names], dtype=float), np.array([[c != "-" for c in p] for p in names], dtype=float)
    fire = np.repeat([[0.4, false_alarms]], n_rules, axis=0)
    weight, good, start = 1 + 0.001 * n.sum(), prior, fire
    for _ in range(rounds):
        log = bad @ np.log(fire) + (cast - bad) @ np.log(1 - fire) + np.log([1 - good, good])
        post = np.exp(log - log.max(axis=1, keepdims=True))
        post /= post.sum(axis=1, keepdims=True)
        mass = post * n[:, None]
        fresh = (bad.T @ mass + weight * start) / (cast.T @ mass + weight)
        fresh[:, 1] = np.minimum(fresh[:, 1], false_alarms)
        fresh[:, 0] = np.clip(fresh[:, 0], 2 * false_alarms, 0.99)
        now = (mass[:, 1].sum() + weight * prior) / (n.sum() + weight)
        moved = abs(fresh - fire).max() + abs(now - good)
        fire, good = fresh, now
        if moved < 1e-9:
            break
    return dict(zip(names, post[:, 1].tolist())), fire, float(good)


def judge(docs: DataFrame, rules=RULES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, the features, votes, posterior, base_failed and kept."""
    votes = written(features(docs, id_col, text_col).withColumn("votes", pattern(rules)), "quality")
    out = _judged(votes, _posterior(votes, rules), threshold)
    return out.select("doc_id", *FEATURES, "votes", "posterior", "base_failed", "kept")


def _posterior(votes: DataFrame, rules) -> DataFrame:
    """Rows (votes, posterior); at most 3 ** rules."""
    counts = {r["votes"]: r["count"] for r in votes.groupBy("votes").count().collect()}  # at most 3 ** rules rows
    posterior, _, _ = estimate(counts, len(rules))
    return votes.sparkSession.createDataFrame(sorted(posterior.items()), "votes string, posterior double")


def _judged(votes: DataFrame, posterior: DataFrame, threshold: float) -> DataFrame:
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return votes.join(F.broadcast(posterior), "votes").withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))


def keep_good(docs: DataFrame, rules=RULES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that ``judge`` rejects; all columns stay, whatever their names. The verdict follows from the
    row itself, so one scan counts the votes and a second one judges each row where it is: no text is shuffled."""
    votes = features(docs, id_col, text_col).select(pattern(rules).alias("votes"))
    posterior = _posterior(votes, rules)
    rows = docs.select(F.struct("*").alias("row"))

    def run(batches):
        for row, texts in rows_and_texts(batches, text_col):
            yield pa.RecordBatch.from_arrays([row, *_table(texts)], names=["row", *FEATURES])

    schema = T.StructType([rows.schema["row"], *(T.StructField(f, T.LongType()) for f in FEATURES)])
    measured = rows.mapInArrow(released(run), schema).withColumn("votes", pattern(rules))
    return _judged(measured, posterior, threshold).where("kept").select("row.*")
