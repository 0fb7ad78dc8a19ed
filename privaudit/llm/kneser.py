"""Quality classifier: an interpolated modified Kneser-Ney n-gram model of characters, trained on trusted text; joins against
the sharded counts give every document's perplexity, and quantiles of each language decide.

Half of the trusted documents (by the hash of their id) train the model; the other half, which it has not seen, gives the
thresholds: a document is kept if its perplexity is at most ``slack`` times the given quantile of the held-out trusted
documents of its language.

Texts are dealt over blocks of a few megabytes, compressed. A block asks for each of its distinct n-grams once, however
often its documents use it; the requests of all blocks meet the counts in plain joins by n-gram, order by order, and the
answers return to the block, which adds them up per document. An n-gram is one row per block at most, so a very frequent
one is no hot key. The tables grow with the corpus and nothing of them is collected but the counts of counts.

Null and empty texts have only the end to predict; a null language is a language of its own; null ids are never trusted;
repeated rows give repeated rows; of several labels of an id any untrusted one makes it untrusted. A language without
held-out trusted text takes the threshold of all languages; where there is no trusted text at all everything is kept. Empty
tables give empty results; other columns are ignored. Whole texts are scored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from privaudit.llm.tables import bytes_of, written

ORDER = 4
BLOCK_BYTES = 4 << 20
#: Noncharacters of Unicode that stand for what precedes a text and for its end.
START, STOP = "﷐", "﷑"
#: Characters packed at once.
PIECE = 1 << 20


DOCUMENTS = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("text", pa.string())])


def pack():
    """Arrow batches of (doc_id, lang, text) to rows (block, body): the documents of one block, compressed together."""
    def run(batches):
        press = zstandard.ZstdCompressor(level=6)
        for b in batches:
            block = b.column(3).to_numpy()
            order = np.argsort(block, kind="stable")
            cuts = np.flatnonzero(np.diff(block[order], prepend=-1)).tolist() + [len(order)]
            ids, bodies = [], []
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, DOCUMENTS) as w:
                    w.write_batch(pa.RecordBatch.from_arrays([b.column(i).take(pa.array(order[lo:hi])) for i in range(3)], names=["doc_id", "lang", "text"]))
                ids.append(int(block[order[lo]]))
                bodies.append(press.compress(sink.getvalue()))
            yield pa.RecordBatch.from_arrays([pa.array(ids, type=pa.int32()), pa.array(bodies, type=pa.binary())], names=["block", "body"])

    return run


def unpack(rows: pa.Table) -> pa.Table:
    """The documents of a block; none where only its labels or answers are given."""
    undo = zstandard.ZstdDecompressor()
    tables = [pa.ipc.open_stream(undo.decompress(b.as_py())).read_all() for b in rows.column("body")]
    return pa.concat_tables([DOCUMENTS.empty_table(), *tables])


def pieces(texts: list[str | None], order: int, size: int):
    """Lists of (text number, characters) of about ``size`` characters; a part of a text starts with the order - 1 before it."""
    held, total = [], 0
    for k, text in enumerate(texts):
        text = START * (order - 1) + (text or "").replace("\0", "\ufffd") + STOP
        for at in range(0, len(text) - order + 1, size):
            held.append((k, text[at: at + size + order - 1]))
            total += len(held[-1][1])
            if total >= size:
                yield held
                held, total = [], 0
    if held:
        yield held


def grams(texts: list[str | None], order: int, size: int = PIECE):
    """Yield (distinct n-grams as strings, number of the n-gram at each place, text of each place) for pieces of the texts.

    A text has one n-gram per character and one for its end.
    """
    for held in pieces(texts, order, size):
        points = np.frombuffer("".join([t for _, t in held]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        used, code = np.unique(points, return_inverse=True)
        bits = np.uint64(max(1, int(len(used) - 1).bit_length()))
        if int(bits) * order > 64:
            yield from ((s, n, np.array([k for k, _ in held])[w]) for s, n, w in _again([t for _, t in held], order))
            continue
        lengths = np.array([len(t) for _, t in held])
        text = np.repeat(np.array([k for k, _ in held]), lengths)
        inside = np.arange(len(points)) + order <= np.repeat(np.cumsum(lengths), lengths)
        n = len(points) - order + 1
        key = np.zeros(n, dtype=np.uint64)
        for i in range(order):
            key = (key << bits) | code[i: i + n].astype(np.uint64)
        inside = inside[:n]
        distinct, number = np.unique(key[inside], return_inverse=True)
        chars = np.stack([(distinct >> (bits * np.uint64(order - 1 - i))) & ((np.uint64(1) << bits) - np.uint64(1)) for i in range(order)], axis=1).astype(np.int64)
        yield np.ascontiguousarray(used[chars]).view(f"<U{order}").reshape(-1), number, text[:n][inside]


def _again(parts: list[str], order: int):
    """n-grams of parts whose alphabet is too large to pack: as strings, one part at a time."""
    for k, t in enumerate(parts):
        distinct, number = np.unique(np.array([t[i: i + order] for i in range(len(t) - order + 1)]), return_inverse=True)
        yield distinct, number, np.full(len(number), k)


def _count(order: int):
    """Per block: its distinct n-grams with their number in training texts."""
    def run(key, rows, labels):
        docs = unpack(rows)
        trained = set(labels.column("doc_id").to_pylist())
        flags = np.array([i in trained for i in docs.column("doc_id").to_pylist()], dtype=bool)
        total: dict[str, int] = {}
        for strings, number, text in grams(docs.column("text").to_pylist(), order):
            n = np.bincount(number, weights=flags[text], minlength=len(strings)).astype(np.int64)
            for g, c in zip(strings.tolist(), n.tolist()):
                total[g] = total.get(g, 0) + c
        return pa.table({"block": pa.array([key[0].as_py()] * len(total), type=pa.int32()), "gram": pa.array(total.keys(), type=pa.string()), "n": pa.array(total.values(), type=pa.int64())})

    return run


def _score(order: int):
    """Per block: the summed log probabilities of its documents."""
    def run(rows, answers):
        docs = unpack(rows)
        log = dict(zip(answers.column("gram").to_pylist(), answers.column("logp").to_pylist()))
        total, places = np.zeros(docs.num_rows), np.zeros(docs.num_rows, dtype=np.int64)
        for strings, number, text in grams(docs.column("text").to_pylist(), order):
            value = np.array([log[g] for g in strings.tolist()])
            total += np.bincount(text, weights=value[number], minlength=docs.num_rows)
            places += np.bincount(text, minlength=docs.num_rows)
        return pa.table({"doc_id": docs.column("doc_id"), "lang": docs.column("lang"), "n_chars": places - 1, "logp": total})

    return run


def discounts(counts: list[int]) -> list[float]:
    """D1, D2 and D3+ from the numbers of n-grams that occur once, twice, three and four times."""
    n1, n2, n3, n4 = counts
    y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    raw = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return [min(max(d, 0.1), i + 0.9) for i, d in enumerate(raw)]


def _off(c: str, d: list[float]) -> Column:
    return F.when(F.col(c) <= 0, 0.0).when(F.col(c) == 1, d[0]).when(F.col(c) == 2, d[1]).otherwise(d[2])


def probabilities(counted: DataFrame, order: int) -> DataFrame:
    """Rows (gram, logp) for all n-grams of ``counted`` (gram, c; c = 0: not in the training text).

    Interpolated modified Kneser-Ney: the highest order has counts, lower ones the number of different characters that
    precede; each order takes off its own three discounts and gives them to the next lower one, the last to a uniform
    distribution over the characters and one unknown.
    """
    levels = {order: counted}
    for k in range(order - 1, 0, -1):
        levels[k] = written(levels[k + 1].groupBy(F.substring("gram", 2, k).alias("gram")).agg(F.sum((F.col("c") > 0).cast("long")).alias("c")), f"kneser-{k}")
    scored = None
    for k in range(1, order + 1):
        table = levels[k]
        found = table.agg(*(F.coalesce(F.sum((F.col("c") == i).cast("long")), F.lit(0)).alias(f"n{i}") for i in range(1, 5)), F.sum((F.col("c") > 0).cast("long")).alias("types"),
                          F.coalesce(F.sum("c"), F.lit(0)).alias("total")).first()
        d = discounts([found[f"n{i}"] for i in range(1, 5)])
        if k == 1:
            total = found["total"]
            rest = table.agg(F.sum(_off("c", d)).alias("x")).first()["x"] / total if total else 1.0
            p = F.greatest(F.col("c") - _off("c", d), F.lit(0.0)) / max(total, 1) + rest / ((found["types"] or 0) + 1)
            scored = table.select("gram", p.alias("p"))
            continue
        history = F.substring("gram", 1, k - 1)
        contexts = table.groupBy(history.alias("history")).agg(F.sum("c").alias("s"), F.sum(_off("c", d)).alias("off"))
        lower = scored.select(F.col("gram").alias("suffix"), F.col("p").alias("p_lower"))
        seen = F.col("s") > 0
        p = F.when(seen, F.greatest(F.col("c") - _off("c", d), F.lit(0.0)) / F.col("s")).otherwise(0.0) + F.when(seen, F.col("off") / F.col("s")).otherwise(1.0) * F.col("p_lower")
        scored = (table.withColumn("history", history).withColumn("suffix", F.substring("gram", 2, k - 1)).join(contexts, "history").join(lower, "suffix").select("gram", p.alias("p")))
    return scored.select("gram", F.log("p").alias("logp"))


def perplexities(docs: DataFrame, trusted: DataFrame, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Rows (doc_id, lang, n_chars, logp, perplexity) under the model of the ``trusted`` documents (column doc_id)."""
    frame = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    blocks = max(1, -(-bytes_of(frame) // BLOCK_BYTES))
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int").alias("block")
    ids = trusted.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct().select("doc_id", block("doc_id"))
    packets = (frame.select("doc_id", "lang", "text", F.when(F.col("doc_id").isNull(), block("text")).otherwise(block("doc_id")).alias("block"))
               .mapInArrow(pack(), "block int, body binary"))
    requests = written(packets.groupBy("block").cogroup(ids.groupBy("block")).applyInArrow(_count(order), "block int, gram string, n long"), "kneser-requests")
    counted = written(requests.groupBy("gram").agg(F.sum("n").alias("c")), "kneser-counts")
    answers = requests.select("block", "gram").join(probabilities(counted, order), "gram")
    out = packets.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_score(order), "doc_id long, lang string, n_chars long, logp double")
    return out.withColumn("perplexity", F.exp(-F.col("logp") / (F.col("n_chars") + 1)))


def classify(docs: DataFrame, labels: DataFrame, trust: Column, order: int = ORDER, share: float = 0.995, slack: float = 1.25, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: doc_id, lang, n_chars, perplexity, threshold and kept.

    ``trust`` says of a row of ``labels`` (doc_id, ...) whether the document is trusted. Perplexities enter the quantiles
    in steps of a thousandth of their logarithm, as counts per step, so a language of any size is a short table.
    """
    known = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.bool_and(F.coalesce(trust, F.lit(False))).alias("ok")).where("ok and doc_id is not null")
    held_out = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 1
    scored = written(perplexities(docs, known.where(~held_out), order, id_col, text_col, lang_col), "kneser-scores")
    steps = (scored.join(known.where(held_out).select("doc_id"), "doc_id", "left_semi")
             .groupBy("lang", F.ceil(1000 * F.log("perplexity")).alias("step")).agg(F.count("*").alias("n")))
    limit = F.exp(F.percentile("step", F.lit(share), F.col("n")) / 1000)
    overall = steps.agg(limit.alias("t")).first()["t"]
    own = steps.groupBy("lang").agg(limit.alias("own")).withColumnRenamed("lang", "__lang")
    threshold = F.coalesce("own", F.lit(overall).cast("double"), F.lit(float("inf"))) * slack
    return (scored.join(own, F.col("lang").eqNullSafe(F.col("__lang")), "left")
            .select("doc_id", "lang", "n_chars", "perplexity", threshold.alias("threshold"), (F.col("perplexity") <= threshold).alias("kept")))
