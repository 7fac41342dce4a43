"""Stupid-backoff scores of every document under the corpus's own counts.

    S(w | context) = c(context w) / c(context)              if c(context w) >= min_count
                   = alpha * S(w | context without its first word)      otherwise
    S(w)           = c(w) / N

summed as logarithms over a document's words; a word too near the beginning for
the full context has the shorter one. Counts cover all documents.

The plan is relational. Each document is exploded into rows of its different
n-grams with their repetitions. These rows, partitioned by the hash of the
n-gram, are aggregated into the count table there and joined to it where they
lie: one exchange serves both sides. A row whose n-gram is frequent enough asks
for the count of its context, any other for the score of its shorter n-gram;
the next order's count table answers, and a sum for each document ends it.

Frequent n-grams make no hot partition. A bounded sample names up to
``HOT_GRAMS`` of them; they are counted over all documents, with combining where
texts are read, and scored there. Which ones the sample names changes the work,
not the result. Words are coded by their rank among the ``VOCABULARY`` most
frequent ones (a list of a fixed size, the only other broadcast) or, beyond it,
by a 48-bit hash.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.common import Scratch, hash_sample, release, utf8
from tracewell.llm.minhash import mix

ORDER, ALPHA, MIN_COUNT = 2, 0.4, 2
BITS = 20
COLD = 1 << BITS  # codes from here on are hashes
VOCABULARY = COLD - 1
TOTAL, UNIT = -1, 2.0**-30
HOT_GRAMS, SAMPLE_ROWS = 262_143, 8000
SLICE_ROWS, SLICE_CHARS = 2048, 3_000_000
ROWS_PER_PART = 2_000_000

_LOW48 = np.uint64((1 << 48) - 1)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[bytes]:
    return utf8(text).lower().split()


def word_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) & 0xFFFFFFFFFFFF


def slices(batches, names):
    """Column lists of at most ``SLICE_ROWS`` rows and about ``SLICE_CHARS`` characters."""
    for batch in batches:
        cols = [batch.column(n).to_pylist() for n in names]
        size, start = 0, 0
        for at, text in enumerate(cols[0]):
            if at > start and (at - start >= SLICE_ROWS or size > SLICE_CHARS):
                yield [c[start:at] for c in cols]
                start, size = at, 0
            size += len(text or "")
        if batch.num_rows > start:
            yield [c[start:] for c in cols]


def flat(texts) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts in a row, and the number of the text of each."""
    lists = [words(t) for t in texts]
    sizes = [len(x) for x in lists]
    digest = xxhash.xxh3_64_intdigest
    h = np.fromiter((digest(w) for x in lists for w in x), np.uint64, sum(sizes)) & _LOW48
    return h, np.repeat(np.arange(len(lists)), sizes)


def find(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of ``keys`` in ``sorted_keys``, and which of them are there."""
    if not len(sorted_keys):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return at, sorted_keys[at] == keys


def starts(doc: np.ndarray, n: int) -> np.ndarray:
    """Where an n-gram begins: positions whose ``n`` words are of one text."""
    last = len(doc) - n + 1
    return np.flatnonzero(doc[:last] == doc[n - 1 :]) if last > 0 else np.empty(0, np.int64)


def gram_hash(columns: list[np.ndarray]) -> np.ndarray:
    return reduce(lambda acc, x: mix(acc * _ODD + x.astype(np.uint64)), columns[1:], mix(columns[0].astype(np.uint64)))


def _sampled(n: int):
    """The n-grams of a sample's texts as word hashes, counted slice by slice."""

    def run(batches):
        for (texts,) in slices(batches, ["text"]):
            h, doc = flat(texts)
            at = starts(doc, n)
            columns = [h[at + i] for i in range(n)]
            _, first, many = np.unique(gram_hash(columns), return_index=True, return_counts=True) if len(at) else (0, at, at)
            arrays = [pa.array(c[first].astype(np.int64)) for c in columns] + [pa.array(many.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*(f"w{i}" for i in range(n)), "c"])

    return run


def _counted(named: dict[int, np.ndarray]):
    """Counts of all words (level 1) and of the named n-grams, combined slice by slice."""

    def run(batches):
        for (texts,) in slices(batches, ["text"]):
            h, doc = flat(texts)
            for level in (1, *named):
                if level == 1:
                    keys = h
                else:
                    at = starts(doc, level)
                    keys = gram_hash([h[at + i] for i in range(level)]) if len(at) else np.empty(0, np.uint64)
                    keys = keys[find(named[level], keys)[1]]
                keys, many = np.unique(keys, return_counts=True)
                yield pa.RecordBatch.from_pydict(
                    {
                        "level": pa.array(np.full(len(keys), level, np.int32)),
                        "h": pa.array(keys.view(np.int64)),
                        "c": pa.array(many.astype(np.int64)),
                    }
                )

    return run


class Words:
    """What every task knows: the vocabulary with its counts, and the scores of hot n-grams."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, total: int, hot: np.ndarray, hot_score: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.ranks, self.log_counts = hashes[order], order.astype(np.int64), np.log(np.maximum(counts, 1).astype(np.float64))
        self.log_total = math.log(max(total, 1))
        self.hot, self.hot_score = hot, hot_score

    def codes(self, h: np.ndarray) -> np.ndarray:
        """Ranks of frequent words; hashes, moved above all ranks, of the others."""
        if not len(h):
            return np.empty(0, np.int64)
        different, inverse = np.unique(h, return_inverse=True)
        at, known = find(self.hashes, different)
        code = different.astype(np.int64) + COLD
        if known.any():
            code[known] = self.ranks[at[known]]
        return code[inverse]


def packed(columns: list[np.ndarray]) -> np.ndarray:
    """The key of an n-gram of vocabulary words, which holds their ranks."""
    return reduce(lambda acc, x: acc | x[1] << (BITS * x[0]), enumerate(columns), np.zeros(len(columns[0]), np.int64))


def _exploded(known, order: int):
    """Rows of each document: its different n-grams, its first words, and one with its total.

    A row of first words, which are scored by a shorter n-gram, has the negative
    order of that in ``n``. The row with a total has ``TOTAL`` for its first word,
    the number of tokens in ``n`` and, for its second word, the score of all that
    is known here in units of ``UNIT``.
    """
    names = ["doc", "key", "n", *(f"w{i}" for i in range(order))]

    def rows(doc, key, n, codes):
        k = len(doc)
        codes = [*codes, *[None] * (order - len(codes))]
        empty = pa.nulls(k, pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array(doc), key if key is not None else empty, pa.array(n.astype(np.int64))]
            + [c if c is not None else empty for c in codes],
            names=names,
        )

    def run(batches):
        w = known()
        for texts, ids in slices(batches, ["text", "doc"]):
            ids = np.array(ids, np.int64)
            h, doc = flat(texts)
            code = w.codes(h)
            local = np.zeros(len(texts))
            position = np.arange(len(h)) - np.searchsorted(doc, doc)
            for n in range(1, order):
                end = np.flatnonzero(position == n - 1)
                if n == 1:  # the part of the score that any first word has is known, and the count of a frequent one
                    here = code[end] < COLD
                    local[doc[end]] -= w.log_total
                    local[doc[end[here]]] += w.log_counts[code[end[here]]]
                    end = end[~here]
                columns = [pa.array(code[end - n + 1 + i]) for i in range(n)]
                yield rows(ids[doc[end]], None, np.full(len(end), -n), columns)
            at = starts(doc, order)
            if len(at):
                gram = gram_hash([h[at + i] for i in range(order)])
                place, hot = find(w.hot, gram)
                local += np.bincount(doc[at[hot]], w.hot_score[place[hot]], len(texts)) if hot.any() else 0.0
                at, gram = at[~hot], gram[~hot]
                _, first, many = np.unique(mix(gram + doc[at].astype(np.uint64) * _ODD), return_index=True, return_counts=True)
                in_order = np.argsort(first, kind="stable")
                at, many = at[first[in_order]], many[in_order]
                columns = [code[at + i] for i in range(order)]
                cold = np.any([c >= COLD for c in columns], axis=0)
                key = pa.array(np.where(cold, 0, packed([np.minimum(c, COLD - 1) for c in columns])), mask=cold)
                yield rows(ids[doc[at]], key, many, [pa.array(c, mask=~cold) for c in columns])
            total = [pa.array(np.full(len(texts), TOTAL)), pa.array(np.rint(local / UNIT).astype(np.int64))]
            yield rows(ids, None, np.bincount(doc, minlength=len(texts)), total)

    return run


def _combined(known, n: int):
    """All n-grams of a shorter order, counted slice by slice."""

    def run(batches):
        w = known()
        for (texts,) in slices(batches, ["text"]):
            h, doc = flat(texts)
            code, at = w.codes(h), starts(doc, n)
            columns = [code[at + i] for i in range(n)]
            _, first, many = np.unique(gram_hash(columns), return_index=True, return_counts=True) if len(at) else (0, at, at)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c[first]) for c in columns] + [pa.array(many.astype(np.int64))], names=[*(f"w{i}" for i in range(n)), "n"]
            )

    return run


def gram_key(codes: list[Column]) -> Column:
    """``packed`` for vocabulary words; a negative hash where another word takes part; a single word's code."""
    if len(codes) == 1:
        return codes[0]
    pack = reduce(lambda acc, x: acc.bitwiseOR(F.shiftleft(x[1], BITS * x[0])), enumerate(codes[1:], 1), codes[0])
    known = reduce(lambda acc, c: acc & (c < COLD), codes, F.lit(True))
    return F.when(known, pack).otherwise(F.xxhash64(*codes).bitwiseOR(F.lit(-(2**63))))


def most_frequent(counts: DataFrame, size: int) -> DataFrame:
    """The ``size`` rows of the greatest ``c``; ties go to the smaller ``h``.

    Counts are first tallied by their power of two: only rows from the power on
    that has enough of them are sorted.
    """
    tally = {int(r["p"]): r["n"] for r in counts.groupBy(F.floor(F.log2("c")).alias("p")).agg(F.count("*").alias("n")).collect()}
    enough, least = 0, 0
    for power in sorted(tally, reverse=True):
        enough += tally[power]
        least = power
        if enough >= size:
            break
    return counts.where(F.col("c") >= 2**least).orderBy(F.desc("c"), "h").limit(size)


def columns_of(table: pa.Table) -> dict[str, np.ndarray]:
    return {name: table.column(name).to_numpy() for name in table.column_names}


def lm_scores(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    order: int = ORDER,
    min_count: int = MIN_COUNT,
    alpha: float = ALPHA,
    vocabulary: int = VOCABULARY,
    hot_grams: int = HOT_GRAMS,
    sample_rows: int = SAMPLE_ROWS,
    rows_per_part: int = ROWS_PER_PART,
) -> DataFrame:
    """``doc_id, n_tokens, log_score, mean_log_score`` for every row of ``docs``.

    Words are split at ASCII white space after lower-casing A-Z. Null and empty
    texts have no tokens, the score 0 and no mean; an empty table gives none.
    Rows of a repeated id, and null ids, are scored each: where there are any,
    rows are numbered in a written copy of the two columns. Very long texts are
    scored whole. Extra columns, whatever their names, are ignored. ``order`` is
    2 or 3. An n-gram of fewer than ``min_count`` occurrences backs off.

    At most ``sample_rows`` documents are sampled for names of hot n-grams; one
    that ``share`` of all documents hold is missed with the probability
    ``(1 - share) ** sample_rows``, so no partition's key has many more rows
    than a few thousandths of the documents.
    """
    if order not in (2, 3):
        raise ValueError("order must be 2 or 3")
    spark = docs.sparkSession
    scratch = Scratch(spark)
    source = docs.select(F.col(text_col).alias("text"), F.col(id_col).cast("long").alias("doc_id"))
    repeated = source.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL")
    numbered = None
    if repeated.isEmpty():
        source = source.select("text", F.col("doc_id").alias("doc"))
    else:
        numbered = scratch.table(source.withColumn("doc", F.monotonically_increasing_id()))
        source = numbered.select("text", "doc")

    # Hot n-grams of the order, their contexts, and those of shorter orders, by word hashes.
    named: dict[int, np.ndarray] = {}
    seen: dict[int, list[np.ndarray]] = {}
    some = scratch.table(hash_sample(source, sample_rows, "doc").select("text"))
    for n in range(order, 1, -1):
        keys = [f"w{i}" for i in range(n)]
        found = some.mapInArrow(_sampled(n), ", ".join(f"{k} long" for k in [*keys, "c"]))
        found = found.groupBy(*keys).agg(F.sum("c").alias("c")).where("c > 1").orderBy(F.desc("c"), *keys).limit(hot_grams)
        got = columns_of(found.toArrow())
        columns = [got[k].astype(np.uint64) for k in keys]
        if n + 1 in seen:
            columns = [np.concatenate([c, d]) for c, d in zip(columns, seen[n + 1], strict=False)]
        hashes, first = np.unique(gram_hash(columns), return_index=True)
        seen[n], named[n] = [c[first] for c in columns], hashes

    scratch.drop(some)
    sent_names = spark.sparkContext.broadcast(named)
    counted = source.select("text").mapInArrow(lambda b: _counted(sent_names.value)(b), "level int, h long, c long")
    counted = scratch.table(counted.groupBy("level", "h").agg(F.sum("c").alias("c")))
    release(spark)
    unigrams = counted.where("level = 1").select("h", "c")
    total = unigrams.agg(F.sum("c")).first()[0] or 0
    ranked = most_frequent(unigrams, min(vocabulary, VOCABULARY))
    ranked = scratch.table(ranked.select("h", "c", (F.row_number().over(Window.orderBy(F.desc("c"), "h")) - 1).cast("long").alias("key")))
    listed = columns_of(ranked.orderBy("key").toArrow())
    frequent, counts = listed["h"].astype(np.uint64), listed["c"].astype(np.int64)
    coder = Words(frequent, counts, total, np.empty(0, np.uint64), np.empty(0))

    # Their counts: the score of those of the full order, a small table for each shorter one.
    hot_counts: dict[int, tuple[np.ndarray, np.ndarray]] = {1: (frequent[np.argsort(frequent)], counts[np.argsort(frequent)])}
    answers: dict[int, DataFrame] = {1: ranked.select("key", "c")}
    for n in range(2, order + 1):
        got = columns_of(counted.where(F.col("level") == n).select("h", "c").toArrow())
        by = np.argsort(got["h"].view(np.uint64))
        hot_counts[n] = got["h"].view(np.uint64)[by], got["c"][by]
        at, there = find(hot_counts[n][0], named[n])
        codes = [coder.codes(c) for c in seen[n]]
        there &= np.all([c < COLD for c in codes], axis=0)
        if n < order:
            answers[n] = _table(spark, packed([c[there] for c in codes]), hot_counts[n][1][at[there]])
    hot, score = np.empty(0, np.uint64), np.empty(0)
    if len(named[order]):
        at, there = find(hot_counts[order][0], named[order])
        context = seen[order][: order - 1]
        below, known = find(hot_counts[order - 1][0], context[0] if order == 2 else gram_hash(context))
        there &= known
        c = np.where(there, hot_counts[order][1][at] if len(hot_counts[order][1]) else 0, 0)
        there &= c >= min_count
        hot, score = named[order][there], np.log(c[there]) - np.log(hot_counts[order - 1][1][below[there]])
    coder.hot, coder.hot_score = hot, score
    sent = spark.sparkContext.broadcast(coder)

    def known():
        return sent.value

    codes = [f"w{i}" for i in range(order)]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // rows_per_part))
    exploded = source.mapInArrow(lambda b: _exploded(known, order)(b), ", ".join(f"{f} long" for f in ("doc", "key", "n", *codes)))
    log_alpha, log_total = math.log(alpha), coder.log_total
    alone = F.xxhash64("doc", "n").bitwiseOR(F.lit(-(2**63)))  # a row that is no n-gram of the order
    hashed = F.coalesce("key", F.when(F.col(codes[-1]).isNull() | (F.col("w0") == TOTAL), alone).otherwise(gram_key([F.col(c) for c in codes])))
    spread = exploded.withColumn("key", hashed).repartition(parts, "key")
    # The table takes the greatest of each column that the rows carry, so that one exchange serves both.
    carried = ["doc", *codes]
    table = spread.groupBy("key").agg(F.sum("n").alias("c"), *[F.min(x).alias(f"t_{x}") for x in carried])
    joined = spread.join(table.hint("shuffle_hash"), "key").select("key", "n", "c", *[F.greatest(x, f"t_{x}").alias(x) for x in carried])
    ranks = [F.shiftright("key", BITS * i).bitwiseAND(F.lit(COLD - 1)) for i in range(order)]
    is_total = F.coalesce(F.col("w0") == TOTAL, F.lit(False))
    rows = joined.select(
        "doc",
        F.when(is_total, F.col("n")).alias("tokens"),
        F.when(is_total, F.col("w1") * UNIT).otherwise(F.lit(0.0)).alias("value"),
        F.when(is_total, 0).when(F.col("n") < 0, -F.col("n")).otherwise(order).cast("int").alias("ask"),
        *[F.coalesce(c, r).alias(c) for c, r in zip(codes, ranks, strict=True)],
        F.when(F.col("n") < 0, 1).otherwise(F.col("n")).alias("weight"),
        F.lit(False).alias("plain"),
        "c",
    )
    rows = answered(rows, order, min_count, log_alpha, log_total)
    for n in range(order - 1, 1, -1):
        asked = rows.withColumn("key", F.when(F.col("ask") == n, gram_key([F.col(c) for c in codes[:n]])))
        asked = scratch.table(asked.join(F.broadcast(answers[n]), "key", "left"))
        # (bound here: the loop's next round has another n)
        below = source.select("text").mapInArrow(lambda b, n=n: _combined(known, n)(b), ", ".join(f"{c} long" for c in [*codes[:n], "n"]))
        below = below.select(gram_key([F.col(c) for c in codes[:n]]).alias("key"), "n").groupBy("key").agg(F.sum("n").alias("c"))
        open_ = (F.col("ask") == n) & F.col("c").isNull()
        told = asked.where(open_).drop("c").join(below, "key").select(asked.columns)
        rows = answered(asked.where(~open_).unionByName(told).drop("key"), n, min_count, log_alpha, log_total)

    # The last asks are for words: those of the vocabulary are known everywhere, the others joined to the table.
    words_ = answers[1].select(F.col("key").alias("w0"), F.log(F.col("c").cast("double")).alias("log_c"))
    rows = rows.withColumn("w0", F.when(F.col("ask") == 1, F.col("w0"))).join(F.broadcast(words_), "w0", "left")
    rows = rows.select(
        "doc",
        "tokens",
        (F.col("value") + F.coalesce(F.col("weight") * F.col("log_c"), F.lit(0.0))).alias("value"),
        F.when(F.col("log_c").isNull(), F.col("w0")).alias("w0"),
        F.when(F.col("w0").isNotNull(), F.col("weight")).alias("weight"),
    )
    rows = scratch.table(rows.groupBy("doc", "w0").agg(*[F.sum(c).alias(c) for c in ("tokens", "value", "weight")]))
    del exploded, spread, table, joined
    release(spark)
    rare = unigrams.select((F.col("h") + F.lit(COLD)).alias("w0"), F.log(F.col("c").cast("double")).alias("log_c"))
    looked = rows.where("w0 IS NOT NULL").join(rare, "w0").select("doc", "tokens", (F.col("value") + F.col("weight") * F.col("log_c")).alias("value"))
    out = rows.where("w0 IS NULL").select("doc", "tokens", "value").unionByName(looked)
    out = out.groupBy("doc").agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("n_tokens"), F.round(F.sum("value"), 6).alias("log_score"))
    if numbered is None:
        out = out.withColumnRenamed("doc", "doc_id")
    else:
        out = out.join(numbered.select("doc", "doc_id"), "doc")
    mean = F.when(F.col("n_tokens") > 0, F.col("log_score") / F.col("n_tokens"))
    return out.select("doc_id", "n_tokens", "log_score", mean.alias("mean_log_score"))


def _table(spark, keys: np.ndarray, counts: np.ndarray) -> DataFrame:
    return spark.createDataFrame(pa.table({"key": pa.array(keys.astype(np.int64)), "c": pa.array(counts.astype(np.int64))}))


def answered(rows: DataFrame, n: int, min_count: int, log_alpha: float, log_total: float) -> DataFrame:
    """Take the count ``c`` that answers what rows ask of order ``n``, and turn to what they ask next.

    A plain ask is for the count alone. Any other is a score: with a frequent
    n-gram, its context's count is asked for, to be subtracted; else the score of
    the n-gram without its first word.
    """
    here, plain = F.col("ask") == n, F.col("plain")
    often = F.col("c") >= min_count
    log_c = F.log(F.col("c").cast("double"))
    value = F.col("weight") * F.when(plain | often, log_c).otherwise(F.lit(log_alpha))
    if n == 2:
        value -= F.when(~plain & ~often, F.col("weight") * log_total).otherwise(F.lit(0.0))
    codes = [c for c in rows.columns if c[0] == "w" and c[1:].isdigit()]
    moved = [F.when(here & ~often, F.col(b)).otherwise(F.col(a)).alias(a) for a, b in zip(codes, codes[1:], strict=False)]
    return rows.select(
        "doc",
        "tokens",
        (F.col("value") + F.when(here, value).otherwise(F.lit(0.0))).alias("value"),
        F.when(here & plain, 0).when(here, n - 1).otherwise(F.col("ask")).alias("ask"),
        *(moved or codes),
        F.when(here & often, -F.col("weight")).otherwise(F.col("weight")).alias("weight"),
        F.when(here, often).otherwise(plain).alias("plain"),
    )


def op8_lm_score(spark, sf_dir: str) -> DataFrame:
    """Scores of all ``documents`` at order two; nulls, empty texts and repeated rows as in ``lm_scores``."""
    return lm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
