"""Spelling variants by a symmetric-delete join.

Runs of letters are counted, batch by batch and then by Spark. Every word that
is frequent enough emits a key for itself and one for each distinct string that
is left when one of its code points is deleted. Two words at the distance of
one share such a key: the shorter word itself, or what is left of two equally
long words without the place where they differ. Rows are dealt out and sorted
by key; within a key words are told apart by the real remainder, so a hash that
clashes links nothing. Pairs are never written out: under one remainder all
words that miss the same place are near each other, and all longer words are
near the remainder itself, so the number of near words and the best two of each
such set say all. A key holds at most one word and, of each place, one word for
each letter of the alphabet.

Forms are the near words of largest count, where that is at least twice the
word's own. As counts double from word to form, a chain is no longer than the
logarithm of the largest count; roots are joined on by pointer doubling.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import Scratch, ship

#: Letters besides A-Z that belong to a run: code points of Latin-1, a fixed range.
RUN = re.compile("[a-zÀ-ÿ]+")
MIN_LENGTH, MIN_COUNT, RATIO, MODULUS = 5, 3, 2, 97
#: Words whose key has as many code points carry a number instead of themselves until the key is known to be shared.
LONG_KEY = 256
PIECE, DIFFERENT = 1 << 20, 100_000
WORDS = "word string, n long"
NEAR = "word string, n_near long, best_n long, best string"

_PRIMES = (2_147_483_629, 2_147_483_587)
_BASE = 1_000_003


def runs(text: str) -> Iterator[list[str]]:
    """The runs of a text, piece by piece; a piece ends where a run does."""
    low = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    at = 0
    while at < len(low):
        end = at + PIECE
        if end < len(low) and (cut := RUN.match(low, end)) is not None:
            end = cut.end()
        yield RUN.findall(low, at, end)
        at = end


def misspelt(doc: bytes, run: str) -> str:
    """``run``, without one code point where ``MODULUS`` divides the checksum of document and run."""
    h = zlib.crc32(run.encode(), zlib.crc32(doc))
    if h % MODULUS:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1 :]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()

    def out() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names=["word", "n"])
        seen.clear()
        return made

    for batch in batches:
        for doc, text in zip(batch.column(0), batch.column(1), strict=True):
            if not text.is_valid:
                continue
            prefix = f"{doc.as_py() or ''}:".encode("utf-8", "surrogatepass")
            own: Counter = Counter()
            for piece in runs(text.as_py()):
                own.update(piece)
            start = zlib.crc32(prefix)
            for run, n in own.items():
                if len(run) >= MIN_LENGTH:
                    if zlib.crc32(run.encode(), start) % MODULUS == 0:
                        run = misspelt(prefix, run)
                        if len(run) < MIN_LENGTH:
                            continue
                    seen[run] += n
            if len(seen) >= DIFFERENT:
                yield out()
    if seen:
        yield out()


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word, n`` of all words, rare ones too, of at least ``MIN_LENGTH`` code points."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").cast("string"), F.col(f"`{text_col}`").cast("string"))
    return rows.mapInArrow(_count, WORDS).groupBy("word").agg(F.sum("n").alias("n"))


def _long_hashes(word: str) -> tuple[int, np.ndarray]:
    """A hash of a word, and of it without each of its code points, in time and space of its length."""
    codes = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) + 1
    whole, without = [], []
    for prime in _PRIMES:
        powers = np.ones(len(codes), np.int64)
        step, done = _BASE % prime, 1
        while done < len(codes):
            take = min(done, len(codes) - done)
            powers[done : done + take] = powers[:take] * step % prime
            step, done = step * step % prime, 2 * done
        sums = np.concatenate([[0], np.cumsum(codes * powers % prime)])
        behind = (sums[-1] - sums[1:]) % prime * pow(_BASE, -1, prime) % prime
        whole.append(int(sums[-1] % prime))
        without.append((sums[:-1] + behind) % prime)
    return whole[0] << 31 | whole[1], without[0] << 31 | without[1]


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def keys(word: str) -> tuple[list[int], list[int]]:
    """Keys of a word and of what distinct single deletions leave, with the first place deleted (-1: the word itself).

    Of equal neighbours only the first is deleted; keys of ``LONG_KEY`` code
    points and more are hashed by sums over prefix and suffix.
    """
    size = len(word)
    starts = [i for i in range(size) if i == 0 or word[i] != word[i - 1]]
    if size < LONG_KEY:
        return [_hash(word), *(_hash(word[:i] + word[i + 1 :]) for i in starts)], [-1, *starts]
    whole, without = _long_hashes(word)
    left = [_hash(word[:i] + word[i + 1 :]) for i in starts] if size == LONG_KEY else without[starts].tolist()
    return [whole, *left], [-1, *starts]


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["key", "at", "wid", "word", "n"]
    schema = pa.schema(zip(names, (pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int64()), strict=True))
    for batch in batches:
        cols: tuple[list, ...] = ([], [], [], [], [])
        for wid, word, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            for key, at in zip(*keys(word), strict=True):
                long = len(word) - (at >= 0) >= LONG_KEY
                for col, x in zip(cols, (key, at, wid, None if long else word, n), strict=True):
                    col.append(x)
                if len(cols[0]) >= 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)
                    cols = ([], [], [], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def _best(of: list[tuple[int, str]]) -> list[tuple[int, str]]:
    """The two of largest count, ties by code points."""
    return sorted(of, key=lambda x: (-x[0], x[1]))[:2]


def near_within(members: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int, str]]:
    """``word, number of near words, count and word of the best one`` for rows (word, n, at) of one key."""
    rests = defaultdict(list)
    for word, n, at in members:
        rests[word if at < 0 else word[:at] + word[at + 1 :]].append((word, n, at))
    for rest, rows in rests.items():
        if len(rows) < 2:
            continue
        longer = [r for r in rows if r[2] >= 0]
        itself = next((r for r in rows if r[2] < 0), None)
        if itself is not None:
            top = _best([(n, w) for w, n, _ in longer])[0]
            yield rest, len(longer), *top
            for word, _, _ in longer:
                yield word, 1, itself[1], rest
        places = defaultdict(list)
        for word, n, at in longer:
            place = at
            while place < len(word) and word[place] == word[at]:
                places[place].append((n, word))
                place += 1
        for alike in places.values():
            if len(alike) > 1:
                top = _best(alike)
                for n, word in alike:
                    yield word, len(alike) - 1, *(top[1] if top[0] == (n, word) else top[0])


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key; a key may go on in the next batch."""
    held: list[tuple[str, int, int]] = []
    held_key = None
    for batch in batches:
        found: list[tuple[str, int, int, str]] = []
        key_of, ats, texts, counts = (batch.column(c).to_pylist() for c in ("key", "at", "word", "n"))
        for key, at, word, n in zip(key_of, ats, texts, counts, strict=True):
            if key != held_key:
                if len(held) > 1:
                    found += near_within(held)
                held, held_key = [], key
            held.append((word, n, at))
        yield _rows(found)
    if len(held) > 1:
        yield _rows(list(near_within(held)))


def _rows(found: list) -> pa.RecordBatch:
    cols = list(zip(*found, strict=True)) or [()] * 4
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["word", "n_near", "best_n", "best"])


def near_words(words: DataFrame) -> DataFrame:
    """``word, n_near, best_n, best`` of every word of ``words`` (``wid, word, n``) that has near words."""
    ship(words.sparkSession)
    emitted, size = "key long, at int, wid long, word string, n long", F.length("word")
    short = words.where(size <= LONG_KEY).select("wid", "word", "n").mapInArrow(_emit, emitted)
    short = short.where("word IS NOT NULL").select("key", "at", "word", "n")
    # Words of long keys, few or none, come in only where a key is shared: else they would be repeated for each place.
    giants = words.where(size >= LONG_KEY).select("wid", "word", "n")
    long = giants.mapInArrow(_emit, emitted).where("word IS NULL").drop("word")
    shared = long.groupBy("key").count().where("count > 1").select("key")
    long = long.join(shared, "key", "left_semi").join(giants.select("wid", "word"), "wid").select("key", "at", "word", "n")
    dealt = short.unionByName(long).repartition(F.col("key")).sortWithinPartitions("key")
    first = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    found = dealt.mapInArrow(_near, NEAR).groupBy("word").agg(F.sum("n_near").alias("n_near"), first.alias("first"))
    return found.select("word", "n_near", (-F.col("first.n")).alias("best_n"), F.col("first.word").alias("best"))


def resolve_roots(scratch: Scratch, forms: DataFrame) -> DataFrame:
    """``word, root`` for every word with a form: pointers are doubled until none moves."""
    at = scratch.table(forms.select("word", F.col("form").alias("root")))
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        new = scratch.table(at.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        scratch.drop(at)
        if new.where("moved").isEmpty():
            return new.select("word", "root")
        at = new


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word, n, n_near, form, form_n, root`` of every word that occurs at least ``MIN_COUNT`` times in ``docs``.

    Words are runs of letters of the whole texts, lower-cased in A-Z only, each
    with the deletion that checksum of document and run may ask for. Null and
    empty texts and texts without letters have no words; repeated rows count
    again; a null id counts as an empty one in the checksum. Of near words with
    one count the smallest by code points is the form. Words may be of any
    length. Extra columns are ignored; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession)
    counted = count_words(docs, id_col, text_col).where(F.col("n") >= MIN_COUNT)
    words = scratch.table(counted.withColumn("wid", F.monotonically_increasing_id()))
    near = words.select("word", "n").join(near_words(words), "word", "left")
    is_form = F.col("best_n") >= RATIO * F.col("n")
    near = scratch.table(near.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n")))
    scratch.drop(words)
    roots = resolve_roots(scratch, near.where("form IS NOT NULL"))
    out = near.join(roots, "word", "left")
    return out.select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def op11_spelling_variants(spark, sf_dir: str) -> DataFrame:
    """Spelling variants in all ``documents``; nulls, ties, empty and repeated rows as in ``spelling_variants``."""
    return spelling_variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP11_SQL = r"""
WITH RECURSIVE runs AS (
    SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents),
own AS (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY ALL),
bytes AS (
    SELECT run, n, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''), lambda c:
        CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]
             ELSE [192 | (unicode(c)::BIGINT >> 6), 0, 0, 0, 0, 0, 0, 0, 128 | (unicode(c)::BIGINT & 63), 0, 0, 0, 0, 0, 0, 0] END)) AS bits FROM own),
hashed AS (
    SELECT run, n, xor(list_reduce(bits, lambda c, x: xor(xor(c, x) >> 1, (xor(c, x) & 1) * 3988292384), 4294967295::BIGINT), 4294967295) AS h FROM bytes),
spelt AS (
    SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM spelt WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
cut AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM places),
pairs AS (
    SELECT a.word, b.word AS other, b.n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
    UNION SELECT c.word, w.word, w.n FROM cut c JOIN words w ON w.word = c.rest
    UNION SELECT w.word, c.word, c.n FROM cut c JOIN words w ON w.word = c.rest),
near AS (SELECT word, count(*) AS n_near, first(other ORDER BY n DESC, other) AS best, max(n) AS best_n FROM pairs GROUP BY word),
formed AS (
    SELECT word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 2 * w.n THEN best END AS form, CASE WHEN best_n >= 2 * w.n THEN best_n END AS form_n
    FROM words w LEFT JOIN near USING (word)),
walk AS (SELECT word, word AS top, form AS further FROM formed UNION ALL SELECT w.word, f.word, f.form FROM walk w JOIN formed f ON f.word = w.further)
SELECT word, n, n_near, form, form_n, top AS root FROM formed JOIN (SELECT word, top FROM walk WHERE further IS NULL) USING (word)
"""
