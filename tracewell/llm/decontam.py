"""Benchmark decontamination with a BM25 inverted index and block-max pruning.

Test items are cut into segments of at most ``SEGMENT`` words and indexed: each
term's postings carry the segment's BM25 impact, normalised by the score that
the segment has for itself, and are grouped in blocks of ``BLOCK`` segments with
the block's maximal impact. Every training text is a sequence of overlapping
windows of ``WINDOW`` words; each window is a query that retrieves *all*
segments whose normalised score reaches ``THRESHOLD``.

Pruning keeps that exact, in the manner of block-max WAND. Terms of long posting
lists are non-essential: together they stay below the threshold in every
segment. A window visits only its essential terms. It skips a block unless the
sum of block maxima plus the block's bound for non-essential terms reaches the
threshold (the pivot test, here for all windows of a batch at once); a segment
is fully scored only if its essential impacts plus its own bound still reach it.

Retrieved items are verified on the whole text: the share of the question's and
of the answer's words that lie in five-word shingles also found in the text.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm.common import Scratch, annotate, remembered

SHINGLE = 5
SEGMENT = 48
WINDOW, STRIDE = 128, 64
BLOCK = 16
THRESHOLD = 0.5
OVERLAP, PARTLY = 0.8, 0.5
K1, B = 1.2, 0.75
MAX_ITEMS = 20_000  # items of one index; more are indexed in further blocks

_WORD = re.compile(r"\w+")


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """The answer is the last line; in a text of one line, there is none."""
    lines = [w for w in map(words, text.split("\n")) if w]
    if len(lines) < 2:
        return (lines[0] if lines else []), []
    return [w for line in lines[:-1] for w in line], lines[-1]


def segments_of(tokens: list[str]) -> list[list[str]]:
    """Parts of nearly equal length, of at most ``SEGMENT`` words each."""
    if not tokens:
        return []
    size = -(-len(tokens) // -(-len(tokens) // SEGMENT))
    return [tokens[i : i + size] for i in range(0, len(tokens), size)]


@dataclass
class Item:
    item_id: int
    tokens: list[str]
    n_question: int
    shingles: dict[tuple[str, ...], list[int]] = field(default_factory=lambda: defaultdict(list))


class _Terms(dict):
    """Term numbers; all other words share the number after the last."""

    def __missing__(self, word: str) -> int:
        return len(self)


class Index:
    """Impact-ordered postings of one block of test items.

    ``stats`` has what BM25 needs of all items where ``rows`` are some of them: the
    number of segments, their mean length, and (term, segments that hold it).
    """

    def __init__(self, rows: tuple[tuple[int, str], ...], threshold: float, stats: tuple[int, float, tuple] | None = None):
        self.items: list[Item] = []
        segments: list[tuple[int, list[str]]] = []
        for item_id, text in rows:
            question, answer = question_and_answer(text or "")
            tokens = question + answer
            if not tokens:
                continue
            item = Item(item_id, tokens, len(question))
            span = min(SHINGLE, len(tokens))
            for i in range(len(tokens) - span + 1):
                item.shingles[tuple(tokens[i : i + span])].append(i)
            segments += [(len(self.items), part) for part in segments_of(tokens)]
            self.items.append(item)
        self.owner = np.array([k for k, _ in segments], np.int64)
        n = len(segments)
        postings: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for s, (_, tokens) in enumerate(segments):
            for t in dict.fromkeys(tokens):
                postings[t].append((s, tokens.count(t)))
        if stats is None:
            every, mean, held = n, sum(len(t) for _, t in segments) / max(n, 1), {t: len(p) for t, p in postings.items()}
        else:
            every, mean, held = stats[0], stats[1], dict(stats[2])
        self.terms = _Terms((t, i) for i, t in enumerate(postings))
        impact, own = [], np.zeros(n)
        for t, plist in postings.items():
            idf = np.log(1 + (every - held[t] + 0.5) / (held[t] + 0.5))
            weights = [
                idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(segments[s][1]) / mean)) for s, tf in plist
            ]
            impact.append(weights)
            for (s, _), w in zip(plist, weights, strict=True):
                own[s] += w
        self.start = np.concatenate([[0], np.cumsum([len(p) for p in postings.values()])]).astype(np.int64)
        self.segment = np.array([s for p in postings.values() for s, _ in p], np.int64)
        self.impact = np.array([w for ws in impact for w in ws]) / np.maximum(own[self.segment], 1e-12)
        self.n_segments, self.n_blocks = n, -(-n // BLOCK)
        self._split_terms(threshold)
        self._block_maxima()

    def _split_terms(self, threshold: float) -> None:
        """Longest lists first, terms are non-essential while every segment's sum stays below the threshold."""
        lengths = np.diff(self.start)
        self.bound = np.zeros(self.n_segments)
        self.essential = np.ones(len(lengths) + 1, bool)
        self.essential[-1] = False  # stands for words outside the index
        for t in np.argsort(-lengths, kind="stable"):
            at = slice(self.start[t], self.start[t + 1])
            if (self.bound[self.segment[at]] + self.impact[at]).max() >= 0.8 * threshold:
                continue
            self.bound[self.segment[at]] += self.impact[at]
            self.essential[t] = False
        self.rest: list[dict[int, float]] = [{} for _ in range(self.n_segments)]
        for t in np.flatnonzero(~self.essential[:-1]).tolist():
            for i in range(self.start[t], self.start[t + 1]):
                self.rest[self.segment[i]][t] = float(self.impact[i])

    def _block_maxima(self) -> None:
        term = np.repeat(np.arange(len(self.start) - 1), np.diff(self.start))
        pair = term * self.n_blocks + self.segment // BLOCK
        keys, first = np.unique(pair, return_index=True)
        self.block_of = keys % max(self.n_blocks, 1)
        self.block_max = np.maximum.reduceat(self.impact, first) if len(keys) else np.empty(0)
        owner = keys // max(self.n_blocks, 1)
        self.block_start = np.searchsorted(owner, np.arange(len(self.start)))
        self.block_bound = np.zeros(self.n_blocks)
        np.maximum.at(self.block_bound, np.arange(self.n_segments) // BLOCK, self.bound)

    @staticmethod
    def _expand(start: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of all list entries of ``terms``, and which term each belongs to."""
        count = start[terms + 1] - start[terms]
        which = np.repeat(np.arange(len(terms)), count)
        offset = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
        return start[terms][which] + offset, which

    def retrieve(self, ids: np.ndarray, doc_of: np.ndarray, threshold: float) -> dict[tuple[int, int], float]:
        """(document, item) -> best score over windows; ``ids`` has a window's term ids in each row."""
        ids = np.sort(ids, axis=1)
        fresh = np.ones(ids.shape, bool)
        fresh[:, 1:] = ids[:, 1:] != ids[:, :-1]
        window, column = np.nonzero(fresh & self.essential[ids])
        terms = ids[window, column]
        at, which = self._expand(self.block_start, terms)
        pair = window[which] * self.n_blocks + self.block_of[at]
        keys, inverse = np.unique(pair, return_inverse=True)
        upper = np.bincount(inverse, self.block_max[at], len(keys)) + self.block_bound[keys % max(self.n_blocks, 1)]
        alive = keys[upper >= threshold - 1e-9]
        if not len(alive):
            return {}
        some = np.isin(window, alive // self.n_blocks)
        window, terms = window[some], terms[some]
        at, which = self._expand(self.start, terms)
        seg, win = self.segment[at], window[which]
        inside = np.isin(win * self.n_blocks + seg // BLOCK, alive)
        keys, inverse = np.unique(win[inside] * self.n_segments + seg[inside], return_inverse=True)
        score = np.bincount(inverse, self.impact[at[inside]], len(keys))
        seg = keys % self.n_segments
        open_ = score + self.bound[seg] >= threshold - 1e-9
        found: dict[tuple[int, int], float] = {}
        for key, partial in zip(keys[open_].tolist(), score[open_].tolist(), strict=True):
            w, s = divmod(key, self.n_segments)
            row = set(ids[w].tolist())
            partial += sum(v for t, v in self.rest[s].items() if t in row)
            if partial >= threshold - 1e-9:
                k = (int(doc_of[w]), int(self.owner[s]))
                found[k] = max(found.get(k, 0.0), partial)
        return found

    def verify(self, k: int, shingles: set[tuple[str, ...]]) -> tuple[float, float]:
        """Shares of the question's and the answer's words inside shingles of the text."""
        item = self.items[k]
        covered = np.zeros(len(item.tokens), bool)
        for g, places in item.shingles.items():
            if g in shingles:
                for i in places:
                    covered[i : i + len(g)] = True
        q = float(covered[: item.n_question].mean()) if item.n_question else 0.0
        a = float(covered[item.n_question :].mean()) if len(covered) > item.n_question else q
        return q, a

    def screen(self, texts: list[str | None], threshold: float, overlap: float) -> list[list[dict]]:
        """Verified leaks of each text."""
        out: list[list[dict]] = [[] for _ in texts]
        if not self.items:
            return out
        at = 0
        while at < len(texts):  # windows of bounded many words at a time
            part, size = [], 0
            while at < len(texts) and (not part or size + len(texts[at] or "") < 1_000_000):
                part.append((at, words(texts[at])))
                size += len(texts[at] or "")
                at += 1
            self._screen(part, out, threshold, overlap)
        return out

    def _screen(self, part, out, threshold, overlap) -> None:
        none, number = len(self.start) - 1, self.terms.__getitem__
        rows, doc_of = [], []
        for i, (_, tokens) in enumerate(part):
            if not tokens:
                continue
            ids = np.array(list(map(number, tokens)), np.int64)
            count = max(1, -(-(len(ids) - WINDOW) // STRIDE) + 1)
            full = np.full((count - 1) * STRIDE + WINDOW, none, np.int64)
            full[: len(ids)] = ids[: len(full)]
            halves = full.reshape(-1, STRIDE)  # a window is two strides long
            rows.append(np.concatenate([halves[:-1], halves[1:]], axis=1))
            doc_of += [i] * count
        if not rows:
            return
        found = self.retrieve(np.concatenate(rows), np.array(doc_of), threshold)
        last, shingles = -1, set()
        for (i, k), score in sorted(found.items()):
            where, tokens = part[i]
            if i != last:
                last, shingles = i, set(zip(*(tokens[j:] for j in range(SHINGLE)), strict=False))
            item = self.items[k]
            if len(item.tokens) < SHINGLE:
                n = len(item.tokens)
                hit = {tuple(tokens[j : j + n]) for j in range(len(tokens) - n + 1)}
                q, a = self.verify(k, hit)
            else:
                q, a = self.verify(k, shingles)
            if leaked(item, q, a, overlap):
                out[where].append({"item_id": item.item_id, "score": score, "question_overlap": q, "answer_overlap": a})


def leaked(item: Item, q: float, a: float, overlap: float) -> bool:
    """Whether question and answer are both in a text, by their overlaps.

    Both reach ``overlap``; or their words together do, and each ``PARTLY``: a
    word changed within a short answer takes the shingles of several others.
    """
    both = (q * item.n_question + a * (len(item.tokens) - item.n_question)) / len(item.tokens)
    return min(q, a) >= overlap or both >= overlap and min(q, a) >= PARTLY


def segment_terms(items: DataFrame) -> DataFrame:
    """``terms``, one entry for each segment that holds a term, and ``lengths`` of the segments of each item."""
    fields = [T.StructField("terms", T.ArrayType(T.StringType())), T.StructField("lengths", T.ArrayType(T.LongType()))]

    def make():
        def run(texts):
            parts = [segments_of([w for half in question_and_answer(x or "") for w in half]) for x in texts]
            return [[t for part in ps for t in dict.fromkeys(part)] for ps in parts], [[len(part) for part in ps] for ps in parts]

        return run

    return annotate(items, ["text"], fields, make)


LEAK = T.ArrayType(
    T.StructType(
        [
            T.StructField("item_id", T.LongType()),
            T.StructField("score", T.DoubleType()),
            T.StructField("question_overlap", T.DoubleType()),
            T.StructField("answer_overlap", T.DoubleType()),
        ]
    )
)


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    keep: list[str] | None = None,
    threshold: float = THRESHOLD,
    overlap: float = OVERLAP,
    max_items: int = MAX_ITEMS,
) -> DataFrame:
    """Add ``leaks``: the test items that a text holds, as an array of structs.

    Null and empty texts and items leak nothing; repeated items are each
    reported. An item counts when both its question and its answer are in the
    text, as ``leaked`` says; one without an id is reported as -1. Items travel
    to the executors in blocks of at most ``max_items``; with several, each is a
    job of its own that appends what it found to a table, so that driver and
    workers hold one block at a time. The statistics of BM25 cover all items, so
    scores do not depend on the blocks. A column that is called ``leaks`` is replaced.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    blocks = max(1, -(-items.count() // max_items))
    if blocks == 1:
        return annotate(docs, [text], [T.StructField("leaks", LEAK)], _screener(_rows(items), threshold, overlap, None), keep)
    scratch = Scratch(docs.sparkSession)
    cut = scratch.table(segment_terms(items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))))
    lengths = cut.select(F.explode("lengths").alias("n")).agg(F.count("*").alias("n"), F.avg("n").alias("mean")).first()
    held = scratch.table(cut.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("n")))
    kept = [c for c in (docs.columns if keep is None else keep) if c != "leaks"]
    # A row's number stands for it, whatever its id; its own columns come back at the end.
    rows = scratch.table(docs.select(F.monotonically_increasing_id().alias("__row"), F.struct(*[F.col(f"`{c}`") for c in kept]).alias("__own"), F.col(f"`{text}`").alias("__text")))
    found = []
    for k in range(blocks):
        part = cut.where(F.col("block") == k)
        own = held.join(part.select(F.explode("terms").alias("t")).distinct(), "t", "left_semi")
        stats = (lengths["n"], lengths["mean"] or 0.0, tuple(sorted((r["t"], r["n"]) for r in own.collect())))
        screened = annotate(rows, ["__text"], [T.StructField("leaks", LEAK)], _screener(_rows(part), threshold, overlap, stats), ["__row"])
        found.append(scratch.table(screened.where(F.size("leaks") > 0)))
    every = reduce(DataFrame.unionByName, found).groupBy("__row").agg(F.array_sort(F.flatten(F.collect_list("leaks"))).alias("leaks"))
    out = rows.join(every, "__row", "left").withColumn("leaks", F.coalesce("leaks", F.array().cast(LEAK)))
    return out.select("__own.*", "leaks")


def _rows(items: DataFrame) -> tuple:
    return tuple(sorted((r["item_id"] if r["item_id"] is not None else -1, r["text"]) for r in items.select("item_id", "text").collect()))


def _screener(rows, threshold, overlap, stats):
    def make():
        built = remembered(Index, rows, threshold, stats)
        return lambda texts: (built.screen(texts, threshold, overlap),)

    return make


def op3_decontamination(spark, sf_dir: str) -> DataFrame:
    """One row for each verified (document, test item) leak; nulls, empty and repeated rows and ties as in ``leaks``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = leaks(docs, benchmark, keep=["doc_id"]).select("doc_id", F.explode("leaks").alias("leak"))
    return found.select("doc_id", "leak.*")
