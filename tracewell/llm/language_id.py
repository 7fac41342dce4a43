"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text accepts every substring of
that text. A document is parsed greedily into the longest phrases that the
automaton accepts; the language that needs the fewest bits (phrases times the
log of its text's length, per character) wins.

Parsing is laid out for vector arithmetic: a text is cut into blocks of
``BLOCK`` symbols, each block parsed from the automaton's root, and thousands of
blocks step through the transition table together. All blocks of a text count,
so whole texts are judged; a block boundary costs every language the same
fraction of a phrase.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm.common import annotate, remembered

UNDETERMINED = "und"
BLOCK = 512
PIECE, LANGUAGES = 250, 200
#: Entries of a language's transition table at most; letters too rare for it share the symbol of their code points' block.
TABLE, SHARED = 1 << 24, 64
#: Entries of all tables together, about: many languages have smaller tables of less text.
TABLES = 1 << 27
#: How sharply the score falls off as another language's cost nears the winner's.
SHARPNESS = 25
PAD, GAP, FIRST = 0, 1, 2  # symbols: filler, any run of non-letters, first letter


def held_out(doc_id) -> F.Column:
    """True for the fifth of the documents that is never learned from."""
    return F.crc32(doc_id.cast("string")) % 5 == 0


def learn(
    docs: DataFrame,
    docs_per_language: int = 60,
    chars_per_language: int = 30_000,
    languages: int = LANGUAGES,
) -> tuple[tuple[str, str], ...]:
    """Training text for each value of ``lang``: a bounded, repeatable sample.

    Of the ``languages`` most frequent values, at most ``docs_per_language``
    labelled documents outside the held-out fifth are drawn for each, in the
    order of a hash of their id. They are cut into pieces of ``PIECE``
    characters from beginning to end, and pieces from anywhere in them are drawn
    by hash, ``chars_per_language`` characters at most, and less of more
    than 17 languages, so that all tables together have about ``TABLES`` entries.
    """
    known = docs.select("doc_id", "lang", "text").where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")) & F.col("text").rlike(r"\p{L}"))
    common = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages)
    names = [r["lang"] for r in common.collect()]
    # A text's automaton has at most two states a character, and a state one entry for each symbol.
    chars_per_language = min(chars_per_language, TABLES // (2 * (2 * SHARED + FIRST + 1) * max(len(names), 1)))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    # Of each language only so many ids leave a task as the draw needs, whatever it holds.
    drawn = known.where(F.col("lang").isin(names)).select("lang", "doc_id").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= docs_per_language)
    drawn = drawn.select("lang", "doc_id").distinct()
    texts = known.join(F.broadcast(drawn), ["lang", "doc_id"], "left_semi")
    starts = F.sequence(F.lit(1), F.length("text"), F.lit(PIECE))
    cut = F.transform(starts, lambda at: F.struct(at.alias("at"), F.substr("text", at, F.lit(PIECE)).alias("piece")))
    pieces = texts.select("lang", "doc_id", F.explode(cut).alias("p")).select("lang", "doc_id", "p.at", "p.piece").distinct()
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", "at"), "doc_id", "at", "piece")
    rows = pieces.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= -(-chars_per_language // PIECE)).collect()
    parts: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["rank"])):
        parts.setdefault(r["lang"], []).append(r["piece"])
    return tuple((lang, "\n".join(p)) for lang, p in sorted(parts.items()))


def automaton(symbols: list[int], width: int) -> np.ndarray:
    """Transition table of the suffix automaton of ``symbols``.

    ``table[state * width + symbol]`` is ``(next_state * width) * 2 + restart``.
    A symbol that continues no phrase restarts from the root; the low bit marks
    each symbol that begins a phrase. ``PAD`` stays where it is.
    """
    goto: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for s in symbols:
        cur = len(goto)
        goto.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and s not in goto[p]:
            goto[p][s] = cur
            p = link[p]
        if p >= 0:
            q = goto[p][s]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                twin = len(goto)
                goto.append(dict(goto[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and goto[p].get(s) == q:
                    goto[p][s] = twin
                    p = link[p]
                link[q] = link[cur] = twin
        last = cur
    root = np.ones(width, np.int32 if len(goto) * width < 2**30 else np.int64)
    for s, to in goto[0].items():
        root[s] = to * width * 2 + 1
    table = np.tile(root, (len(goto), 1))
    for state, out in enumerate(goto):
        for s, to in out.items():
            table[state, s] = to * width * 2
    table[0] = root
    table[:, PAD] = np.arange(len(goto)) * width * 2
    return table.ravel()


class Parser:
    """Automata of all languages: one code for a letter of any text, and for each language the symbols it tells apart."""

    def __init__(self, model: tuple[tuple[str, str], ...]):
        counts = [Counter(c for c in text.lower() if c.isalpha()) for _, text in model]
        letters = sorted(set().union(*counts))
        self.codes = np.full(0x110000, GAP, np.uint16)
        self.unknown = FIRST + len(letters)
        for cp in range(0x30000):  # letters that no training text has still are letters
            if chr(cp).isalpha():
                self.codes[cp] = self.unknown
        for i, c in enumerate(letters):
            self.codes[ord(c)] = FIRST + i
        self.languages = [lang for lang, _ in model]
        self.tables, self.bits, self.symbols = [], [], []
        for (_, text), own in zip(model, counts, strict=True):
            symbols = self.encode(text)
            most = min(TABLE, TABLES // len(model))
            room = max(SHARED, most // (2 * len(symbols) + 2) - FIRST - SHARED - 1)
            kept = sorted(own, key=lambda c: (-own[c], c))[:room]
            # Codes to this language's symbols: its letters, shared symbols of its rare ones, one for all others.
            shared = SHARED if len(kept) < len(own) else 0
            to = np.full(self.unknown + 1, FIRST + len(kept) + shared, np.uint16)
            to[[PAD, GAP]] = PAD, GAP
            for c in own if shared else ():
                to[self.codes[ord(c)]] = FIRST + len(kept) + (ord(c) >> 8) % SHARED
            for i, c in enumerate(kept):
                to[self.codes[ord(c)]] = FIRST + i
            self.symbols.append(to)
            self.tables.append(automaton(to[symbols].tolist(), FIRST + len(kept) + shared + 1))
            self.bits.append(math.log2(len(symbols) + 2))

    def encode(self, text: str) -> np.ndarray:
        raw = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        s = self.codes[raw]
        if len(s) > 1:
            keep = np.ones(len(s), bool)
            keep[1:] = (s[1:] != GAP) | (s[:-1] != GAP)
            s = s[keep]
        return s

    def judge(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
        """Language, score between 0 and 1, and the winner's phrases per symbol."""
        lang, score, rate = [UNDETERMINED] * len(texts), [0.0] * len(texts), [1.0] * len(texts)
        todo: list[tuple[int, np.ndarray]] = []
        size = 0
        for i, t in enumerate(texts):
            if t and self.languages:
                s = self.encode(t)
                if (s >= FIRST).any():
                    todo.append((i, s))
                    size += len(s)
            if todo and (size > 3_000_000 or i == len(texts) - 1):
                self._parse(todo, lang, score, rate)
                todo, size = [], 0
        if todo:
            self._parse(todo, lang, score, rate)
        return lang, score, rate

    def _parse(self, todo, lang, score, rate) -> None:
        blocks = np.array([-(-len(s) // BLOCK) for _, s in todo])
        first = np.concatenate([[0], np.cumsum(blocks)])
        longest = BLOCK if (blocks > 1).any() else max(len(s) for _, s in todo)
        flat = np.zeros((first[-1], BLOCK), np.uint16)
        for k, (_, s) in enumerate(todo):
            flat[first[k] : first[k + 1]].reshape(-1)[: len(s)] = s
        steps = np.ascontiguousarray(flat.T[:longest])
        lengths = np.array([len(s) for _, s in todo])
        cost = np.empty((len(self.tables), len(todo)))
        for j, table in enumerate(self.tables):
            state = np.zeros(first[-1], table.dtype)
            begun = np.zeros(first[-1], np.int32)
            for symbols in self.symbols[j][steps]:
                got = table[state + symbols]
                begun += got & 1
                state = got >> 1
            phrases = np.add.reduceat(begun, first[:-1])
            cost[j] = phrases / lengths * self.bits[j]
        best = cost.argmin(axis=0)
        low = cost[best, np.arange(len(todo))]
        shares = np.exp(-SHARPNESS * (cost / low - 1)).sum(axis=0)
        for k, (i, _) in enumerate(todo):
            lang[i] = self.languages[best[k]]
            score[i] = float(1 / shares[k])
            rate[i] = float(low[k] / self.bits[best[k]])


def identify(
    docs: DataFrame,
    model: tuple[tuple[str, str], ...],
    text: str = "text",
    keep: list[str] | None = None,
) -> DataFrame:
    """Add ``lang_pred``, ``score`` and ``phrase_rate`` to every row.

    Null and empty texts and texts without a letter get ``und``, 0 and 1. With an
    empty model every text does. Rows of equal text get equal values; ties
    between languages go to the one that sorts first. Texts of any length are
    parsed whole; an empty table gives none. Other columns pass
    through; columns that have a new column's name are replaced.
    """
    fields = [
        T.StructField("lang_pred", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("phrase_rate", T.DoubleType()),
    ]
    return annotate(docs, [text], fields, lambda: remembered(Parser, model).judge, keep)


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    """Language of all ``documents``; nulls, empty and repeated texts as in ``identify``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = identify(docs, learn(docs), keep=["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "phrase_rate")
