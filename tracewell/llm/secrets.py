"""Secret scanning: fixed patterns, and a linear-chain CRF that adds spans.

The CRF tags every token of a text as begin, inside or outside of a secret. A
token is a run of letters and digits, or a run of one mark; a line's tokens are
one chain, outside at both borders. Features are a token's shape, the words and
marks around it, whether a word that announces secrets stands before it, and
features of the file. The values that the fixed patterns find are the training
labels, so that the model learns what secrets look like and where they stand,
and finds others of that kind; in training, groups of features are left out at
random, so that shape and neighbourhood each can tell.

Features are computed for all tokens of a batch of texts in array arithmetic.
Viterbi is exact and yet short: where being outside beats everything else by
more than any change of transitions could win back, the best path is outside,
and the chain falls apart into parts that are decoded one by one.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm.common import annotate, hash_sample
from tracewell.llm.minhash import mix

KINDS = ("assign", "access", "hex", "crf")
MIN_VALUE, MIN_ACCESS, MIN_HEX = 6, 20, 24

_ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
_HEX_BYTES = bytes(49 if c in b"0123456789abcdef" else 48 for c in range(256))

#: Tags, and the words that tell of a secret to come.
OUT, BEGIN, INSIDE = 0, 1, 2
HINTS = tuple("password passwd pwd pass passphrase secret token key apikey api auth authorization bearer credential credentials private access".split())

#: Bounds of the training sample: documents, windows of a chain for each kind of window, tokens of a window.
SAMPLE_ROWS, SAMPLE_WINDOWS, WINDOW = 4000, 3008, 48
DEALS = 16  # windows are ranked in so many parts
EPOCHS, BATCH = 12, 128
WEIGHTS = 1 << 16
SLICE_CHARS = 200_000

# Classes of characters.
SPACE, LOWER, UPPER, DIGIT, OTHER, MARK = range(6)
_CLASS = np.full(128, MARK, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = SPACE
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = LOWER, UPPER, DIGIT
_VOWEL = np.zeros(128, bool)
_VOWEL[[ord(c) for c in "aeiouyAEIOUY"]] = True
_NON_HEX = np.ones(128, bool)
_NON_HEX[48:58] = _NON_HEX[97:103] = False


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Matches of the fixed patterns, by start and then in the order of ``KINDS``."""
    spans = []
    lowered = text.lower()
    if "pass" in lowered or "secret" in lowered or "token" in lowered or "key" in lowered:
        spans += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= MIN_VALUE]
    if "AKIA" in text:
        spans += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= MIN_ACCESS]
    if b"1" * MIN_HEX in text.encode("utf-8", "surrogatepass").translate(_HEX_BYTES):
        spans += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def secret_values(text: str) -> list[tuple[int, int]]:
    """Where the secrets themselves stand in the matches of the fixed patterns: the training labels."""
    found = [(m.start(2), m.end(2)) for m in _ASSIGN.finditer(text) if len(m[2]) >= MIN_VALUE]
    return sorted({*found, *((s, e) for k, s, e in base_spans(text) if k != "assign")})


def word_id(word: str) -> int:
    return int(_ids(np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.uint64), np.arange(len(word)), np.array([0]))[0])


def _ids(chars: np.ndarray, place: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(mix(chars + np.uint64(1)) * (2 * place.astype(np.uint64) + np.uint64(1)), starts)


_HINT_IDS = np.sort(np.array([word_id(w) for w in HINTS], np.uint64))


class Tokens:
    """All tokens of some texts: where they stand, their lines, and an index of weights for each feature.

    ``files`` has what the features say of whole files, where ``texts`` are
    parts of such: for each text a row of ``facts``.
    """

    def __init__(self, texts: list[str], files: np.ndarray | None = None):
        raw = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        ascii_ = np.minimum(raw, 127)
        kind = np.where(raw < 128, _CLASS[ascii_], OTHER).astype(np.uint8)
        filled, mark = kind != SPACE, kind == MARK
        same = np.zeros(len(raw), bool)  # goes on with the token of the character before
        same[1:] = filled[1:] & filled[:-1] & np.where(mark[1:], raw[1:] == raw[:-1], ~mark[:-1])
        first = filled & ~same
        self.start = np.flatnonzero(first)
        n = len(self.start)
        border = np.append(np.flatnonzero(~same), len(raw))
        self.end = border[np.searchsorted(border, self.start) + 1] if n else self.start
        begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
        self.doc = np.searchsorted(begins, self.start, "right") - 1
        self.start_in, self.end_in = self.start - begins[self.doc], self.end - begins[self.doc]
        self.line = np.cumsum(raw == 10)[self.start]
        #: Of each text: tokens, those with a digit, and those that announce a secret.
        self.facts = np.zeros((len(texts), 3), np.int64)
        if not n:
            self.indices = []
            return

        def total(x):
            return np.add.reduceat(x, self.start, dtype=np.int64)

        size = self.end - self.start
        lower, upper, digit, other = (total(kind == k) for k in (LOWER, UPPER, DIGIT, OTHER))
        is_mark = mark[self.start]
        turn = np.zeros(len(raw), bool)
        turn[1:] = same[1:] & (kind[1:] != kind[:-1])
        turns = np.minimum(total(turn), 7)
        plain_hex = total(_NON_HEX[ascii_] & filled) == 0
        vowels = total(_VOWEL[ascii_] & filled)
        token = np.maximum(np.cumsum(first) - 1, 0)
        low = raw + np.where(kind == UPPER, np.uint32(32), np.uint32(0))
        chars = np.where(filled, low, 0).astype(np.uint64)
        ids = mix(_ids(np.where(filled, chars, np.uint64(0xFFFFFFFFFFFFFFFF)), np.arange(len(raw)) - self.start[token], self.start))
        long = np.searchsorted(np.array([2, 3, 4, 6, 8, 12, 16, 20, 24, 32, 40, 64]), size, "right").astype(np.uint64)
        shape = (is_mark * 16 + (lower > 0) * 8 + (upper > 0) * 4 + (digit > 0) * 2 + (other > 0)).astype(np.uint64)
        # What neighbours see of a token: the word, the mark, or of anything with a digit its shape.
        seen = np.where(digit > 0, mix(shape * np.uint64(64) + long), ids)
        glued = np.zeros(n, np.uint64)
        glued[1:] = self.start[1:] == self.end[:-1]

        def near(x, k, none=np.uint64(7)):
            """The value ``k`` tokens on, within the line."""
            out = np.full(n, none)
            if k < 0:
                out[-k:] = np.where(self.line[-k:] == self.line[:k], x[:k], none)
            else:
                out[:-k] = np.where(self.line[:-k] == self.line[k:], x[k:], none)
            return out

        hint = np.isin(ids, _HINT_IDS) | np.isin(ids, mix(_HINT_IDS))
        hinted = np.zeros(n, np.uint64)
        for k in range(1, 6):
            hinted |= near(hint.astype(np.uint64), -k, np.uint64(0))
        before, after = near(seen, -1), near(seen, 1)
        marks = near(np.where(is_mark, ids, np.uint64(3)), -1) ^ near(np.where(is_mark, ids, np.uint64(5)), -2) * np.uint64(3)
        for k, x in enumerate((None, digit > 0, hint)):
            self.facts[:, k] = np.bincount(self.doc, x, len(texts))
        per_doc, digits, hints = (self.facts if files is None else files).T
        doc_hint = hints > 0
        doc_digit = np.searchsorted([0.01, 0.05, 0.2, 0.5], digits / np.maximum(per_doc, 1))
        doc_size = np.minimum(np.frexp(np.maximum(per_doc, 1))[1] // 3, 5)
        share = (digit * 5 // size).astype(np.uint64)
        vowel_share = (vowels * 6 // size).astype(np.uint64)
        word = shape * np.uint64(16) + long
        values = [
            # shape
            word,
            np.minimum(size, 80).astype(np.uint64),
            (share * np.uint64(2) + plain_hex) * np.uint64(16) + long,
            vowel_share * np.uint64(16) + long,
            turns.astype(np.uint64) * np.uint64(16) + long,
            # the word itself and its neighbours
            np.where(digit > 0, np.uint64(1), ids),
            before,
            near(seen, -2),
            after,
            near(seen, 2),
            before * np.uint64(2) + glued,
            near(glued, 1, np.uint64(0)) + np.uint64(2) * (after & np.uint64(0xFFFFFFFF)),
            # what announces a secret
            hinted,
            hinted * np.uint64(1 << 40) + marks % np.uint64(1 << 40),
            hinted * np.uint64(4096) + word,
            # the file
            doc_hint[self.doc].astype(np.uint64) * np.uint64(64) + doc_digit[self.doc].astype(np.uint64) * np.uint64(8) + np.uint64(1),
            doc_size[self.doc].astype(np.uint64),
            np.zeros(n, np.uint64),
        ]
        self.indices = [(mix(v + np.uint64((k + 1) << 50)) % np.uint64(WEIGHTS)).astype(np.int32) for k, v in enumerate(values)]


#: Features that training leaves out together.
GROUPS = (range(5), range(5, 12), range(12, 15))


class Crf:
    """Weights of three tags for each feature index, and the 3 x 3 transitions; a line's borders are outside."""

    def __init__(self, w: np.ndarray, trans: np.ndarray):
        self.w, self.trans = np.asarray(w, np.float32), np.asarray(trans, np.float64)
        t = self.trans.copy()
        t[OUT, INSIDE] = -np.inf
        self.table = t.tolist()
        # The most that transitions can win if one token is not outside: alone, and with an inside token after it.
        alone = [t[p, x] + t[x, q] - t[p, OUT] - t[OUT, q] for p in range(3) for x in (BEGIN, INSIDE) for q in (OUT, BEGIN)]
        led = [t[p, x] + t[x, INSIDE] + t[INSIDE, r] - t[p, OUT] - t[OUT, BEGIN] - t[BEGIN, r] for p in range(3) for x in (BEGIN, INSIDE) for r in range(3)]
        self.alone, self.led = max(alone), max(led)

    def emissions(self, indices: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(indices[0]) if indices else 0, 3), np.float32)
        for i in indices:
            out += self.w[i]
        return out

    def surely_outside(self, e: np.ndarray, line: np.ndarray) -> np.ndarray:
        """Tokens that every best path leaves outside."""
        lead = e[:, OUT] - np.maximum(e[:, BEGIN], e[:, INSIDE])
        turn = np.full(len(e), -np.inf)
        turn[:-1] = np.where(line[1:] == line[:-1], self.led + np.maximum(e[1:, INSIDE] - e[1:, BEGIN], 0), -np.inf)
        return lead > np.maximum(self.alone, turn) + 1e-3

    def decode(self, e: list[list[float]]) -> list[int]:
        """Viterbi between two outside tokens; ties go to the lower tag."""
        t = self.table
        best, back = [t[OUT][s] + e[0][s] for s in range(3)], []
        for row in e[1:]:
            step, now = [], []
            for s in range(3):
                options = [best[r] + t[r][s] for r in range(3)]
                r = max(range(3), key=options.__getitem__)
                step.append(r)
                now.append(options[r] + row[s])
            back.append(step)
            best = now
        s = max(range(3), key=lambda s: best[s] + t[s][OUT])
        tags = [s]
        for step in reversed(back):
            s = step[s]
            tags.append(s)
        return tags[::-1]

    def tag(self, tokens: Tokens) -> np.ndarray:
        """The best tags of all lines."""
        tags = np.zeros(len(tokens.start), np.int8)
        if not len(tags):
            return tags
        e = self.emissions(tokens.indices)
        open_ = np.flatnonzero(~self.surely_outside(e, tokens.line))
        if len(open_):
            cut = np.flatnonzero((np.diff(open_) > 1) | (np.diff(tokens.line[open_]) > 0)) + 1
            for part in np.split(open_, cut):
                tags[part] = self.decode(e[part].astype(np.float64).tolist())
        return tags


UNTRAINED = Crf(np.zeros((WEIGHTS, 3)), [[9, -9, -9], [0, 0, 0], [0, 0, 0]])


def train(chains: list[tuple[np.ndarray, np.ndarray]], epochs: int = EPOCHS, rate: float = 0.2, decay: float = 1e-3, dropout: float = 0.2) -> Crf:
    """Maximum likelihood by AdaGrad over (features x tokens, tags) of windows, in a fixed order."""
    if not any((t == BEGIN).any() for _, t in chains):
        return UNTRAINED
    slots = chains[0][0].shape[0]
    w, t = np.zeros((WEIGHTS + 1, 3)), np.zeros((3, 3))  # the last row stands for what is left out
    seen_w, seen_t = np.full(w.shape, 1e-6), np.full((3, 3), 1e-6)
    closed = np.zeros((3, 3))
    closed[OUT, INSIDE] = -1e9
    rng = np.random.default_rng(7)
    by_size = sorted(range(len(chains)), key=lambda c: chains[c][0].shape[1])
    batches = [by_size[i : i + BATCH] for i in range(0, len(by_size), BATCH)]
    for _ in range(epochs):
        for b in rng.permutation(len(batches)):
            some = [chains[c] for c in batches[b]]
            n, wide = len(some), max(f.shape[1] for f, _ in some)
            index, tags, real = np.full((n, wide, slots), WEIGHTS), np.zeros((n, wide), np.int64), np.zeros((n, wide), bool)
            for i, (f, y) in enumerate(some):
                index[i, : f.shape[1]], tags[i, : len(y)], real[i, : len(y)] = f.T, y, True
            for group in GROUPS:
                index[np.ix_(rng.random(n) < dropout, range(wide), group)] = WEIGHTS
            e = w[index].sum(axis=2)
            move = t + closed
            stay = np.where(np.eye(3, dtype=bool), 0.0, -1e9)
            fwd, bwd = np.zeros((n, wide, 3)), np.zeros((n, wide, 3))
            fwd[:, 0] = move[OUT] + e[:, 0]
            for i in range(1, wide):
                step = np.where(real[:, i, None, None], move, stay)
                fwd[:, i] = np.logaddexp.reduce(fwd[:, i - 1, :, None] + step, axis=1) + np.where(real[:, i, None], e[:, i], 0)
            bwd[:, -1] = move[:, OUT]
            for i in range(wide - 2, -1, -1):
                step = np.where(real[:, i + 1, None, None], move, stay)
                ahead = np.where(real[:, i + 1, None], e[:, i + 1], 0) + bwd[:, i + 1]
                bwd[:, i] = np.logaddexp.reduce(step + ahead[:, None, :], axis=2)
            z = np.logaddexp.reduce(fwd[:, 0] + bwd[:, 0], axis=1)
            g = np.exp(fwd + bwd - z[:, None, None])
            grad_t = g[:, 0].sum(axis=0)[None, :] * np.eye(3)[OUT][:, None]
            last = real.sum(axis=1) - 1
            grad_t += g[np.arange(n), last].sum(axis=0)[:, None] * np.eye(3)[OUT][None, :]
            inner = real[:, 1:]
            pair = np.exp(fwd[:, :-1, :, None] + move + (e + bwd)[:, 1:, None, :] - z[:, None, None, None])
            grad_t += pair[inner].sum(axis=0)
            rows = np.arange(n)
            np.subtract.at(grad_t, (OUT, tags[:, 0]), 1)
            np.subtract.at(grad_t, (tags[rows, last], OUT), 1)
            np.subtract.at(grad_t, (tags[:, :-1][inner], tags[:, 1:][inner]), 1)
            g -= np.eye(3)[tags]
            g[~real] = 0
            flat = index.reshape(-1)
            grad = np.stack([np.bincount(flat, np.repeat(g[:, :, s].reshape(-1), slots), WEIGHTS + 1) for s in range(3)], axis=1) / n + decay * w
            grad[WEIGHTS] = 0
            seen_w += grad * grad
            w -= rate * grad / np.sqrt(seen_w)
            seen_t += (grad_t / n) ** 2
            t -= rate * (grad_t / n) / np.sqrt(seen_t)
    return Crf(w[:WEIGHTS].round(5), t.round(5))


def labelled(tokens: Tokens, texts: list[str]) -> np.ndarray:
    """Tags of tokens by the fixed patterns' values."""
    tags = np.zeros(len(tokens.start), np.int8)
    edges = np.searchsorted(tokens.doc, np.arange(len(texts) + 1))
    for d, text in enumerate(texts):
        at = tokens.end_in[edges[d] : edges[d + 1]]
        for s, e in secret_values(text):
            low = edges[d] + np.searchsorted(at, s, "right")
            high = edges[d] + np.searchsorted(tokens.start_in[edges[d] : edges[d + 1]], e)
            if high > low:
                tags[low:high] = INSIDE
                tags[low] = BEGIN
    return tags


def windows(text: str) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(kind of window, features x tokens, tags): around each label, around two other tokens with a digit, and two of plain words."""
    tokens = Tokens([text])
    n = len(tokens.start)
    if not n:
        return []
    tags = labelled(tokens, [text])
    all_ = np.stack(tokens.indices)
    digit = np.array([any(c.isdigit() for c in text[s:e]) for s, e in zip(tokens.start_in, tokens.end_in, strict=True)])
    order = mix(tokens.indices[5].astype(np.uint64) + np.arange(n).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).argsort()
    picks = [(0, i) for i in np.flatnonzero(tags == BEGIN)]
    for kind, able in ((1, digit & (tags == OUT)), (2, ~digit & (tags == OUT))):
        picks += [(kind, i) for i in order[able[order]][:2]]
    out = []
    for kind, i in picks:
        low, high = np.searchsorted(tokens.line, [tokens.line[i], tokens.line[i] + 1])
        low, high = max(low, i - WINDOW // 2), min(high, i + WINDOW // 2)
        while tags[low] == INSIDE:  # a window begins outside a secret or with its first token
            low += 1
        out.append((kind, all_[:, low:high], tags[low:high]))
    return out


def learn(docs: DataFrame, text: str = "text", key: str = "doc_id", sample_rows: int = SAMPLE_ROWS, sample_windows: int = SAMPLE_WINDOWS) -> Crf:
    """Fit the CRF on windows of at most ``sample_rows`` documents with a digit, drawn by a hash of ``key`` and text.

    Texts are turned into windows on the executors; of each of the three kinds
    the driver gets at most ``sample_windows``, by a hash. Without any label,
    nothing is tagged.
    """
    some = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.col("text").rlike("[0-9]"))
    some = hash_sample(some, sample_rows, "key", "text").select("text")
    row = T.StructType([T.StructField("k", T.IntegerType()), T.StructField("f", T.ArrayType(T.IntegerType())), T.StructField("t", T.ArrayType(T.IntegerType()))])

    def make():
        return lambda texts: ([[{"k": k, "f": f.ravel().tolist(), "t": t.tolist()} for k, f, t in windows(x)] for x in texts],)

    found = annotate(some, ["text"], [T.StructField("w", T.ArrayType(row))], make, keep=[], slice_rows=64).select(F.explode("w").alias("w")).select("w.*")
    drawn = found.withColumn("hash", F.xxhash64("f", "t")).withColumn("deal", F.pmod("hash", F.lit(DEALS)))
    rank = F.row_number().over(Window.partitionBy("k", "deal").orderBy("hash"))
    rows = drawn.withColumn("rank", rank).where(F.col("rank") <= -(-sample_windows // DEALS)).select("f", "t").toArrow().to_pylist()
    chains = [(np.array(r["f"], np.int32).reshape(-1, len(r["t"])), np.array(r["t"])) for r in rows if r["t"]]
    chains.sort(key=lambda c: (c[0].shape[1], c[0].tobytes()))
    return train(chains)


def parts_of(text: str) -> list[str]:
    """A text in parts of at most ``SLICE_CHARS`` code points that end where a line does; only a longer line makes a longer one."""
    out, at = [], 0
    while len(text) - at > SLICE_CHARS:
        end = text.rfind("\n", at, at + SLICE_CHARS) + 1 or text.find("\n", at) + 1 or len(text)
        out.append(text[at:end])
        at = end
    return [*out, text[at:]]


def crf_spans(texts: list[str], crf: Crf, files: np.ndarray | None = None) -> list[list[tuple[str, int, int]]]:
    """The spans that the CRF tags in each text."""
    tokens = Tokens(texts, files)
    tags = crf.tag(tokens)
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    begin = np.flatnonzero(tags == BEGIN)
    stop = np.flatnonzero((tags == INSIDE) & np.append(tags[1:] != INSIDE, True)) if len(tags) else begin
    for i in begin:
        k = np.searchsorted(stop, i)
        j = int(stop[k]) if i + 1 < len(tags) and tags[i + 1] == INSIDE else int(i)
        out[int(tokens.doc[i])].append(("crf", int(tokens.start_in[i]), int(tokens.end_in[j])))
    return out


def long_text_spans(text: str, crf: Crf) -> list[tuple[str, int, int]]:
    """``crf_spans`` of one text, some lines at a time: lines are chains of their own, and what is said of the file is summed first."""
    parts = parts_of(text)
    files = sum(Tokens([p]).facts for p in parts)
    out, at = [], 0
    for part in parts:
        out += [(k, s + at, e + at) for k, s, e in crf_spans([part], crf, files)[0]]
        at += len(part)
    return out


def find_all(texts: list[str], crf: Crf) -> list[tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]]:
    """(spans of the fixed patterns, all spans) of each text: the CRF adds those of ``MIN_VALUE`` characters that overlap none of the former."""
    out, at = [], 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) <= SLICE_CHARS):
            size += len(texts[to])
            to += 1
        some = texts[at:to]
        added = crf_spans(some, crf) if size <= SLICE_CHARS else [long_text_spans(some[0], crf)]
        for text, tagged in zip(some, added, strict=True):
            base = base_spans(text)
            more = [c for c in tagged if c[2] - c[1] >= MIN_VALUE]
            if more and base:
                ends = np.maximum.accumulate([e for _, _, e in base])
                starts = np.array([s for _, s, _ in base])
                # The spans that begin before an added one ends: does the farthest of them reach into it?
                upto = [int(np.searchsorted(starts, e)) for _, _, e in more]
                more = [c for c, k in zip(more, upto, strict=True) if not k or ends[k - 1] <= c[1]]
            out.append((base, sorted(base + more, key=lambda s: (s[1], KINDS.index(s[0]), s[2])) if more else base))
        at = to
    return out


def find(text: str, crf: Crf):
    return find_all([text], crf)[0]


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def redact(text: str, spans: list[tuple[str, int, int]], mark: str = "[SECRET]") -> str:
    """The text with each maximal overlap of spans replaced by ``mark``."""
    out, at, end = [], 0, -1
    for _, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= end:
            out += [text[at:s] if s > at else "", mark]
        at = end = max(end, e)
    return "".join([*out, text[at:]])


SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])


def scan(docs: DataFrame, crf: Crf, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``secrets`` (array of kind, start, end in code points) and ``redacted``.

    A null text has no secrets and stays null when redacted; an empty one has
    none. Equal texts get equal spans. Texts are read whole, whatever their
    length or the number of spans. Spans of two fixed patterns may overlap, added
    ones overlap none. Columns named like the new ones are replaced; an empty
    table gives none.
    """
    fields = [T.StructField("secrets", T.ArrayType(SPAN)), T.StructField("redacted", T.StringType())]

    def make():
        def run(texts):
            spans, clean = [], []
            for t, (_, found) in zip(texts, find_all([t or "" for t in texts], crf), strict=True):
                spans.append([{"kind": k, "start": s, "end": e} for k, s, e in found])
                clean.append(redact(t, found) if found else t)
            return spans, clean

        return run

    return annotate(docs, [text], fields, make, keep)


def op4_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Spans of all ``documents``; nulls, empty and repeated texts as in ``scan``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = scan(docs, learn(docs), keep=["doc_id"])
    base = F.filter("secrets", lambda s: s["kind"] != "crf")

    def text_of(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        count("assign"),
        count("access"),
        count("hex"),
        F.sha2(text_of(base), 256).alias("base_sha256"),
        text_of(F.col("secrets")).alias("spans"),
        count("crf"),
    )
