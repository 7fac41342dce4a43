"""Spelling variants against comparison of all pairs."""

import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracewell.llm import spelling
from tracewell.llm.common import Scratch


def letters(text):
    out, run = [], ""
    for c in (text or "") + " ":
        if "a" <= c.lower() <= "z" and c.isascii() or 0xC0 <= ord(c) <= 0xFF:
            run += c.lower() if c.isascii() else c
        elif run:
            out.append(run)
            run = ""
    return out


def near(u, v):
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v, strict=True)) == 1
    if len(u) > len(v):
        u, v = v, u
    return len(v) == len(u) + 1 and any(v[:i] + v[i + 1 :] == u for i in range(len(v)))


def plain(rows):
    n = {}
    for doc, text in rows:
        for run in letters(text):
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] = n.get(run, 0) + 1
    n = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}
    out, form = {}, {}
    for w in n:
        by = [x for x in n if x != w and near(w, x)]
        best = min(by, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
        out[w] = len(by)

    def root(w):
        return w if form[w] is None else root(form[w])

    return {(w, n[w], out[w], form[w], n.get(form[w]), root(w)) for w in n}


def found(df):
    rows = [(r["word"], r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_variants_match_all_pairs(spark):
    rng = random.Random(3)
    stems = ["letter", "latter", "lettre", "aaaaa", "aaaaaa", "éclair", "Éclair", "straße", "abcde"]
    rows = []
    for doc in range(60):
        words = []
        for _ in range(60):
            w = rng.choice(stems)
            if rng.random() < 0.3:
                i = rng.randrange(len(w))
                w = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("aetÿ") + w[i:], w[:i] + rng.choice("aetÿ") + w[i + 1 :]])
            words.append(rng.choice([w, w.upper() if w.isascii() else w]))
        rows.append((doc, rng.choice([" ", "1", "\n", "×"]).join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain(rows)
    assert len({r[5] for r in want}) > 3 and any(r[3] for r in want)
    assert found(spelling.spelling_variants(df)) == want


def test_odd_rows_and_clashing_columns(spark):
    long = "".join(random.Random(5).choice("abcdefgh") for _ in range(1500))
    other, shorter = long[:700] + "z" + long[701:], long[:300] + long[301:]
    boundary = long[:256], long[:255], long[:257]
    rows = [(None, "house house house hause"), (1, None), (1, ""), (1, "12 .. 3"), (2, "house mouse mouse mouse"), (2, "house mouse mouse mouse")]
    rows += [(10 + i, " ".join([long] * 3 + [other, shorter, *boundary, "q" * 5000, "q" * 5001])) for i in range(3)]
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "doc_id long, text string, n long, key int, word string")
    got = found(spelling.spelling_variants(df))
    assert got == plain(rows)
    assert {r[5] for r in got if r[0] in (other, shorter)} == {long}
    assert found(spelling.spelling_variants(df.where("false"))) == set()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abé", min_size=1, max_size=7), min_size=2, max_size=30, unique=True))
def test_words_of_one_key_count_each_near_word_once(words):
    by_key = {}
    for w in words:
        for key, at in zip(*spelling.keys(w), strict=True):
            by_key.setdefault(key, []).append((w, len(w), at))
    counts = dict.fromkeys(words, 0)
    best = {}
    for members in by_key.values():
        for w, n, best_n, other in spelling.near_within(members):
            counts[w] += n
            best[w] = min(best.get(w, (0, "")), (-best_n, other))
    for w in words:
        by = [x for x in words if near(w, x)]
        assert counts[w] == len(by)
        if by:
            assert best[w] == min((-len(x), x) for x in by)


@pytest.mark.parametrize("size", [255, 256, 257, 300])
def test_long_keys_are_those_of_the_remainders(size):
    word = "".join(random.Random(size).choice("abc") for _ in range(size))
    got = dict(zip(*reversed(spelling.keys(word)), strict=True))
    for at, key in got.items():
        rest = word if at < 0 else word[:at] + word[at + 1 :]
        assert spelling.keys(rest)[0][0] == key


def test_a_chain_of_forms_ends_in_one_root(spark):
    chain = [("w" + "a" * i, "w" + "a" * (i - 1) if i else None) for i in range(40)]
    df = spark.createDataFrame([c for c in chain if c[1]], "word string, form string")
    assert {r["root"] for r in spelling.resolve_roots(Scratch(spark), df).collect()} == {"w"}
    assert spelling.resolve_roots(Scratch(spark), df.where("false")).count() == 0


def test_registered_words_match_plain_counts(spark, small):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    assert found(spelling.op11_spelling_variants(spark, small)) == plain(rows)
