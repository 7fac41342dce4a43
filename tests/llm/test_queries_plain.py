"""Results of registered queries against plain computations of the same rows."""

import hashlib
import io
import re
import wave
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.llm import chat_quotes, decontam, media, mixing

# --- quotations


def normal(text):
    return " ".join(re.findall(r"\w+", text.lower()))


def plain_replies(messages):
    """(turn, slot) that each message answers, by comparing normalised texts with all earlier messages."""
    held = []
    for turn, slot, text in messages:
        own, _ = chat_quotes.parse(text)
        parts = [own, *re.split(r"\n\s*\n", own), *own.split("\n"), *re.split(r"(?<=[.!?])\s+", own)]
        w = normal(own).split()
        held.append((turn, slot, {normal(p) for p in parts} - {""}, {tuple(w[i : i + 4]) for i in range(len(w) - 3)}))
    out = {}
    for turn, slot, text in messages:
        _, quotes = chat_quotes.parse(text)
        quotes = [(level, q) for level, q in quotes if normal(q)]
        outer = min((level for level, _ in quotes), default=0)
        best = None
        for level, q in quotes:
            if level != outer:
                continue
            w = normal(q).split()
            asked = [(0, normal(q))]
            asked += [(1, normal(p)) for p in [*q.split("\n"), *re.split(r"(?<=[.!?])\s+", q)] if normal(p) and normal(p) != normal(q)]
            asked += [(2, tuple(w[i : i + 4])) for i in range(len(w) - 3)]
            for how, key in asked:
                able = [(t, s) for t, s, texts, runs in held if t < turn and key in (runs if how == 2 else texts)]
                if able:
                    out.setdefault((turn, slot), []).append((how, key, max(able)))
        votes = {}
        for how, key, source in out.get((turn, slot), ()):
            votes.setdefault((how, source), set()).add(key)
        ranked = [(-how, len(keys) if how == 2 else 1, source) for (how, source), keys in votes.items()]
        best = max(ranked, default=(0, 0, None))[2]
        out[turn, slot] = best
    return out


def test_replies_match_plain_comparison(spark, tmp_path):
    import random

    rng = random.Random(11)
    words = [f"word{i}" for i in range(40)]
    rows, wants = [], {}
    for conv in range(12):
        messages = []
        for turn in range(14):
            own = "\n\n".join(" ".join(rng.choices(words, k=rng.randint(3, 9))) + "." for _ in range(rng.randint(1, 3)))
            quoted = ""
            if messages and rng.random() < 0.8:
                source = chat_quotes.parse(rng.choice(messages)[2])[0]
                cut = rng.choice([source, source.split("\n")[0], " ".join(source.split()[1:7]), "never said by anyone at all"])
                level = rng.choice(["> ", "> > "])
                quoted = "\n".join(level + line for line in cut.split("\n")) + "\n"
                if rng.random() < 0.3:
                    quoted += "> unknown author said this once\n"
            messages.append((turn, 0, f"{quoted}{own}"))
        rows += [(conv, t, "u", text) for t, _, text in messages]
        wants |= {(conv, t): source for (t, _), source in plain_replies(messages).items()}
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    out = chat_quotes.op1_chat_quotes(spark, str(tmp_path)).collect()
    assert len(out) == len(rows) and sum(r["reply_to"] is not None for r in out) > 40
    for r in out:
        want = wants[r["conv_id"], r["turn"]]
        assert (r["reply_to"], r["reply_slot"]) == (want or (None, None)), r
    for conv in range(12):
        line = sorted((r["position"], r["thread"], r["turn"]) for r in out if r["conv_id"] == conv)
        assert [x[0] for x in line] == list(range(14)) and [x[1:] for x in line] == sorted(x[1:] for x in line)


def test_an_unknown_outer_quote_answers_nobody(spark):
    rows = [(1, 0, "u", "root of it all"), (1, 1, "a", "> > root of it all\n> text of a stranger\nwell")]
    out = chat_quotes.link_quotations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).where("turn = 1").first()
    assert (out["reply_to"], out["thread"], out["n_quotes"], out["n_linked"]) == (None, 1, 2, 1)


# --- decontamination


def test_retrieval_misses_no_leak(spark, small):
    """All pairs of documents and items verified, without any retrieval."""
    larger = small.replace("sf0.001", "sf0.01")
    items = spark.read.parquet(f"{larger}/benchmark.parquet").collect()
    docs = spark.read.parquet(f"{larger}/documents.parquet").collect()
    index = decontam.Index(tuple((r["item_id"], r["text"]) for r in items), decontam.THRESHOLD)
    want = set()
    for d in docs:
        tokens = decontam.words(d["text"])
        runs = {n: {tuple(tokens[j : j + n]) for j in range(len(tokens) - n + 1)} for n in {min(decontam.SHINGLE, len(x.tokens)) for x in index.items}}
        for k, item in enumerate(index.items):
            q, a = index.verify(k, runs[min(decontam.SHINGLE, len(item.tokens))])
            together = (q * item.n_question + a * (len(item.tokens) - item.n_question)) / len(item.tokens)
            if min(q, a) >= decontam.OVERLAP or together >= decontam.OVERLAP and min(q, a) >= decontam.PARTLY:
                want.add((d["doc_id"], item.item_id))
    found = decontam.leaks(spark.read.parquet(f"{larger}/documents.parquet"), spark.read.parquet(f"{larger}/benchmark.parquet"))
    assert {(r["doc_id"], x["item_id"]) for r in found.collect() for x in r["leaks"]} == want and len(want) > 20


def test_odd_documents_and_items(spark):
    docs = spark.createDataFrame([(1, None, 1), (1, None, 1), (2, "", 2), (3, "x y z", 3)], "doc_id long, text string, leaks int")
    items = spark.createDataFrame([(1, None), (None, "x y z"), (2, "")], "item_id long, text string")
    out = decontam.leaks(docs, items)
    assert out.columns == ["doc_id", "text", "leaks"] and out.count() == 4
    assert decontam.leaks(docs, items.where("false")).where(F.size("leaks") > 0).isEmpty()
    assert decontam.leaks(docs.where("false"), items).isEmpty()


# --- mixing


def nearest_rates(w, p, goal):
    """Rates of least squared distance to 1 that meet the goal: projections in turn onto the plane and the nonnegative rates (Dykstra)."""
    a = p * w[:, None]
    b = p  # the distance is weighted by w, so a step along the plane's normal is p itself
    r, kept = np.ones(len(w)), np.zeros(len(w))
    inverse = np.linalg.pinv(a.T @ b)
    for _ in range(20_000):
        on_plane = r + b @ (inverse @ (goal - a.T @ r))
        r_next = np.maximum(0, on_plane + kept)
        kept = on_plane + kept - r_next
        if np.abs(r_next - r).max() < 1e-10:
            break
        r = r_next
    return r


def test_rates_match_a_plain_solution(spark):
    rng = np.random.default_rng(5)
    p = rng.dirichlet([0.3, 0.3, 0.3], 200)
    tokens = rng.integers(1, 50, 200)
    soft = spark.createDataFrame([(i, int(t), *map(float, x)) for i, (t, x) in enumerate(zip(tokens, p, strict=True))], "id int, tokens long, p_clean double, p_poor double, p_toxic double")
    targets = {"clean": 0.7, "poor": 0.25, "toxic": 0.05}
    pulls, log = mixing.fit_rates(soft, targets, tolerance=1e-6)
    got = np.array([r["rate"] for r in mixing.with_rates(soft, pulls).orderBy("id").collect()])
    want = nearest_rates(tokens / tokens.sum(), p, np.array(list(targets.values())))
    assert np.abs(got - want).max() < 2e-3 and not mixing.missed(log, targets)
    assert (got == 0).any() and (got > 1).any()


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_registered_rates_meet_the_targets(spark, small, size):
    where = small.replace("sf0.001", size)
    out = mixing.op5_mixing(spark, where).persist()
    total = out.agg(F.sum("tokens")).first()[0]
    rated = out.agg(*[(F.sum(F.col("rate") * F.col("tokens") * F.col(f"p_{d}")) / total).alias(d) for d in mixing.DOMAINS]).first()
    share = out.agg(*[(F.sum(F.col("tokens") * F.col(f"p_{d}")) / total).alias(d) for d in mixing.DOMAINS]).first()
    assert out.count() == spark.read.parquet(f"{where}/documents.parquet").count() and out.where("rate < 0").isEmpty()
    missed = out.first()["targets_missed"]
    for d, goal in mixing.TARGETS.items():
        within = abs(rated[d] - goal) <= 1.001 * mixing.TOLERANCE * (goal or share[d]) + 1e-9
        assert within != (d in missed)
    if size == "sf0.01":
        assert missed == ""
    out.unpersist()


# --- media


def test_registered_media_match_the_standard_library(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    extra = [(-1, None), (-2, ""), (-2, ""), (None, "é\x00RIFF"), (-3, "x" * 100_000)]
    texts = {(r["doc_id"], r["text"]) for r in docs} | set(extra)
    rows = media.op9_media_columns(spark, small).collect()
    assert len(rows) == len(docs) and {r["doc_id"] for r in rows} == {r["doc_id"] for r in docs}
    seen = {r["doc_id"]: r for r in rows}
    for doc_id, text in texts:
        raw = (text or "").encode()
        payload = raw + b" " * ((-len(raw)) % 192 or (192 if not raw else 0))
        out = io.BytesIO()
        with wave.open(out, "wb") as w:
            w.setnchannels(1)
            w.setsampwidth(1)
            w.setframerate(8000)
            w.writeframes(payload)
        stored = media.wav_of(media.payload_of(text)[1])
        with wave.open(io.BytesIO(stored)) as w:
            assert w.readframes(w.getnframes()) == payload
        assert stored == out.getvalue()
        if doc_id in seen:
            r = seen[doc_id]
            assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
            assert (r["tail_crc32"], r["media_bytes"], r["media_sha256"]) == (zlib.crc32(payload[-16:]), len(stored), hashlib.sha256(stored).hexdigest())
            s = [b for b in payload]
            assert f"|sum={sum(s)}|" in r["feature"] and f"|peak={max(s)}|" in r["feature"]
            assert r["media_type"] == "audio/wav" and r["corrected"] == (len(raw) % 2 == 1)


def test_media_of_odd_rows(spark, tmp_path):
    rows = [(1, None, "a"), (1, "", "b"), (None, "x", "c"), (2, "x", "d")]
    spark.createDataFrame(rows, "doc_id long, text string, media string").write.parquet(f"{tmp_path}/documents.parquet")
    out = media.op9_media_columns(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"] or -1, r["n_bytes"]) for r in out) == [(-1, 1), (1, 0), (1, 0), (2, 1)]
    assert len({(r["payload_sha256"], r["feature"], r["media_sha256"]) for r in out if r["n_bytes"] == 1}) == 1


# --- stages of the pipeline


def test_stages_with_odd_rows(spark, small):
    """Nulls, empty and repeated rows, no rows, and columns with clashing names pass every stage."""
    import corpus_pipeline

    text = "the of and to is that this with " * 30
    rows = [(1, text, "en", 7), (1, text, "en", 7), (None, text + " more", "en", 7), (2, None, None, None), (3, "", "de", 0), (4, "12 34", None, 5), (5, "password = hunter22abc and more words", "en", 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long")
    for extra in ("score", "leaks", "secrets", "tokens", "row", "kept"):
        docs = docs.withColumn(extra, F.lit(extra))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, small)
        assert out.columns == docs.columns and out.where("leaks <> 'leaks' OR score <> 'score' OR secrets <> 'secrets'").isEmpty(), name
        assert 0 < out.count() <= 7
        assert stage(spark, docs.where("false"), small).isEmpty()
    out = corpus_pipeline.STAGES[-1][1](spark, docs, small)
    assert out.count() == 7 and out.where("rate IS NULL OR rate < 0").isEmpty()
    assert corpus_pipeline.STAGES[-1][1](spark, docs.where("false"), small).isEmpty()
    clean = corpus_pipeline.secret_stage(spark, docs, small).where("doc_id = 5").first()
    assert "hunter22abc" not in clean["text"] and clean["n_chars"] == len(clean["text"])
