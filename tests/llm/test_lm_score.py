"""Stupid-backoff scores against plain counts."""

import collections
import math

import pytest

from tracewell.llm import lm_score

SCHEMA = "doc_id long, text string"


def words(text):
    return (text or "").encode().lower().split()


def plain_scores(texts, order, min_count=2, alpha=0.4):
    """log S of each text, by dictionaries of all n-grams."""
    counts = collections.Counter()
    for text in texts:
        w = words(text)
        for n in range(1, order + 1):
            counts.update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    total = sum(c for g, c in counts.items() if len(g) == 1)

    def log_s(gram):
        if len(gram) == 1:
            return math.log(counts[gram] / total)
        if counts[gram] >= min_count:
            return math.log(counts[gram] / counts[gram[:-1]])
        return math.log(alpha) + log_s(gram[1:])

    return [sum(log_s(tuple(w[max(0, i - order + 1) : i + 1])) for i in range(len(w))) for w in map(words, texts)]


@pytest.mark.parametrize("order", [2, 3])
@pytest.mark.parametrize("hot", [0, 300])
def test_scores_match_plain_counts(spark, small, order, hot):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    docs = docs.union(spark.createDataFrame([(-1, None), (-2, ""), (-3, "the " * 30_000), (-4, "the"), (-5, "Two words"), (-6, "nowhere else")], SCHEMA))
    got = {r["doc_id"]: r for r in lm_score.lm_scores(docs, order=order, vocabulary=150, hot_grams=max(hot, 1), sample_rows=100, rows_per_part=20_000).collect()}
    rows = docs.collect()
    for r, want in zip(rows, plain_scores([r["text"] for r in rows], order), strict=True):
        out = got[r["doc_id"]]
        assert out["log_score"] == pytest.approx(want, abs=1e-5) and out["n_tokens"] == len(words(r["text"]))
        assert out["mean_log_score"] == (pytest.approx(want / out["n_tokens"], abs=1e-5) if out["n_tokens"] else None)
    assert len(got) == len(rows)


def test_repeated_and_null_ids_and_clashing_columns(spark):
    texts = [(1, "a b c"), (1, "a b c"), (1, "c b"), (None, "b c"), (None, None), (2, "\n")]
    docs = spark.createDataFrame([(*r, 5, "x", -1.0) for r in texts], "doc_id long, text string, doc int, key string, value double")
    out = lm_score.lm_scores(docs).collect()
    want = plain_scores([t for _, t in texts], 2)
    assert sorted((r["doc_id"] or 0, r["n_tokens"], round(r["log_score"], 5)) for r in out) == sorted(
        (i or 0, len(words(t)), round(s, 5)) for (i, t), s in zip(texts, want, strict=True)
    )
    assert out[0].asDict().keys() == {"doc_id", "n_tokens", "log_score", "mean_log_score"}


def test_scores_of_nothing(spark):
    assert lm_score.lm_scores(spark.createDataFrame([], SCHEMA)).count() == 0
    with pytest.raises(ValueError):
        lm_score.lm_scores(spark.createDataFrame([], SCHEMA), order=4)


def test_one_exchange_serves_table_and_rows(spark, small):
    """The exploded n-grams cross the network once: counts are taken and joined where they lie."""
    import re

    plan = []
    keep = lm_score.Scratch.table

    def table(self, df):
        plan.append(df._jdf.queryExecution().toString())
        return keep(self, df)

    lm_score.Scratch.table = table
    try:
        lm_score.lm_scores(spark.read.parquet(f"{small}/documents.parquet")).count()
    finally:
        lm_score.Scratch.table = keep
    physical = plan[-1][plan[-1].index("== Physical Plan ==") :]
    assert "ShuffledHashJoin" in physical and len(re.findall(r"REPARTITION_BY_NUM", physical)) in (1, 2)
