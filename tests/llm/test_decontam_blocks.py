"""Benchmark items in several blocks."""

import pytest
from pyspark.sql import functions as F

from tracewell.llm import decontam


def test_blocks_keep_columns_and_scores(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    items = spark.read.parquet(f"{small}/benchmark.parquet")

    def found(out):
        return {(r["doc_id"], x["item_id"]): x["score"] for r in out.select("doc_id", "leaks").collect() for x in r["leaks"]}

    blocks = decontam.leaks(docs, items, max_items=15)
    assert blocks.columns == [*docs.columns, "leaks"] and decontam.leaks(docs, items, keep=["doc_id"], max_items=15).columns == ["doc_id", "leaks"]
    whole = found(decontam.leaks(docs, items))
    assert items.count() > 15 and whole and found(blocks) == pytest.approx(whole)


def test_a_question_without_its_answer_is_no_leak(spark):
    question = " ".join(f"word{i}" for i in range(24))
    items = spark.createDataFrame([(1, f"{question}\nfour words of answer")], "item_id long, text string")
    texts = [f"x {question} y", f"x {question} four words of answer y", f"{question} four words for answer", f"{question} four", "four words of answer " * 9]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"] for r in decontam.leaks(docs, items).collect() if r["leaks"]} == {1, 2}


def test_one_block_at_a_time(spark, small, monkeypatch):
    """The driver makes the closure of a block after the job of the one before has ended; repeated rows and items stay."""
    items = spark.read.parquet(f"{small}/benchmark.parquet")
    items = items.union(items)
    docs = spark.read.parquet(f"{small}/documents.parquet").withColumn("__text", F.lit("own"))
    docs = docs.union(docs)
    events, screener, table = [], decontam._screener, decontam.Scratch.table
    monkeypatch.setattr(decontam, "_screener", lambda rows, *a: (events.append(("rows", len(rows))), screener(rows, *a))[1])
    monkeypatch.setattr(decontam.Scratch, "table", lambda self, df: (table(self, df), events.append(("job", 0)))[0])
    out = decontam.leaks(docs, items, max_items=15)
    made = [e for e in events if e[0] == "rows"]
    assert len(made) == -(-items.count() // 15) and sum(n for _, n in made) == items.count()
    assert all(events[i + 1][0] == "job" for i, e in enumerate(events) if e[0] == "rows")
    whole = decontam.leaks(docs, items)
    assert out.columns == whole.columns
    rows = lambda df: sorted((r["doc_id"], r["__text"], sorted((x["item_id"], round(x["score"], 9)) for x in r["leaks"])) for r in df.collect())
    assert rows(out) == rows(whole)
