"""Quotations that are trimmed or wrapped anew, and rows that share a turn or have none."""

import pytest

from tracewell.llm import chat_quotes

CHATS = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize(
    ("original", "quote"),
    [
        ("l1\nl2\nl3", "> l1\n> l2"),
        ("We met. It rained all day! Then we left.", "> It rained all day!"),
        ("the first line ends here\nand a second goes on\nuntil a third", "> line ends here and a second\n> goes on"),
    ],
)
def test_trimmed_quotations(spark, original, quote):
    rows = [(1, 0, "u", original), (1, 1, "a", "Something else was said."), (1, 2, "a", f"{quote}\nYes.")]
    out = chat_quotes.link_quotations(spark.createDataFrame(rows, CHATS)).where("turn = 2").first()
    assert (out["reply_to"], out["thread"], out["n_quotes"], out["n_linked"], out["text"]) == (0, 0, 1, 1, "Yes.")


def test_messages_of_one_turn_and_of_none(spark, tmp_path):
    rows = [(1, 0, "u", "alpha"), (1, 0, "u", "beta"), (1, 1, "a", "> beta\nyes"), (1, 1, "a", "> alpha\nno"), (None, 2, "u", "x"), (1, None, "u", "> alpha\ny")]
    spark.createDataFrame(rows, CHATS).write.parquet(f"{tmp_path}/conversations.parquet")
    out = chat_quotes.op1_chat_quotes(spark, str(tmp_path)).collect()
    placed = sorted((r["position"], r["turn"], r["slot"], r["text"], r["reply_to"], r["reply_slot"]) for r in out if r["position"] is not None)
    assert placed == [(0, 0, 0, "alpha", None, None), (1, 1, 0, "no", 0, 0), (2, 0, 1, "beta", None, None), (3, 1, 1, "yes", 0, 1)]
    assert sorted((r["text"], r["reply_to"]) for r in out if r["position"] is None) == [("x", None), ("y", None)]
