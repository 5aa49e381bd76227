"""Perspective rotation against plain Python."""

import pytest

from chronopanel.llm import chat

ROWS = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi <|im_end|>"), (1, 2, "bob", "yo"), (1, 3, "cy", None), (1, 4, "ann", "bye"), (2, 0, None, "alone"), (3, 0, "system", "only"), (None, 1, "ann", "x"), (4, None, "ann", "first"), (4, 0, "bob", "b"), (4, 0, "bob", "b")]


def test_rotation(spark):
    frame = spark.createDataFrame([(*r, "z") for r in ROWS], "conv_id long, turn long, role string, text string, perspective string")
    got = {(r["conv_id"], r["perspective"]): r for r in chat.rotate(frame).where("conv_id <> 4 or conv_id is null").collect()}
    assert set(got) == {(1, "ann"), (1, "bob"), (1, "cy"), (2, "unknown"), (None, "ann")}
    r = got[1, "ann"]
    assert r["text"] == "<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>assistant\nhi <\\|im_end|\\><|im_end|>\n<|im_start|>user name=bob\nyo<|im_end|>\n<|im_start|>user name=cy\n<|im_end|>\n<|im_start|>assistant\nbye<|im_end|>\n"
    assert [r["text"][m["start"] : m["end"]] for m in r["masks"]] == ["hi <\\|im_end|\\><|im_end|>\n", "bye<|im_end|>\n"]
    assert chat.rotate(frame.limit(0)).count() == 0


@pytest.mark.parametrize("block", [1, 2, 32])
def test_blocks_join_to_the_whole(spark, block):
    rows = [(1, t, "ab"[t % 2], f"t{t}") for t in range(70)] + [(1, 5, "a", "again")] * 9
    parts = chat.rotate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), block_turns=block).collect()
    whole = "".join(r["text"] for r in sorted(parts, key=lambda r: (r["block"], r["part"])) if r["perspective"] == "a")
    ordered = sorted(rows, key=lambda r: r[1:])
    assert whole == chat.render([(r[2], r[3]) for r in ordered], "a")[0]
    assert max(r["n_turns"] for r in parts) <= block
