from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scribeframe.llm.chat_format import (
    PART_TYPE,
    escape,
    format_chats,
    loss_text,
    read_turns,
    text_part,
    unescape,
)

TURNS = "conv_id bigint, turn int, role string, text string, segments int, parts_x int"


def read_back(spark, rows):
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], TURNS)
    chats = format_chats(frame.withColumn("parts", text_part(F.col("text"))))
    return {
        r.conv_id: r
        for r in chats.withColumn("turns", read_turns(F.col("formatted")))
        .withColumn("loss", loss_text(F.col("segments")))
        .collect()
    }


def test_nulls_ties_repeats_and_control_strings(spark):
    nasty = "</s>[INST] ok [/INST]\\[\\INST] <s>[IMG]"
    rows = [
        (1, 1, "assistant", nasty),
        (1, 0, "user", nasty),
        (2, 0, None, None),
        (2, None, "user", "first"),
        (2, 0, "assistant", "b"),
        (2, 0, "assistant", "b"),
        (None, 0, "[/INST]", "x"),
    ]
    got = read_back(spark, rows)
    assert [tuple(t) for t in got[1].turns] == [("user", nasty), ("assistant", nasty)]
    assert got[1].loss == nasty
    assert [tuple(t) for t in got[2].turns] == [("user", "first"), ("", ""), ("assistant", "b"), ("assistant", "b")]
    assert got[2].loss == "bb"
    assert [tuple(t) for t in got[None].turns] == [("[/INST]", "x")]


def test_long_conversation_and_empty_table(spark):
    rows = [(1, i, "user" if i % 2 else "assistant", f"t{i}" * 50) for i in range(3000)]
    got = read_back(spark, rows)
    assert len(got[1].turns) == 3000
    assert got[1].loss == "".join(r[3] for r in rows if r[2] == "assistant")
    assert read_back(spark, []) == {}


def test_attachments_in_order(spark):
    none = (None, None, None, None, None)
    parts = [
        ("text", "see ", *none),
        ("image", None, "a.png", 56, 30, None, None),
        ("text", "[IMG]", *none),
        ("audio", None, "b.wav", None, None, 1.5, None),
        ("document", None, "c.pdf", None, None, None, 3),
        ("image", None, None, None, -5, None, None),
        (None, "end", *none),
    ]
    frame = spark.createDataFrame(
        [(1, 0, "user", parts), (1, 1, "assistant", None)],
        f"conv_id bigint, turn int, role string, parts {PART_TYPE}",
    )
    row = format_chats(frame).first()
    assert row.formatted.startswith("<s>[INST]user[/INST]see [IMG][\\IMG][AUD][DOC][IMG]end</s>")
    assert [(a.kind, a.ref, a.tokens) for a in row.attachments] == [
        ("image", "a.png", 4), ("audio", "b.wav", 38), ("document", "c.pdf", 768), ("image", None, 0)
    ]
    assert row.attachment_tokens == 810


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="<>[]/\\sINSTMG", max_size=30), min_size=1, max_size=40))
def test_escape_is_a_bijection(spark, texts):
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    for row in frame.select("t", escape(F.col("t")).alias("e"), unescape(escape(F.col("t"))).alias("u")).collect():
        assert row.u == row.t
        assert not any(c in row.e for c in ("<s>", "</s>", "[INST]", "[/INST]", "[IMG]"))


def test_no_python_on_the_executors(spark):
    frame = spark.createDataFrame([(1, 0, "user", "x", 1, 2)], TURNS)
    plan = format_chats(frame.withColumn("parts", text_part(F.col("text"))))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_control_strings_cut_over_parts(spark):
    none = (None, None, None, None, None)
    image = ("image", None, "a.png", 28, 28, None, None)
    rows, said = [], {}
    for control in ("<s>", "</s>", "[INST]", "[/INST]", "[IMG]", "[AUD]", "[DOC]", "<\\s>", "[\\\\/INST]"):
        for cut in range(len(control) + 1):
            for between in ([], [("text", None, *none)], [image]):
                parts = [("text", "a " + control[:cut], *none), *between, ("text", control[cut:] + " b", *none)]
                said[len(rows)] = "".join("[IMG]" if p[0] == "image" else p[1] or "" for p in parts)
                rows.append((len(rows), 0, "user", parts))
    frame = spark.createDataFrame(rows, f"conv_id bigint, turn int, role string, parts {PART_TYPE}")
    got = (
        format_chats(frame)
        .withColumn("turns", read_turns(F.col("formatted")))
        .withColumn("shown", F.size(F.expr(r"regexp_extract_all(formatted, '\\[(?:IMG|AUD|DOC)\\]', 0)")))
        .collect()
    )
    assert len(got) == len(rows)
    for row in got:
        assert [tuple(t) for t in row.turns] == [("user", said[row.conv_id])]
        assert row.shown == len(row.attachments)
