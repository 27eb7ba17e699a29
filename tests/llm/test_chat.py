"""Chat formatting: exact round trips, masks and layouts."""

import random

from pyspark.sql import functions as F

from tallyline.llm import chat

NASTY = ["", "###", "####", "\\", "\\\\#", "</turn>", "</turn>\n### user: x</turn>\n", "\\### Assistant: </turn> ok", "<\\/turn>",
         "#\\##", "a: b", ": ", "<", "</", "##", "/turn>", "é漢😀\x00", "\n\n", "\\n", "$1 \\$"]


def chats(spark, turns):
    rows = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    made = chat.format_chats(chat.canonical_turns(rows, order_col="turn"))
    return {r.conv_id: r for r in made.select(
        "conv_id", "formatted", "spans", chat.read_turns(F.col("formatted")).alias("turns"),
        chat.loss_text(F.col("formatted"), F.col("spans")).alias("loss"),
    ).collect()}


def test_whatever_texts_say_is_read_back(spark):
    draw = random.Random(5)
    turns = [(c, n, draw.choice(["user", "assistant", "a: b", "###", "", "role\\"]), "".join(draw.choices(NASTY, k=draw.randrange(4))))
             for c in range(60) for n in range(draw.randrange(1, 6))]
    got = chats(spark, turns)
    for c in {t[0] for t in turns}:
        mine = [t for t in turns if t[0] == c]
        assert [tuple(t) for t in got[c].turns] == [(t[2], t[3]) for t in mine]
        assert got[c].loss == "".join(t[3] for t in mine if t[2] == "assistant")
        assert len(got[c].spans) == sum(t[2] == "assistant" for t in mine)
        for span in got[c].spans:
            assert got[c].formatted[span.first_char:span.first_char + span.chars] == got[c].formatted.encode()[
                span.first_byte:span.first_byte + span.bytes].decode()


def test_nulls_ties_and_repeats(spark):
    got = chats(spark, [(1, None, None, None), (1, 2, "user", "b"), (1, 2, "assistant", "z"), (1, 2, "user", "b"), (None, 1, "user", "x")])
    assert [tuple(t) for t in got[1].turns] == [("", ""), ("assistant", "z"), ("user", "b"), ("user", "b")]
    assert [tuple(t) for t in got[None].turns] == [("user", "x")]


def test_an_empty_table_and_long_texts(spark):
    assert chats(spark, []) == {}
    long = "word ### </turn> " * 30_000
    got = chats(spark, [(1, 1, "assistant", long)] + [(2, n, "user", "hi") for n in range(3000)])
    assert got[1].loss == long
    assert len(got[2].turns) == 3000


def test_layouts_are_told_by_their_fingerprints(spark):
    lines = [
        '{"conv_id": 1, "messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}',
        '{"conv_id": 2, "prompt": "q", "response": "a"}',
        '{"conv_id": 3, "instruction": "do", "input": "this", "output": "done"}',
        '{"conv_id": 4, "instruction": "do", "output": "done"}',
        '{"conv_id": 5, "conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}',
        '{"conv_id": 6, "system": "s", "instruction": "do", "output": "done"}',
        '{"conv_id": 7, "prompt": "only"}',
        '{"conv_id": 8}',
        '{"conv_id": 9, "prompt": "q", "completion": "a"}',
    ]
    records = spark.read.json(spark.createDataFrame([(x,) for x in lines], "value string").rdd.map(lambda r: r[0]))
    laid = {r.conv_id: r.layout for r in chat.with_layout(records).collect()}
    assert laid == {1: "messages", 2: "prompt", 3: "instruction", 4: "instruction", 5: "shared turns", 6: "system instruction",
                    7: None, 8: None, 9: "completion"}
    assert sorted(r.conv_id for r in chat.unmapped_rows(records).collect()) == [7, 8]
    turns = {}
    for r in chat.canonical_turns(records).orderBy("conv_id", "part").collect():
        turns.setdefault(r.conv_id, []).append((r.role, r.text))
    assert turns[1] == turns[2] == turns[5] == turns[9] == [("user", "q"), ("assistant", "a")]
    assert turns[3] == [("user", "do\nthis"), ("assistant", "done")]
    assert turns[6] == [("system", "s"), ("user", "do"), ("assistant", "done")]


def test_other_columns_are_no_part_of_the_layout_unless_named(spark):
    rows = spark.createDataFrame([(1, 1, "user", "a", "x", 4)], "conv_id long, turn long, role string, text string, head string, piece int")
    assert chat.with_layout(rows).first().layout is None
    turns = chat.canonical_turns(rows, order_col="turn", columns=["turn", "role", "text"])
    assert [tuple(r)[3:5] for r in turns.collect()] == [("user", "a")]


def read_json(spark, lines):
    return spark.read.json(spark.createDataFrame([(x,) for x in lines], "value string").rdd.map(lambda r: r[0]))


def test_contents_in_parts(spark):
    records = read_json(spark, [
        '{"conv_id": 1, "messages": [{"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}]},'
        ' {"role": "assistant", "content": [{"type": "text", "text": "c"}]}]}',
        '{"conv_id": 2, "messages": [{"role": "user", "content": [{"type": "image", "url": "x"}, {"type": "text", "text": "b"}]}]}',
        '{"conv_id": 3, "messages": [{"role": "user", "content": [{"text": "only"}, {}]}, {"role": "assistant", "content": null}]}',
        '{"conv_id": 4, "messages": [{"role": "user", "content": [{"text": "q"}], "tool_calls": [{"function": {"name": "f"}}]}]}',
        '{"conv_id": 5, "messages": []}',
    ])
    laid = {r.conv_id: r.layout for r in chat.with_layout(records).collect()}
    assert laid == {1: "message parts", 2: None, 3: "message parts", 4: None, 5: None}
    turns = {}
    for r in chat.canonical_turns(records).orderBy("conv_id", "part").collect():
        turns.setdefault(r.conv_id, []).append((r.role, r.text))
    assert turns == {1: [("user", "ab"), ("assistant", "c")], 3: [("user", "only"), ("assistant", "")]}
    texts = read_json(spark, ['{"conv_id": 1, "messages": [{"role": "user", "content": ["a", "b"]}]}'])
    assert [r.text for r in chat.canonical_turns(texts).collect()] == ["ab"]


def test_layouts_of_other_shapes_and_types_are_unmapped(spark):
    for line in (
        '{"conv_id": 1, "prompt": {"text": "q", "lang": "en"}, "response": "a"}', '{"conv_id": 1, "messages": "text"}',
        '{"conv_id": 1, "messages": [["user", "a"]]}', '{"conv_id": 1, "turn": 1, "role": {"name": "user"}, "text": "x"}',
        '{"conv_id": 1, "messages": {"role": "user", "content": "a"}}', '{"conv_id": 1, "instruction": ["do"], "output": "done"}',
        '{"conv_id": 1, "conversations": [{"from": "human", "value": {"deep": [{"er": 1}]}}]}',
    ):
        records = read_json(spark, [line])
        assert chat.with_layout(records).first().layout is None, line
        assert chat.unmapped_rows(records).count() == 1 and chat.canonical_turns(records).collect() == []
    numbers = read_json(spark, ['{"conv_id": "x", "prompt": 1, "response": 2.5}'])
    assert [(r.conv_id, r.role, r.text) for r in chat.canonical_turns(numbers).collect()] == [("x", "user", "1"), ("x", "assistant", "2.5")]
