"""Chat formatting: round trips, turn order, and the loss, against plain Python."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from turnline.llm import chat
from turnline.llm.queries import chat_digests

CHATML = chat.ChatTemplate(
    begin="<|begin|>",
    roles={
        "user": chat.Marks("<|start|>user\n", "<|end|>\n"), "assistant": chat.Marks("<|start|>assistant\n", "<|end|>\n", loss=True),
        "tool": chat.Marks("<|start|>tool\n", "<|end|>\n", loss=True),
    },
    other=chat.Marks("<|other|>", "<|end|>\n"), name_end="<|name|>",
    controls=("<|begin|>", "<|start|>", "<|end|>", "<|other|>", "<|name|>"),
    moves=(("start", "user", "user"), ("user", "assistant", "assistant"), ("assistant", "user", "user"),
           ("assistant", "tool", "tool"), ("tool", "assistant", "assistant")),
    accepting=("assistant", "tool"),
)
SCHEMA = "conv_id long, turn long, role string, text string"


def in_order(rows):
    out = {}
    for c, t, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        out.setdefault(c, []).append((role or "", text or ""))
    return out


def wrong_place(roles, template):
    state, moves = template.start, {(a, b): c for a, b, c in template.moves}
    for i, role in enumerate(roles, 1):
        if (state, role) not in moves:
            return i
        state = moves[state, role]
    return None if state in template.accepting else len(roles) + 1


@pytest.fixture(scope="module")
def hard():
    rng = random.Random(9)
    pieces = [*chat.BRACKETS.controls, *CHATML.controls, "\\", "\\\\", "<", "[", "]", ">", "/", "|", "s>", "INST]", " ", "\n", "é", "😀", "$1", "a"]
    rows = []
    for c in range(150):
        for t in range(rng.randrange(1, 7)):
            role = rng.choice(["user", "assistant", "system", "tool", "", None, "user", "assistant", "[TEXT]x", "<|name|>\\"])
            rows.append((c, rng.choice([None, t, t, t]), role, rng.choice([None, "", "".join(rng.choices(pieces, k=rng.randrange(1, 12)))])))
    rows += [(500, t, ("user", "assistant")[t % 2], "ok") for t in range(4)] + [(501, 0, "system", "s"), (501, 1, "user", "u")]
    rows += [(None, 0, "user", "nameless"), (502, 0, "user", "x " * 400_000 + "</s>" * 1000 + "\\" * 5000 + "[INST]"), (502, 1, "assistant", "\\" * 9)]
    return rows + rows[:20]  # repeated rows


@pytest.mark.parametrize("template", [chat.BRACKETS, CHATML])
def test_turns_and_loss_come_back(spark, hard, template):
    frame = spark.createDataFrame(hard, SCHEMA).repartition(3)
    out = chat.format_chats(frame, template).withColumn("whole", chat.formatted(F.col("segments")))
    rows = out.withColumns({"turns": chat.parse(F.col("whole"), template), "loss": chat.loss_text(F.col("segments"), template)}).collect()
    expected = in_order(hard)
    assert len(rows) == len(expected)
    under = [name for name, marks in template.roles.items() if marks.loss]
    for r in rows:
        turns = expected[r.conv_id]
        assert [tuple(t) for t in r.turns] == turns
        assert r.loss == "".join(x for role, x in turns if role in under)
        assert r.first_error == wrong_place([role for role, _ in turns], template)
        # Marks stand where the template put them and nowhere else.
        count = sum(r.whole.count(c) for c in template.controls)
        marks = [template.begin] + [m for role, _ in turns for m in (
            (template.roles[role].before, template.roles[role].after) if role in template.roles
            else (template.other.before, template.name_end, template.other.after))]
        assert count == len(marks) and len(r.segments) == 1 + 3 * len(turns)


def test_texts_without_control_strings_stay_as_they_are(spark):
    rows = [(1, 0, "user", "C:\\path [x] <b> \\[ \\"), (1, 1, "assistant", "fine")]
    row = chat.format_chats(spark.createDataFrame(rows, SCHEMA)).select(chat.formatted(F.col("segments")).alias("w")).first()
    assert row.w == "<s>[INST]C:\\path [x] <b> \\[ \\[/INST][OUT]fine</s>"


def test_digests_count_code_points(spark):
    rows = [(1, 0, "user", "</s>😀"), (1, 1, "assistant", "é[INST]😀")]
    row = chat_digests(spark.createDataFrame(rows, SCHEMA)).first()
    assert (row.n_turns, row.loss_chars, row.first_error) == (2, 8, None)
    assert row.loss_sha256 == hashlib.sha256("é[INST]😀".encode()).hexdigest()
    assert row.turns_sha256 == hashlib.sha256("user\n</s>😀\nassistant\né[INST]😀\n".encode()).hexdigest()
    assert row.formatted_chars == len("<s>[INST]<\\/s>😀[/INST][OUT]é[\\INST]😀</s>")


def test_empty_table_and_clashing_columns(spark):
    assert chat_digests(spark.createDataFrame([], SCHEMA)).count() == 0
    wide = spark.createDataFrame([("t", 1, "segments", 0, "user", "p")], "text string, conv_id long, segments string, turn long, role string, turns string")
    assert chat_digests(wide).first().n_turns == 1


def test_only_spark_functions(spark):
    frame = spark.createDataFrame([(1, 0, "user", "x")], SCHEMA)
    plan = chat_digests(frame.select("*"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


@pytest.mark.parametrize("change", [
    {"controls": ("<s>", "</s>", "[INST]")}, {"begin": "plain"}, {"controls": (*chat.BRACKETS.controls, "s>")},
    {"controls": (*chat.BRACKETS.controls, "x<s")}, {"controls": (*chat.BRACKETS.controls, "<")},
    {"other": chat.Marks("[INST]x", "[/ROLE]")},
])
def test_templates_that_could_not_be_read_back_are_refused(change):
    from dataclasses import replace

    with pytest.raises(ValueError):
        replace(chat.BRACKETS, **change)
