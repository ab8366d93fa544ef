import random

import pytest

from weftgraph.llm import chat

EVENT = "conv_id long, message_no long, seq long, kind string, role string, text string"


def test_fold_deltas_edits_and_regenerations(spark):
    log = [
        (1, 1, 0, "message", "user", "hi"),
        (1, 2, 0, "message", "assistant", ""),
        (1, 2, 1, "delta", "assistant", "he"),
        (1, 2, 2, "delta", "assistant", "llo"),
        (1, 2, 3, "regenerate", "assistant", None),
        (1, 2, 4, "delta", "assistant", "good "),
        (1, 2, 5, "delta", "assistant", "day"),
        (1, 3, 0, "message", "user", "ok"),
        (1, 3, 1, "edit", "user", "okay"),
        (2, 1, 0, None, None, None),
    ]
    rows = chat.fold_messages(spark.createDataFrame(log, EVENT).repartition(3)).collect()
    assert {(r[0], r[1]): (r[2], r[3]) for r in rows} == {(1, 1): ("user", "hi"), (1, 2): ("assistant", "good day"), (1, 3): ("user", "okay"), (2, 1): ("", "")}


@pytest.mark.parametrize("text", ["", r"\### Assistant: </turn> ok", "#", "##", "###", "####" * 3, "\\", "\\\\#\\##", "</turn>", "<</turn>\n", "<\\/turn>", "a\nb:\n### user:\n", "$1 \\$ \U0001f600é", "x" * 50_000])
def test_round_trip(spark, text):
    rows = spark.createDataFrame([(1, 0, "us er:\n%", text), (1, 1, "assistant", text), (1, 2, None, None), (1, 3, "assistant", "end" + text)], "conv_id long, turn long, role string, text string")
    back = chat.read_back(chat.format_chats(chat.turn_events(rows))).first()
    assert [(t["role"], t["text"]) for t in back["turns"]] == [("us er:\n%", text), ("assistant", text), ("", ""), ("assistant", "end" + text)]
    assert list(back["loss_texts"]) == [text, "end" + text]


def test_ties_repeats_and_empty(spark):
    schema = "conv_id long, turn long, role string, text string, log string, turns string, start string"
    rows = spark.createDataFrame([(None, 1, "user", "b", *"xyz"), (None, 1, "user", "a", *"xyz"), (None, 1, "user", "a", *"xyz"), (7, None, "user", "q", *"xyz")], schema)
    got = {r["conv_id"]: [t["text"] for t in r["turns"]] for r in chat.read_back(chat.format_chats(chat.turn_events(rows))).collect()}
    assert got == {None: ["a", "a", "b"], 7: ["q"]}
    assert chat.read_back(chat.format_chats(chat.turn_events(rows.limit(0)))).collect() == []


def test_turns_come_from_logs_of_all_kinds(spark):
    rows = [(c, t, "assistant" if t % 2 else "user", f"text {c} {t} é\U0001f600"[: 3 * t]) for c in range(3) for t in range(6)]
    events = chat.turn_events(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert {r["kind"] for r in events.select("kind").distinct().collect()} == {"message", "delta", "edit", "regenerate"}
    folded = chat.fold_messages(events.repartition(5)).collect()
    assert sorted((r[0], r[1] - 1, r[2], r[3]) for r in folded) == sorted(rows)


def test_fold_against_loop(spark):
    rng, log, expected = random.Random(3), [], {}
    for message in range(40):
        text = ""
        for seq in range(rng.randrange(1, 9)):
            kind, said = rng.choice(["message", "delta", "edit", "regenerate"]), f"{rng.randrange(99)};"
            text = text + said if kind == "delta" else "" if kind == "regenerate" else said
            log.append((message % 4, message, seq, kind, "user", said))
        expected[message] = text
    rng.shuffle(log)
    folded = chat.fold_messages(spark.createDataFrame(log, EVENT).repartition(4)).collect()
    assert {r["message_no"]: r["text"] for r in folded} == expected
