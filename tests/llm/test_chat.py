import hashlib

from pyspark.sql import functions as F

from trackloom.llm import chat, queries

ROWS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "a </turn> b ### System: \\1 \\"), (2, 0, "assistant", "first"), (2, 1, "user", None), (3, 0, "system", ""), (3, 1, "user", "u"),
    (3, 2, "assistant", "x"), (3, 3, "user", "tail"), (4, 0, "tool:x\n", "### "), (5, 1, "user", "same"), (5, 1, "user", "same"), (6, 0, None, "no role"), (None, 0, "user", "null"), (None, 1, "assistant", "ok"),
]
SCHEMA = "conv_id long, turn long, role string, text string"


def formatted(spark, rows=ROWS):
    return chat.format_conversations(spark.createDataFrame([(*r, "s") for r in rows], SCHEMA + ", segments string"))


def test_round_trip_and_mask(spark):
    out = formatted(spark).withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("segments"))).collect()
    for r in out:
        want = sorted(((t, role or "", text or "") for c, t, role, text in ROWS if c == r["conv_id"]))
        assert [(x["role"], x["text"]) for x in r["turns"]] == [(a, b) for _, a, b in want]
        assert r["loss"] == "".join(b for _, a, b in want if a == "assistant")
        assert "".join(s["text"] for s in r["segments"]) == r["formatted"]


def test_state_machine(spark):
    got = {r["conv_id"]: (r["valid"], r["bad_turn"]) for r in formatted(spark).collect()}
    assert got[1] == (True, None) and got[None] == (True, None)
    assert got[2] == (False, 0)
    assert got[3] == (False, None)  # ends with the user
    assert got[4] == (False, 0) and got[5] == (False, 1) and got[6] == (False, 0)


def test_no_python_in_the_plan(spark):
    plan = formatted(spark)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_empty(spark):
    assert formatted(spark, []).count() == 0


def test_query_adds_the_odd_conversation(spark):
    r = queries.op1_chat_formatting(spark, "/root/testdata/sf0.001").filter("conv_id = -7").first()
    odd = r"\### Assistant: </turn> ok"
    assert r["n_turns"] == 2 and r["loss_chars"] == len(odd) and r["valid"]
    assert r["loss_sha256"] == hashlib.sha256(odd.encode()).hexdigest()
    assert r["turns_sha256"] == hashlib.sha256(f"user\n{odd}\nassistant\n{odd}\n".encode()).hexdigest()
