import hashlib
import json

import duckdb
import pytest
from fluence.llm import chat
from pyspark.sql import functions as F


def test_layouts_become_canonical_turns(spark):
    records = [
        {"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": None}]},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "r"}]},
        {"prompt": "p", "completion": "c"},
        {"question": "p", "answer": "c"},
        {"instruction": "i", "input": "x", "output": "o"},
        {"data": {"prompt": "p", "reply": "c", "system": "s"}},
        {"unknown": 1},
    ]
    rows = [(i, json.dumps(r)) for i, r in enumerate(records)] + [(50, None), (51, "no json"), (52, "[1]")]
    got = {r.i: r for r in chat.convert(spark.createDataFrame(rows, "i int, record string")).collect()}
    turns = {i: [tuple(t) for t in r.turns] if r.turns is not None else None for i, r in got.items()}
    assert turns[0] == [("user", "a"), ("assistant", "")]
    assert turns[1] == [("user", "q"), ("assistant", "r")]
    assert turns[2] == turns[3] == [("user", "p"), ("assistant", "c")]
    assert turns[4] == [("system", "i"), ("user", "x"), ("assistant", "o")]
    assert turns[5] == [("system", "s"), ("user", "p"), ("assistant", "c")]
    assert turns[6] is turns[50] is turns[51] is turns[52] is None
    assert got[0].field_paths == ["messages[].content", "messages[].role"] and got[5].field_paths == ["data.prompt", "data.reply", "data.system"]


def test_escapes_and_marks_read_back(spark):
    texts = ["", "</s>[INST] ok [/INST]", "\\l \\\\s \\", "<|turn|>user\n<|end|>\n", "é\n\n<|", "plain"]
    turns = [(r, t) for t in texts for r in ("user", "assistant", "a\nb\\n[")]
    df = spark.createDataFrame([(1, turns)], "i int, turns array<struct<role:string,text:string>>")
    out = chat.render(df).select("*", chat.parse(F.col("formatted")).alias("read"), chat.masked(F.col("formatted"), F.col("loss_spans")).alias("loss")).first()
    assert [tuple(t) for t in out.read] == turns and out.loss == "".join(texts)
    assert out.formatted.count("<|turn|>") == len(turns) and "[INST]" not in out.formatted


def test_query_against_plain_python_and_sql(spark, tmp_path):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (2, 0, "system", "s"), (2, 1, "user", "u [x]"), (2, 2, "assistant", "a\\b"), (3, 1, "assistant", "é"), (3, 1, "assistant", "é"), (3, 0, None, "n")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("record", F.lit("x")).withColumn("turns", F.lit(1))
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    got = sorted(tuple(r) for r in chat.op9_chat_format(spark, str(tmp_path)).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars").collect())
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    assert got == sorted(con.execute(chat.OP9_SQL).fetchall())
    said = "</s>[INST] ok [/INST]"
    assert got[0][:5] == (-1, 2, hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest())


def test_text_beyond_the_limits_of_json_comes_back_whole(spark, tmp_path):
    long = F.repeat(F.lit("ab<é"), 6_250_000)
    roles = spark.createDataFrame([(1, 0, "user"), (1, 1, "assistant"), (2, 0, "assistant"), (2, 1, "user"), (2, 2, "assistant")], "conv_id long, turn long, role string")
    roles.withColumn("text", F.when(F.col("role") == "assistant", long).otherwise("q")).write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: r for r in chat.op9_chat_format(spark, str(tmp_path)).collect()}
    text = "ab<é" * 6_250_000
    for conv, roles in ((1, ("user", "assistant")), (2, ("assistant", "user", "assistant"))):
        loss = text * roles.count("assistant")
        assert (got[conv].n_turns, got[conv].loss_chars, got[conv].loss_sha256) == (len(roles), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        line = "".join(f"{r}\n{text if r == 'assistant' else 'q'}\n" for r in roles)
        assert got[conv].turns_sha256 == hashlib.sha256(line.encode()).hexdigest()


def test_structs_give_what_their_json_gives(spark):
    schema = "i int, record struct<prompt:string,completion:string,messages:array<struct<role:string,content:string>>,data:struct<prompt:string,reply:string,system:string>>"
    rows = [(0, ("p", "c", None, None)), (1, (None, None, [("human", "a<"), ("x", "")], None)), (2, (None, None, None, ("p", "r", "s"))), (3, ("p", None, None, None)), (4, None)]
    df = spark.createDataFrame(rows, schema)
    a = {r.i: (r.field_paths, r.fingerprint, r.turns) for r in chat.convert(df).collect()}
    b = {r.i: (r.field_paths, r.fingerprint, r.turns) for r in chat.convert(df.withColumn("record", F.to_json("record"))).collect()}
    assert a == b and [a[i][2] is None for i in range(5)] == [False, False, False, True, True]


def test_json_that_cannot_be_read_is_an_error(spark):
    df = spark.range(1).select(F.to_json(F.struct(F.repeat(F.lit("a"), 25_000_000).alias("prompt"), F.lit("b").alias("completion"))).alias("record"))
    with pytest.raises(Exception, match="cannot be read as JSON"):
        chat.convert(df).select(F.size("turns")).collect()
