import hashlib

import duckdb

from rasterloom.llm import op5_chat as op5

SF = "/root/testdata/sf0.01"


def test_layouts_become_canonical_turns(spark):
    ddl = "struct<messages:array<struct<role:string,content:string>>,conversations:array<struct<`from`:string,value:string>>,prompt:string,response:string,instruction:string,input:string,output:string,system:string>"
    row = lambda **k: ([k.get(x) for x in ("messages", "conversations", "prompt", "response", "instruction", "input", "output", "system")],)
    rows = [row(messages=[("user", "a"), ("assistant", None), (None, "c")]), row(conversations=[("human", "x")]), row(prompt="p", response="r"), row(prompt="p", response="r", system="s"), row(instruction="i", output="o"), row(instruction="i", input="n", output="o"), row(prompt="p"), row(), row(messages=[]), (None,)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], f"k int, record {ddl}").selectExpr("*", "'x' as other")
    got = {r.k: (r.layout, None if r.turns is None else [tuple(t) for t in r.turns], r.formatted, r.fingerprint) for r in op5.format_chats(df, "record").collect()}
    assert got[0][:2] == ("messages", [("user", "a"), ("assistant", ""), ("", "c")])
    assert got[1][:2] == ("conversations", [("human", "x")])
    assert got[2][:2] == ("prompt", [("user", "p"), ("assistant", "r")])
    assert got[3][:2] == ("prompt", [("system", "s"), ("user", "p"), ("assistant", "r")])
    assert got[4][:2] == ("instruction", [("user", "i"), ("assistant", "o")])
    assert got[5][:2] == ("instruction", [("user", "i\n\nn"), ("assistant", "o")])
    assert got[6][:3] == got[7][:3] == got[9][:3] == (None, None, None)
    assert got[8][:3] == ("messages", [], "")
    assert len({g[3] for g in got.values()}) == 8  # 0 and 8 fill the same paths, 7 and 9 none


def test_query_against_sql_and_python(spark, tmp_path):
    tricky = ["", None, "\\", "\\\\h", "</turn>\n### assistant: x", ":# <\\l", "é\n\n", "### ", "\\b\\\\b"]
    rows = [(1, k, r, t) for k, (r, t) in enumerate((r, t) for r in ("assistant", "user", "assistant: ", None) for t in tricky)]
    rows += [(2, 0, "assistant", "b"), (2, 0, "assistant", "a"), (2, 0, "assistant", "a"), (None, 1, "user", "q"), (3, None, "user", "last"), (3, 5, "assistant", "long " * 50000)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as record", "2 as turns").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: r.asDict() for r in op5.op5_chat(spark, str(tmp_path)).collect()}
    assert set(got) == {1, 2, 3, None, -7}
    for c, g in got.items():
        own = sorted((x for x in rows if x[0] == c), key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or "")) if c != -7 else [(-7, 0, "user", op5.TRICKY), (-7, 1, "assistant", op5.TRICKY)]
        own = [(r or "", t or "") for _, _, r, t in own]
        assert g["n_turns"] == len(own)
        assert g["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest()
        loss = "".join(t for r, t in own if r == "assistant")
        assert g["loss_chars"] == len(loss) and g["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest(), c
    for d in (str(tmp_path), SF):
        src = f"{d}/conversations.parquet" + ("/*.parquet" if d != SF else "")
        con = duckdb.connect()
        con.execute(f"create view conversations as select * from '{src}'")
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        want = sorted(map(str, con.execute(f"select {', '.join(names)} from ({op5.ORACLE})").fetchall()))
        assert want == sorted(str(tuple(r)) for r in op5.op5_chat(spark, d).select(*names).collect())


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    assert [r.conv_id for r in op5.op5_chat(spark, str(tmp_path)).collect()] == [-7]
