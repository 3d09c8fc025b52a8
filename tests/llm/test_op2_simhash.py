import hashlib
import random

from pyspark.sql import functions as F

from rasterloom.llm import op2_simhash as op2
from rasterloom.llm import registry


def test_edited_texts_and_fingerprints(spark, tmp_path):
    r = random.Random(1)
    say = lambda n: " ".join("".join(r.choice("abcdeé😀") for _ in range(r.randint(1, 9))) for _ in range(n))
    rows = [(i * 7, say(r.randint(0, 60))) for i in range(60)] + [(1000, None), (1001, ""), (1002, " \t"), (1003, "x")]
    rows += [(r0[0] + 1, r0[1]) for r0 in rows[:10]]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("part", F.lit("clash")).withColumn("fp", F.lit(1))
    df.write.parquet(str(tmp_path / "documents.parquet"))
    for range_bytes in (16 << 20, 500):
        e = op2.edited(df, range_bytes)
        got = {x.doc_id: (x.text, x.edited) for x in e.collect()}
        order = sorted(rows, key=lambda x: -x[0])
        for k, (d, t) in enumerate(order):
            t, n = t or "", order[(k + 1) % len(order)][1] or ""
            third = len(t) // 3
            assert got[d] == (t, t[: len(t) - third] + n[:third])
    out = {x.doc_id: x for x in op2.op2_simhash(spark, str(tmp_path)).collect()}
    assert len(out) == len(rows)
    for k, (d, t) in enumerate(order):
        t, n = t or "", order[(k + 1) % len(order)]
        x = out[d]
        assert x.n_chars == len(t) and x.edited_sha256 == hashlib.sha256(got[d][1].encode()).hexdigest()
        far = bin(int(x.fingerprint, 16) ^ int(out[n[0]].fingerprint, 16)).count("1")
        assert abs(x.near_next - (1 - far / 64)) < 1e-12
        far = bin(int(x.fingerprint, 16) ^ int(x.edited_fingerprint, 16)).count("1")
        assert abs(x.near_edited - (1 - far / 64)) < 1e-12
    assert out[0].fingerprint == out[1].fingerprint and out[1001].fingerprint == out[1002].fingerprint == "0" * 16


def test_bits_follow_the_signed_votes(spark):
    words = ["alpha", "b", "alpha", "gamma" * 5, "é"]
    df = spark.createDataFrame([(1, " ".join(words))], "k int, text string")
    fp = op2.simhash(df, ["k"]).first()["fp"] & ((1 << 64) - 1)
    hashes = [x[0] & ((1 << 64) - 1) for x in spark.createDataFrame([(w,) for w in words], "w string").select(F.xxhash64("w")).collect()]
    for b in range(64):
        vote = sum((1 if h >> b & 1 else -1) * min(len(w), 16) for w, h in zip(words, hashes))
        assert (fp >> b & 1) == (vote > 0)


def test_neighbours_against_all_pairs(spark):
    r = random.Random(2)
    base = [r.getrandbits(64) for _ in range(30)]
    fps = {b ^ sum(1 << k for k in r.sample(range(64), r.randint(0, 5))) for b in base for _ in range(8)}
    signed = [op2._signed(x) for x in fps]
    df = spark.createDataFrame([(x,) for x in signed + signed[:5]] + [(None,)], "fp long")
    got = sorted(map(tuple, op2.neighbours(df, 3).collect()))
    want = sorted((a, b) for a in signed for b in signed if a < b and bin((a ^ b) & ((1 << 64) - 1)).count("1") <= 3)
    assert got == want


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert op2.op2_simhash(spark, str(tmp_path)).count() == 0


def test_counts_of_a_query_set_against_brute_force(spark):
    r = random.Random(9)
    base = [r.getrandbits(63) for _ in range(6)]
    fps = [b ^ sum(1 << k for k in r.sample(range(64), n)) for b in base for n in (0, 1, 2, 3, 3, 4, 5) for _ in range(4)]
    fps = [f - (1 << 64) if f >= 1 << 63 else f for f in fps]
    asked = fps[::5]
    near = lambda a, b: bin((a ^ b) & (1 << 64) - 1).count("1") <= 3
    want = {a: n for a in asked if (n := sum(a != b and near(a, b) for b in set(fps)))}
    make = lambda x: spark.createDataFrame([(f,) for f in x], "fp long")
    assert {x.fp: x.n_near for x in op2.within(make(asked), make(fps)).collect()} == want


def test_the_tables_of_a_query_set_are_not_broadcast(spark):
    fps = spark.range(200).selectExpr("explode(array(xxhash64(id), xxhash64(id) ^ 5)) as fp")
    found = op2.within(fps.where("pmod(fp, 20) < 2"), fps)
    assert found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan
