import random

from rasterloom.llm import op9_mixing as op9


def test_targets_reshare_what_is_above_the_cap():
    got = op9.targets({"a": 10, "b": 1000, "c": 1000, None: 990})
    assert got["a"] == 30 and abs(sum(got.values()) - 3000) < 1e-9
    assert abs(got["b"] / got["c"] - 2) < 1e-9 and abs(got[None] / got["c"] - 5) < 1e-9
    assert op9.targets({}) == {} and op9.targets({"a": 0, "b": 0}) == {"a": 0.0, "b": 0.0}


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(op9, "BITS", 4)
    r = random.Random(4)
    rows = [(i, r.choice(["s1", "s2", "ü", "z", None]), " \n".join("w" * r.randint(1, 40)) if i % 50 else r.choice([None, "", " \t"])) for i in range(600)]
    rows += [(1000, "tiny", "a b c")] + rows[:7]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").selectExpr("*", "1 as h", "2 as size")
    out = op9.mix(df).collect()
    assert sorted(map(str, out)) == sorted(map(str, op9.mix(df).collect())) and len(out) == len(rows)
    src = dict((d, s) for d, s, _ in rows)
    size = {d: len((t or "").encode().split()) for d, _, t in rows}
    per, taken, target = {}, {}, {}
    for x in out:
        assert x["size"] == size[x.doc_id] and x.taken <= 3 * x["size"] and (not x["size"] or x.taken % x["size"] == 0)
        s = src[x.doc_id]
        per[s] = per.get(s, 0) + x["size"]
        taken[s] = taken.get(s, 0) + x.taken
        target[s] = x.target
    assert {src[x.doc_id]: x.source_size for x in out} == per
    assert target == op9.targets(per)
    for s in per:
        assert abs(taken[s] - target[s]) <= 40, s


def test_empty_table(spark):
    assert op9.mix(spark.createDataFrame([], "doc_id long, source string, text string")).count() == 0
