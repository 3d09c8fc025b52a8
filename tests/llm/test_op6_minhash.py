import random
from collections import Counter

import numpy as np

from rasterloom.llm import op6_minhash as op6
from rasterloom.llm.bagminhash import overlap, shingles, signatures
from rasterloom.llm.components import components


def test_registers_agree_like_weighted_jaccard():
    r = random.Random(0)
    bag = lambda w: shingles(" ".join(w).encode(), 1)
    for n in (1, 20, 300):
        a = [r.choice("abcdefghij") for _ in range(n)] + ["x"] * 70
        b = a[: n // 2] + [r.choice("abcKLM") for _ in range(n)] + ["x"] * 41
        both, union = overlap(bag(a), bag(b))
        x, y = Counter(a), Counter(b)
        assert both == sum((x & y).values()) and union == sum((x | y).values())
        s = signatures([bag(a), bag(b), bag([])], 3000)
        assert abs((s[0] == s[1]).mean() - both / union) < 0.04
        assert np.array_equal(signatures([bag(b)], 3000)[0], s[1])


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(170)] + [(1000 + k, 1001 + k) for k in range(40)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {x.node: x.comp for x in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}


def brute(rows):
    bags = [shingles((t or "").encode()) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both, union = overlap(bags[i], bags[j])
            if (rows[i][1] or "") == (rows[j][1] or "") or union and 5 * both >= 4 * union:
                root[find(i)] = find(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[find(i)] = min(d, ids.get(find(i), d))
    return sorted(((d, ids.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def test_classes_against_all_pairs(spark):
    r = random.Random(2)
    vocab = [f"w{k}" for k in range(200)]
    say = lambda n: [r.choice(vocab) for _ in range(n)]
    rows = [(0, None), (1, ""), (2, "one two"), (3, "one two"), (4, "one  two"), (5, "a " * 3000), (6, "a " * 2900)]
    base = say(120)
    for k in range(60):  # a group whose members differ from each other at the threshold
        t = list(base)
        for _ in range(r.randint(0, 3)):
            t[r.randrange(len(t))] = r.choice(vocab)
        rows.append((100 + k, " ".join(t)))
    for k in range(25):
        t = say(r.randint(4, 200))
        rows.append((300 + 4 * k, " ".join(t)))
        for j in range(r.randint(0, 3)):
            t = list(t)
            t[r.randrange(len(t))] = "new"
            rows.append((301 + 4 * k + j, " ".join(t)))
    rows += [(900 + k, rows[40][1]) for k in range(30)] + [(901, rows[40][1]), (None, rows[41][1]), (None, "alone here with nobody near")]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as node", "'k' as key")
    assert sorted((tuple(x) for x in op6.near_duplicates(df).collect()), key=str) == brute(rows)


def test_empty_table_and_no_duplicates(spark):
    assert op6.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    df = spark.createDataFrame([(1, "a b c d e f"), (2, "g h i j k l")], "doc_id long, text string")
    assert sorted(map(tuple, op6.near_duplicates(df).collect())) == [(1, 1), (2, 2)]


def test_large_buckets_by_differences(spark, monkeypatch):
    """Edited copies around an original and around edited ones of their own, many of them only near each other."""
    monkeypatch.setattr(op6, "SMALL", 3)
    monkeypatch.setattr(op6, "MANY", 6)
    r = random.Random(5)
    base = [f"w{r.randrange(50)}" for _ in range(90)]
    rows = []

    def edited(t, n):
        t = list(t)
        for _ in range(n):
            t[r.randrange(len(t))] = f"n{r.randrange(4)}"
        return t

    family = [base] + [edited(base, r.randint(3, 5)) for _ in range(8)]
    for k in range(150):
        rows.append((k, " ".join(edited(r.choice(family), r.randint(0, 3)))))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(x) for x in op6.near_duplicates(df).collect()), key=str) == brute(rows)


def test_pairs_of_a_bucket_come_once(spark):
    """All that are far and any on one side and on the other, in either role; sizes of 0 let all of them be near."""
    r = random.Random(6)
    rows = [(key, node, r.random() < 0.6, r.random() < 0.7, 0, 0, 0) for key in range(4) for node in r.sample(range(40), 15)]
    df = spark.createDataFrame(rows, "key long, node long, far boolean, any boolean, parts long, rank long, whole long")
    want = {(x[0], *sorted((x[1], y[1]))) for x in rows for y in rows if x[0] == y[0] and x[1] != y[1] and x[2] and y[3]}
    got = [tuple(x) for x in op6._met_in_buckets(df).collect()]
    assert sorted(got) == sorted(x[1:] for x in want)


def test_members_of_one_pivot_are_dealt_over_tasks(spark, monkeypatch):
    """As on tables whose statistics are too large to broadcast: no task gets the rows of a whole group, and the rows don't depend on the shares."""
    r = random.Random(7)
    rows = [(b"u", b"%d" % k, True, r.random() < 0.5, 100, r.sample(range(1000), 40)) for k in range(600)] + [(b"w", b"%d" % k, True, k > 0, 100, [5, 6, 7 + k]) for k in range(40)]
    met = spark.createDataFrame(rows, "u binary, v binary, big boolean, near boolean, whole long, parts array<long>")
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        found = []
        for dealt in (64, 10_000):
            monkeypatch.setattr(op6, "DEALT", dealt)
            smaller = op6._smaller(met)
            of_task = Counter(x[0] for x in smaller.select(op6.F.spark_partition_id()).collect())
            assert max(of_task.values()) < 2 * sum(of_task.values()) / 8
            found.append(Counter(tuple(x) for x in smaller.collect()))
        assert found[0] == found[1] and found[0]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
