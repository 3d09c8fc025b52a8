import hashlib
import random

from rasterloom.llm.op1_substring_dedup import substring_dedup


def brute(rows, w):
    seen, cut = set(), {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        words = (t or "").encode().split()
        gone = [False] * len(words)
        for s in range(len(words) - w + 1):
            key = tuple(words[s : s + w])
            if key in seen:
                gone[s : s + w] = [True] * w
            seen.add(key)
        cut[d] = (len(words), sum(gone), b" ".join(x for x, g in zip(words, gone) if not g).decode())
    return cut


def corpus():
    r = random.Random(5)
    vocab = [f"w{i}" for i in range(300)] + ["é", "ü x"]
    say = lambda n: [r.choice(vocab) for _ in range(n)]
    shared = [say(60), say(23), say(20), say(150)]
    rows = [(0, None), (1, ""), (2, "one two"), (3, " \t\n\v\f\r "), (4, "a " * 300), (5, "a b c " * 50), (6, " ".join("a b c".split() * 9))]
    for d in range(10, 120):
        t = say(r.randint(0, 90))
        for _ in range(r.randint(0, 2)):
            at = r.randint(0, len(t))
            p = list(r.choice(shared))
            if r.random() < 0.4:
                p[r.randrange(len(p))] = "changed"
            t[at:at] = p
        rows.append((d, r.choice([" ", "\n", "  "]).join(t)))
    rows += [(200 + i, rows[20 + i][1]) for i in range(30)]
    rows.append((300, " ".join(say(3000) + say(20) * 7)))
    r.shuffle(rows)
    return rows


def test_against_brute_force(spark):
    rows = corpus()
    for shard_bytes in (8 << 20, 2000):
        df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'x' as shard", "1 as h1")
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring_dedup(df, shard_bytes=shard_bytes).collect()}
        assert got == brute(rows, 20)


def test_empty_table_and_null_and_repeated_rows(spark):
    assert substring_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    t = " ".join(f"x{i}" for i in range(40))
    got = sorted(map(tuple, substring_dedup(spark.createDataFrame([(1, t), (1, t), (2, t), (None, "a b")], "doc_id long, text string")).collect()), key=str)
    assert got == [(1, 40, 0, t), (1, 40, 0, t), (2, 40, 40, ""), (None, 2, 0, "a b")]


def periodic(unit, joint, g_n, lengths):
    """Documents that say one line over and over: periods of g_n units, its neighbours, parts and multiples."""
    r = random.Random(9)
    rows = []
    for p in (g_n // 2, g_n - 1, g_n, g_n + 1, 2 * g_n, 3 * g_n):
        for n in lengths:
            line = [unit(r) for _ in range(p)]
            rows.append((len(rows), joint.join((line * (n // p + 1))[:n])))
    whole = rows[2 * len(lengths) + 1][1]
    rows += [(len(rows) + k, t) for k, t in enumerate((whole, joint.join(unit(r) for _ in range(40)) + joint + whole))]
    return rows


def test_lines_repeated_at_the_length_of_a_name(spark):
    line = " ".join(f"x{i}" for i in range(13))
    df = spark.createDataFrame([(1, " ".join([line] * 4))], "doc_id long, text string")
    assert list(map(tuple, substring_dedup(df).collect())) == [(1, 52, 39, line)]
    rows = periodic(lambda r: f"w{r.randrange(10**6)}", " ", 13, (33, 52, 60, 500, 1200))
    for shard_bytes in (8 << 20, 2000):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring_dedup(df, shard_bytes=shard_bytes).collect()} == brute(rows, 20)


def test_one_id_on_several_texts(spark):
    """Rows of one doc_id and different texts are documents of their own, in the order of their hashes."""
    r = random.Random(6)
    say = lambda n: " ".join(r.choice("abcdefghij") + r.choice("klmnop") for _ in range(n))
    shared = say(30)
    rows = [(1, say(25) + " " + shared), (1, shared + " " + say(25)), (2, say(5)), (2, say(40) + " " + shared), (3, shared), (3, shared), (None, shared), (-(1 << 63), shared), ((1 << 63) - 1, shared)]
    order = {x: k for k, x in enumerate(sorted({x for x in rows if x[0] is not None}, key=lambda x: (x[0], hashlib.md5(x[1].encode()).digest())))}
    seen, want = {}, []
    for x, k in order.items():
        w = x[1].split()
        for s in range(len(w) - 19):
            seen.setdefault(tuple(w[s : s + 20]), (k, s))
    for x in rows:
        w = x[1].split()
        gone = {s + i for s in range(len(w) - 19) for i in range(20) if x[0] is not None and seen[tuple(w[s : s + 20])] < (order[x], s)}
        want.append((str(x[0]), len(w), len(gone), " ".join(t for k, t in enumerate(w) if k not in gone)))
    got = substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(x.doc_id), *x[1:]) for x in got) == sorted(want)
