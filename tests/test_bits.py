import pytest
from pyspark.sql import functions as F

from rasterloom.functions import bits


def test_words_hold_all_fields(spark):
    rows = [list(range(64)), [5] * 17, [1], [], None]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(rows)], "k int, v array<int>")
    for n in (8, 16):
        got = {r.k: r.w for r in df.select("k", bits.pack_words(F.col("v"), 4, n).alias("w")).collect()}
        for k, v in enumerate(rows):
            assert (got[k] is None) if v is None else [w >> 4 * j & 15 for w in got[k] for j in range(n)][: len(v)] == [x & 15 for x in v] and len(got[k]) == -(-len(v) // n)


def test_a_word_too_small_for_all_fields_is_refused(spark):
    df = spark.createDataFrame([([1] * 17,)], "v array<int>")
    with pytest.raises(Exception, match="more than 16 fields"):
        df.select(bits.pack(F.col("v"), 4)).collect()


def test_golden_vectors(spark):
    """Fields of a byte: reversal, and packing with a base or from the highest bit."""
    from pyspark.sql import functions as F

    from rasterloom.functions import bits

    a = lambda *x: F.array(*[F.lit(k).cast("long") for k in x])
    row = spark.range(1).select(
        bits.bit_reverse(a(0x12), 4).alias("a"), bits.bit_reverse(a(0x01), 1).alias("b"), bits.pack_bytes(a(1, 2, 3, 4), 4).alias("c"),
        bits.pack_bytes(bits.less_base(a(0x11, 0x12, 0x00, 0x13), 4, 0x10), 4).alias("d"), bits.pack_bytes(a(1, 0, 1, 1, 0, 0, 0, 0), 1).alias("e"), bits.pack_bytes(a(1, 0, 1, 1, 0, 0, 0, 0), 1, True).alias("f"),
    ).first()
    assert list(row) == [[0x21], [0x80], [0x21, 0x43], [0x21, 0x30], [0x0D], [0xB0]]
