"""Lookups in the paged index of a run."""

from bisect import bisect_right

from tidemark.operators import runs as run_ops


def _case(spark):
    firsts = {r: sorted(f"k{(i * 37 + r) % 900:03d}" for i in range(n)) for r, n in ((0, 1), (1, 2), (2, 7), (3, 8), (4, 61))}
    index = spark.createDataFrame([(r, b, k) for r, own in firsts.items() for b, k in enumerate(own)], "run_id long, block_id long, first_key string")
    keys = ["", "a", "z", *(f"k{i:03d}" for i in range(0, 900, 7)), *firsts[4], "k100a"]
    want = sorted((r, k, bisect_right(own, k) - 1) for r, own in firsts.items() for k in set(keys))
    return spark.createDataFrame([(k,) for k in set(keys)], "key string"), index, want


def test_place_finds_the_block_at_any_page_size(spark):
    keys, index, want = _case(spark)
    for page in (1, 2, 8, 256):
        assert sorted(map(tuple, run_ops.place(keys, index, page).select("run_id", "key", "block_id").collect())) == want
