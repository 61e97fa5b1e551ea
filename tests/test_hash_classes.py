"""Classes of equal hashes and pairs of near ones against brute force."""

import random

import pytest

from oddlens.operators import tables as tb
from oddlens.plans import fixtures as fx
from oddlens.plans import registry


def test_hash_classes(spark, monkeypatch):
    rng, bits = random.Random(5), []
    for _ in range(30):
        base = rng.sample([0] * 32 + [1] * 32, 64)
        for flips in (0, 0, 1, 2, 3, 4, 6):
            b = list(base)
            for k in rng.sample(range(64), flips):
                b[k] = 1 - b[k]
            bits.append(b)
    rng.shuffle(bits)
    df = spark.createDataFrame([(i, "a", [float(x) for x in b]) for i, b in enumerate(bits)], "item_id bigint, category string, grid array<double>")
    monkeypatch.setattr(fx, "grids", lambda spark, sf: df)
    code = ["".join(f"{int(''.join(map(str, b[k : k + 4])), 2):x}" for k in range(0, 64, 4)) for b in bits]
    got = registry.QUERIES["p8_hash_classes"](spark, "").collect()
    assert sorted(map(tuple, got)) == [(i, h, code.index(h), code.count(h)) for i, h in enumerate(code)]
    near = registry.QUERIES["p8_near_hashes"](spark, "").collect()
    apart = lambda a, b: (int(a, 16) ^ int(b, 16)).bit_count()
    want = [(a, b, apart(a, b)) for a in set(code) for b in set(code) if a < b and apart(a, b) <= 3]
    assert sorted(tuple(r) for r in near if r.hash_b) == sorted(want) and want
    assert {r.hash_a for r in near} == set(code)


@pytest.mark.parametrize("bucket", [256, 4])
def test_near_hashes_in_buckets_that_are_cut_again(spark, bucket):
    """Hashes with many common bits fill whole buckets; they are cut by their other bits and no pair is lost."""
    rng = random.Random(1)
    code = {f"{rng.getrandbits(24):016x}" for _ in range(120)} | {f"{(0xABCDEF << 40) | (1 << k):016x}" for k in range(20)} | {"f" * 16, "0" * 16}
    got = tb.near_hashes(spark.createDataFrame([(h,) for h in code], "hash string"), 3, bucket).collect()
    apart = lambda a, b: (int(a, 16) ^ int(b, 16)).bit_count()
    want = [(a, b, apart(a, b)) for a in code for b in code if a < b and apart(a, b) <= 3]
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 190
