import random

import numpy as np
from helpers import SCHEMA, corpus, with_clashes
from multisvm.llm import keyblobs
from multisvm.llm.components import components
from multisvm.llm.simhash import fingerprint, flips, links, simhash_groups


def bitwise(text):
    """The fingerprint by its definition."""
    import xxhash

    ws = [w for w in __import__("re").split(rb"[\x20\x09-\x0D]+", (text or "").encode().lower()) if w]
    grams = [b" ".join(ws[i:i + 4]) for i in range(len(ws) - 3)] or ([b" ".join(ws)] if ws else [])
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def union(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_fingerprint_by_definition(spark):
    for _, t, *_ in corpus():
        assert fingerprint(t) == bitwise(t)
    h = spark.sql("SELECT xxhash64('ab cd ef gh')").first()[0]
    assert fingerprint("AB cd\tEF  gh") == h % (1 << 64)


def test_groups_equal_brute_force(spark):
    data = corpus()
    df = with_clashes(spark.createDataFrame(data, SCHEMA))
    rows = simhash_groups(df).collect()
    assert len(rows) == len(data)
    fps = sorted({fingerprint(t) for _, t, *_ in data})
    near = [(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 4]
    root = union(near, fps)
    least = {}
    for i, t, *_ in data:
        r = root[fingerprint(t)]
        least[r] = min((x for x in (least.get(r), i) if x is not None), default=None)
    texts = {}
    for i, t, *_ in data:
        texts.setdefault(i, []).append(least[root[fingerprint(t)]])
    for r in rows:
        assert r.component_id in texts[r.doc_id]


def test_chains_and_every_distance(spark):
    """Links at exactly 0 .. 4 flipped bits, none at 5; a chain is one component."""
    rng = random.Random(3)
    fps, near = set(), []
    for d in range(1, 7):
        for _ in range(30):
            a = rng.getrandbits(64)
            b = a
            for bit in rng.sample(range(64), d):
                b ^= 1 << bit
            fps |= {a, b}
            near += [(a, b)] if d <= 4 else []
    chain = [rng.getrandbits(64)]
    for _ in range(12):
        x = chain[-1]
        for bit in rng.sample(range(64), 4):
            x ^= 1 << bit
        chain.append(x)
    fps |= set(chain)
    centre = rng.getrandbits(64)  # a dense cluster: many within reach of each other
    dense = {centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(300)}
    fps |= dense
    want = union([(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 4], sorted(fps))
    signed = [(int(np.uint64(x).view(np.int64)),) for x in fps]
    found = links(spark.createDataFrame(signed, "fp long")).collect()
    for r in found:
        a, b = r.u % (1 << 64), r.v % (1 << 64)
        assert want[a] == want[b]
    got = union([(r.u % (1 << 64), r.v % (1 << 64)) for r in found], sorted(fps))
    assert got == want


def test_components_of_random_links(spark):
    rng = random.Random(4)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1040)] + [(7, 7)]
    want = union([tuple(sorted(p)) for p in pairs], sorted({x for p in pairs for x in p}))
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    alone = {n for n, r in want.items() if sum(x == r for x in want.values()) == 1}
    assert got == {n: r for n, r in want.items() if n not in alone}


def test_flips():
    assert len(flips(2)) == 1 + 64 + 2016 and len(set(flips(2).tolist())) == 2081


def test_empty_table(spark):
    assert simhash_groups(spark.createDataFrame([], SCHEMA)).count() == 0


def test_keys_pack_and_meet():
    rng = np.random.default_rng(2)
    for n, top in [(0, 9), (1, 1 << 40), (4000, 1 << 20), (4000, 1 << 62), (3000, 1 << 33), (30, 3)]:
        keys = keyblobs.twice(rng.integers(0, top, n).astype(np.uint64))
        assert (keyblobs.unpack(keyblobs.pack(keys)) == keys).all()
    some = np.unique(rng.integers(0, 1 << 40, 500).astype(np.uint64))
    every = np.concatenate([some[::3], rng.integers(0, 1 << 40, 500).astype(np.uint64)])
    assert (keyblobs.member(some, every) == np.isin(every, some)).all()


def test_packed_rows_grow_with_the_keys_and_memory_with_their_root():
    from multisvm.llm import keyblobs

    for keys in (0, 1, 10**6, 10**9, 10**11, 10**13, 10**14):
        batches, buckets = keyblobs.layout(keys, 1_000_000, 700_000)
        assert batches * buckets * keyblobs.LEAST_KEYS <= max(2 * keys, 10**8)
        assert keys / batches <= max(1_000_000, 100 * keys**0.5) and keys / buckets <= max(700_000, 100 * keys**0.5)
    small, large = (keyblobs.layout(n, 1_000_000, 700_000) for n in (10**11, 10**14))
    assert large[0] < 40 * small[0]  # a thousand times the keys: some thirty times the batches and the rows of each, not a thousand


def test_buckets_are_even_ranges_of_any_width():
    import numpy as np
    from multisvm.llm import keyblobs

    rng = np.random.default_rng(1)
    for bits, buckets in ((64, 1), (64, 7), (44, 1000), (24, 5), (32, 3), (64, 3_000_000)):
        keys = np.sort(rng.integers(0, 1 << bits, 5000, dtype=np.uint64))
        parts = keyblobs.buckets_of(keys, buckets, bits)
        assert np.array_equal(np.concatenate([k for _, k in parts]), keys) and [b for b, _ in parts] == sorted({b for b, _ in parts})
        assert all(0 <= b < buckets and (keyblobs.bucket_numbers(k, buckets, bits) == b).all() for b, k in parts)
        if buckets <= 1000:
            assert max(len(k) for _, k in parts) < 3 * len(keys) / buckets + 20


def test_hot_centres_are_joined_by_broadcast(spark):
    from multisvm.llm import components as c

    links = [(i, 0) for i in range(1, 3000)] + [(5000 + i, 5001 + i) for i in range(40)]
    df = spark.createDataFrame(links, "u long, v long")
    facts = df.groupBy("u").agg(c.F.min("v").alias("m"), c.F.count("*").alias("n"))
    rows = c.join_counted(df.select(c.F.col("v").alias("u"), c.F.col("u").alias("w")), df.groupBy(c.F.col("v").alias("u")).agg(c.F.count("*").alias("n")), "u", len(links))
    assert rows.count() == len(links) and facts.count() > 0
    roots = {r.node: r.root for r in c.components(df).collect()}
    assert all(roots[i] == 0 for i in range(3000)) and all(roots[5000 + i] == 5000 for i in range(41))


def test_a_batch_of_variants_is_held_once():
    """Making and packing a batch's variants takes little besides their own array."""
    import tracemalloc

    from multisvm.llm.simhash import _variants

    fps, masks = np.sort(np.random.default_rng(6).integers(0, 1 << 63, 2048).astype(np.uint64)), flips(2)
    tracemalloc.start()
    try:
        keys = _variants(fps, masks, 35)
        made = tracemalloc.get_traced_memory()[1]
        table = keyblobs.blob_table(0, keys, 54, 35)
        packed = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert made < 1.3 * keys.nbytes and packed < 1.7 * keys.nbytes
    got = np.concatenate([keyblobs.unpack(b) for b in table.column("keys").to_pylist()])
    assert np.array_equal(got, keyblobs.twice(keyblobs.mix((fps[:, None] ^ masks[None, :]).ravel()) >> np.uint64(29)))
