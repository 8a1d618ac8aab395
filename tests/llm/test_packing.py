import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from helpers import SCHEMA, corpus, with_clashes
from multisvm.llm import bpe, packing
from multisvm.llm.packing import pack_documents, plan
from tokenizers import Tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")


def laid_out(counts, capacity):
    used, placed = {}, {}
    for n, first, pieces, seq, each, offset in plan(counts, capacity):
        assert first == placed.get(n, 0)
        placed[n] = first + pieces
        for k in range(pieces):
            used.setdefault(seq + k // each, []).append((offset + k % each * n, n))
    assert placed == {n: c for n, c in counts.items() if c}
    for parts in used.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= capacity
        assert sum(3 * n > capacity for _, n in parts) <= 2
    return len(used)


def test_plans_are_gapless_and_whole():
    rng = random.Random(1)
    for _ in range(400):
        capacity = rng.choice([1, 2, 10, 30, 100])
        laid_out({rng.randint(1, capacity): rng.randint(0, 9) for _ in range(rng.randint(0, 30))}, capacity)


def test_large_items_are_matched_as_well_as_can_be():
    rng = random.Random(2)
    for _ in range(200):
        items = [rng.randint(34, 100) for _ in range(rng.randint(1, 8))]

        def best(left):
            if not left:
                return 0
            first, rest = left[0], left[1:]
            return 1 + min([best(rest)] + [best(rest[:i] + rest[i + 1:]) for i, x in enumerate(rest) if first + x <= 100])

        assert laid_out({n: items.count(n) for n in items}, 100) == best(items)


def test_near_the_bound_on_many_documents():
    rng, counts = random.Random(3), {}
    for _ in range(50_000):
        n = min(4096, max(1, int(rng.lognormvariate(6.3, 1))))
        counts[n] = counts.get(n, 0) + 1
    assert laid_out(counts, 4096) <= 1.001 * -(-sum(n * c for n, c in counts.items()) // 4096) + 1


def test_pieces_and_places(spark):
    data = corpus()
    library = Tokenizer.from_file(PATH)
    want = []
    for i, t, *_ in data:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        for p, a in enumerate(range(0, len(ids), 256)):
            part = ids[a:a + 256]
            want.append((str(i), p, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    df = with_clashes(spark.createDataFrame(data, SCHEMA).repartition(5))
    rows = pack_documents(df, PATH, capacity=256, with_ids=True).collect()
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    assert all(len(r.ids) == r.length for r in rows)
    ends = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert ends.get(r.sequence_id, 0) == r.offset
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 256 and len(ends) <= -(-sum(w[3] for w in want) // 256) + 2
    assert pack_documents(spark.createDataFrame([], SCHEMA), PATH).count() == 0


def test_a_worker_keeps_no_words_after_its_task(spark):
    """The next job in the same worker does not carry the tables of this one."""
    docs = spark.createDataFrame([(i, f"one two word{i} more-of{i}") for i in range(200)], "doc_id long, text string").repartition(8)
    jobs = [lambda: pack_documents(docs, PATH).count(), lambda: bpe.round_trip(docs, PATH).collect(), lambda: bpe.encode_documents(docs, PATH).collect()]

    def left(batches):
        tables = [*packing._words(PATH), bpe.codec(PATH), bpe.encoded_words(PATH)]
        n = sum(len(t) + len(t.old) if isinstance(t, dict) else len(t._pieces) + len(t.transducer._known) for t in tables)
        for _ in batches:
            pass
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    for job in jobs:
        job()
        kept = [r.n for r in docs.mapInArrow(left, "n long").collect()]
        assert len(kept) == 8 and not any(kept)
