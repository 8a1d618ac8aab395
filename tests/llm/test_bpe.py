import hashlib
import random
import tracemalloc

import public_tokenizers
import pytest
from helpers import SCHEMA, corpus, with_clashes
from multisvm.llm import bpe
from tokenizers import Tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids_of(text):
    return [int(i) for ids in bpe.encode_stream(PATH, text) for i in ids]


def texts():
    rng = random.Random(1)
    letters = "abcdefghijklmnopqrstuvwxyz"
    out = [t or "" for _, t, *_ in corpus()]
    out += ["".join(rng.choices(letters, k=rng.randint(1, 60))) for _ in range(1500)]
    out += [rng.choice(["a", "the", "ing", "aa", "lol", "xo"]) * rng.randint(1, 300) for _ in range(100)]
    odd = ["é", "ß", "A", "Σ", "ς", "İ", "日", "\U0001f642", "'s", "'", "'LL", "1", "٣", "½", "_", "-", "!!!",
           "\x1c", "\x85", "　", "é", "<|endoftext|>", "<|startoftext|>", "<|", "​", "x", " ", "\n", "Ⅷ", "ǅ", " ", "᠎"]
    out += ["".join(rng.choices(odd, k=rng.randint(1, 14))) for _ in range(1500)]
    out += [f"a{chr(c)}b {chr(c)}" for c in [*range(0x300), *rng.sample(range(0x300, 0xD800), 800), *rng.sample(range(0xE000, 0x1FFFF), 400)]]
    return out


def test_ids_and_decoded_text_equal_the_library(library):
    for t in texts():
        want = library.encode(t, add_special_tokens=False).ids
        assert ids_of(t) == want, t
        assert "".join(bpe.codec(PATH).pieces([want])) == library.decode(want, skip_special_tokens=False)


def test_a_long_piece_streams_in_constant_memory(library):
    rng = random.Random(2)
    of = bpe.codec(PATH).transducer
    for unit in ("a", "thering", "abc"):
        piece = unit * 300
        assert list(map(of.ids.get, of.encode(piece))) == library.encode(piece, add_special_tokens=False).ids
    piece = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=200_000))
    for _ in of.encode(piece):
        break
    tracemalloc.start()
    first, early = None, 0
    for n, _ in enumerate(of.encode(piece)):
        if n == 1000:
            first = tracemalloc.get_traced_memory()[0]
        early = n
    assert early > 10_000 and tracemalloc.get_traced_memory()[0] - first < 60_000_000 * 1
    tracemalloc.stop()


def test_plain_text_comes_back():
    of = bpe.codec(PATH)
    for t in ["the quick brown fox", "été 日本 \U0001f642"]:
        assert "".join(of.text(ids_of(t))).strip() == t


def test_queries_rows(spark, library):
    data = corpus()
    df = with_clashes(spark.createDataFrame(data, SCHEMA))
    want = []
    for i, t, *_ in data:
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.append((str(i), len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256(text.encode()).hexdigest()))
    got = [(str(r[0]), *r[1:]) for r in bpe.round_trip(df, PATH).collect()]
    assert sorted(got) == sorted(want)
    coded = bpe.encode_documents(df, PATH)
    back = bpe.decode_documents(coded, PATH)
    assert sorted(hashlib.sha256(r.text.encode()).hexdigest() for r in back.collect()) == sorted(w[3] for w in want)
    assert bpe.round_trip(spark.createDataFrame([], SCHEMA), PATH).count() == 0
