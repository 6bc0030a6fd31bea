import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkmill.llm.bpe import public_path, vocabulary
from sparkmill.llm.tokens import count_tokens, decode, encode

tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def pair():
    import public_tokenizers as P

    v = vocabulary(public_path())
    return v, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=v.ranks, special_tokens={})


def test_long_words_stream(pair):
    v, enc = pair
    rng = random.Random(0)
    for _ in range(60):
        s = rng.choice(["a" * rng.randint(1, 3000), "".join(rng.choice("ab") for _ in range(1500)), "".join(rng.choice("abcdefghijklmnopqrstuvwxyzéß€😀") for _ in range(900)), "=" * 700, " " * 600 + "x"])
        assert v.encode(s) == enc.encode_ordinary(s)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=200))
def test_any_text(pair, s):
    v, enc = pair
    s = s.encode("utf-8", "ignore").decode()
    ids = v.encode(s)
    assert ids == enc.encode_ordinary(s) and "".join(v.decode(ids)) == s


@pytest.mark.parametrize("word", [b"a" * 30_000, bytes(random.Random(1).choice(b"abcdefgh") for _ in range(30_000)), b"0" * 5_000 + b"=-" * 10_000])
def test_memory_is_bounded(pair, word):
    """Bytes that are read but not told yet never exceed a few lookaheads, however long a word is."""
    v, _ = pair
    read = told = most = 0

    def bytes_in():
        nonlocal read, most
        for b in word:
            read += 1
            most = max(most, read - told)
            yield b

    for t in v.transduce(bytes_in()):
        told += len(v.bytes_of[t])
    assert told == read == len(word) and most <= 4 * v.lookahead


def test_tables(spark, pair):
    v, enc = pair
    rows = [(1, "Hello <|endoftext|> world"), (2, None), (3, ""), (3, ""), (4, "x" * 100_000)]
    df = spark.createDataFrame([(*r, [1]) for r in rows], "doc_id bigint, text string, ids array<int>")
    got = sorted((r["doc_id"], list(r["ids"])) for r in encode(df).collect())
    assert got == sorted((i, enc.encode_ordinary(t or "")) for i, t in rows)
    assert sorted(r["n_tokens"] for r in count_tokens(df).collect())[:3] == [0, 0, 0]
    assert {r["doc_id"]: r["text"] for r in decode(encode(df)).collect()} == {i: t or "" for i, t in rows}
    assert encode(df.limit(0)).count() == 0
