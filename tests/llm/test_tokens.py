import os
import random

import pytest

from terrafold.llm import tokens

PATH = tokens.rank_file()
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no public tokenizers here")

TEXTS = [
    None,
    "",
    " ",
    "   \n\t ",
    "hello world",
    "don't we'll I'M it's <|endoftext|> x",
    "tabs\tand\r\nlines\r\n\r\n  indented\n",
    "日本語のテキスト、混ぜて English 123",
    "😀😃👩‍👩‍👧 é é   \x85\x1c x",
    "a" * 5000,
    "word " * 30000,
    ("line one is here\n" * 9000) + " " * 500,
    "漢" * 30000,
    "x1 \n y2\n\n\nz3   q " * 8000,
]


def plain(text):
    return tokens.encoder(PATH).encode_ordinary(text) if text else []


def test_whole_and_cut_texts_have_the_same_ids():
    for t in TEXTS:
        for size in (7, 100, tokens.PART):
            assert tokens.ids_of(t, PATH, size).tolist() == plain(t)


def test_the_published_pattern_finds_the_same_words():
    published = pytest.importorskip("public_tokenizers").PATTERN
    import tiktoken

    enc = tokens.encoder(PATH)
    other = tiktoken.Encoding("published", pat_str=published, mergeable_ranks=enc._mergeable_ranks, special_tokens={})
    rng = random.Random(1)
    alphabet = "ab cde  \n\n\t\r.,'stm'll1 23漢é😀  \x85_-"
    for t in [x for x in TEXTS if x] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for _ in range(3000)]:
        assert other.encode_ordinary(t) == plain(t)


def test_random_texts_cut_anywhere():
    rng = random.Random(3)
    alphabet = "ab cd  \n\n\t.,'stm 12漢é😀 "
    for _ in range(500):
        t = "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 200)))
        assert "".join(tokens.parts_of(t, 3)) == t
        assert tokens.ids_of(t, PATH, 3).tolist() == plain(t)
        assert tokens.bytes_of(plain(t), PATH) == t.encode()


def test_documents(spark):
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)] + [(1, "again", "x"), (None, "no id", "x")], "doc_id bigint, text string, ids string")
    got = tokens.encode(df).collect()
    assert len(got) == len(TEXTS) + 2
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["ids"]) for r in got) == sorted([*((i, plain(t)) for i, t in enumerate(TEXTS)), (1, plain("again")), (-1, plain("no id"))])
    assert {r["n_tokens"] for r in tokens.count(df.where("text = 'again'")).collect()} == {len(plain("again"))}
    back = {r["doc_id"]: bytes(r["bytes"]) for r in tokens.decode(tokens.encode(df.where("doc_id <> 1"))).collect()}
    assert all(back[i] == (t or "").encode() for i, t in enumerate(TEXTS) if i != 1)
    assert all(r["same"] for r in tokens.round_trip(df).collect())
    assert tokens.encode(df.limit(0)).count() == 0


def test_a_split_character_decodes_to_its_raw_bytes():
    ids = plain("😀")
    assert len(ids) > 1 and b"".join(tokens.bytes_of([i], PATH) for i in ids) == "😀".encode()
