"""Encoding whole texts with a public byte-level tokenizer, and decoding them again.

The encoder is tiktoken with a local rank file; the file's path is a parameter (default: environment variable
``TERRAFOLD_TOKENIZERS`` or /opt/tokenizers).  A long text is cut before it is encoded, at places where the splitting
pattern always begins a new word, and the encoder never holds all words of a very long text at once.  There are two kinds:

* anything but white space, followed by white space: words of the pattern have white space only at their beginning;
* a letter of the common scripts, followed by punctuation, as in texts without blanks: words of letters end before it.

No word crosses such a place and the pattern never looks back, so the ids are those of the whole text.  A run of letters
without either, however long, is one word to the pattern and stays whole.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.ship import ship

RANKS = "byte_bpe_50k.tiktoken"
#: Texts longer than so many characters are encoded in parts of about that length.
PART = 1 << 14
_LETTER = "A-Za-zÀ-ÖØ-öø-ɏΑ-ΡΣ-Ωα-ωА-яא-תء-غف-يअ-हก-ะぁ-ゖァ-ヺ一-龥가-힣"
_STOP = "!\"#$%&()*,./:;<=>?@\\[\\]{|}~、。〈-】「」『』！（），．：；？"
_SAFE = re.compile(rf"(?<=\S)(?=[ \t\r\n\u3000])|(?<=[{_LETTER}])(?=[{_STOP}])")


def rank_file(name: str = RANKS, folder: str | None = None) -> str:
    return os.path.join(folder or os.environ.get("TERRAFOLD_TOKENIZERS", "/opt/tokenizers"), name)


@lru_cache(maxsize=4)
def encoder(path: str):
    """The tokenizer of a rank file, without special tokens; built once per worker.

    Texts are split into words by the pattern that the encoder library publishes for this vocabulary.
    """
    import tiktoken
    from tiktoken_ext.openai_public import r50k_pat_str

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding(os.path.basename(path), pat_str=r50k_pat_str, mergeable_ranks=ranks, special_tokens={})


def parts_of(text: str, size: int = PART) -> Iterator[str]:
    """Cut a text at safe places, each part being at least ``size`` long but for the last; one without any stays whole."""
    start = 0
    while len(text) - start > size:
        cut = _SAFE.search(text, start + size)
        if not cut:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def ids_of(text: str | None, path: str, size: int = PART) -> np.ndarray:
    """The ids of a text; of an empty or null text none."""
    if not text:
        return np.zeros(0, np.int32)
    enc = encoder(path)
    found = [enc.encode_to_numpy(p, disallowed_special=()) for p in parts_of(text, size)]
    return (found[0] if len(found) == 1 else np.concatenate(found)).astype(np.int32)


def bytes_of(ids: list[int] | np.ndarray, path: str) -> bytes:
    """The raw bytes of ids.  A run of ids may begin or end within a character, so text is made only of the whole."""
    return encoder(path).decode_bytes([int(i) for i in ids])


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """``key, ids``: one row per document, with an empty list for a null or empty text; never a null list."""
    ranks = path or rank_file()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [ids_of(t.as_py(), ranks) for t in b.column(1)]
            ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
            flat = np.concatenate(found) if found else np.zeros(0, np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], names=[key, "ids"])

    ship(docs.sparkSession)
    kind = dict(docs.dtypes)[key]
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def count(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """``key, n_tokens``: 0 for a null or empty text."""
    ranks = path or rank_file()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = np.fromiter((len(ids_of(t.as_py(), ranks)) for t in b.column(1)), np.int32, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n)], names=[key, "n_tokens"])

    ship(docs.sparkSession)
    kind = dict(docs.dtypes)[key]
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_tokens int")


def decode(encoded: DataFrame, key: str = "doc_id", path: str | None = None) -> DataFrame:
    """``key, bytes``: the raw bytes of a table ``key, ids``; a null list gives null."""
    ranks = path or rank_file()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [None if x is None else bytes_of(x, ranks) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=[key, "bytes"])

    ship(encoded.sparkSession)
    kind = dict(encoded.dtypes)[key]
    return encoded.select(key, "ids").mapInArrow(run, f"`{key}` {kind}, bytes binary")


def round_trip(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """``key, n_tokens, same``: whether decoding gives the text's bytes back (those of an empty text for null)."""
    ranks = path or rank_file()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, same = [], []
            for t in b.column(1):
                s = t.as_py()
                ids = ids_of(s, ranks)
                n.append(len(ids))
                same.append(bytes_of(ids, ranks) == (s or "").encode())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int32()), pa.array(same)], names=[key, "n_tokens", "same"])

    ship(docs.sparkSession)
    kind = dict(docs.dtypes)[key]
    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, n_tokens int, same boolean")
