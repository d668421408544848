"""Operators 4 and 9 equal the libraries, whole text by whole text."""

import base64
import hashlib
import random

import public_tokenizers as P
import pytest
import sentencepiece
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from palimp.llm import bpe, token_counts

from .helpers import ODD, documents, sentence

RANKS, MODEL = P.path("byte_bpe_50k.tiktoken"), P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def small():
    """Chunks so small that every text is stitched."""
    return bpe.ByteBPE(RANKS, P.PATTERN, chunk=40, overlap=16)


def texts():
    rng = random.Random(3)
    return [*ODD, *(sentence(rng, n) for n in (1, 5, 400, 4000)), "word\n" * 5000, " " * 20_000 + "end", "a" * 20_000 + " b" * 3]


@pytest.mark.parametrize("chunk,overlap", [(bpe.CHUNK, bpe.OVERLAP), (300, 24)])
def test_bpe_equals_library(spark, library, chunk, overlap):
    data = documents(spark, [*texts(), *texts()[:6]])
    got = {r["doc_id"]: r for r in bpe.encode_decode(data, RANKS, P.PATTERN, emit=bpe.Digest, columns=bpe.AS_DIGEST, chunk=chunk, overlap=overlap).collect()}
    for r in data.collect():
        ids = library.encode_ordinary(r["text"] or "")
        x = got[r["doc_id"]]
        assert x["n_tokens"] == len(ids)
        assert x["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert x["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()


def test_bpe_ids_repeated_rows_and_empty_table(spark, library):
    rows = spark.createDataFrame([("k", "one two"), ("k", "one two"), (None, "z" * 9000), (None, "z" * 9000), ("k", None)], "id string, body string")
    got = bpe.encode_decode(rows, RANKS, P.PATTERN, text="body", key="id").collect()
    assert sorted((r["id"] or "", r["decoded"]) for r in got) == sorted((a or "", b or "") for a, b in [(r["id"], r["body"]) for r in rows.collect()])
    assert [list(r["ids"]) for r in got if r["decoded"] == "one two"] == [library.encode_ordinary("one two")] * 2
    assert bpe.encode_decode(rows.limit(0), RANKS, P.PATTERN, text="body", key="id").collect() == []


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab'strelm d\n\t  12%é日\u0301\u00a0", max_size=400))
def test_stitching(small, library, text):
    ids = small.encode(text)
    assert ids == library.encode_ordinary(text) and small.decode(ids) == text.encode()


def test_stitching_at_white_space(library):
    """20,000 texts full of blank lines, tabs, no-break spaces and apostrophes, in chunks of 16 to 64 signs."""
    coder, rng = bpe.ByteBPE(RANKS, P.PATTERN), random.Random(11)
    parts = ["\n\n", "\n", "\t", "\u00a0", "  ", " ", "'s", "'", "don't", "we'll", "a", "word", "12", "é", "!?", "\r\n", "\x85", "\u2028", "\x1f", "日本"]
    for _ in range(20_000):
        coder.chunk, coder.overlap = rng.randint(16, 64), rng.randint(9, 24)
        text = "".join(rng.choices(parts, k=rng.randint(5, 60)))
        assert coder.encode(text) == library.encode_ordinary(text), (coder.chunk, coder.overlap, text)


@pytest.mark.parametrize("space", ["\n\n", "\n\n\n", " \n", "\u00a0\u00a0", "\t\t", "  "])
def test_white_space_around_a_chunk_border(library, space):
    coder = bpe.ByteBPE(RANKS, P.PATTERN)
    for at in (*range(bpe.CHUNK - 4, bpe.CHUNK + 4), *range(bpe.CHUNK + bpe.OVERLAP - 10, bpe.CHUNK + bpe.OVERLAP + 3)):
        text = ("one two " * 4000)[:at] + space + "three four " * 50
        assert coder.encode(text) == library.encode_ordinary(text), at


@pytest.mark.parametrize("text", ["a" * 500, " " * 300 + "x", "x" + " " * 300, "1" * 97 + "a" * 97 + " " * 97, "we're " * 60, "it's'll" * 50, "\n \n" * 99])
def test_stitching_without_agreement(small, library, text):
    assert small.encode(text) == library.encode_ordinary(text)


def test_token_counts_equal_library(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    data = documents(spark, [*texts(), *texts()[:6]])
    got = {r["doc_id"]: r for r in token_counts.token_counts(data, MODEL).collect()}
    for r in data.collect():
        text = r["text"] or ""
        n = len(sp.encode(text))
        assert (got[r["doc_id"]]["n_bytes"], got[r["doc_id"]]["n_tokens"], got[r["doc_id"]]["over_limit"]) == (len(text.encode()), n, n > 4096), text[:40]
    assert token_counts.token_counts(data.limit(0), MODEL).collect() == []


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="abc  \n\u2581é<s>/0", max_size=60), max_size=8))
def test_segments(texts):
    import pyarrow as pa

    counter = _counter()
    assert counter.counts(pa.array(texts, pa.string())).tolist() == counter.whole(texts)


def _counter(cache=[]):  # noqa: B006
    if not cache:
        cache.append(token_counts.PieceCounter(MODEL))
    return cache[0]
