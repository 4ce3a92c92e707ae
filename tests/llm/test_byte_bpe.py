"""Pieces, ids and offsets against tiktoken; decoding is an exact round trip."""

from __future__ import annotations

import pickle
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from pairloom.llm import byte_bpe as bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
HARD = [
    "", " ", "  ", "a", "'s", "it's", " 's", "  's", "\n's", "don't 'tis I'LL we'll they'vex 'rest", "''s", "!'s", "'", "a'", "a' b",
    "x  y", "x\n\ny", "x \n y", "x\t y", "tail  ", "tail \n", " x", "   x", "　　x", "1 22 ３ ½", "a1b2", "a_b",
    "Größe über", "日本語 テキスト", "été", "😀😀 ab", "\0\0a\0", "\x1c\x1d x", "\x85\x85y", "a" * 3000, "ab" * 2000, " " * 700 + "z", "'re're're", "'d'd d'd",
    "###!!!   ???\r\n\r\nend", "'ſ", "a'llb",
]


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(PATH)


@pytest.fixture(scope="module")
def reference(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def made_up(n: int) -> list[str]:
    dice = random.Random(5)
    alphabet = "aabcdestrvml'' éü日0179 \n\t !?#-_　\U0001d49c\U0001f600"
    return ["".join(dice.choice(alphabet) for _ in range(dice.randrange(0, 80))) for _ in range(n)]


def test_ids_and_offsets(ranks, reference):
    values = HARD + made_up(3000)
    cache = bpe.PieceCache(ranks)
    ids, offsets, counts = bpe.encode_texts(values, cache)
    ends = np.cumsum(counts)
    for text, end, count in zip(values, ends, counts):
        own = ids[end - count : end].tolist()
        assert own == reference.encode_ordinary(text), text
        sizes = [len(reference.decode_single_token_bytes(i)) for i in own]
        assert offsets[end - count : end].tolist() == [sum(sizes[:i]) for i in range(len(sizes))]


def test_operator_keeps_rows_and_columns(spark, reference):
    rows = [(1, "it's", "x"), (1, "it's", "x"), (None, None, "y"), (3, "", None), (4, "abc " * 40_000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    decoded = bpe.decode(bpe.encode(docs, PATH), PATH).collect()
    assert [bytes(r["decoded"]).decode() for r in sorted(decoded, key=lambda r: len(r["ids"]))] == ["", "", "it's", "it's", "abc " * 40_000]
    assert all(r["ids"] == reference.encode_ordinary(bytes(r["decoded"]).decode()) for r in decoded)
    assert bpe.token_digests(docs.limit(0), PATH).collect() == []


def test_a_task_has_one_python_worker(spark):
    docs = spark.createDataFrame([(1, "it's"), (2, None)], "doc_id long, text string")
    digests = bpe.token_digests(docs, PATH)
    assert digests._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert {r["doc_id"]: r["n_tokens"] for r in digests.collect()} == {1: 2, 2: 0}


def test_decoding_holds_bytes_only(ranks, reference):
    tokens = bpe.TokenBytes(ranks)
    ids = reference.encode_ordinary("Größe über 日本語")
    assert bytes(tokens.of(np.array(ids))).decode() == "Größe über 日本語"
    assert len(pickle.dumps(tokens)) < 1 << 20


def test_generations_of_the_cache_give_the_same_ids(ranks, reference, monkeypatch):
    monkeypatch.setattr(bpe.PieceCache, "MOST_PIECES", 60)
    cache, values = bpe.PieceCache(ranks), made_up(600)
    for begin in range(0, 600, 20):
        part = values[begin : begin + 20]
        ids, _, counts = bpe.encode_texts(part, cache)
        for text, end, count in zip(part, np.cumsum(counts), counts):
            assert ids[end - count : end].tolist() == reference.encode_ordinary(text)
        assert cache.bytes_of(ids).tobytes().decode() == "".join(part)
    assert cache.elder[0] and len(cache) < 600


def test_decoding_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK_IDS", 7)
    rows = [(i, None if i % 7 == 0 else list(range(i, i + i % 11))) for i in range(60)]
    tokens = {rank: token for token, rank in bpe.read_ranks(PATH).items()}
    docs = spark.createDataFrame(rows, "doc_id long, ids array<int>")
    found = {r["doc_id"]: bytes(r["decoded"]) for r in bpe.decode(docs, PATH).collect()}
    assert found == {i: b"".join(tokens[x] for x in ids or ()) for i, ids in rows}
    with pytest.raises(Exception, match="do not have"):
        bpe.decode(spark.createDataFrame([(1, [60_000])], docs.schema), PATH).collect()


def test_merging_many_pieces_is_merging_each(ranks):
    pieces = [t.encode() for t in made_up(400) if t] + [b"a" * 64, b"a" * 65, b"ab" * 40, b"th", b"\xff\xfe"]
    ids, counts = bpe.Merger(ranks).merge_all(pieces)
    ends = np.cumsum(counts)
    assert [ids[e - c : e].tolist() for e, c in zip(ends, counts)] == [bpe.merge(p, ranks) for p in pieces]
    assert bpe.Merger(ranks).merge_all([])[0].tolist() == []
