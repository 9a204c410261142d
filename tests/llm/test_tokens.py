"""Byte-level BPE against the tiktoken library, and exact round trips."""

import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from ebbtide.llm import bpe
from tests.llm.conftest import counted

RANKS = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def encoder():
    return bpe.load(RANKS, P.PATTERN)


@pytest.fixture(scope="module")
def library(encoder):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=encoder.ranks, special_tokens={})


@pytest.mark.parametrize("text", ["", " ", "a" * 3000, "abab" * 700 + "1234567" * 90, "漢字かな" * 200, "😀é " * 50, "\x00\x01 ", " \n\n  x  ", "it's they'll", "<|endoftext|>"])
def test_equals_the_library(encoder, library, text):
    ids = encoder.encode(text)
    assert ids.tolist() == library.encode_ordinary(text)
    assert encoder.decode(ids) == text.encode()


def test_forgetting_changes_nothing(encoder, library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 3)
    text = "some words that come again and again, some words that do not"
    assert encoder.encode(text).tolist() == library.encode_ordinary(text)


def test_words_of_a_large_vocabulary_are_merged_once():
    own, merged = bpe.Encoder({bytes([b]): b for b in range(256)}, P.PATTERN), []
    own.merge = lambda piece: merged.append(piece) or [0]
    text = " ".join(f"{i:05x}".translate(str.maketrans("0123456789", "ghijklmnop")) for i in range(390_000))
    own.encode(text)
    own.encode(text)
    assert len(merged) == len(set(merged)) == 390_000


def test_merging_leaves_the_queue_empty(encoder, library):
    for text in ("abababab", "aaaaaaaaaaaa", "zzyzzyx", "éèêçç", "q", "漢漢漢字字"):
        assert encoder.merge(text.encode()) == library.encode_ordinary(text)
        assert not encoder.queue.buckets and not any(encoder.queue.leaves)


def test_queue_gives_lowest_rank_then_leftmost():
    q = bpe.RankQueue(70_000)
    entries = [(69_999, 4), (300, 9), (300, 2), (0, 7), (255, 1), (256, 1)]
    for e in entries:
        q.push(*e)
    assert [q.pop() for _ in entries] == sorted(entries)
    assert not q.top


def test_odd_rows(odd, none, library):
    out = bpe.decode(bpe.encode(odd, RANKS, P.PATTERN), RANKS, P.PATTERN)
    want = [(r.doc_id, library.encode_ordinary(r.text or ""), (r.text or "").encode()) for r in odd.select("doc_id", "text").collect()]
    got = [(r.doc_id, np.frombuffer(r.token_ids, "<u4").tolist(), bytes(r.decoded)) for r in out.collect()]
    assert counted(got) == counted(want)
    assert bpe.encode(none, RANKS, P.PATTERN).count() == 0


@pytest.mark.parametrize("with_ids", [True, False])
def test_round_trip_of_odd_rows(odd, none, library, with_ids):
    def digest(x):
        return hashlib.sha256(x).hexdigest()

    want = []
    for r in odd.select("doc_id", "text").collect():
        ids = np.array(library.encode_ordinary(r.text or ""), "<u4").tobytes()
        want.append((r.doc_id, len(ids) // 4, digest(ids), digest((r.text or "").encode()), *[bytearray(ids)] * with_ids))
    assert counted(bpe.round_trip(odd, RANKS, P.PATTERN, with_ids=with_ids).collect()) == counted(want)
    assert bpe.round_trip(none, RANKS, P.PATTERN, with_ids=with_ids).count() == 0
