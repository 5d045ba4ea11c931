from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from staffloom.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    ranks, _ = bpe.ranks_of(PATH)
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_random_texts_match_the_library(reference):
    rng = random.Random(1)
    parts = ["a", "s", "'s", "'t", "'ll", "'re", "'", "  ", " ", "\n", "\t", "1", "½", "é", "ß", "中", "!", "?", "\x1c", "\x85", "'ve", "r", "　", "L", "'S", "\U0001f600", "́", "<|endoftext|>"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    assert [x.tolist() for x in bpe.encoder(PATH).encode(texts)] == [reference.encode_ordinary(t) for t in texts]


def test_blocks_don_t_change_the_result(reference, monkeypatch):
    texts = ["it's  a 'll x " * 60, "y" * 700 + "' s", " " * 300 + "z"]
    monkeypatch.setattr(bpe, "BLOCK", 50)
    assert [x.tolist() for x in bpe.encoder(PATH).encode(texts)] == [reference.encode_ordinary(t) for t in texts]


def test_scan_composes_as_one_by_one_steps():
    single, table, from_none, _ = bpe.automaton()
    kinds = np.random.default_rng(0).integers(0, 16, 5000)
    states, state = [], bpe.NONE
    for k in kinds:
        state = bpe.step(state, int(k))[0]
        states.append(state)
    assert from_none[bpe.scan(single[kinds], table)].tolist() == states


def test_long_and_short_merges_agree():
    ranks, _ = bpe.ranks_of(PATH)
    for piece in (b"internationalization", b"aaaaaaaaaaaaab", "日本語テキスト".encode(), bytes(range(60))):
        assert bpe.merged_short(piece, ranks) == bpe.merged_long(piece, ranks)


def test_table_round_trip(docs, texts, reference, empty):
    ranks, vocabulary = bpe.ranks_of(PATH)
    for r in bpe.encoded(docs, PATH).collect():
        raw = (texts[r.doc_id] or "").encode()
        ids = reference.encode_ordinary(texts[r.doc_id] or "")
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(raw).hexdigest() and r.offsets[-1] == len(raw)
        half = len(ids) // 2
        assert bpe.decode(np.array(r.ids, np.uint32), np.array(r.offsets), vocabulary, half) == raw[r.offsets[half] :]
    assert bpe.encoded(empty, PATH).count() == 0
