from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from staffloom.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_pieces_and_sequences(docs, texts, empty):
    tokenizer = Tokenizer.from_file(PATH)
    rows = packing.pack_documents(docs.union(docs.where("doc_id = 3")), PATH).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == set(texts)
    for i, text in texts.items():
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        own = sorted(by_doc[i], key=lambda r: (r.piece, r.sequence_id))[:: 2 if i == 3 else 1]
        assert [r.start for r in own] == [0, *np.cumsum([r.length for r in own])[:-1].tolist()]
        assert sum(r.length for r in own) == len(ids) and all(r.length == 2048 for r in own[1:])
        for r in own:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    for own in by_seq.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [0, *np.cumsum([r.length for r in own])[:-1].tolist()]
        assert sum(r.length for r in own) <= 2048
    assert packing.pack_documents(empty, PATH).count() == 0


def test_cut_points():
    assert packing.cut_points(1, 10) == [0, 1] and packing.cut_points(10, 10) == [0, 10]
    assert packing.cut_points(11, 10) == [0, 1, 11] and packing.cut_points(25, 10) == [0, 5, 15, 25]


def test_local_search_raises_squared_fill_and_empties_bins():
    lengths = np.array([6, 6, 6, 5, 5, 4, 4, 4], np.int64)
    bins = [[0, 5], [1, 6], [2, 3], [4, 7]]
    lengths2 = np.array([5, 3, 5, 3, 4, 4], np.int64)
    out = packing.local_search([[0, 4], [2, 5], [1, 3]], lengths2, 12)
    assert sorted(i for b in out for i in b) == list(range(6)) and all(lengths2[b].sum() <= 12 for b in out) and len(out) == 2
    before = sum(int(lengths[b].sum()) ** 2 for b in bins)
    out = packing.local_search([list(b) for b in bins], lengths, 12)
    assert sum(int(lengths[b].sum()) ** 2 for b in out) >= before


def test_close_to_the_lower_bound():
    lengths = np.random.default_rng(1).integers(1, 900, 3000)
    bins = packing.local_search(packing.best_fit(lengths, 2048), lengths, 2048)
    assert len(bins) <= -(-lengths.sum() // 2048) + 1


def test_ids_equal_the_library_s():
    tokenizer, encode = Tokenizer.from_file(PATH), packing.encoder(PATH)
    for text in ("", "a <|endoftext|> b", "<|endoftext|><|endoftext|>", "x" * 100_000, " " * 5_000 + "a", "it's　we've  \n\n  y" * 20_000):
        assert encode(text) == tokenizer.encode(text, add_special_tokens=False).ids
    for i in range(tokenizer.get_vocab_size()):  # every token by itself
        text = tokenizer.decode([i], skip_special_tokens=False)
        assert encode(text) == tokenizer.encode(text, add_special_tokens=False).ids


def test_every_underfull_bin_gives():
    rng = np.random.default_rng(3)
    lengths = rng.integers(500, 900, 2_000)
    bins = packing.best_fit(lengths, 2048)
    found = packing.local_search([list(b) for b in bins], lengths, 2048)
    assert sorted(i for b in found for i in b) == list(range(len(lengths))) and all(lengths[b].sum() <= 2048 for b in found)
    assert len(found) <= len(bins) - 20  # many bins must give before as many are empty
