import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyroom.llm import bpe_codec, token_coder
from tallyroom.llm.queries import word_vocabulary

from .conftest import odd_texts


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(word_vocabulary())


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 60_000), max_size=400), st.sampled_from([1, 4, 32]), st.sampled_from([32, 64, 256]))
def test_shards_round_trip(ids, lanes, block):
    ids = np.array(ids, np.uint32)
    raw = token_coder.encode_shard(ids, lanes=lanes, block_tokens=block, checkpoint_steps=4)
    shard = token_coder.Shard(raw)
    assert (shard.decode() == ids).all()
    for b in range(len(shard.blocks)):
        own = ids[b * block : (b + 1) * block]
        assert (shard.decode(b, b + 1) == own).all()
        for c in range(1, len(shard.blocks[b][2])):
            rest = own[c * 4 * lanes :]
            if len(rest):
                assert (shard.decode(b, b + 1, c, 4) == rest).all()


def test_shards_are_small_and_guarded():
    ids = np.random.default_rng(1).choice(np.array([3, 9, 70_000], np.uint32), 200_000, p=[0.9, 0.09, 0.01])
    raw = bytearray(token_coder.encode_shard(ids))
    assert len(raw) < 0.09 * 4 * len(ids)
    raw[-5] ^= 1
    with pytest.raises(ValueError):
        token_coder.Shard(bytes(raw)).decode()
    with pytest.raises(ValueError):
        token_coder.Shard(b"XXXX" + bytes(60))


def test_encoding_equals_the_library():
    own, lib = bpe_codec.codec(word_vocabulary()), library()
    for _, text in odd_texts():
        ids = own.encode(text or "")
        assert ids == lib.encode(text or "", add_special_tokens=False).ids
        assert own.decode(ids) == lib.decode(ids, skip_special_tokens=False)


@settings(max_examples=80, deadline=None)
@given(st.text(max_size=60))
def test_encoding_equals_the_library_on_any_text(text):
    text = text.encode("utf-8", "ignore").decode()
    assert bpe_codec.codec(word_vocabulary()).encode(text) == library().encode(text, add_special_tokens=False).ids


def test_documents_through_the_codec(odd, none):
    lib = library()
    rows = bpe_codec.encode_decode(odd, word_vocabulary()).collect()
    want = sorted(((i, lib.encode(t or "", add_special_tokens=False).ids) for i, t in odd_texts()), key=str)
    assert sorted(((r["doc_id"], r["ids"]) for r in rows), key=str) == want
    for r in rows:
        assert r["ids_sha256"] == hashlib.sha256(np.array(r["ids"], "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(r["decoded"].encode()).hexdigest()
    assert bpe_codec.encode_decode(none, word_vocabulary()).count() == 0


def test_documents_through_shards(odd, none):
    lib = library()
    shards = token_coder.write_shards(token_coder.tokenised(odd, word_vocabulary(), 2, shard_tokens=500))
    rows = token_coder.read_shards(shards).orderBy("start").collect()
    texts = sorted(odd_texts(), key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))
    at = 0
    for r, (i, t) in zip(rows, texts, strict=True):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 2]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert shards.count() >= 1
    assert token_coder.read_shards(token_coder.write_shards(token_coder.tokenised(none, word_vocabulary(), 2))).count() == 0
