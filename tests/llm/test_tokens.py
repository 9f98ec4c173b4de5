import hashlib

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm.helpers import ROWS, clashing, docs, rows_of
from vigilspark.llm.bpe import ByteBPE, Memo
from vigilspark.llm.bpe_codec import bpe_round_trip, encode_decode_digest
from vigilspark.llm.token_counts import token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
OWN = ByteBPE(open(PATH, "rb").read())


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=60))
def test_encode_count_decode_equal_library(text):
    ids = LIBRARY.encode(text, add_special_tokens=False).ids
    assert OWN.encode(text) == ids
    assert OWN.count(text) == len(ids)
    assert OWN.decode(ids) == LIBRARY.decode(ids, skip_special_tokens=False) == text


@pytest.mark.parametrize("text", ["<|endoftext|>", "a<|endoftext|>b  <|endoftext|>", "  \n\n x", "don't we'll", "\x1c\x1d", "ab" * 5000, "́e­"])
def test_edges_equal_library(text):
    assert OWN.encode(text) == LIBRARY.encode(text, add_special_tokens=False).ids
    assert OWN.count(text) == len(OWN.encode(text))


def test_decode_of_broken_utf8():
    ids = LIBRARY.encode("é", add_special_tokens=False).ids + OWN.encode("a")
    cut = [OWN.byte_id[0xC3]] + OWN.encode("a")
    assert OWN.decode(ids) == "éa"
    assert OWN.decode(cut) == LIBRARY.decode(cut, skip_special_tokens=False)


def test_memo_is_bounded():
    memo = Memo(len)
    memo.LIMIT = 3
    assert [memo[w] for w in ("a", "bb", "ccc", "dddd", "a" * 100)] == [1, 2, 3, 4, 100]
    assert len(memo) <= 3 and len(memo.old) <= 3 and "a" * 100 not in memo
    asked = []
    memo = Memo(lambda w: asked.append(w) or len(w))
    memo.LIMIT = 3
    for k in range(30):
        assert memo["often"] == 5 and memo[f"rare{k}"] == len(f"rare{k}")
    assert asked.count("often") == 1 and len(asked) == 31


def test_counts_of_awkward_rows(spark):
    want = sorted(((i, len((t or "").encode()), len(LIBRARY.encode(t or "", add_special_tokens=False).ids)) for i, t, _, _ in ROWS), key=lambda r: tuple((v is None, str(v)) for v in r))
    assert rows_of(token_counts(docs(spark), PATH), "doc_id", "n_bytes", "n_tokens") == want
    assert rows_of(token_counts(clashing(spark), PATH), "doc_id", "n_bytes", "n_tokens") == want
    assert token_counts(docs(spark, []), PATH).count() == 0


def test_digests_of_awkward_rows(spark):
    want = []
    for i, t, _, _ in ROWS:
        ids = LIBRARY.encode(t or "", add_special_tokens=False).ids
        back = LIBRARY.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    want.sort(key=lambda r: tuple((v is None, str(v)) for v in r))
    columns = ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert rows_of(encode_decode_digest(bpe_round_trip(docs(spark), PATH)), *columns) == want
    assert rows_of(encode_decode_digest(bpe_round_trip(clashing(spark), PATH)), *columns) == want
    assert bpe_round_trip(docs(spark, []), PATH).count() == 0
