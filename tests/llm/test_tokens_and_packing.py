"""Token counts and packing against the library itself."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm.cases import rows, table
from tokenizers import Tokenizer

from tracelode.llm import packing, tokens
from tracelode.llm.bpe import VOCABULARY, PreTokens


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path(VOCABULARY))


TEXTS = [
    "", " ", "it's we'll 'sx don't", "a  b\n\n c \t", "x² ½ Ünïcode ٣ 中文 😀 <|endoftext|> tail<|endoftext|>", "a\x1cb\x85c\xa0d", "=" * 300, "word" * 100, "_a_1", "І’м “quoted” — dash…",
]


@pytest.mark.parametrize("text", TEXTS)
def test_cached_ids_equal_the_library(library, text):
    known = PreTokens()
    for _ in range(2):  # the second time from the cache
        assert np.frombuffer(known.ids(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.text(st.characters(codec="utf-8"), max_size=60))
def test_cached_ids_equal_the_library_on_any_text(text):
    known = test_cached_ids_equal_the_library_on_any_text.__dict__.setdefault("known", PreTokens())
    assert np.frombuffer(known.ids(text), "<u4").tolist() == known.library.encode(text, add_special_tokens=False).ids


def test_counts(spark, library):
    got = sorted(map(tuple, tokens.count_tokens(table(spark), limit=100).collect()), key=str)
    want = []
    for row in rows():
        n = len(library.encode(row[1] or "", add_special_tokens=False).ids)
        want.append((row[0], len((row[1] or "").encode()), n, n > 100))
    assert got == sorted(want, key=str)
    assert tokens.count_tokens(table(spark, [])).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 300), max_size=60), st.sampled_from([8, 64, 100]))
def test_layout_keeps_every_id_once(lengths, capacity):
    at = packing.layout(np.array(lengths, np.int64), capacity)
    for doc, length in enumerate(lengths):
        own = at[at[:, 0] == doc]
        own = own[np.argsort(own[:, 1])]
        assert own[0, 1] == 0 and own[-1, 1] + own[-1, 2] == length and (own[:-1, 1] + own[:-1, 2] == own[1:, 1]).all()
    for number in np.unique(at[:, 3]):
        own = at[at[:, 3] == number]
        assert own[0, 4] == 0 and (own[:-1, 4] + own[:-1, 2] == own[1:, 4]).all() and own[:, 2].sum() <= capacity
    # Only the last bins of the classes and of the stream can be short.
    assert sum(lengths) > 0.5 * capacity * (at[:, 3].max(initial=-1) - 12)


def test_packing_round_trip(spark, library):
    got = packing.pack(table(spark), block=2_000).collect()
    ids = {}
    for row in rows():
        ids.setdefault(row[0], []).append(library.encode(row[1] or "", add_special_tokens=False).ids + [1])
    sequences = {}
    for row in got:
        held = ids[row["doc_id"]]
        assert any(zlib.crc32(np.array(own[row["start"] : row["start"] + row["length"]], "<u4").tobytes()) == row["ids_crc32"] and len(own) == row["doc_tokens"] for own in held)
        sequences[row["sequence_id"]] = sequences.get(row["sequence_id"], 0) + row["length"]
    assert sum(sequences.values()) == sum(len(own) for held in ids.values() for own in held) and max(sequences.values()) <= 2048
    assert packing.pack(table(spark, [])).count() == 0


def test_small_cache_gives_the_same_ids(library):
    known, most = PreTokens(entries=4), 4
    for text in [*TEXTS, "one two three four five six seven", "six one nine ten"] * 2:
        most = max(most, len(known.pieces(text) or ()))  # what a text needs at once is kept
        assert np.frombuffer(known.ids(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
        assert len(known.older) <= most and len(known.cache) <= most
