from __future__ import annotations

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from salesops.llm import simple8b
from salesops.llm.queries import token_ids, tokenizer_path
from tests.llm.conftest import ODD


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 2), st.integers(0, 60_000), st.integers(0, 2**64 - 1)), max_size=700))
def test_round_trip(ids):
    words, offsets = simple8b.encode_block(np.array(ids, dtype=np.uint64))
    assert simple8b.decode_block(words, offsets, len(ids)).tolist() == ids


@pytest.mark.parametrize("n", [239, 240, 241, 480, 1000])
def test_runs_of_zeros_take_one_word_each(n):
    words = simple8b.encode_words(np.zeros(n, dtype=np.uint64))
    assert len(words) <= n // 240 + 3
    assert not simple8b.decode_words(words, n).any()


def test_every_selector_is_used_where_it_fits():
    for selector in range(2, 16):
        ids = np.full(simple8b.COUNTS[selector], 2 ** int(simple8b.BITS[selector]) - 1, dtype=np.uint64)
        words = simple8b.encode_words(ids)
        assert len(words) == 1 and int(words[0]) >> 60 == selector


def test_runs_decode_from_their_offsets():
    ids = np.arange(3 * simple8b.CHUNK, dtype=np.uint64) % 50_000
    words, offsets = simple8b.encode_block(ids)
    assert len(offsets) == 3
    middle = simple8b.decode_words(words[offsets[1] : offsets[2]], simple8b.CHUNK)
    assert (middle == ids[simple8b.CHUNK : 2 * simple8b.CHUNK]).all()


@pytest.fixture(scope="module")
def both():
    return simple8b.WordTokenizer(tokenizer_path()), Tokenizer.from_file(tokenizer_path())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("aBzé É'.,!ツم\n\t0 <|>Σß́ﬁ　😀-"), max_size=40), max_size=4))
def test_words_give_the_ids_of_whole_texts(both, texts):
    mine, plain = both
    assert mine.by_word
    expected = [[*plain.encode(t, add_special_tokens=False).ids, 2] for t in texts]
    assert [ids.tolist() for ids in mine.encode(texts, 2)] == expected


def test_a_full_cache_changes_nothing(both, monkeypatch, texts):
    monkeypatch.setattr(simple8b, "CACHE_WORDS", 50)
    mine, plain = simple8b.WordTokenizer(tokenizer_path()), both[1]
    some = list(texts.values())[:40]
    for i in range(0, 40, 5):
        got = mine.encode(some[i : i + 5], 2)
        assert [g.tolist()[:-1] for g in got] == [plain.encode(t, add_special_tokens=False).ids for t in some[i : i + 5]]


class Watched:
    """A tokenizer that notes the words it is given."""

    def __init__(self, inner: Tokenizer, given: list[str]):
        self.inner, self.given = inner, given

    def encode(self, text, **options):
        self.given += text.split()
        return self.inner.encode(text, **options)

    def encode_batch_fast(self, texts, **options):
        self.given += " ".join(texts).split()
        return self.inner.encode_batch_fast(texts, **options)


def test_letters_are_tokenised_once_whatever_marks_follow(both):
    mine, plain, given = simple8b.WordTokenizer(tokenizer_path()), both[1], []
    mine.tokenizer, mine.plain = Watched(mine.tokenizer, given), Watched(mine.plain, given)
    portions = [
        ["Letters, letters.*** letters letters!!", "*** , naïve naïve' \"naïve\" it's it.'s it'"],
        ["letters.*** letters,%%% %%% LETTERS? naïve", "letters,%%%\nletters\tletters\u00a0x", "", "l'eau, l'eau"],
    ]
    for texts in portions:
        expected = [[*plain.encode(t, add_special_tokens=False).ids, 2] for t in texts]
        assert [ids.tolist() for ids in mine.encode(texts, 2)] == expected
    assert given.count("letters") == 3  # once, and twice inside a word with other white space
    assert given.count("naïve") == given.count("***") == given.count(",%%%") == 1


@pytest.mark.parametrize("n", [0, 1, 15, 16, 17, 1000])
def test_the_walk_over_words_visits_what_single_steps_reach(n):
    steps = np.random.default_rng(n).choice(simple8b.COUNTS, n)
    places, i = [], 0
    while i < n:
        places.append(i)
        i += steps[i]
    assert simple8b._walk(steps).tolist() == places


def expected(texts: dict, plain: Tokenizer) -> dict:
    start, out = 0, {}
    for doc_id in sorted(texts):
        ids = [*plain.encode(texts[doc_id] or "", add_special_tokens=False).ids, 2]
        out[doc_id] = (start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        start += len(ids)
    return out


def test_files_hold_what_the_tokenizer_gives(spark, small, texts, both):
    found = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_ids(spark, small).collect()}
    assert found == expected(texts, both[1])


def test_files_are_in_order(spark, documents, tmp_path):
    simple8b.write_token_files(documents, str(tmp_path / "t"), tokenizer_path(), 2, shards=5)
    rows = spark.read.parquet(str(tmp_path / "t")).orderBy("shard", "block").collect()
    ids = [i for r in rows for i in r["doc_ids"]]
    assert ids == sorted(ids) and len({r["shard"] for r in rows}) > 1


def test_odd_rows(spark, odd, no_docs):
    rows = simple8b.encode_and_read(odd, tokenizer_path()).collect()
    assert len(rows) == len(ODD)
    assert [r["n_tokens"] for r in rows if r["doc_id"] in (2, 3, 4)] == [1, 1, 1]
    ordered = sorted(rows, key=lambda r: r["start"])
    assert [r["doc_id"] for r in ordered][:2] == [None, None]
    assert simple8b.encode_and_read(no_docs, tokenizer_path()).count() == 0
