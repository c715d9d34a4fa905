"""Properties over generated texts."""

import base64

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from inkgauge.llm import byte_bpe, fingerprints, near_dedup, packing

RANKS, WORDS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("word_bpe_49k.json")
SPECIAL = st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|endoftext|>a"])
TEXT = st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("ab .,!'\n\t  éΣ")), max_size=60)

_codec = byte_bpe.Codec(RANKS, public_tokenizers.PATTERN, 500)
_tokenizer = Tokenizer.from_file(WORDS)


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_bpe_equals_library_and_decodes(text):
    import tiktoken

    global _library
    if "_library" not in globals():
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
        _library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ((raw, _),) = _codec.encode([text])
    assert np.frombuffer(raw, "<u4").tolist() == _library.encode_ordinary(text)
    assert _codec.decode(raw) == text.encode()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(TEXT, TEXT, SPECIAL), max_size=4).map("".join))
def test_word_table_equals_tokenizer(text):
    (raw,) = packing.encode([text], WORDS)
    assert np.frombuffer(raw, "<u4").tolist() == _tokenizer.encode(text, add_special_tokens=False).ids


@given(st.integers(0, 10**6), st.integers(0, 12))
def test_pieces_are_powers_of_two(n, bits):
    pieces = packing.binary_lengths(n, 1 << bits)
    assert sum(pieces) == n and all(p & (p - 1) == 0 and 0 < p <= 1 << bits for p in pieces) and pieces == sorted(pieces, reverse=True)


@given(st.lists(TEXT, max_size=5), st.lists(TEXT, max_size=5), st.randoms())
def test_fingerprints_are_sums(one, two, rng):
    a, b, both = fingerprints.fingerprints(["\n".join(one), "\n".join(two), "\n".join(one + two)])[:, None]
    assert fingerprints.combine(a, b).tobytes() == both.tobytes()
    assert fingerprints.combine(both, b, -1).tobytes() == a.tobytes()
    mixed = one + two
    rng.shuffle(mixed)
    assert fingerprints.fingerprints(["\n".join(mixed)])[0].tobytes() == both[0].tobytes()
    assert 0 <= fingerprints.likeness(a, both)[0] <= 1


@given(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=12), st.integers(1, 5))
def test_shingle_counts(words, size):
    want = {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} or ({tuple(words)} if words else set())
    found = near_dedup.shingles(words, size)
    assert len(found) == len(want) and (np.diff(found.astype(float)) >= 0).all()
