"""Token counts of long stretches without blanks: right, and encoded a few times at most."""

import random

import pytest

from pulsegrid.llm import tokens

public_tokenizers = pytest.importorskip("public_tokenizers")
WORD_BPE = str(public_tokenizers.path("word_bpe_49k.json"))


def test_stretches_without_blanks_are_encoded_once(monkeypatch):
    tokenizer = tokens._ids(WORD_BPE).tokenizer
    rng, seen, starts = random.Random(1), [], tokens._starts
    monkeypatch.setattr(tokens, "_starts", lambda t, text, at: seen.append(len(text)) or starts(t, text, at))
    blob = "".join(rng.choices("abcdefghijklmnop0123456789+/", k=60_000))
    for text in (blob, f"word and {blob} tail " + "more words here " * 900 + blob, f"{blob} a", " ".join(["x" * 900] * 70), blob[:1200] + "\n" + blob):
        seen.clear()
        assert tokens.splice_count(tokenizer, text, 1000, 100) == len(tokenizer.encode(text, add_special_tokens=False).ids)
        assert sum(seen) < 4 * len(text)


def test_splices_of_any_chunk_agree():
    tokenizer = tokens._ids(WORD_BPE).tokenizer
    rng = random.Random(2)
    for _ in range(150):
        text = "".join(rng.choice(["ab", "x" * rng.randint(1, 60), " ", "\n", "é", "12", "'s", ",", "  "]) for _ in range(rng.randint(1, 400)))
        want = len(tokenizer.encode(text, add_special_tokens=False).ids)
        assert all(tokens.splice_count(tokenizer, text, chunk, overlap) == want for chunk, overlap in ((40, 5), (100, 16), (17, 3)))


def test_long_pieces_are_not_remembered():
    ids = tokens._ids(WORD_BPE)
    long = "z" * 200
    assert len(ids.of(f"a b {long}, Ж {long}")) // 4 == len(ids.tokenizer.encode(f"a b {long}, Ж {long}", add_special_tokens=False).ids)
    assert not any(len(p) > 48 for p in (*ids.pieces, *ids.words))
