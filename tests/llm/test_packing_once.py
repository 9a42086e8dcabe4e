"""How much of the texts packing hands to the tokenizer."""

import random

import numpy as np
import tokenizers

from cellwright.llm import packing

MARKS = ["", ",", ".", ";", "!", "?"]


class Counted:
    """A tokenizer, or its model, that counts the characters it is given."""

    seen = 0

    def __init__(self, inner):
        self.inner = tokenizers_made(inner.inner) if isinstance(inner, Counted) else inner

    @staticmethod
    def from_file(path):
        return Counted(from_file(path))

    @property
    def model(self):
        return Counted(self.inner.model)

    def __getattr__(self, name):
        got = getattr(self.inner, name)
        if name not in ("tokenize", "encode", "encode_batch_fast"):
            return got

        def call(given, **options):
            Counted.seen += len(given) if isinstance(given, str) else sum(map(len, given))
            return got(given, **options)

        return call


tokenizers_made, from_file = tokenizers.Tokenizer, tokenizers.Tokenizer.from_file


def test_a_word_is_tokenized_once_whatever_marks_follow(monkeypatch):
    import public_tokenizers

    rng = random.Random(5)
    words = sorted({"".join(rng.choices(["al", "bre", "cé", "dun", "eß", "fo", "gü"], k=5)) for _ in range(400)})
    texts = ["Go " + " ".join(w + rng.choice(MARKS) for w in rng.sample(words, len(words))) for _ in range(30)]
    monkeypatch.setattr(tokenizers, "Tokenizer", Counted)
    held = packing.Encoder(str(public_tokenizers.path("byte_bpe_50k.json")))
    encode = getattr(held, "encode_all", lambda many: [held.encode(x) for x in many])
    Counted.seen = 0
    got = encode(texts[:15]) + encode(texts[15:])
    assert Counted.seen < 2 * sum(map(len, words))
    whole = held.whole.inner
    assert [np.frombuffer(x, np.uint32).tolist() for x in got] == [whole.encode(x, add_special_tokens=False).ids for x in texts]


def test_parts_are_forgotten_by_number_and_by_size(monkeypatch):
    held = packing.encoder()
    texts = [f"text {'x' * n}y{n}é. a{n}\nb{n} 1{n}|, end{n}" for n in range(1, 60)] + ["", " ", "a ", "b  c", "a b ", "<|endoftext|> c<|endoftext|> <|endoftext|>"]
    for known, size, together in ((10, 10**9, 50), (10**9, 300, 50), (10**9, 10**9, 1)):
        monkeypatch.setattr(packing, "KNOWN", known)
        monkeypatch.setattr(packing, "HELD", size)
        held.forget()
        got = [x for i in range(0, len(texts), together) for x in held.encode_all(texts[i : i + together])]
        assert [np.frombuffer(x, np.uint32).tolist() for x in got] == [held.whole.encode(x, add_special_tokens=False).ids for x in texts]
    held.forget()
    assert len(held.known) == 0 and len(held.ids) == 0


def test_where_the_model_alone_does_not_do(monkeypatch):
    """A tokenizer with tokens beyond the end of a word, and one that writes spaces otherwise."""
    held = packing.Encoder(str(__import__("public_tokenizers").path("byte_bpe_50k.json")))
    texts = ["some words, and more\nof them; naïve 12 a.b", "other words. and some"]
    want = [held.whole.encode(x, add_special_tokens=False).ids for x in texts]
    held.bare = None
    assert [np.frombuffer(x, np.uint32).tolist() for x in held.encode_all(texts)] == want
    held.forget()
    held.begins[:] = False
    assert [np.frombuffer(x, np.uint32).tolist() for x in held.encode_all(texts)] == want
