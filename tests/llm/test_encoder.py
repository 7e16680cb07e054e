"""The word-wise encoder of the token files against the library's own encoding."""

import json
import random
import struct

import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from actlens.llm import token_files as tf

PATH = public_tokenizers.path(tf.TOKENIZER)


def _texts(n=300, seed=3):
    rng = random.Random(seed)
    parts = ["water", "kāinga", " ", " ", " ", "\n", "\t", "  ", "<|endoftext|>", " ", "x ", "\U0001F600", "don't", "3.14", ""]
    return ["".join(rng.choice(parts) + (str(rng.randrange(99)) if rng.random() < 0.2 else "") for _ in range(rng.randrange(20)))
            for _ in range(n)]


def _check(encoder, texts):
    for text, found in zip(texts, encoder.encode(texts)):
        ids = encoder.tokenizer.encode(text, add_special_tokens=False).ids
        assert found == struct.pack(f"<{len(ids)}H", *ids), text


def test_encoder_gives_the_library_s_ids(monkeypatch):
    texts = _texts()
    encoder = tf.Encoder(PATH)
    _check(encoder, texts)
    _check(encoder, texts)
    monkeypatch.setattr(tf, "_CACHED", 8)  # forgets its words all the time
    _check(tf.Encoder(PATH), texts)
    small = tf.Encoder(PATH)
    for k in range(0, len(texts), 3):
        _check(small, texts[k:k + 3])


def test_texts_of_known_words_gather_none(monkeypatch):
    encoder = tf.Encoder(PATH)
    encoder.encode(["a house of wood", "a road"])
    asked = []
    learn = encoder._learn
    monkeypatch.setattr(encoder, "_learn", lambda words, space, known: (asked.append((space, words)), learn(words, space, known)))
    encoder.encode(["a wood of house", "a road"])
    assert [words for space, words in asked if space] == []
    encoder.encode(["a wood of house", "a new road"])
    assert [words for space, words in asked if space] == [{"new", "road"}]


class _Counting:
    """A tokenizer that notes what it is given."""

    def __init__(self, tokenizer):
        self.tokenizer, self.given = tokenizer, []

    def encode(self, text, **how):
        self.given.append(text)
        return self.tokenizer.encode(text, **how)

    def encode_batch_fast(self, texts, **how):
        self.given += texts
        return self.tokenizer.encode_batch_fast(texts, **how)


def test_plain_words_go_to_the_model_alone():
    encoder = tf.Encoder(PATH)
    encoder.tokenizer = _Counting(encoder.tokenizer)
    encoder.encode(["Das Haus, très grand.\nThe (old) road; 42% of 3.14!"])
    assert encoder.tokenizer.given == ["Das"]  # the text's first word
    encoder.encode(["Das Haus isn't 東京"])
    assert sorted("".join(encoder.tokenizer.given[1:]).split()) == ["isn't", "東京"]


def test_plain_words_are_encoded_as_the_library_does():
    rng = random.Random(5)
    encoder = tf.Encoder(PATH)
    assert encoder.model is not None
    letters = [chr(c) for c in range(0x21, 0x250) if chr(c).isprintable()] + ["\n", "\n\n", "'s", "'", "\u00a0", "\u2028", "е", "٣", "\u0301"]
    texts = ["".join(rng.choice(letters) + rng.choice(["", "", " ", "a", "The", ".", "7", "\n"]) for _ in range(40)) for _ in range(1500)]
    texts += ["", "\n", " ", "a", " a\n", "x \ny", "x\n y"]
    names = sorted(encoder.tokenizer.get_vocab().values())
    pieces = [encoder.tokenizer.decode([k]) for k in names]
    texts += [" ".join(a.strip(" ") + b.strip(" ") for a, b in zip(pieces[k:k + 50], rng.sample(pieces, 50)))
              for k in range(0, len(pieces), 50)]
    _check(encoder, texts)


def test_a_model_that_joins_letters_and_signs_is_not_used_alone(tmp_path):
    config = json.load(open(PATH))
    config["model"]["vocab"]["e."] = len(config["model"]["vocab"]) + 1
    config["model"]["merges"].append(["e", "."] if isinstance(config["model"]["merges"][0], list) else "e .")
    joined = Tokenizer.from_str(json.dumps(config))
    assert tf._plain_model(joined) is None and tf._plain_model(Tokenizer.from_file(PATH)) is not None


def test_parts_hold_all_rows(monkeypatch):
    monkeypatch.setattr(tf, "_BYTES", 10)
    texts = ["a" * 4, None, "b" * 6, "c", "d" * 30, "", "e" * 10, "f"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(texts)], names=["doc_id", "text"])
    assert [p.column(0).to_pylist() for p in tf._parts(batch)] == [[0, 1, 2], [3], [4], [5, 6], [7]]
