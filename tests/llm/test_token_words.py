"""Words that end with a punctuation mark share the ids of the bare word."""

from __future__ import annotations

import public_tokenizers

from millrace.llm.token_files import Encoder

TEXTS = [
    "alpha beta, gamma. alpha, beta. gamma",
    "one's 3.5 a.b end... \"quoted.\" caf\u00e9, \u4f60\u597d! x? y;; .z , z\nnew. line",
    "a. b, . ,",
]


def test_a_word_and_its_mark_are_encoded_apart_and_equal_the_library(monkeypatch):
    encoder = Encoder(str(public_tokenizers.path("byte_bpe_50k.json")))
    asked = []
    raw = encoder._raw
    monkeypatch.setattr(encoder, "_raw", lambda texts: asked.extend(texts) or raw(texts))
    found = encoder.encode(TEXTS)
    assert "".join(asked).count(" beta") == 1
    assert found == [ids.tobytes() for ids in raw(TEXTS)]
