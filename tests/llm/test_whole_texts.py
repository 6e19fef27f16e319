"""Texts with added tokens, and pages with unclosed or custom elements."""

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tesserae.llm import tokens


@pytest.mark.parametrize(("name", "led"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_added_tokens_are_the_library_s_own(name, led):
    path = public_tokenizers.path(name)
    library = Tokenizer.from_file(path)
    texts = ["x <|endoftext|> y", "plain words, here.", "", "<|endoftext|>", "a<|startoftext|>b <|ENDOFTEXT|>", "x <| y |> z", "a  b <|endoftext|>", "the end"]
    own = tokens.encoder(path, 1, led)
    for some in (texts, texts[::-1], texts[3:5]):
        ids, counts = own.encode(some)
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [[*library.encode(t, add_special_tokens=False).ids, 1] for t in some]
