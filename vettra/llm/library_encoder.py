"""Byte-level BPE with the model of the tokenizers library, one pre-split word at a time.

Texts are cut by ``pieces``, and each new word goes to the library's BPE model. The ids equal those of the library's own
``encode`` on the whole text (tested); repeated pieces cost a dictionary look-up instead of a call.
"""

from __future__ import annotations

import os
from functools import lru_cache

from vettra.llm.bpe_automaton import byte_letters
from vettra.llm.pieces import PieceEncoder


@lru_cache(maxsize=2)
def encoder(path: str, specials: bool = True, size: int = 350_000) -> PieceEncoder:
    """With ``specials`` false, strings that stand for special tokens are plain text; ``size`` bounds the pieces kept."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks already use every core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    model = tokenizer.model
    model._resize_cache(0)  # pieces are kept here; the model's own cache then only costs time
    letters = {b: letter for letter, b in byte_letters().items()}
    space = letters[0x20]
    marks = {x.content: i for i, x in tokenizer.get_added_tokens_decoder().items() if x.special} if specials else {}

    def word(text: str) -> list[int]:
        shown = text.replace(" ", space) if text.isascii() and text.strip(" ").isalpha() else text.encode().decode("latin-1").translate(letters)
        return [x.id for x in model.tokenize(shown)]

    return PieceEncoder(word, marks, size)
