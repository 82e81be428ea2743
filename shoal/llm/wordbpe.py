"""Token ids of whole texts by the ``tokenizers`` library, whose model is called once for each new word.

The vocabulary's normaliser (NFC, lower case) is applied to whole texts. Its pre-tokenizer never joins
characters across white space, so a text's ids are those of its white-space-separated chunks in a row,
and a chunk's those of its pieces. A full stop or comma between a letter and white space is a piece of
its own and is set apart first, so that most chunks are words. Ids that the model gave a chunk are
kept, up to a bound. Texts that hold a special token's string, or one of the four separators that
Python but not the library takes for white space, go to the library whole.
"""

from __future__ import annotations

import os
import re
import unicodedata

import numpy as np
import public_tokenizers
import regex

from shoal.llm import bytesplit, scratch

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
#: The pre-tokenizer's pattern, as the vocabulary file has it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPECIAL = ("<|startoftext|>", "<|endoftext|>")
_KEPT = 300_000
_ODD = re.compile("[\x1c-\x1f]")
_ENDS = re.compile(r"(?<=[a-z])(?=[.,](?:\s|\Z))")


class _Chunks(dict):
    """Chunk -> its ids as little-endian unsigned 32-bit numbers, made when first asked for."""

    def __init__(self, model):
        self.tokenize = model.tokenize
        self.find = regex.compile(PATTERN).findall

    def __missing__(self, chunk: str) -> bytes:
        ids = [t.id for p in ((chunk,) if chunk.isascii() and chunk.isalpha() else self.find(chunk)) for t in self.tokenize(p if p.isascii() else "".join(map(bytesplit.LETTER.__getitem__, p.encode())))]
        if len(self) >= _KEPT:
            self.clear()
        raw = self[chunk] = ids[0].to_bytes(4, "little") if len(ids) == 1 else np.array(ids, dtype="<u4").tobytes()
        return raw


class Encoder:
    def __init__(self, path: str = VOCABULARY):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.chunks = _Chunks(self.library.model)

    def encode_one(self, text: str) -> bytes:
        if _ODD.search(text) or "<|" in text and any(s in text for s in SPECIAL):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # the library lower-cases each character alone
        return b"".join(map(self.chunks.__getitem__, _ENDS.sub(" ", text.lower()).split()))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text, without special tokens; null counts as empty."""
        return [self.encode_one(t or "") for t in texts]


def encoder(path: str = VOCABULARY) -> Encoder:
    """The worker's encoder: made once, used by all its tasks."""
    return scratch.held(("words", path), lambda: Encoder(path))
