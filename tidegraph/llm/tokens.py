"""Token ids of whole texts inside tasks, by way of the ids of their words."""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np

LONG_WORD = 64
_ASCII_WORDS = re.compile(r"[^ \t\n\r]+")
# Characters at which Python splits and the tokenizer does not.
_ODD = "\x1c\x1d\x1e\x1f"
_LETTERS = re.compile(r"[a-z\xdf-\xf6\xf8-\xff]+")
# A full stop or comma between a small letter and white space or the end.
_STOP = re.compile(r"[.,](?<=[a-z\xdf-\xf6\xf8-\xff].)(?=\s|$)")


class WordIds(dict):
    """The ids of words as bytes, encoded when first asked for."""

    def __init__(self, tokenizer, kind: str):
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer, self.kind = tokenizer, kind
        # How small letters of Latin-1 look to the merges.
        bytewise = ByteLevel(add_prefix_space=False, use_regex=False)
        letters = [chr(c) for c in range(0xDF, 0x100) if c != 0xF7]
        self.letters = str.maketrans({c: bytewise.pre_tokenize_str(c)[0][0] for c in letters})

    def __missing__(self, word: str) -> bytes:
        if _LETTERS.fullmatch(word):
            # One piece as it stands, so the merges alone are needed.
            ids = [x.id for x in self.tokenizer.model.tokenize(word.translate(self.letters))]
        else:
            ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        found = np.array(ids, dtype=self.kind).tobytes()
        if len(word) <= LONG_WORD:
            self[word] = found
        return found


class WordEncoder:
    """Encodes texts with a tokenizer that never joins characters across white space.

    ``word_bpe_49k.json`` is of that kind: it composes and lowers characters,
    drops white space and splits there before any merge, so a text's ids are
    those of its words in order. The markers of the vocabulary, such as
    ``<|endoftext|>``, hold no white space and have their own ids. A word is encoded once and remembered. The
    memory is emptied when it holds ``limit`` words; words of over 64
    characters are not kept.
    """

    def __init__(self, path: str, limit: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # Ids that the caller appends are below the size of the vocabulary.
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.limit = limit
        self.known = WordIds(self.tokenizer, f"<u{self.width}")

    def encode(self, text: str | None) -> bytes:
        """Little-endian ids of ``width`` bytes; none for null."""
        if len(self.known) > self.limit:
            self.known.clear()
        return b"".join(map(self.known.__getitem__, self._split(text)))

    @staticmethod
    def _split(text: str | None) -> list[str]:
        if not text:
            return []
        if any(c in text for c in _ODD):
            return _ASCII_WORDS.findall(text)
        if "<|" in text:
            # A marker as it stands has one id; what lowering would make one has not.
            return text.split()
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return text.split()
        # Nothing to compose here, and lowering is by character: what the
        # tokenizer would do, and fewer distinct words to remember.
        return _STOP.sub(r" \g<0>", text.lower()).split()


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """One encoder for each Python worker, whose memory outlives a task."""
    return WordEncoder(path)
