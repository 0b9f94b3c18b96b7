"""Token ids of whole texts by a vocabulary file of the tokenizers library."""

from __future__ import annotations

from struct import pack
from unicodedata import is_normalized

import numpy as np
from tokenizers import Tokenizer

#: Distinct words whose ids a worker keeps in each of two generations; a full new generation becomes the old one.
KEEP_WORDS = 600_000

_ASCII_LOWER = str.maketrans({i: i + 32 for i in range(65, 91)})
_LOADED: dict[tuple[str, bool, int], WordEncoder] = {}


def default_vocabulary() -> str:
    """The vocabulary file that the queries use; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> dict[int, int]:
    """Byte-level vocabularies write a byte that is a visible Latin-1 character as that, the others as U+0100 and on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in visible]
    return {b: 0x100 + i for i, b in enumerate(hidden)}


class _Known(dict):
    """Ids of parts, learned when first asked for."""

    def __init__(self, encoder: WordEncoder, keep: int = KEEP_WORDS):
        super().__init__({"": b""})
        self.encoder, self.keep = encoder, keep
        self.old: dict[str, bytes] = {}

    def __missing__(self, part: str) -> bytes:
        if len(self) >= self.keep:
            self.old = dict(self)
            self.clear()
            self[""] = b""
            if not part:
                return b""
        ids = self.old.get(part)
        if ids is None:
            ids = self.encoder.learn(part)
        self[part] = ids
        return ids


class WordEncoder:
    """Encodes texts, reusing the ids of words seen before.

    by_word is for byte-level vocabularies that lower-case, drop white space and never join
    across it (such as word_bpe_49k.json): ids of a text are then those of its parts between
    white space, so each distinct part goes through the library once. A full stop or comma
    after an ASCII letter is a part of its own there too, and a lower-case word of letters
    alone goes straight to the vocabulary's model. Texts with "<|" may hold special tokens,
    whose case matters, and are encoded whole, as all texts are without by_word.
    """

    def __init__(self, path: str, by_word: bool, keep: int = KEEP_WORDS):
        self.tokenizer = Tokenizer.from_file(path)
        self.by_word = by_word
        self.known = _Known(self, keep)
        self.letters = _byte_letters()
        self.model = self.tokenizer.model

    @classmethod
    def load(cls, path: str, by_word: bool = True, keep: int = KEEP_WORDS) -> WordEncoder:
        if (path, by_word, keep) not in _LOADED:
            _LOADED[path, by_word, keep] = cls(path, by_word, keep)
        return _LOADED[path, by_word, keep]

    def whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, dtype="<u4").tobytes() for x in found]

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; a null or empty text has none."""
        if not text:
            return b""
        if not self.by_word or "<|" in text:
            return self.whole([text])[0]
        parts = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        return b"".join(map(self.known.__getitem__, parts))

    def learn(self, x: str) -> bytes:
        """Ids of a part that isn't known."""
        low = x.lower() if x.isascii() else x.translate(_ASCII_LOWER)
        stop = low[-1] if len(low) > 1 and low[-1] in ".," and low[-2].isascii() and low[-2].isalpha() else ""
        word = low[:-1] if stop else low
        if not word.isalpha() or word != word.lower() or not is_normalized("NFC", word):
            return self.whole([x])[0]
        return self._model_ids(word) + (self._model_ids(stop) if stop else b"")

    def _model_ids(self, word: str) -> bytes:
        written = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
        found = [t.id for t in self.model.tokenize(written)]
        return pack(f"<{len(found)}I", *found)
