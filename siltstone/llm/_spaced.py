"""Token ids of byte-level vocabularies that keep white space (such as byte_bpe_50k.json)."""

from __future__ import annotations

import re
from struct import pack

import regex

from siltstone.llm._tokens import WordEncoder, _byte_letters, _Known

#: Fixed: how such vocabularies cut a text before pairs are merged.
_PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")

_RUN = re.compile(r"\s\s|\s\Z")
_SAFE = re.compile(r"(?<=\S) (?=\S)")


class _Side:
    """Learns parts that follow a space, or that don't."""

    def __init__(self, encoder: SpacedEncoder, before: str):
        self.encoder, self.before = encoder, before

    def learn(self, part: str) -> bytes:
        return self.encoder.learn(self.before + part)


class SpacedEncoder:
    """Encodes texts, reusing the ids of words seen before.

    No token of such a vocabulary crosses from a character that isn't white space to a single
    space or line feed, so a text is cut there and each different part is encoded once. Where
    white space follows white space, only spaces between two other characters are cut at. Texts
    with "<|" may hold special tokens and are encoded whole.
    """

    _LOADED: dict[str, SpacedEncoder] = {}

    def __init__(self, path: str):
        self.library = WordEncoder.load(path, by_word=False)
        self.letters = _byte_letters()
        self.space = chr(self.letters[32])
        self.model = self.library.tokenizer.model
        self.bare, self.spaced = _Known(_Side(self, "")), _Known(_Side(self, " "))
        self.line_feed = self.library.whole(["\n"])[0]

    @classmethod
    def load(cls, path: str) -> SpacedEncoder:
        if path not in cls._LOADED:
            cls._LOADED[path] = cls(path)
        return cls._LOADED[path]

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; a null or empty text has none."""
        if not text:
            return b""
        if "<|" in text:
            return self.library.whole([text])[0]
        if _RUN.search(text):
            first, *rest = _SAFE.split(text)
            return self.learn(first) + b"".join(map(self.spaced.__getitem__, rest))
        found = []
        for line in text.split("\n"):
            first, *rest = line.split(" ")
            found.append(self.bare[first] + b"".join(map(self.spaced.__getitem__, rest)))
        return self.line_feed.join(found)

    def learn(self, part: str) -> bytes:
        """Ids of a part that isn't known."""
        if part and max(part) > "ɏ":  # beyond Latin letters the classes above may differ from the library's
            return self.library.whole([part])[0]
        word = part[1:] if part[:1] == " " else part
        if word.isalpha():
            return self._merged(part)
        if word[-1:] in (".", ",") and word[:-1].isalpha():  # most often the word alone is known
            side = self.spaced if part[0] == " " else self.bare
            return side[word[:-1]] + self.bare[word[-1]]
        return b"".join(map(self._merged, _PARTS.findall(part)))

    def _merged(self, part: str) -> bytes:
        if not part.isascii():
            part = part.encode().decode("latin-1").translate(self.letters)
        elif part[0] == " " and part[1:].isalpha():
            part = self.space + part[1:]
        elif not part.isalpha():
            part = part.translate(self.letters)
        found = [t.id for t in self.model.tokenize(part)]
        return pack(f"<{len(found)}I", *found)
