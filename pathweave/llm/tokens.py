"""Token ids of texts through a public tokenizer, with a memory of words.

The tokenizer drops white space and never joins what it parts, so a text's ids are its words' ids one after the other.
Most words come again: a task looks a word up in a bounded memory that outlives it in the same Python process.
"""

from __future__ import annotations

import re

#: Words remembered in each of two generations: the older one is dropped when the newer one is full.
MEMORY = 400_000

_LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")
_ENDING = b".,;:!?"


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write each byte as a letter: printable Latin-1 as itself, the rest from U+0100 on."""
    printable = {b: chr(b) for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174}
    rest = [b for b in range(256) if b not in printable]
    return printable | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordMemory:
    """Ids, as little-endian 32-bit bytes, of texts given as UTF-8."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.coded = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def ids(self, text: bytes) -> bytes:
        # the strings of special tokens are lower case and start so; capitals must not turn into one
        words = (text if b"<|" in text else text.lower()).split()
        if len(self.young) > MEMORY:
            self.young, self.old = {}, self.young
        young = self.young
        try:
            return b"".join(map(young.__getitem__, words))
        except KeyError:
            old = self.old
            for word in {w for w in words if w not in young}:
                found = old.get(word)
                young[word] = self._new(word) if found is None else found
            return b"".join(map(young.__getitem__, words))

    def _new(self, word: bytes) -> bytes:
        if _plain(word):
            return self._letters(word)
        stem = word.rstrip(_ENDING)
        if len(stem) < len(word) and _plain(stem):
            # letters and marks after them are parted before tokens are looked for
            return (self.young.get(stem) or self.old.get(stem) or self._letters(stem)) + self._known(word[len(stem):])
        return self._whole(word)

    def _known(self, marks: bytes) -> bytes:
        if marks not in self.young:
            self.young[marks] = self._whole(marks)
        return self.young[marks]

    def _letters(self, word: bytes) -> bytes:
        """One run of small letters goes to the vocabulary as it is, byte by byte."""
        text = word.decode() if word.isascii() else word.decode("latin1").translate(self.letters)
        coded = self.coded
        return b"".join([coded[t.id] for t in self.model.tokenize(text)])

    def _whole(self, word: bytes) -> bytes:
        return b"".join([self.coded[i] for i in self.tokenizer.encode(word.decode(), add_special_tokens=False).ids])


def _plain(word: bytes) -> bool:
    return word.isalpha() and word.islower() or _LETTERS.fullmatch(word) is not None


_memories: dict[str, WordMemory] = {}


def memory(path: str) -> WordMemory:
    """This Python process's memory for a tokenizer file."""
    if path not in _memories:
        _memories[path] = WordMemory(path)
    return _memories[path]
