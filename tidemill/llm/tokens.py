"""Token ids of whole texts by a public vocabulary, as little-endian unsigned 32-bit bytes."""

from __future__ import annotations

import codecs
import re
import struct
from functools import lru_cache

#: Parts of texts whose ids a worker remembers, half of them in the older of two
#: generations; only speed and memory (about 0.2 KB a part) depend on it.
CACHE_PARTS = 800_000
#: Places of the hashes of parts met, a byte each; emptied when half of them are taken.
MET_PARTS = 1 << 21


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordIds(dict):
    """Ids of the parts of texts that the vocabulary's split makes.

    A text within Latin-1 is split here, as its letters and digits are a fixed
    list, and each part is merged once by the library's model and remembered. Of
    another text the words go through the whole tokenizer, since the split never
    crosses white space.
    """

    # Letters, digits, and what else stands together; lower case by then. No part
    # begins with a letter or digit and is something else, so the order of the first two is free.
    parts = re.compile(r"[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|'(?:s|t|re|ve|m|ll|d)|[^\sa-zªµºß-öø-ÿ0-9²³¹¼½¾]+").findall
    #: Special tokens' texts, and what only one of Python and the tokenizer takes as white space.
    odd = ("<|", "\x1c", "\x1d", "\x1e", "\x1f", "\x85")

    def __init__(self, path: str, remembered: int = CACHE_PARTS):
        from tokenizers import Tokenizer

        self.remembered = remembered
        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        self.older: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.met, self.n_met = bytearray(MET_PARTS), 0
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [b for b in range(256) if b not in shown]
        letters = {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(hidden)}
        self.letters = "".join(letters[b] for b in range(256))  # of the vocabulary, for each byte

    def __missing__(self, part: str) -> bytes:
        found = self.older.get(part)
        if found is None:
            found = self._packed([t.id for t in self.merge(codecs.charmap_decode(part.encode(), "strict", self.letters)[0])])
            if not self._again(part):
                return found
        if len(self) >= self.remembered // 2:
            self.older = dict(self)
            self.clear()
        self[part] = found
        return found

    def _again(self, part: str) -> bool:
        """Whether the part was met before, by its hash; one that never comes again is not remembered."""
        at = hash(part) % MET_PARTS
        if self.met[at]:
            return True
        self.met[at] = 1
        self.n_met += 1
        if self.n_met > MET_PARTS // 2:
            self.met, self.n_met = bytearray(MET_PARTS), 0
        return False

    def _word(self, word: str) -> bytes:
        found = self.words.get(word)
        if found is None:
            if len(self.words) >= self.remembered // 4:
                self.words.clear()
            self.words[word] = found = self._whole(word)
        return found

    def _whole(self, text: str) -> bytes:
        return self._packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    @staticmethod
    def _packed(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        if any(x in text for x in self.odd):
            return self._whole(text)
        if within_latin1(text):
            return b"".join(map(self.__getitem__, self.parts(text.lower())))
        return b"".join(map(self._word, text.split()))


def within_latin1(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


@lru_cache(maxsize=2)
def word_ids(path: str, remembered: int = CACHE_PARTS) -> WordIds:
    """One for each worker process, which tasks share one after another."""
    return WordIds(path, remembered)
