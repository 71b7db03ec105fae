"""Token ids of whole texts by a word-level BPE tokenizer, each distinct word encoded once.

The tokenizer splits a text into words before it merges, so the ids of a text
are those of its words in a row. For texts of plain Latin letters, digits and
punctuation, words are cut here by the tokenizer's own rule and looked up; all
other texts (and those with the tokenizer's special strings in them) go to the
tokenizer as they are. Either way the ids are what the tokenizer gives.
"""

from __future__ import annotations

import json
import re
from functools import cache

import numpy as np

#: The tokenizer's word rule for lower-cased text, ASCII and of the other characters that _OTHER lets pass.
_ASCII_WORD = re.compile(r"[a-z]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^a-z0-9\s]+", re.A)
_WORD = re.compile(r"[a-zß-öø-žſ]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^\sa-z0-9ß-öø-ž]+")
_PLAIN_ASCII = bytes([*range(9, 14), *range(32, 127)])
#: Any character outside these sends the text to the tokenizer whole (their lower case, width and class are beyond doubt).
_OTHER = re.compile("[^\t-\r -~¡-©«-±´¶-¸»¿-ňŊ-ž]|İ")
_WORD_END = "</w>"
#: Words of a generation; the one before is kept too, and what is met again moves up. Longer words are not kept.
CACHE_WORDS = 150_000
LONGEST_KEPT = 48


class WordBpe:
    """ids of texts, as little-endian unsigned integers of ``dtype``."""

    def __init__(self, path: str, dtype: str = "<u2"):
        from tokenizers import Tokenizer

        self.path, self.dtype = path, np.dtype(dtype)
        with open(path, encoding="utf-8") as f:
            plain = json.load(f)
        self.specials = [t["content"] for t in plain["added_tokens"]]
        # For words that are cut and lower-cased already:
        cut = {"type": "Split", "pattern": {"String": " "}, "behavior": "Removed", "invert": False}
        plain["normalizer"], plain["pre_tokenizer"]["pretokenizers"][0] = None, cut
        ids = {t["id"] for t in plain["added_tokens"]} | set(plain["model"]["vocab"].values())
        if max(ids) > np.iinfo(self.dtype).max:
            raise ValueError("ids of this vocabulary need a wider dtype")
        self.ends = np.zeros(max(ids) + 1, bool)
        for token, i in plain["model"]["vocab"].items():
            self.ends[i] = token.endswith(_WORD_END)
        self.merger = Tokenizer.from_str(json.dumps(plain))
        self.whole = None  # the tokenizer as it is, loaded by the first text that needs it
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        if self.whole is None:
            from tokenizers import Tokenizer

            self.whole = Tokenizer.from_file(self.path)
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _learn(self, words: list[str]) -> None:
        """Encode new words in one go; the token that ends a word tells where the next begins."""
        ids = np.array(self.merger.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, self.dtype)
        cut = np.flatnonzero(self.ends[ids]) + 1
        if len(cut) != len(words):
            raise ValueError("the tokenizer does not end each word with its own token")
        raw, at = ids.tobytes(), [0, *(cut * self.dtype.itemsize).tolist()]
        for word, a, b in zip(words, at, at[1:]):
            self.known[word] = raw[a:b]

    def _words(self, text: str) -> list[str] | None:
        """None if the text must go to the tokenizer whole."""
        if any(s in text for s in self.specials):
            return None
        if text.isascii():
            return None if text.encode().translate(None, _PLAIN_ASCII) else _ASCII_WORD.findall(text.lower())
        return None if _OTHER.search(text) else _WORD.findall(text.lower())

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [self._words(t) for t in texts]
        if len(self.known) > CACHE_WORDS:
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        missing = set().union(*filter(None, split)).difference(known)
        known.update((w, older[w]) for w in missing.intersection(older))
        new = missing.difference(known)
        if new:
            self._learn(sorted(new))
        out = [self._whole(t) if words is None else b"".join([known[w] for w in words]) for t, words in zip(texts, split)]
        for w in new:
            if len(w) > LONGEST_KEPT:
                del known[w]
        return out


@cache
def word_bpe(path: str) -> WordBpe:
    """One for each Python worker, so that tasks go on with the words that earlier ones met."""
    return WordBpe(path)
