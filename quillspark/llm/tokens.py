"""Token ids of whole texts by the tokenizers library, word by word where that is exact."""

from __future__ import annotations

import json
import os
import re
import sys
from array import array

_L = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
_N = "0-9\xb2\xb3\xb9\xbc-\xbe"
#: Texts of these characters only are split into words here; others are encoded whole.
_PLAIN = b"\t\n\r" + bytes(range(0x20, 0x7F)) + bytes(range(0xA1, 0x100))
_BYTE_LEVEL = re.compile(f"'(?:[stmd]|re|ve|ll)| ?[{_L}]+| ?[{_N}]+| ?[^\\s{_L}{_N}]+|\\s+(?!\\S)|\\s+")
_WORD_END = re.compile(f"'(?:[stmd]|re|ve|ll)|[{_L}]+|[{_N}]|[^\\s{_L}{_N}]+")
#: Words kept in memory, some 200 bytes each; when there are more, the memory starts anew.
CACHE_WORDS = 800_000


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """encode(texts): for each text its ids (add_special_tokens=False) as little-endian uint32.

    Both vocabularies split a text into words and encode each word by itself, so the ids of a
    text are those of its words in order. Words are found by an equal pattern over Latin-1 and
    each is encoded once by the library; a text with other characters, or with the string of a
    special token, goes to the library whole. A tokenizer of another kind encodes whole texts.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        pre, norm = parts.get("pre_tokenizer") or {}, parts.get("normalizer")
        self.special = [x["content"] for x in parts.get("added_tokens", [])]
        self.lower, self.words = False, None
        if parts["model"].get("type") == "BPE" and not parts["model"].get("dropout"):
            if norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
                self.words = _BYTE_LEVEL
            elif norm == _NORMALIZER and [x.get("type") for x in pre.get("pretokenizers", [])] == ["Split", "ByteLevel"] and pre["pretokenizers"][0].get("pattern") == _SPLIT and pre["pretokenizers"][0].get("invert") and pre["pretokenizers"][0].get("behavior") == "Removed":
                self.words, self.lower = _WORD_END, True
        self.model = self.tokenizer.model
        self.cache: dict[str, bytes] = {}
        self.cache_words = cache_words

    def _library(self, texts: list[str]) -> list[bytes]:
        return [_little(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _word(self, word: str) -> bytes:
        """One word by the library's model, spelled in its alphabet of bytes."""
        return _little([t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(_ALPHABET))])

    def _plain(self, text: str) -> bool:
        try:
            return self.words is not None and not text.encode("latin-1").translate(None, _PLAIN) and not any(s in text for s in self.special)
        except UnicodeEncodeError:
            return False

    def encode(self, texts: list[str]) -> list[bytes]:
        out = []
        for text in texts:
            if not self._plain(text):
                out += self._library([text])
                continue
            words = self.words.findall(text.lower() if self.lower else text)
            ids = list(map(self.cache.get, words))
            if None in ids:
                if len(self.cache) > self.cache_words:
                    self.cache.clear()
                for i, x in enumerate(ids):
                    if x is None:
                        w = words[i]
                        ids[i] = self.cache.get(w) or self.cache.setdefault(w, self._word(w))
            out.append(b"".join(ids))
        return out


def _little(ids: list[int]) -> bytes:
    a = array("I", ids)
    if sys.byteorder == "big":
        a.byteswap()
    return a.tobytes()


def _alphabet() -> dict[int, int]:
    """Byte-level BPE spells each byte as one printable character: those that print stand for
    themselves, the others, in order, for the code points from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: 256 + i for i, b in enumerate(hidden)}


_ALPHABET = _alphabet()
#: The normalizer and split of the vocabulary with word ends.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}

_encoders: dict[str, Encoder] = {}


def encoder(path: str, cache_words: int = CACHE_WORDS) -> Encoder:
    """One per Python worker and path; its words last from task to task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    _encoders[path].cache_words = cache_words
    return _encoders[path]
