"""Whole-text token ids with the ``tokenizers`` library, word by word.

A text is cut before blanks that follow a character other than white space; no
token of the tokenizers meant here crosses such a place, so the ids of the parts,
set side by side, are the ids of the text. Parts repeat, and each worker keeps the
ids of the parts it saw last. Texts in which a blank follows other white space, and
tokenizers of other kinds, are encoded whole.
"""

from __future__ import annotations

import json
import re

import numpy as np

from perfgrid.llm.common import Cache, at_leaving, enter

_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_MARKS = r"!-&(-/:-@\[-`{-~"
_PLAIN = re.compile(rf"[ \n0-9{_LETTERS}{_MARKS}]*")
_LED = re.compile(rf" ?[{_LETTERS}]+| ?[0-9]+| ?[{_MARKS}]+|\s+(?!\S)|\s+")
_FREE = re.compile(rf"[{_LETTERS}]+|[0-9]|[{_MARKS}]+")
_DOUBLE = re.compile(r"\s ")


def byte_letters() -> dict[int, str]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 bytes stand
    for themselves, the others for the code points from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = iter(range(256, 512))
    return {b: chr(b) if b in plain else chr(next(rest)) for b in range(256)}


class TextEncoder:
    """``ids(text)`` equals ``Tokenizer.encode(text, add_special_tokens=False).ids`` of the tokenizer as it is
    loaded. Texts that hold the string of an added token are encoded whole. About ``keep`` bytes of
    parts are remembered, and fewer of words."""

    def __init__(self, path: str, keep: int = 64 << 20):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.added = [t.content.lower() for t in self.tok.get_added_tokens_decoder().values()]
        self.model = self.tok.model
        self.size = self.tok.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.words = Cache("encode", self._word, 32 << 20)
        self.keep, self.used, self.parts = keep, 0, {}
        spec = json.loads(self.tok.to_str())
        pre, norm = spec["pre_tokenizer"] or {}, spec["normalizer"]
        led = norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
        steps = [n.get("type") for n in (norm or {}).get("normalizers", [])]
        inner = pre.get("pretokenizers", [{}])[0]
        free = steps == ["NFC", "Replace", "Lowercase"] and inner.get("type") == "Split" and inner.get("invert")
        plain_bpe = spec["model"].get("type") == "BPE" and not spec["model"].get("dropout")
        self.mode = "led" if led and plain_bpe else "free" if free and plain_bpe else None
        letters = byte_letters()
        self._ascii = {b: letters[b] for b in range(128)}
        self._letters = letters

    def _whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()

    def _word(self, word: str) -> bytes:
        if word.isascii():
            spelled = word.translate(self._ascii)
        else:
            spelled = "".join([self._letters[b] for b in word.encode()])
        return np.array([t.id for t in self.model.tokenize(spelled)], dtype=self.dtype).tobytes()

    def _part(self, part: str) -> bytes:
        if _PLAIN.fullmatch(part):
            words = _LED.findall(part) if self.mode == "led" else _FREE.findall(part.lower())
            return b"".join([self.words[w] for w in words])
        return self._whole(part)

    def raw(self, text: str) -> bytes:
        """Ids as little-endian bytes of ``dtype``."""
        if self.mode is None or _DOUBLE.search(text):
            return self._whole(text)
        low = text.lower()
        if any(t in low for t in self.added):
            return self._whole(text)
        parts = text.split(" ")
        if self.mode == "led":
            parts = [parts[0], *[" " + p for p in parts[1:]]]
        known = self.parts
        new = [p for p in set(parts) if p not in known]
        if new:
            if self.used > self.keep:
                known.clear()
                self.used, new = 0, list(set(parts))
            for p in new:
                known[p] = self._part(p)
            self.used += 200 * len(new) + 3 * sum(map(len, new))
        return b"".join([known[p] for p in parts])

    def ids(self, text: str) -> np.ndarray:
        return np.frombuffer(self.raw(text), dtype=self.dtype)


_LOADED: dict[str, TextEncoder] = {}
at_leaving("encode", _LOADED.clear)


def encoder(path: str) -> TextEncoder:
    """One encoder for each worker process and tokenizer file."""
    enter("encode")
    if path not in _LOADED:
        _LOADED[path] = TextEncoder(path)
    return _LOADED[path]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
