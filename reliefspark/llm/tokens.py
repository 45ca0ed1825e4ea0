"""Token ids of whole texts by a tokenizer file, with a cache over its pre-tokens.

Byte-pair merges never cross a pre-token, so the ids of a text are those of its
pre-tokens one after the other. Texts whose characters all lie below U+0100 are
split here by the same rule that the tokenizer file states, and only pre-tokens
not seen before go through the tokenizers library; any other text goes through it
whole. The ids are the same either way.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

# The Unicode classes White_Space, L and N below U+0100.
_SPACE = r"\t-\r \x85\xa0"
_LETTER = r"a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
_NUMBER = r"0-9\xb2\xb3\xb9\xbc-\xbe"
# The splitting rules of the two kinds of tokenizer file.
_BYTE_RULE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_WORD_RULE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Joins pre-tokens into one call; a text that holds it goes through the library whole.
_JOIN = "\x1f"
_PER_CALL = 256


def _narrow(rule: str) -> re.Pattern[str]:
    """The rule with its Unicode classes written out for characters below U+0100."""
    out = rule.replace(r"\S", f"[^{_SPACE}]")
    out = out.replace(r"[\p{L}]", f"[{_LETTER}]").replace(r"[\p{N}]", f"[{_NUMBER}]")
    out = out.replace(r"[^\s\p{L}\p{N}]", f"[^{_SPACE}{_LETTER}{_NUMBER}]")
    return re.compile(out.replace(r"\p{L}", f"[{_LETTER}]").replace(r"\p{N}", f"[{_NUMBER}]").replace(r"\s", f"[{_SPACE}]"))


class Encoder:
    """ids(texts): for each text the little-endian uint32 ids, as bytes."""

    def __init__(self, path: str, cached: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Regex, Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, Split

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True  # their strings in a text are ordinary text
        self.vocab_size = self.whole.get_vocab_size()
        self.most, self.cache = cached, {}
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        norm, pre = spec.get("normalizer"), spec.get("pre_tokenizer") or {}
        self.rule, self.lower = None, False
        if norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
            self.rule = _narrow(_BYTE_RULE)
        elif norm and [x.get("type") for x in norm.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"] and [x.get("pattern", {}).get("Regex") for x in pre.get("pretokenizers", [])][:1] == [_WORD_RULE]:
            self.rule, self.lower = _narrow(_WORD_RULE), True
        if self.rule:
            self.parts = Tokenizer.from_file(path)
            self.parts.encode_special_tokens = True
            self.parts.normalizer = None
            self.parts.pre_tokenizer = Sequence([Split(Regex(_JOIN), "removed"), ByteLevel(add_prefix_space=False, trim_offsets=False, use_regex=False)])

    def _learn(self, new: list[str]) -> None:
        calls = [new[i : i + _PER_CALL] for i in range(0, len(new), _PER_CALL)]
        for words, e in zip(calls, self.parts.encode_batch([_JOIN.join(x) for x in calls], add_special_tokens=False), strict=True):
            at = np.searchsorted(np.asarray(e.word_ids), np.arange(len(words) + 1)).tolist()
            ids = np.asarray(e.ids, "<u4").tobytes()
            self.cache.update((w, ids[4 * a : 4 * b]) for w, a, b in zip(words, at, at[1:], strict=False))

    def ids(self, texts: list[str]) -> list[bytes]:
        split: list[list[str] | None] = []
        for t in texts:
            if self.rule is None or _JOIN in t or not (t.isascii() or max(t) < "Ā"):
                split.append(None)
            else:
                split.append(self.rule.findall(t.lower() if self.lower else t))
        if len(self.cache) > self.most:
            self.cache.clear()
        new = [w for w in set().union(*[x for x in split if x]) if w not in self.cache]
        if new:
            self._learn(new)
        get = self.cache.__getitem__
        out = [b"" if x is None else b"".join(map(get, x)) for x in split]
        rest = [i for i, x in enumerate(split) if x is None]
        for i, e in zip(rest, self.whole.encode_batch([texts[i] for i in rest], add_special_tokens=False) if rest else [], strict=True):
            out[i] = np.asarray(e.ids, "<u4").tobytes()
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each Python worker and file, so that tasks share its cache."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
