"""Pre-tokens of a tokenizer file of the ``tokenizers`` library, exactly as the library cuts them, and their pieces.

The library's path from text to ids is: cut out added tokens, normalise, pre-tokenise, then
look each pre-token up on its own. So ids and counts of a pre-token never depend on its
neighbours, and a dictionary of pre-tokens replaces nearly all library calls.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

from tokenizers import Tokenizer, pre_tokenizers

#: The normaliser and the split pattern for which the short path below is exact.
_KNOWN_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
_KNOWN_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Characters up to here have the same classes in every Unicode version and lower-case alone.
_PLAIN_END = 0x24F


def _char_class(wanted) -> str:
    return "".join(re.escape(chr(c)) for c in range(0x80, 0x308) if wanted(chr(c)))


@lru_cache(maxsize=4)
class PreTokenizer:
    """``tokens(text)``: pre-tokens in order, added tokens verbatim; ``ids(token)``, ``count(token)``: its pieces.

    One object per process and path (workers are reused), so caches last over batches.
    """

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        self.tokenizer = Tokenizer.from_file(path)
        if not spec.get("pre_tokenizer"):
            raise ValueError(f"{path} has no pre-tokenizer, so texts have no pre-tokens to count")
        self.added = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        if any(x["single_word"] or x["lstrip"] or x["rstrip"] or x["normalized"] for x in spec.get("added_tokens", [])):
            raise ValueError(f"{path} has added tokens that take in their surroundings")
        self._cut = re.compile("(" + "|".join(re.escape(x) for x in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        steps = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        splits = (spec["pre_tokenizer"].get("pretokenizers") or [{}])[0]
        self._short = steps == _KNOWN_NORMALIZERS and (splits.get("pattern") or {}).get("Regex") == _KNOWN_PATTERN
        letters, numbers = _char_class(lambda c: unicodedata.category(c)[0] == "L"), _char_class(lambda c: unicodedata.category(c)[0] == "N")
        spaces = "\\x85\\xa0"
        self._ascii = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+", re.ASCII)
        self._latin = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[a-z{letters}]+|[0-9{numbers}]|[^\sa-z0-9{letters}{numbers}{spaces}]+", re.ASCII)
        self._beyond = re.compile(f"[^\\x00-{chr(_PLAIN_END)}]").search
        alone = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self._to_bytes = lambda s: alone.pre_tokenize_str(s)[0][0]
        self._byte_of: dict[str, int] | None = None

    def tokens(self, text: str) -> list[str]:
        if self._cut is None or not self._cut.search(text):
            return self._plain(text)
        out: list[str] = []
        for k, part in enumerate(self._cut.split(text)):
            if k % 2:
                out.append(part)
            elif part:
                out += self._plain(part)
        return out

    def _plain(self, text: str) -> list[str]:
        if self._short:
            if text.isascii():
                return self._ascii.findall(text.lower())
            if not self._beyond(text):
                return self._latin.findall(text.lower())
        return self._library(text)

    def _library(self, text: str) -> list[str]:
        """The library's own normaliser and pre-tokeniser, for any text."""
        if self.tokenizer.normalizer is not None:
            text = self.tokenizer.normalizer.normalize_str(text)
        return [self._raw(t) for t, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def _raw(self, token: str) -> str:
        """The text of a byte-level token."""
        if token.isascii():
            return token
        if self._byte_of is None:
            every = [*range(0xC0), *range(0xC0, 0x800, 64), 0x800, *range(0x1000, 0x10000, 0x1000), 0x10000, *range(0x40000, 0x110000, 0x40000)]
            every = [c for c in every if not 0xD800 <= c < 0xE000]
            self._byte_of = {m: b for c in every for m, b in zip(self._to_bytes(chr(c)), chr(c).encode(), strict=True)}
        return bytes(self._byte_of[c] for c in token).decode()

    def ids(self, token: str) -> list[int]:
        if token in self.added:
            return [self.added[token]]
        return [x.id for x in self.tokenizer.model.tokenize(self._to_bytes(token))]

    def count(self, token: str) -> int:
        return len(self.ids(token))
