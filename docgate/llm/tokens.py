"""Pre-tokens of a public tokenizer, counted or turned into ids once for each distinct one.

`Splitter` cuts texts as the library does. Where a text is all Latin-1 and the tokenizer has the word-BPE layout
(NFC, white space folded, lower case, then one pattern), an equal pattern over the whole text does it: NFC leaves
Latin-1 as it is and its lower case is letter by letter. Any other text goes through the library's own normaliser
and pre-tokenizer. Special strings inside a text are cut out first, as the library does by default.
"""

from __future__ import annotations

import json
import re
from collections import defaultdict

import numpy as np

#: The pattern that a word-BPE file holds, and the same one for lower-case Latin-1.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
LATIN_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^\t-\r \x85\xa0a-z0-9ªµºß-öø-ÿ²³¹¼½¾]+"


def byte_letters() -> list[str]:
    """Byte-level BPE's letter for each byte: itself where it prints, else the next from U+0100 on."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in prints else next(spare)) for b in range(256)]


class Splitter:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        said = json.loads(self.tokenizer.to_str())
        self.specials = {t["content"]: t["id"] for t in said["added_tokens"]}
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in said["added_tokens"]):
            raise NotImplementedError("added tokens that take in their surroundings")
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        steps = [x["type"] for x in (said["normalizer"] or {}).get("normalizers", [])]
        first = ((said["pre_tokenizer"] or {}).get("pretokenizers") or [{}])[0]
        self.plain = steps == ["NFC", "Replace", "Lowercase"] and first.get("pattern") == {"Regex": WORD_PATTERN}
        self.find = re.compile(LATIN_PATTERN).findall
        self.letters = byte_letters()

    def _pieces(self, text: str) -> list[str]:
        """The pre-tokens of a text without special strings."""
        if self.plain:
            try:
                text.encode("latin-1")
                return self.find(text.lower())
            except UnicodeEncodeError:
                pass
        if self.tokenizer.normalizer is not None:
            text = self.tokenizer.normalizer.normalize_str(text)
        return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def split(self, texts: list[str]) -> tuple[list[str | int], np.ndarray, np.ndarray]:
        """The distinct pre-tokens (a special string's is its id), the pre-tokens of all texts as positions among these, and the number of each text."""
        seen: dict[str | int, int] = defaultdict()
        seen.default_factory = seen.__len__
        found: list[int] = []
        sizes = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            before = len(found)
            if self.special is not None and self.special.search(text):
                for part in self.special.split(text):
                    if part in self.specials:
                        found.append(seen[self.specials[part]])
                    elif part:
                        found += [seen[w] for w in self._pieces(part)]
            else:
                found += [seen[w] for w in self._pieces(text)]
            sizes[i] = len(found) - before
        return list(seen), np.array(found, np.int64), sizes

    def ids(self, piece: str | int) -> list[int]:
        if isinstance(piece, int):
            return [piece]
        if not (piece.isascii() and piece.isprintable() and " " not in piece):
            piece = "".join([self.letters[b] for b in piece.encode()])
        return [t.id for t in self.model.tokenize(piece)]
