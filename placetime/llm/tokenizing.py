"""Token ids of whole texts, by public vocabularies whose files are given by path."""

from __future__ import annotations

import json
import os
import re
from functools import cached_property

import numpy as np

#: The white space of the pre-token pattern: Unicode's White_Space.
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Where white space follows something else, a pre-token always begins, whatever stands on either
#: side; so the ids of these parts joined are the ids of the whole.
PARTS = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
#: The pre-token pattern of byte-level BPE (a fixed value: its vocabulary was made with it).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: From here on (beyond Latin, Greek and Cyrillic), letter classes may differ between Unicode versions.
DISPUTED = "\u0530"


class ByteBpe:
    """A byte-level BPE vocabulary in the `tokenizers` file format.

    Its ids follow the merge order, so the same vocabulary read as ranks gives the same ids several
    times faster; that is used for letters whose classes no Unicode version disputes, the
    `tokenizers` library for the rest. Strings of special tokens are ordinary text; with `added_tokens`,
    the file's added tokens keep their ids instead, as in a plain call of the library, which then
    encodes the texts that hold one.
    """

    def __init__(self, path: str, added_tokens: bool = False):
        self.path, self.added_tokens = path, added_tokens

    @cached_property
    def _added(self) -> list[str]:
        if not self.added_tokens:
            return []
        with open(self.path, encoding="utf-8") as file:
            return [token["content"] for token in json.load(file).get("added_tokens") or []]

    @cached_property
    def _library(self):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(self.path)
        made.encode_special_tokens = True
        return made

    @cached_property
    def _plain_library(self):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    @cached_property
    def _ranks(self):
        import tiktoken

        with open(self.path, encoding="utf-8") as file:
            vocabulary = json.load(file)["model"]["vocab"]
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        byte_of = {chr(b): b for b in shown}
        byte_of |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        ranks = {}
        for piece, number in vocabulary.items():
            if all(c in byte_of for c in piece) and not (piece.startswith("<|") and piece.endswith("|>")):
                ranks[bytes(byte_of[c] for c in piece)] = number
        return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        """The ids of a whole text, as unsigned little-endian 32-bit numbers."""
        if any(token in text for token in self._added):
            return np.array(self._plain_library.encode(text, add_special_tokens=False).ids, "<u4")
        if text.isascii() or max(text) < DISPUTED:
            return np.array(self._ranks.encode_ordinary(text), "<u4")
        return np.array(self._mixed(text), "<u4")

    def _mixed(self, text: str) -> list[int]:
        numbers: list[int] = []
        plain: list[str] = []
        for part in PARTS.findall(text):
            if max(part) < DISPUTED:
                plain.append(part)
                continue
            numbers += self._ranks.encode_ordinary("".join(plain))
            plain.clear()
            numbers += self._library.encode(part, add_special_tokens=False).ids
        return numbers + self._ranks.encode_ordinary("".join(plain))


class PieceBpe:
    """A sentencepiece vocabulary with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        self._model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.is_byte = np.array([self._model.IsByte(i) for i in range(self._model.GetPieceSize())])

    def ids(self, text: str) -> np.ndarray:
        return np.array(self._model.encode(text), np.int64)
