"""A tokenizer that remembers the ids of words it has seen.

This is for tokenizers that normalise and split as NORMALIZER and SPLIT say: neither a match of the pre-tokenizer nor an
added token holds ASCII white space, and normalisation does not act across it, so a text's ids are the ids of its
blank-separated chunks in order. Most chunks recur; only new ones reach the tokenizer. A tokenizer file with any other
steps is used plainly, a whole text at a time.
"""

from __future__ import annotations

import json
import re
from array import array
from pathlib import Path

from .support import LOWER_TABLE

#: Chunks that a worker keeps, which bounds its memory; a full cache is emptied.
CACHED = 500_000
#: Lower-case letters of ASCII and Latin-1: a word of them is one pre-token, which normalisation leaves alone.
LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")

# The steps of the tokenizer file that chunks of words are right for.
NORMALIZER = ({"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"})
SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}


def splits_at_blanks(steps: dict) -> bool:
    """If a tokenizer file's steps are those that this module is for."""
    whole = {"type": "Sequence", "normalizers": list(NORMALIZER)}, {"type": "Sequence", "pretokenizers": [SPLIT, BYTES]}
    added = all(t["content"].startswith("<|") and not t["normalized"] for t in steps.get("added_tokens") or ())
    plain = not any(steps.get(c) for c in ("truncation", "padding", "post_processor")) and not steps["model"].get("dropout")
    return (steps.get("normalizer"), steps.get("pre_tokenizer")) == whole and added and plain and steps["model"].get("type") == "BPE"


def byte_characters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if printable, else one from 256 up."""
    out, more = [], 256
    for b in range(256):
        plain = 33 <= b <= 126 or 161 <= b <= 172 or b >= 174
        out.append(chr(b if plain else more))
        more += not plain
    return out


class CachedTokenizer(dict):
    """Chunk of lower-cased UTF-8 to its ids, as little-endian unsigned 32-bit numbers."""

    _open: dict[str, CachedTokenizer] = {}
    _characters = byte_characters()

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.by_words = splits_at_blanks(json.loads(Path(path).read_text(encoding="utf-8")))

    @classmethod
    def of(cls, path: str) -> CachedTokenizer:
        """One for each worker process and file, so that tasks share what is remembered."""
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def __missing__(self, chunk: bytes) -> bytes:
        if chunk.isalpha():  # of bytes: ASCII letters only
            raw = array("I", [t.id for t in self.model.tokenize(chunk.decode())]).tobytes()
        elif LETTERS.fullmatch(chunk):
            raw = array("I", [t.id for t in self.model.tokenize("".join(map(self._characters.__getitem__, chunk)))]).tobytes()
        elif chunk[-1] in b".," and LETTERS.fullmatch(chunk, 0, len(chunk) - 1):  # letters and a stop are two pre-tokens
            raw = self[chunk[:-1]] + self[chunk[-1:]]
        else:
            raw = array("I", self.tokenizer.encode(chunk.decode(), add_special_tokens=False).ids).tobytes()
        self[chunk] = raw
        return raw

    def encode_bytes(self, text: str | None) -> bytes:
        """The ids of text; null is empty."""
        text = text or ""
        raw = text.encode()
        if not self.by_words or b"<|" in raw:  # an added token is matched before lower-casing, so such a text keeps its case
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        if len(self) > CACHED:
            self.clear()
        return b"".join(map(self.__getitem__, raw.translate(LOWER_TABLE).split()))
