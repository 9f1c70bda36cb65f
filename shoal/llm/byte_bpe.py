"""Token ids of a byte-level BPE file of the ``tokenizers`` library, fast on whole corpora.

A text is cut before each single space that a visible character follows. Such a place always
separates two pre-tokens of the byte-level pattern, so the ids of the cuts, joined, are the
ids of the text. Cuts repeat, and each worker keeps the ids of those met so far (at most
``CACHED``; the table starts anew when full).
"""

from __future__ import annotations

import array
import json
import os
import re
from functools import lru_cache

CACHED = 300_000
#: A space that white space or the end follows: the text is then cut by pattern.
_UNEVEN = re.compile(r" (?=\s|$)")
_CUT = re.compile(r" (?=\S)")
#: Characters that both libraries class alike; cuts with any other go to ``tokenizers``.
_PLAIN = re.compile("[\t\n\r\x20-\x7e¡-ɏ]*")
#: The pre-token pattern of the byte-level pre-tokenizer.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _letters_of_bytes() -> dict[str, int]:
    """The vocabulary file's letter for each byte: itself if printable, else from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


class ByteBpe(dict):
    """Little-endian 32-bit ids of texts; as a dict, of cuts that a space precedes."""

    def __init__(self, path: str):
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        special = {x["content"]: x["id"] for x in model["added_tokens"]}
        letters = _letters_of_bytes()
        ranks = {
            bytes(letters[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special
        }
        self.special = {x: array.array("I", [i]).tobytes() for x, i in special.items()}
        longest_first = sorted(special, key=lambda x: (-len(x), x))
        self.find_special = re.compile("|".join(map(re.escape, longest_first))) if special else None
        self.quick = tiktoken.Encoding("bpe", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _ids(self, text: str) -> bytes:
        if _PLAIN.fullmatch(text):
            ids = self.quick.encode_ordinary(text)
        else:
            ids = self.exact.encode(text, add_special_tokens=False).ids
        return array.array("I", ids).tobytes()

    def __missing__(self, cut: str) -> bytes:
        ids = self._ids(" " + cut)
        if len(cut) < 64:
            if len(self) >= CACHED:
                self.clear()
            self[cut] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """The ids that ``Tokenizer.encode(text, add_special_tokens=False)`` gives."""
        if self.find_special is None or self.find_special.search(text) is None:
            return self._between(text)
        out, at = [], 0
        for found in self.find_special.finditer(text):
            out += [self._between(text[at : found.start()]), self.special[found[0]]]
            at = found.end()
        out.append(self._between(text[at:]))
        return b"".join(out)

    def _between(self, text: str) -> bytes:
        """The ids of a text without special tokens."""
        if not text:
            return b""
        cuts = _CUT.split(text) if _UNEVEN.search(text) else text.split(" ")
        if len(cuts) == 1:
            return self._ids(text)
        first = self._ids(cuts[0]) if cuts[0] else b""
        return first + b"".join(map(self.__getitem__, cuts[1:]))


@lru_cache(maxsize=2)
def byte_bpe(path: str) -> ByteBpe:
    return ByteBpe(path)
