"""Token ids of whole texts by a byte-level BPE vocabulary.

The vocabulary splits a text before its merges, and never between a non-space character and the white space after it.
So a text's ids are the ids of such units in a row. Runs of plain units (ASCII and Latin letters, one white space
character between words) are encoded in one call each by the vocabulary's rank file, with a pattern that says the same
as the vocabulary's on such runs; all other units go piece by piece to the tokenizer file, through a cache.
"""

from __future__ import annotations

import base64
import os
import re
from array import array
from functools import lru_cache

#: White space as Unicode's White_Space has it: the vocabulary's pattern uses this, not Python's wider \s.
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
PIECE = re.compile(f" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
#: Characters that every library classes alike; a run of them is a group. Else: white space up to the last
#: one before a word, a unit with other characters, white space at the end.
_PLAIN = "!-~\\u00c0-\\u00d6\\u00d8-\\u00f6\\u00f8-\\u00ff"
RUN = re.compile(f"((?:[\\t-\\r ]?[{_PLAIN}]++(?![^{_SPACE}]))++)|[{_SPACE}]+(?=[{_SPACE}][^{_SPACE}])|[{_SPACE}]?[^{_SPACE}]++|[{_SPACE}]++")
#: The vocabulary's pattern where white space is single: no look-ahead, so it is read much faster.
SINGLE = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"
#: Bytes of pieces and ids that one Python worker keeps; later pieces are merged anew each time.
MOST_BYTES = 32 << 20


class Pieces(dict):
    """piece -> its ids as little-endian unsigned 32-bit numbers."""

    def __init__(self, tokenizer: str, ranks: str | None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer)
        self.tokenizer.encode_special_tokens = True
        self.plain, self.held = None, 0
        if ranks:
            import tiktoken

            with open(ranks, "rb") as lines:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.plain = tiktoken.Encoding("own", pat_str=SINGLE, mergeable_ranks=table, special_tokens={}).encode_ordinary

    @staticmethod
    def _bytes(ids: list[int]) -> bytes:
        import numpy as np

        return np.frombuffer(array("I", ids), np.uint32).astype("<u4").tobytes()

    def __missing__(self, piece: str) -> bytes:
        out = self._bytes(self.tokenizer.encode(piece, add_special_tokens=False).ids)
        if self.held < MOST_BYTES:
            self.held += 4 * len(piece) + len(out) + 200
            self[piece] = out
        return out

    def ids(self, text: str) -> bytes:
        if self.plain is None:
            return b"".join(map(self.__getitem__, PIECE.findall(text)))
        out = []
        for m in RUN.finditer(text):
            if m.lastindex:
                out.append(self._bytes(self.plain(m.group())))
            else:
                out += map(self.__getitem__, PIECE.findall(m.group()))
        return b"".join(out)


@lru_cache(maxsize=2)
def pieces(tokenizer: str | None = None, ranks: str | None = None) -> Pieces:
    """The worker's own cache. tokenizer: a file of the library tokenizers, by default byte_bpe_50k.json; ranks: the same vocabulary's rank file, used for plain runs since it is read faster."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer, ranks = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    return Pieces(tokenizer, ranks)
