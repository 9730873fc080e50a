"""Token ids by the public byte-level BPE, memoised by pre-token.

BPE never merges across the pre-tokenizer's pieces, so a text's ids are those of its pieces in order. Each distinct
piece is encoded by the tokenizers library's model once and kept as packed 16-bit ids; a text that holds an added token, or
characters outside the range where our pattern equals the library's, is given to the library whole.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np

from recordloom.llm.core import memory

#: Letters whose class is the same for the library and for us: ASCII, Latin-1 and Latin Extended-A and -B.
_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
#: The cut of such texts in UTF-8, where every byte from 128 on belongs to a letter (bytes are found faster than strings).
_PIECES = re.compile(rb" ?[A-Za-z\x80-\xff]+|'(?:[sdmt]|ll|ve|re)| ?[0-9]+| ?[^\sA-Za-z0-9\x80-\xff]+|\s+(?!\S)|\s+")
_PLAIN = re.compile(rf"[\t\n\r\x20-\x7e{_LETTERS}]*")
#: Pieces kept per worker (about 200 bytes each); beyond it the memory starts anew.
MEMORY = 500_000
DTYPE = np.dtype("<u2")


def _alphabet() -> dict[int, str]:
    """Byte -> the printable character that stands for it in a byte-level vocabulary: printable bytes themselves, the
    others in order from code point 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Encoder(dict):
    """Piece (its bytes) -> packed ids."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids are packed in 16 bits")
        self.merge, self.bytes = self.tokenizer.model.tokenize, _alphabet()

    def __missing__(self, piece: bytes) -> bytes:
        """The library's BPE model on one piece, whose bytes are spelt in the vocabulary's alphabet."""
        if len(self) >= MEMORY:
            self.clear()
        self[piece] = ids = array("H", [t.id for t in self.merge(piece.decode("latin-1").translate(self.bytes))]).tobytes()
        return ids

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """Ids of each text, without an end id, in order. Null is empty."""
        for text in texts:
            if not text or (_PLAIN.fullmatch(text) and not any(a in text for a in self.added)):
                packed = b"".join(map(self.__getitem__, _PIECES.findall((text or "").encode())))
            else:
                packed = array("H", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
            yield np.frombuffer(packed, dtype=DTYPE)


def encoder(path: str) -> Encoder:
    """One per worker process and vocabulary."""
    known = memory("tokens")
    if path not in known:
        known[path] = Encoder(path)
    return known[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
