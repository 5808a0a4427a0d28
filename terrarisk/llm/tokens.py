"""Token ids of whole texts, by a tokenizer file of the tokenizers library.

Byte-level BPE never merges across a space that follows a non-space, across the end of a line between non-spaces, or
from a letter to a mark. Texts are therefore cut there and each distinct piece is encoded once: letters, which are one
word to the tokenizer, by the library's model itself, other pieces and texts with other white space by the whole
tokenizer. A worker keeps a bounded number of encoded pieces, the recently used ones longest. All ways give the same ids.
"""

from __future__ import annotations

import json
import os
from array import array

from .common import Cache

#: The most encoded pieces of a generation (about 200 bytes each); a worker keeps two generations.
CACHE_PIECES = 300_000
#: ASCII marks that may end a word.
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_encoders: dict[str, "Encoder"] = {}


def byte_letters() -> dict[int, int]:
    """Byte-level BPE's letter for each byte: printable ones stand for themselves, the others for those from 256 on."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in set(printable)]
    return {b: b for b in printable} | {b: 256 + k for k, b in enumerate(others)}


class Encoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        with open(path, encoding="utf-8") as f:
            given = json.load(f)
        pre = given.get("pre_tokenizer") or {}
        #: whether pieces may be cut and letters given to the model: plain byte-level BPE without changes to the text
        self.plain = given["model"].get("type") == "BPE" and not given.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", False)
        self.letters = byte_letters()
        self.space = chr(self.letters[32])
        self.cache = Cache(self._piece, __name__, CACHE_PIECES)

    def direct(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _piece(self, piece: str) -> bytes:
        if not piece:
            return b""
        stem = piece.rstrip(_MARKS)
        word = stem[1:] if stem[:1] == " " else stem
        if word.isalpha() and max(word) < "ɐ":
            tokens = self.tokenizer.model.tokenize(stem.replace(" ", self.space) if stem.isascii() else stem.encode().decode("latin-1").translate(self.letters))
            own = array("I", [t.id for t in tokens]).tobytes()
            return own + self.cache[piece[len(stem) :]] if len(stem) < len(piece) else own
        return self.direct([piece])[0]

    def ids(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not self.plain or "  " in text or " \n" in text or "\n " in text or "\n\n" in text or _odd(text):
            return self.direct([text])[0]
        self.cache.ready()
        return b"".join(map(self.cache.__getitem__, text.replace(" ", "\x00 ").replace("\n", "\x00\n\x00").split("\x00")))


def _odd(text: str) -> bool:
    """Whether it holds control characters or white space other than spaces and single line ends."""
    return not text.replace("\n", "").isprintable()


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
