"""Byte-level BPE ids, with equal pieces of text encoded once per worker.

New pieces are encoded from the vocabulary's ranks; texts with strings of special tokens go to the tokenizers library, whose ids all
others equal too (tests/llm compares them).
"""

from __future__ import annotations

import base64
import os
import re
from array import array

import numpy as np

from doctables.llm.common import CACHES

#: A vocabulary by the path of its files without ``.json`` and ``.tiktoken``, or by their name in the public tokenizers package.
VOCABULARY = "byte_bpe_50k"
END_OF_DOCUMENT = 50256
#: Pieces kept per Python worker (about 40 MB), and the longest piece that is kept.
KEPT_PIECES, KEPT_LENGTH = 150_000, 48

# A pre-token never goes on over a single blank or line break between two other characters, so texts are cut there.
_DOUBLE = re.compile(r"\s\s|\0")
_CUT = re.compile(r"(?<=\S)(?= \S)|(?<=\S)(?=\n\S)|(?<=\S\n)(?=\S)")
_ONE_WORD = re.compile(r" ?\S+")
_encoders: dict[tuple[str, bool], "Encoder"] = {}
CACHES.append(_encoders)


class Encoder:
    """``encode(texts)`` gives each text's ids as little-endian unsigned 32-bit bytes.

    For vocabularies whose pre-tokenizer starts a pre-token at each blank (the byte-level pattern). ``ordinary``: strings of
    special tokens inside texts are plain text; else they become the special ids, as the library does by default.
    """

    def __init__(self, path: str, ordinary: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path + ".json")
        self.tokenizer.encode_special_tokens = ordinary
        special = [] if ordinary else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        with open(path + ".tiktoken", "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.ranks = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.line_break = self.ranks.encode_ordinary("\n")[0]
        self.kept: dict[str, bytes] = {}

    def pieces(self, text: str) -> list[str]:
        if self.special and self.special.search(text):
            return [text]
        if not _DOUBLE.search(text):
            return text.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0")
        return _CUT.split(text)

    def encoded(self, pieces: list[str]):
        """Each piece with its ids; single words are encoded together, a line break between them."""
        words = [p for p in pieces if _ONE_WORD.fullmatch(p) and not (self.special and self.special.search(p))]
        rest = set(pieces).difference(words)
        for at in range(0, len(words), 10_000):
            some = words[at:at + 10_000]
            ids = np.array(self.ranks.encode_ordinary("\n".join(some)), "<u4")
            cuts = np.flatnonzero(ids == self.line_break)
            if len(cuts) + 1 != len(some):
                rest.update(some)
                continue
            raw = ids.tobytes()
            yield from ((p, raw[4 * a:4 * b]) for p, a, b in zip(some, [0, *(cuts + 1).tolist()], [*cuts.tolist(), len(ids)]))
        for piece in rest:
            yield piece, array("I", self.tokenizer.encode(piece, add_special_tokens=False).ids).tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        cut = [self.pieces(t or "") for t in texts]
        if len(self.kept) > KEPT_PIECES:
            self.kept.clear()
        new = list({p for pieces in cut for p in pieces}.difference(self.kept))
        known, long = self.kept, {}
        for piece, ids in self.encoded(new):
            (known if len(piece) <= KEPT_LENGTH else long)[piece] = ids
        if long:
            return [b"".join([known[p] if p in known else long[p] for p in pieces]) for pieces in cut]
        return [b"".join(map(known.__getitem__, pieces)) for pieces in cut]


def encoder(vocabulary: str = VOCABULARY, ordinary: bool = False) -> Encoder:
    """The worker's encoder for a vocabulary."""
    if (vocabulary, ordinary) not in _encoders:
        path = vocabulary
        if "/" not in vocabulary:
            import public_tokenizers
            path = public_tokenizers.path(vocabulary + ".json").removesuffix(".json")
        _encoders[vocabulary, ordinary] = Encoder(path, ordinary)
    return _encoders[vocabulary, ordinary]
