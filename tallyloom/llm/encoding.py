"""Token ids of whole texts by a public byte-level BPE vocabulary.

The splitting pattern cuts a text before its merges run, so that texts can be cut at
some of the same places first and every distinct piece encoded once (common.PIECE).
A worker keeps its pieces for the tasks that follow, up to a fixed number, until one comes
that does not encode (common.worker_cache): over 200 MB else stay in each idle worker.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np

from tallyloom.llm.common import PIECE, worker_cache

KEPT = 1_200_000  # pieces a worker keeps
CHARS = 1_000_000  # characters encoded at a time
CACHE = "encoders"
_encoders: dict[str, PieceEncoder] = worker_cache(CACHE)


class PieceEncoder:
    """encode(texts) gives an array of ids for each text, like the tokenizers library without special tokens."""

    def __init__(self, vocabulary: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary.decode("utf-8"))
        self.tokenizer.encode_special_tokens = True  # their names in a text are ordinary text
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.known: dict[str, bytes] = {}

    def _learn(self, pieces: Sequence[str]) -> None:
        for at in range(0, len(pieces), 2000):
            part = pieces[at : at + 2000]
            for piece, found in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)):
                self.known[piece] = np.array(found.ids, self.dtype).tobytes()

    def encode(self, texts: Sequence[str | None]) -> Iterator[np.ndarray]:
        at = 0
        while at < len(texts):
            end, chars = at, 0
            while end < len(texts) and (end == at or chars + len(texts[end] or "") <= CHARS):
                chars += len(texts[end] or "")
                end += 1
            cut = [PIECE.findall(t) if t else [] for t in texts[at:end]]
            new = set(chain.from_iterable(cut)).difference(self.known)
            if len(self.known) + len(new) > KEPT:
                self.known.clear()
                new = set(chain.from_iterable(cut))
            self._learn(list(new))
            known = self.known.__getitem__
            for pieces in cut:
                yield np.frombuffer(b"".join(map(known, pieces)), self.dtype)
            at = end


def encoder(vocabulary: bytes) -> PieceEncoder:
    """The worker's encoder for a vocabulary file's content."""
    key = hashlib.sha256(vocabulary).hexdigest()
    if key not in _encoders:
        _encoders[key] = PieceEncoder(vocabulary)
    return _encoders[key]


def read_vocabulary(path: str | None = None, name: str = "byte_bpe_50k.json") -> bytes:
    """The content of a vocabulary file; path None: the installed public one of that name."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(name)
    with open(path, "rb") as f:
        return f.read()
