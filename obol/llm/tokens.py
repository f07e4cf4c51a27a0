"""Token ids of whole texts through the ``tokenizers`` library, with a word cache.

The word tokenizer drops white space and never joins characters across it, so
the ids of a text are the ids of its white-space separated chunks in order.
Each chunk is encoded by the library once per worker and reused.  The cache has
two halves of at most ``CACHE_BYTES`` each: a full half becomes the old one and
the old one goes, but for the chunks that are used again (memory bound, results
unchanged).
"""

from __future__ import annotations

import functools
import re

import numpy as np

from obol.llm.textbytes import EMPTY

#: Bytes of one half of a worker's cache, and those an entry takes besides its chunk and ids.
CACHE_BYTES = 48 << 20
ENTRY_BYTES = 170
#: A full stop or comma between a letter and white space is a token run of its own.
_STOP = re.compile(rb"(?<=[a-z])([.,])(?=[\x20\x09-\x0D]|$)")


class ChunkEncoder:
    """bytes of little-endian uint32 ids per text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.cache: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.held = 0
        vocab = self.tok.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocab.values(), default=0) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True

    def _plain(self, chunk: str) -> bytes:
        return np.array(self.tok.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, chunks: list[bytes]) -> None:
        """Encode new chunks: those of letters only in runs of 64, all others one by one."""
        keys, odd = [], []
        for c in chunks:
            (keys if c.isalpha() or b"<" not in c and c.decode().isalpha() else odd).append(c)
        for c in odd:
            self.cache[c] = self._plain(c.decode())
        runs = [b" ".join(keys[i:i + 64]).decode() for i in range(0, len(keys), 64)]
        ids = np.array([i for e in self.tok.encode_batch_fast(runs, add_special_tokens=False) for i in e.ids], "<u4")
        cut = np.flatnonzero(self.ends[np.minimum(ids, len(self.ends) - 1)]) + 1
        if len(cut) != len(keys):
            self.cache.update((k, self._plain(k.decode())) for k in keys)
            return
        raw, at = ids.tobytes(), [0, *(4 * cut).tolist()]
        self.cache.update((k, raw[a:b]) for k, a, b in zip(keys, at, at[1:], strict=False))

    def _keep(self, chunks: set[bytes]) -> None:
        """Bring chunks that the young half lacks into it, from the old half or the library."""
        if self.held > CACHE_BYTES:
            self.old, self.cache, self.held = self.cache, {}, 0
        missing = chunks.difference(self.cache)
        again = missing.intersection(self.old)
        self.cache.update((c, self.old[c]) for c in again)
        if len(again) < len(missing):
            self._learn(sorted(missing - again))
        self.held += sum(len(c) + len(self.cache[c]) + ENTRY_BYTES for c in missing)

    def encode(self, texts: list[bytes]) -> list[bytes]:
        words = [t.split() if b"<|" in t else _STOP.sub(rb" \1 ", t.lower()).split() for t in texts]
        self._keep(set().union(*words))
        get = self.cache.__getitem__
        return [b"".join(map(get, ws)) for ws in words]


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> ChunkEncoder:
    return ChunkEncoder(path)


EMPTY.append(encoder.cache_clear)
