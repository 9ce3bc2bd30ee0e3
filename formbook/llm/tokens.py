"""Token ids of whole texts with a public tokenizer file."""

from __future__ import annotations

import os
import sys

import numpy as np

CACHE_WORDS = 600_000
JOINED = 512


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Ids of texts with a tokenizer that drops white space and never joins
    pieces across it: equal words have equal ids, so a word is encoded once
    a call, and the first ``cache_words`` words, which hold the frequent
    ones, once a worker process."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        self.cache_words = cache_words
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.dtype = np.uint16 if max(vocab.values()) < 1 << 16 else np.uint32
        self.ends_word = np.zeros(max(vocab.values()) + 1, bool)
        self.ends_word[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.known: dict[bytes, bytes] = {}

    @classmethod
    def of(cls, path: str, cache_words: int = CACHE_WORDS) -> Encoder:
        """The process's encoder (kept on ``sys``: functions that travel by
        value have new module globals in every task)."""
        kept = vars(sys).setdefault("_formbook_encoders", {})
        if (path, cache_words) not in kept:
            kept[path, cache_words] = cls(path, cache_words)
        return kept[path, cache_words]

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[bytes]) -> dict[bytes, bytes]:
        known = {}
        # plain words make one piece each, so a row of them can be cut at the word ends
        decoded = [w.decode() for w in words]
        plain = [i for i, w in enumerate(decoded) if w.isalpha()]
        other = [i for i, w in enumerate(decoded) if not w.isalpha()]
        for k in range(0, len(plain), JOINED):
            part = plain[k:k + JOINED]
            ids = self._ids([" ".join([decoded[i] for i in part])])[0]
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) != len(part):
                other += part
                continue
            size = ids.itemsize
            raw, cuts = ids.tobytes(), [0, *(ends * size).tolist()]
            for i, a, b in zip(part, cuts, cuts[1:]):
                known[words[i]] = raw[a:b]
        for k in range(0, len(other), 4096):
            part = other[k:k + 4096]
            for i, ids in zip(part, self._ids([decoded[i] for i in part])):
                known[words[i]] = ids.tobytes()
        return known

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian ids (``dtype``) of UTF-8 texts."""
        # ASCII case is dropped by the tokenizer too, but for special tokens
        split = [(t if b"<|" in t else t.lower()).split() for t in texts]
        rare = self._learn(sorted(set().union(*split) - self.known.keys()))
        if len(self.known) < self.cache_words:
            self.known |= rare
            return [b"".join(map(self.known.__getitem__, words)) for words in split]
        often = self.known.get
        return [b"".join([x if (x := often(w)) is not None else rare[w] for w in words]) for words in split]
