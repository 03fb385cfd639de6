"""Token ids of words with a public tokenizer that reads lower case, drops white
space and never joins a letter with a following full stop or comma."""

from __future__ import annotations

import os
import re
from collections.abc import Sequence
from functools import lru_cache
from itertools import batched, chain

import numpy as np

#: Words whose ids a worker remembers before it starts over.
REMEMBERED = 1_000_000
#: Words encoded at a time.
TOGETHER = 512
#: Texts whose words are held at a time: few, so that they stay in the caches.
TEXTS = 32
_PLAIN = re.compile(rb"[a-z]+[.,]\Z")
#: A word of one token that is set behind each word of those encoded together.
MARK = b"~"


class WordIds(dict):
    """Word (lower-case UTF-8 bytes) to its ids as little-endian unsigned 16-bit
    integers (the vocabulary is smaller than 2^16)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids do not fit in 16 bits")
        mark = self.tokenizer.encode(MARK.decode(), add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None

    def learn(self, words: list[bytes]) -> None:
        """Remember the ids of words that are not known."""
        if len(self) + len(words) > REMEMBERED:
            self.clear()
        if not self._learn_joined(words):
            found = self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)
            for word, encoding in zip(words, found, strict=True):
                self[word] = np.array(encoding.ids, "<u2").tobytes()

    def _learn_joined(self, words: list[bytes]) -> bool:
        """As one text, in which a mark stands alone behind each word. Not where
        the words hold that token themselves: then it is found too often."""
        if self.mark is None or len(words) == 1:
            return False
        text = (b" " + MARK + b" ").join([*words, b""]).decode()
        (encoding,) = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)
        ids = np.array(encoding.ids, "<u2")
        marks = np.flatnonzero(ids == self.mark)
        if len(marks) != len(words):
            return False
        packed, start = ids.tobytes(), 0
        for word, mark in zip(words, (2 * marks).tolist(), strict=True):
            self[word] = packed[start:mark]
            start = mark + 2
        return True

    def __missing__(self, word: bytes) -> bytes:
        self.learn([word])
        return self[word]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of whole texts; bytes.split() parts at ASCII white space."""
        return list(chain.from_iterable(map(self._encode_some, batched(texts, TEXTS))))

    def _encode_some(self, texts: Sequence[str | None]) -> list[bytes]:
        split = [text.encode().lower().split() if text else [] for text in texts]
        found = [list(map(self.get, words)) for words in split]
        gaps = [_gaps(ids) for ids in found]
        fresh = {words[at] for words, places in zip(split, gaps, strict=True) for at in places}
        stems = {word[:-1] if _PLAIN.match(word) else word for word in fresh}
        new = [stem for stem in stems if stem not in self]
        for at in range(0, len(new), TOGETHER):
            self.learn(new[at : at + TOGETHER])
        for word in fresh:
            if word not in self and _PLAIN.match(word):
                self[word] = self[word[:-1]] + self[word[-1:]]
        for words, ids, places in zip(split, found, gaps, strict=True):
            for at in places:
                ids[at] = self[words[at]]
        return [b"".join(ids) for ids in found]


def _gaps(ids: list[bytes | None]) -> list[int]:
    """Where ``None`` stands."""
    out, at = [], -1
    for _ in range(ids.count(None)):
        at = ids.index(None, at + 1)
        out.append(at)
    return out


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    """One table per worker process, for all its tasks."""
    return WordIds(path)
