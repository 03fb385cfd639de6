"""Words and their ids."""

import public_tokenizers

from veilscan.llm.tokens import TEXTS, WordIds


class Unread(WordIds):
    def __iter__(self):
        raise AssertionError("all known words were gone through")


def test_known_words_are_looked_up_not_gone_through():
    words = Unread(public_tokenizers.path("word_bpe_49k.json"))
    texts = [f"Some text, no. {n} áb &&& end." for n in range(2 * TEXTS + 3)] + [None, "", " \n"]
    expected = [
        b"".join(i.to_bytes(2, "little") for i in words.tokenizer.encode(t or "", add_special_tokens=False).ids)
        for t in texts
    ]
    assert words.encode(texts) == expected
    assert words.encode(texts) == expected


class Counted(WordIds):
    calls = 0

    def get(self, word, default=None):
        self.calls += 1
        return super().get(word, default)


def test_unseen_words_are_encoded_together_and_looked_up_once():
    path = public_tokenizers.path("word_bpe_49k.json")
    words = Counted(path)
    texts = ["don't stop~ ~ ~~ a~b, ~.", "plain words, only plain\x1fones. ́x é   9a9", "<|endoftext|>s ~"]
    expected = [
        b"".join(
            i.to_bytes(2, "little")
            for w in t.encode().lower().split()
            for i in words.tokenizer.encode(w.decode(), add_special_tokens=False).ids
        )
        for t in texts
    ]
    assert [WordIds(path).encode([t])[0] for t in texts] == expected
    assert words.encode(texts) == expected
    assert words.calls == sum(len(t.encode().split()) for t in texts)
    together = WordIds(path)
    assert together._learn_joined([b"one", b"two,", b"3"]) and not together._learn_joined([b"a~b", b"two"])
    assert together[b"two,"] == WordIds(path)[b"two,"]
