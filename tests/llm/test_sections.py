"""Token counts of lines and fields against a plain attribution."""

import random
import re

import pytest

from veilscan.llm import token_counts

tokenizers = pytest.importorskip("public_tokenizers")
RANKS = tokenizers.path("byte_bpe_50k.tiktoken")


def plain(encoding, text, sections):
    """(tokens, crossing) of each section: a token belongs to the section with
    most of its bytes, the first of equal ones."""
    owner = [i for i, s in enumerate(sections) for _ in s.encode()]
    tokens, crossing, at = [0] * len(sections), [0] * len(sections), 0
    for token in encoding.encode(text, disallowed_special=()):
        size = len(encoding.decode_single_token_bytes(token))
        held = owner[at : at + size]
        best = max(sorted(set(held)), key=held.count)
        tokens[best] += 1
        crossing[best] += len(set(held)) > 1
        at += size
    return tokens, crossing


def some_texts():
    pick = random.Random(12)
    words = ["word", "é", "日本", " ", "  ", "\n", "\n\n", "it's", "12", "...", "\t", "\r\n", "😀"]
    return ["".join(pick.choice(words) for _ in range(pick.randrange(40))) for _ in range(120)] + ["", "\n", "a\n\n\n"]


def test_lines(spark):
    encoding, _ = token_counts._encoding(RANKS, tokenizers.PATTERN)
    texts = some_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {}
    for r in token_counts.section_tokens(docs, RANKS, tokenizers.PATTERN).collect():
        found.setdefault(r["doc_id"], []).append(r)
    for i, text in enumerate(texts):
        sections = re.findall(r"[^\n]*\n|[^\n]+\Z", text) or [""]
        tokens, crossing = plain(encoding, text, sections)
        rows = sorted(found[i], key=lambda r: r["section"])
        assert [(r["length"], r["n_tokens"], r["n_crossing"]) for r in rows] == list(zip(map(len, sections), tokens, crossing)), text


def test_fields(spark):
    encoding, _ = token_counts._encoding(RANKS, tokenizers.PATTERN)
    texts = some_texts()
    rows = [(i, texts[i], None if i % 5 == 0 else texts[-i], i, "n") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, title string, body string, n_tokens long, section string")
    found = {}
    for r in token_counts.section_tokens(docs, RANKS, tokenizers.PATTERN, fields=["title", "n_tokens", "body"]).collect():
        found.setdefault(r["doc_id"], []).append(r)
    for i, title, body, number, _ in rows:
        sections = [title + "\n", f"{number}\n", body or ""]
        tokens, crossing = plain(encoding, "".join(sections), sections)
        got = sorted(found[i], key=lambda r: r["section"])
        assert [(r["start"], r["length"], r["n_tokens"], r["n_crossing"]) for r in got] == [
            (sum(map(len, sections[:n])), len(sections[n]), tokens[n], crossing[n]) for n in range(3)]


def test_long_white_space(spark, monkeypatch):
    encoding, _ = token_counts._encoding(RANKS, tokenizers.PATTERN)
    long = ["a b" + " " * 2_000_000 + "c", "\n" * 1_500_000 + " x", "end\t" + "\t" * 1_200_000]
    docs = spark.createDataFrame(list(enumerate(long)), "doc_id long, text string")
    counted = token_counts.section_tokens(docs, RANKS, tokenizers.PATTERN).groupBy("doc_id").sum("n_tokens", "length").collect()
    assert {r[0]: (r[1], r[2]) for r in counted} == {i: (len(token_counts.encode(encoding, t)), len(t)) for i, t in enumerate(long)}
    assert encoding.decode(token_counts.encode(encoding, long[0]).tolist()) == long[0]
    # with a low threshold every text equals its encoding at once
    monkeypatch.setattr(token_counts, "_SPACES", re.compile(token_counts._SPACES.pattern.replace(str(token_counts.LONG_SPACE), "2")))
    pick = random.Random(1)
    for _ in range(3000):
        text = "".join(pick.choice([" ", "\n", "\t", "a", "'s", "1", "é", "　", "\x1c", "   "]) for _ in range(pick.randrange(14)))
        assert token_counts.encode(encoding, text).tolist() == encoding.encode(text, disallowed_special=())
