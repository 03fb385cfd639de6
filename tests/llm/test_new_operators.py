"""Phrase collocations, conversation repair and fingerprints, each against a
plain computation."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from veilscan.llm import collocations, fingerprints, turn_repair

DOCS = "doc_id long, text string, lang string, phrase string, a long, bucket int, k int, text2 string"


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# ----------------------------------------------------------------- collocations


def plain_counts(rows):
    counts = Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", lowered(text)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            counts[lang, 0, ""] += len(ws)
            for k in range(1, 5):
                for i in range(len(ws) - k + 1):
                    counts[lang, k, " ".join(ws[i : i + k])] += 1
    return counts


def plain_ranking(counts, least, top=2000, absorbed=80):
    held = {key: n for key, n in counts.items() if key[1] and n >= least}
    f = {(lang, phrase): n for (lang, _, phrase), n in held.items()}
    longest = {}
    for (lang, k, phrase), n in held.items():
        ws = phrase.split(" ")
        for size in range(2, k):
            for i in range(k - size + 1):
                inner = lang, " ".join(ws[i : i + size])
                longest[inner] = max(longest.get(inner, 0), n)
    out = {}
    for (lang, k, phrase), a in held.items():
        if k < 2 or 100 * longest.get((lang, phrase), -1) >= absorbed * a:
            continue
        ws = phrase.split(" ")
        cuts = [(f[lang, " ".join(ws[:j])], f[lang, " ".join(ws[j:])]) for j in range(1, k)]
        score, j = min((2000000 * a // (x + y), j) for j, (x, y) in enumerate(cuts))
        out.setdefault(lang, []).append((-score, -a, phrase.encode(), phrase, a, *cuts[j], score))
    rows = set()
    for lang, found in out.items():
        for rank, (*_, phrase, a, x, y, score) in enumerate(sorted(found)[:top], 1):
            rows.add((lang, rank, phrase, a, x, y, counts[lang, 0, ""], score))
    return rows


@pytest.fixture(scope="module")
def phrase_rows():
    pick = random.Random(3)
    vocabulary = ["der", "die", "Haus", "haus", "x", "É", "naïve", "日本", "a" * 300, "of", "the", "q q"]
    rows = [(" ".join(pick.choice(vocabulary) + pick.choice(["", "", "", ",", ". ", "\n", "\t"]) for _ in range(pick.randrange(60))), pick.choice(["de", "en", None, "e n"])) for _ in range(150)]
    rows += [(None, "de"), ("", None), (" \t.\n,", "en"), ("lone", "fr"), ("of the " * 3000, "en"), ("A b C d e. " * 500, "en")]
    rows += [("same words in every copy of it", "de")] * 40  # a hot passage
    return rows


@pytest.mark.parametrize("least, buckets", [(2, 4), (5, 64), (30, 1)])
def test_collocations(spark, phrase_rows, least, buckets, monkeypatch):
    monkeypatch.setattr(collocations, "BUCKETS", buckets)
    docs = spark.createDataFrame([(i, t, lang, "x", 1, 2, 3, t) for i, (t, lang) in enumerate(phrase_rows)], DOCS).repartition(5)
    counts = plain_counts([(t, lang or "und") for t, lang in phrase_rows])
    found = {(r["lang"], r["k"], r["phrase"]): r["f"] for r in collocations.phrase_counts(docs, least=least).collect()}
    assert found == {key: n for key, n in counts.items() if (key[1] == 0 and n) or n >= least}
    for top in (2000, 3):
        ranking = collocations.collocations(docs, least=least, top=top).collect()
        assert {tuple(r) for r in ranking} == plain_ranking(counts, least, top)
        assert len(ranking) == len(set(ranking))


def test_collocations_of_nothing(spark):
    assert collocations.collocations(spark.createDataFrame([], DOCS)).collect() == []
    assert collocations.collocations(spark.createDataFrame([(1, None, None, "", 1, 1, 1, "")], DOCS)).collect() == []


def test_scores_beyond_64_bits(spark):
    big = 2**61
    counts = {("en", 0, ""): 2**62, ("en", 1, "a"): big + 7, ("en", 1, "b"): big + 11, ("en", 2, "a b"): big, ("en", 1, "c"): big, ("en", 3, "a b c"): big * 79 // 100, ("en", 2, "b c"): big}
    rows = spark.createDataFrame([(*key, n) for key, n in counts.items()], collocations.COUNTS)
    assert {tuple(r) for r in collocations.ranked(rows).collect()} == plain_ranking(counts, 30)


def test_multikey_quicksort():
    random_ = np.random.default_rng(5)
    for size, kinds in ((0, 2), (1, 2), (500, 2), (2000, 40)):
        keys = random_.integers(1, kinds + 1, (4, size)).astype(np.uint64)
        left = random_.integers(1, 5, size)
        keys[np.arange(4)[:, None] >= left] = 0
        weights = random_.integers(1, 4, size)
        counts = Counter()
        for i in range(size):
            for d in range(1, left[i] + 1):
                counts[tuple(keys[:d, i])] += weights[i]
        heads, depths, sums = collocations.multikey_quicksort(keys, weights, 9)
        found = {tuple(keys[:d, h]): n for h, d, n in zip(heads, depths, sums, strict=True)}
        assert len(found) == len(heads) and found == {p: n for p, n in counts.items() if n >= 9}


# ----------------------------------------------------------------- conversations

NEVER = (10**9, "")


def plain_repair(rows):
    """Every state's least (cost, audit), row after row."""

    def inserted(states):
        states = list(states)
        for _ in range(3):
            for q, (cost, audit) in enumerate(states):
                n = 3 if q == 2 else 2
                states[n] = min(states[n], (cost + 2, audit + "I"))
        return states

    states = [(0, ""), NEVER, NEVER, NEVER]
    for initial, forced, late in rows:
        states = inserted(states)
        new = [(cost + 3, audit + "D") for cost, audit in states]
        for q, (cost, audit) in enumerate(states):
            if forced:
                continue
            n = 3 if q == 2 else 2
            new[n] = min(new[n], (cost + 2 + late, audit + "R"))
            k = {"s": 1 if q == 0 else None, "u": 2 if q != 2 else None, "a": 3 if q == 2 else None}.get(initial)
            if k:
                new[k] = min(new[k], (cost + late, audit + "K"))
        states = new
    states = inserted(states)
    return min(states[0], states[3])


def some_rows(pick, size):
    letters = pick.choice(["sua-", "uuua", "ss", "ua", "-", "su", "-a"])
    forced = [pick.random() < 0.15 for _ in range(size)]
    return [(pick.choice(letters), f, not f and pick.random() < 0.2) for f in forced]


@pytest.mark.parametrize("segment, sizes", [(128, (0, 1, 2, 5, 9, 20)), (5, (4, 5, 6, 11, 33)), (1, (3, 8))])
def test_search(monkeypatch, segment, sizes):
    monkeypatch.setattr(turn_repair, "SEGMENT", segment)
    pick = random.Random(segment)
    for _ in range(800):
        rows = some_rows(pick, pick.choice(sizes))
        repair = turn_repair.Repair()
        for row in rows:
            repair.add(*row)
        assert repair.result() == plain_repair(rows), rows


def test_lower_bounds_hold():
    pick = random.Random(9)
    for _ in range(500):
        rows = some_rows(pick, pick.randrange(12))
        assert turn_repair.lower_bounds(rows)[0][0] <= plain_repair(rows)[0]


SPACE = re.compile(r"[^\x20\x09-\x0d]")


def plain_conversation(rows):
    """The report of one conversation, from its damaged (turn, role, text)."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).digest()))
    seen, letters, counts, before = set(), [], Counter(), None
    for _, role, text in rows:
        blank = not SPACE.search(text)
        duplicate = not blank and (role, text) in seen
        last = SPACE.findall(text)[-1:]
        late = not blank and not duplicate and last[0] not in ".!?"
        seen.add((role, text))
        counts.update(blank=blank, duplicate=duplicate, truncated=late)
        counts["illegal"] += before is not None and before + role[:1] not in {"su", "ua", "au"}
        before = role[:1]
        letters.append((role[:1] if role[:1] in ("s", "u", "a") else "-", blank or duplicate, late))
    cost, audit = plain_repair(letters)
    left, out, state = list(rows), [], ""
    for edit in audit:
        given = "assistant" if state == "u" else "user"
        if edit == "I":
            out.append(f"{given}:")
        else:
            _, role, text = left.pop(0)
            if edit == "D":
                continue
            given = role if edit == "K" else given
            out.append(f"{given}:{text}")
        state = given[0]
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    whole = hashlib.sha256("\n".join(out).encode()).hexdigest()
    return gaps, counts["blank"], counts["duplicate"], counts["truncated"], counts["illegal"], cost, audit, whole


def plain_damage(conversations):
    out = {}
    for conv_id, turn, role, text, *_ in conversations:
        rows = out.setdefault(conv_id, [])
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        rows += [(turn, role, text)] * (kind != 0) * (2 if kind == 3 else 1)
    return out


@pytest.fixture(scope="module")
def conversations():
    pick = random.Random(11)
    texts = ["Yes.", "No", "Why?\n", "", " \t", "Long " * 5000 + "!", "é。", "Yes.", "a:b\nc."]
    roles = ["user", "assistant", "system", "tool", "", None, "User"]
    rows = []
    for conv in [None, *range(120)]:
        for turn in range(pick.randrange(1, 9)):
            role = pick.choice(roles) if pick.random() < 0.3 else ("user", "assistant")[turn % 2]
            rows.append((conv, pick.choice([turn, turn, turn, None]), role, pick.choice([*texts, None]), "x", 1, 2, "y"))
    rows += [(7, 3, "user", "Twice.", "x", 1, 2, "y")] * 3
    # a hot conversation of several segments, and one whose rows all go
    rows += [(500, t, pick.choice(["user", "assistant", "system"]), pick.choice(texts), "x", 1, 2, "y") for t in range(700)]
    gone = next(t for t in range(10**4) if zlib.crc32(f"900:{t}".encode()) % 20 == 0)
    rows.append((900, gone, "user", "Hello.", "x", 1, 2, "y"))
    return rows


TALK = "conv_id long, turn long, role string, text string, kind string, copies int, cost int, audit string"


def test_repairs(spark, conversations):
    table = spark.createDataFrame(conversations, TALK).repartition(7)
    found = turn_repair.repairs(turn_repair.damaged(table), table).collect()
    wanted = {conv: plain_conversation(rows) for conv, rows in plain_damage(conversations).items()}
    assert {r["conv_id"]: tuple(r)[1:] for r in found} == wanted and len(found) == len(wanted)
    assert wanted[900] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_repaired_rows(spark, conversations):
    table = spark.createDataFrame(conversations, TALK)
    rows = turn_repair.prepared(table)
    out = {}
    for r in turn_repair.repaired(rows, turn_repair.reports(rows)).collect():
        out.setdefault(r["conv_id"], []).append(r)
    for conv, lines in out.items():
        lines.sort(key=lambda r: r["place"])
        assert re.fullmatch("(s?(ua)+)?", "".join(r["role"][0] for r in lines)), conv
    assert all(r["text"] == "" and r["turn"] is None for lines in out.values() for r in lines if r["edit"] == "I")


def test_repairs_of_nothing(spark):
    table = spark.createDataFrame([], TALK)
    assert turn_repair.repairs(turn_repair.damaged(table), table).collect() == []


# ------------------------------------------------------------------ fingerprints


def toss(values):
    """One round of coin tossing over a stretch: (value before, value) each."""
    out = []
    for i, v in enumerate(values):
        differ = (values[i - 1] if i else v ^ 1) ^ v
        low = (differ & -differ).bit_length() - 1
        out.append(2 * low + (v >> low & 1))
    return out


def plain_level(names):
    """Blocks of one level as lists of names."""
    blocks, i = [], 0
    while i < len(names):
        j = i + 1
        while j < len(names) and names[j] == names[i]:
            j += 1
        if j > i + 1:
            blocks.append(names[i:j])
            i = j
            continue
        while j < len(names) and not (j + 1 < len(names) and names[j] == names[j + 1]):
            j += 1
        labels = names[i:j]
        for _ in range(4):
            labels = toss(labels)
        cuts = [0] + [t for t in range(1, j - i - 1) if labels[t - 1] < labels[t] > labels[t + 1]] + [j - i]
        blocks += [names[i + a : i + b] for a, b in zip(cuts, cuts[1:])]
        i = j
    return blocks


def plain_phrases(text):
    """The substrings that a fingerprint's phrases stand for, with their level."""
    strings, spans, level, out = fingerprints.mix64(np.array([ord(c) for c in text], np.uint64) + fingerprints._LENGTH).tolist(), [(i, i + 1) for i in range(len(text))], 0, set()
    while strings and (level == 0 or len(strings) > 1 or (level == 1 and len(text) >= fingerprints.SHORT)):
        level += 1
        blocks = plain_level(strings)
        names, _ = fingerprints.parse(np.array(strings, np.uint64), np.arange(len(strings)) == 0)
        assert len(names) == len(blocks)
        ends = np.cumsum([len(b) for b in blocks]).tolist()
        spans = [(spans[e - len(b)][0], spans[e - 1][1]) for b, e in zip(blocks, ends, strict=True)]
        strings = names.tolist()
        if level > 1 or len(text) < fingerprints.SHORT:
            out |= {(level, text[a:b]) for a, b in spans}
    return out


def texts_to_parse():
    pick = random.Random(2)
    out = ["", "a", "aa", "ab", "aab", "é" * 70, "abab" * 40, "x" * 64, "日本語😀", "the cat sat on the mat " * 9]
    out += ["".join(pick.choice("ab") for _ in range(n)) for n in range(40)]
    out += ["".join(pick.choice("abcdefgh ") for _ in range(pick.randrange(900))) for _ in range(40)]
    return out


def test_phrases():
    texts = texts_to_parse()
    of, names = fingerprints.phrases(texts)
    for i, text in enumerate(texts):
        found, wanted = set(names[of == i].tolist()), plain_phrases(text)
        assert len(found) == len(wanted), text
    sketches = fingerprints.sketches(texts)
    for a, x in zip(texts[:30], sketches):
        for b, y in zip(texts[:30], sketches):
            p, q = plain_phrases(a), plain_phrases(b)
            if max(len(p), len(q)) <= fingerprints.NAMES // 2:
                assert fingerprints.likeness(x, y) == (len(p & q) / len(p | q) if p | q else 1.0)


def test_equal_substrings_share_their_inside():
    pick = random.Random(4)
    inside = "".join(pick.choice("abcdefghijklmnop ") for _ in range(4000))
    of, names = fingerprints.phrases([inside] + ["".join(pick.choice("qrstuv") for _ in range(n)) + inside + "#" * n for n in (1, 2, 3, 50, 777)])
    own = set(names[of == 0].tolist())
    for i in range(1, 6):
        assert len(own & set(names[of == i].tolist())) > 0.95 * len(own)


def test_against_edits(spark, monkeypatch):
    pick = random.Random(8)
    rows = [(i, "".join(pick.choice("abcd efg é") for _ in range(pick.randrange(200)))) for i in pick.sample(range(-500, 10**6), 300)]
    rows += [(None, "no id"), (None, "no id"), (None, None), (5000000, None), (5000001, ""), (77, "same id"), (77, "same id"), (77, "another text")]
    rows += [(2**63 - 1, "largest"), (-(2**63), "z" * 3000)]
    table = spark.createDataFrame([(i, t, "en", "x", 1, 2, 3, "q") for i, t in rows], DOCS).repartition(6)
    found = fingerprints.against_edits(table).collect()
    hashes = {r["text"]: r["h"] for r in table.selectExpr("coalesce(text, '') text", "xxhash64(coalesce(text, '')) h").collect()}
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), hashes[r[1]], r[1]))
    sketch = dict(zip([t for _, t in order], fingerprints.sketches([t for _, t in order])))
    wanted = Counter()
    for (i, text), (_, following) in zip(order, order[1:] + order[:1]):
        half = len(text) // 2
        changed = text[: len(text) - half] + following[:half]
        (new,) = fingerprints.sketches([changed])
        wanted[i, len(text), hashlib.sha256(changed.encode()).hexdigest(), fingerprints.as_text(sketch[text]), fingerprints.as_text(new), fingerprints.likeness(sketch[text], new), fingerprints.likeness(sketch[text], sketch[following])] += 1
    assert Counter(map(tuple, found)) == wanted
    alone = {(r["doc_id"], r["n_chars"], r["fingerprint"]) for r in fingerprints.fingerprint(table).collect()}
    assert alone == {(r["doc_id"], r["n_chars"], r["fingerprint"]) for r in found}


def test_fingerprints_of_little(spark):
    empty = spark.createDataFrame([], DOCS)
    assert fingerprints.against_edits(empty).collect() == [] and fingerprints.fingerprint(empty).collect() == []
    (row,) = fingerprints.against_edits(spark.createDataFrame([(1, "abcdef", "en", "x", 1, 2, 3, "q")], DOCS)).collect()
    assert row["edited_sha256"] == hashlib.sha256(b"abcabc").hexdigest() and row["near_next"] == 1.0
