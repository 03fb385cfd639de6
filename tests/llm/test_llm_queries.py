"""The queries of the operators against their SQL, and the pipeline against a
brute-force run of its stages."""

import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from checks.compare import compare, connect
from veilscan.llm import toxicity
from veilscan.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(ORACLE))
def test_query(spark, name):
    same, _, _, difference = compare(spark, connect(SF), SF, name, QUERIES[name], ORACLE[name])
    assert same, difference


def words(text):
    return re.findall(r"[^\x20\x09-\x0d]+", text or "")


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert name == "packing" or docs.columns == columns
        kept[name] = docs.collect()

    # stage 1 rejects what the model of its own input predicts toxic, and nothing else
    given = spark.read.parquet(f"{SF}/documents.parquet")
    marks = spark.read.parquet(f"{SF}/labels.parquet")
    scored = toxicity.score(given, toxicity.fit(given, marks)).select("doc_id", "predicted").collect()
    assert {r["doc_id"] for r in kept["toxicity"]} == {r["doc_id"] for r in scored if r["predicted"] == 0}
    clean = {r["doc_id"] for r in marks.where("toxic = 0").collect()} & {r["doc_id"] for r in scored}
    assert len(clean - {r["doc_id"] for r in kept["toxicity"]}) <= 0.1 * len(clean)

    def shingles(text):
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text))
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = {r["doc_id"]: shingles(r["text"]) for r in kept["toxicity"]}
    groups = {i: i for i in sets}

    def root(x):
        return x if groups[x] == x else root(groups[x])

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                low, high = sorted((root(a), root(b)))
                groups[high] = low
    assert {r["doc_id"] for r in kept["ngram_jaccard_join"]} == {i for i in sets if root(i) == i}

    first = {}
    for r in sorted(kept["ngram_jaccard_join"], key=lambda r: r["doc_id"]):
        w = words(r["text"])
        for j in range(len(w) - 49):
            first.setdefault(tuple(w[j : j + 50]), r["doc_id"])
    left = {}
    for r in kept["ngram_jaccard_join"]:
        w, gone = words(r["text"]), set()
        for j in range(len(w) - 49):
            if first[tuple(w[j : j + 50])] < r["doc_id"]:
                gone.update(range(j, j + 50))
        left[r["doc_id"]] = [x for j, x in enumerate(w) if j not in gone]
    assert {r["doc_id"]: words(r["text"]) for r in kept["substring_dedup"]} == left

    times = Counter(r["doc_id"] for r in kept["mixing"])
    assert set(times) <= set(left) and max(times.values()) <= 2
    total = sum(len(left[i]) * n for i, n in times.items())
    assert total == pytest.approx(1.5 * sum(map(len, left.values())), rel=0.05)
    # every source comes near its target
    sizes = {r["doc_id"]: (r["source"], len(left[r["doc_id"]])) for r in kept["substring_dedup"]}
    taken, had = Counter(), Counter()
    for i, n in times.items():
        taken[sizes[i][0]] += n * sizes[i][1]
    for source, n in sizes.values():
        had[source] += n
    for source, target in plain_targets(had).items():
        most = max(n for s, n in sizes.values() if s == source)
        assert abs(taken[source] - target) <= max(0.05 * target, 2 * most), source

    # every sequence is filled from 0 without gaps, every document is whole as often as it was taken
    sequences, documents = defaultdict(list), defaultdict(list)
    for r in kept["packing"]:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        documents[r["doc_id"]].append((r["start"], r["length"], r["doc_tokens"]))
    for found in sequences.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= 2048
    assert sum(sum(n for _, n in found) < 2048 for found in sequences.values()) <= 1
    assert set(documents) == set(times)
    for i, pieces in documents.items():
        (tokens,) = {t for *_, t in pieces}
        covered = Counter(p for start, length, _ in pieces for p in range(start, start + length))
        assert set(covered) == set(range(tokens)) and set(covered.values()) == {times[i]}


def plain_targets(had):
    """Sources weigh 3, 1, 2 in order of their names, null last, and share 150%
    of all words, none more than twice its own."""
    names = sorted((s for s in had), key=lambda s: (s is None, s or ""))
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, out, open_ = 1.5 * sum(had.values()), {}, set(names)
    while open_:
        share = {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 2 * had[s]}
        if not full:
            return out | share
        for s in full:
            out[s] = 2 * had[s]
            left -= out[s]
        open_ -= full
    return out
