"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing
columns, each against a plain computation."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from veilscan.llm import mixing, packing, quality_rules, substring_dedup, token_counts, toxicity, vector_search
from veilscan.llm.chat_format import escape, read_back, render, unescape
from veilscan.llm.hashing import Words
from veilscan.llm.html_text import main_text
from veilscan.llm.ngram_join import link_documents
from veilscan.llm.templates import TemplateError, compile_template

tokenizers = pytest.importorskip("public_tokenizers")

WORD = re.compile(r"[^\x20\x09-\x0d]+")
DOCS = "doc_id long, text string, source string, size long, n_words long, spans int, content string, id int"


def words(text):
    return WORD.findall(text or "")


def passage(name, count):
    return " ".join(f"{name}{i}" for i in range(count))


@pytest.fixture(scope="module")
def texts():
    base = passage("w", 300)
    return [
        (1, base, "b"),
        (2, base, "b"),
        (2, base, "b"),
        (3, base.replace("w7 ", "x7 ").replace("w250", "y250"), "a"),
        (4, None, None),
        (5, "", "a"),
        (6, " \t\n\x0b\f\r ", "c"),
        (7, "One two", "c"),
        (8, "oNE\ttwo", "é"),
        (9, passage("q", 60) + "\n" + passage("w", 70), "b"),
        (None, base, "b"),
        (10, "zusätzlich\u00a0#*| " * 20 + "\n\n\nend\nend", None),
        (11, passage("long", 40_000), "b"),
        (12, passage("t", 20) + " " + passage("t", 20), "z"),
    ]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, s, 1, 2, 3, "x", 4) for i, t, s in texts], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def shingles(text):
    found = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(found) < 5:
        return {tuple(found)} if found else set()
    return {tuple(found[i : i + 5]) for i in range(len(found) - 4)}


def test_links(spark, docs, empty, texts):
    sets = [(i, shingles(t)) for i, t, _ in texts]
    parent = {i: i for i, _ in sets if i is not None}

    def root(x):
        return x if parent[x] == x else root(parent[x])

    for i, a in sets:
        for j, b in sets:
            if None not in (i, j) and i < j and a and b and 100 * len(a & b) >= 75 * len(a | b):
                low, high = sorted((root(i), root(j)))
                parent[high] = low
    want = Counter((i, len(s), None if i is None else root(i)) for i, s in sets)
    got = Counter(tuple(r) for r in link_documents(docs).collect())
    assert got == want
    assert link_documents(empty).count() == 0


def test_links_of_many_near_copies(spark):
    rng = np.random.Generator(np.random.PCG64(1))
    rows, base = [], [f"k{i}" for i in range(120)]
    for i in range(300):
        own = list(base)
        for at in rng.integers(0, 120, rng.integers(0, 5)):
            own[at] = f"own{i}_{at}"
        rows.append((i, " ".join(own)))
    rows += [(1000 + i, passage(f"o{i}_", 80) + " " + passage("shared", 30)) for i in range(200)]
    got = {r["doc_id"]: r["component_id"] for r in link_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {i: shingles(t) for i, t in rows[:300]}
    reached, queue = {0}, [0]
    while queue:
        a = queue.pop()
        near = [b for b in sets if b not in reached and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
        reached.update(near)
        queue += near
    assert {i for i, c in got.items() if c == 0} == reached
    assert all(got[i] == i for i, _ in rows[300:])


def test_cut_repeats(spark, docs, empty, texts):
    first = {}
    for i, t, _ in sorted((x for x in texts if x[0] is not None), key=lambda x: x[0]):
        w = words(t)
        for j in range(len(w) - 49):
            first.setdefault(tuple(w[j : j + 50]), i)
    want = Counter()
    for i, t, _ in texts:
        w, gone = words(t), set()
        for j in range(len(w) - 49 if i is not None else 0):
            if first[tuple(w[j : j + 50])] < i:
                gone.update(range(j, j + 50))
        want[(i, tuple(x for j, x in enumerate(w) if j not in gone), len(w), len(gone))] += 1
    cut = substring_dedup.cut_repeats(docs)
    assert cut.columns == [c for c in docs.columns if c != "n_words"] + ["n_words", "n_removed"]
    rows = cut.collect()
    assert Counter((r["doc_id"], tuple(words(r["text"])), r["n_words"], r["n_removed"]) for r in rows) == want
    same = {(i, t) for i, t, _ in texts}
    assert all((r["doc_id"], r["text"]) in same for r in rows if r["n_removed"] == 0)
    assert substring_dedup.cut_repeats(empty).count() == 0


def test_winnow_covers_every_window():
    own = Words(pa.array([passage("a", 200), "", passage("b", 49), passage("c", 50)]))
    at, first, count = substring_dedup.winnow(own, 50, substring_dedup.SEED)
    covered = [i for a, n in zip(first.tolist(), count.tolist(), strict=True) for i in range(a, a + n)]
    assert covered == [*range(151), 249]
    assert all(f + n - 1 <= p <= f + 50 - substring_dedup.SEED for p, f, n in zip(at, first, count, strict=True))


def test_toxicity(spark, docs, empty):
    def is_held(i):
        return zlib.crc32(str(i).encode()) % 4 == 2

    rng = np.random.Generator(np.random.PCG64(2))
    rows, marks = [], []
    for i in range(1200):
        own = [f"w{x}" for x in rng.integers(0, 400, 40)]
        toxic = int(i % 6 == 0)
        if toxic:
            own[3:5] = ["idiot", "scum"]
        rows.append((i, " ".join(own)))
        marks.append((i, toxic))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([*marks, (None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit(table, labels)
    got = {r["doc_id"]: r for r in toxicity.score(table, model).collect()}
    held = [i for i, _ in rows if is_held(i)]
    assert sum(got[i]["predicted"] == int(i % 6 == 0) for i in held) >= 0.97 * len(held)
    odd = toxicity.score(docs.withColumnRenamed("size", "score"), model).collect()
    assert len(odd) == docs.count() and all(0 <= r["score"] <= 1 for r in odd)
    assert toxicity.score(empty, toxicity.fit(empty, labels.limit(0))).count() == 0


def test_toxicity_of_pairs():
    """Two terms that are toxic only together."""
    rng = np.random.Generator(np.random.PCG64(3))
    texts, labels = [], []
    for _ in range(3000):
        a, b = rng.random(2) < 0.3
        texts.append(np.array(sorted({*rng.integers(100, 140, 5), *([1] if a else []), *([2] if b else [])}), np.int32))
        labels.append(float(a and b))
    model = toxicity.train(texts, np.array(labels), epochs=30)
    assert float(model.factors[1] @ model.factors[2]) > 0.5
    rows = np.array([0, 1, 2, 4])
    one, two, both = model.logits(np.array([1, 2, 1, 2]), rows)
    assert both > 0 > max(one, two)


def test_toxicity_of_pairs_of_weak_terms():
    """Two terms whose own shares are near the base rate, toxic only together."""
    rng = np.random.Generator(np.random.PCG64(8))
    texts, labels = [], []
    for _ in range(6000):
        a, b = rng.random(2) < 0.1
        toxic = (a and b) or rng.random() < (0.03 if a or b else 0.11)
        texts.append(np.array(sorted({*rng.integers(100, 1000, 60), *([1] if a else []), *([2] if b else [])}), np.int32))
        labels.append(float(toxic))
    counts = toxicity.term_counts(texts, np.array(labels))
    assert not toxicity.telling(*counts)[[1, 2]].any()
    model = toxicity.train(texts, np.array(labels))
    one, two, both = model.logits(np.array([1, 2, 1, 2]), np.array([0, 1, 2, 4]))
    assert both > 0 > max(one, two)


def test_toxicity_of_rare_terms(spark):
    """A term that the training sample misses still counts."""
    rows = [(i, f"w{i % 50} w{i % 7}" + (" gruml" if i % 40 == 0 else "")) for i in range(2400)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    labels = table.selectExpr("doc_id", "cast(doc_id % 40 = 0 or doc_id % 11 = 0 as int) toxic")
    model = toxicity.fit(table, labels, rows=40)
    asked = spark.createDataFrame([(1, "w1 w2 gruml"), (2, "w1 w2")], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in toxicity.score(asked, model).collect()}
    assert got[1] > got[2] + 0.2


def test_top_products(spark):
    rng = np.random.Generator(np.random.PCG64(4))
    rows = [(i, rng.normal(0, 0.3, 8).tolist()) for i in range(400)]
    rows += [(1000 + i, [0.5] * 8) for i in range(300)]  # ties
    rows += [(2000, None), (2050, [None] * 8), (2100, [float("nan")] * 8), (None, [1.0] * 8), (3000, [1.0, 2.0]), (50, rows[50][1])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    grids = {i: np.floor(256 * np.array(v)).astype(int) for i, v in rows if i is not None and v and len(v) == 8 and all(x is not None and x == x for x in v)}
    got = defaultdict(list)
    for r in vector_search.top_products(table).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    asked = [i for i in grids if i % 50 == 0]
    assert sorted(got) == sorted(asked)
    for q in asked:
        best = sorted((-int(v @ grids[q]), i) for i, v in grids.items() if i != q)[:5]
        assert sorted(got[q]) == [(n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert vector_search.top_products(table.limit(0)).count() == 0


def test_top_products_of_repeated_ids(spark):
    """An id with several good vectors takes one of the five places."""
    rows = [(50, [1.0, 0.0]), *((1, [2.0 + x / 8, 0.0]) for x in range(7)), *((i, [i / 16, 0.0]) for i in range(2, 10))]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = vector_search.top_products(table).where("query_id = 50").orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(1, 256 * 704), *((i, 256 * 16 * i) for i in (9, 8, 7, 6))]


def test_tree_bounds():
    vectors = np.random.Generator(np.random.PCG64(5)).integers(-200, 200, (1000, 6))
    order, boxes = vector_search.build(vectors)
    assert sorted(order.tolist()) == list(range(1000))
    for (a, b), (low, high) in zip(vector_search.halves(1000), boxes, strict=True):
        own = vectors[order[a:b]]
        assert (own.min(axis=0) == low).all() and (own.max(axis=0) == high).all()


def water_fill(sizes, weights, total):
    target = dict.fromkeys(sizes, 0.0)
    free = set(sizes)
    while free:
        level = (total - sum(target[s] for s in sizes if s not in free)) / sum(weights[s] for s in free)
        over = {s for s in free if level * weights[s] > 2 * sizes[s]}
        for s in over or free:
            target[s] = 2 * sizes[s] if over else level * weights[s]
        free -= over or free
    return target


def test_mixing(spark, docs, empty, texts):
    rng = np.random.Generator(np.random.PCG64(6))
    rows = [*texts, *((100 + i, passage("m", int(n)), "abcdé"[i % 5]) for i, n in enumerate(rng.integers(1, 200, 600)))]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumnRenamed("extra", "target")
    got = mixing.mix(table).collect()
    again = mixing.mix(table.repartition(7)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((i, len(words(t))) for i, t, _ in rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(words(t))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {s: (3, 1, 2)[n % 3] for n, s in enumerate(order)}
    target = water_fill(dict(sizes), weights, 1.5 * sum(sizes.values()))
    taken = Counter()
    for r in got:
        assert r["target"] == pytest.approx(target[r["source"]]) and r["source_size"] == sizes[r["source"]]
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[r["source"]] += r["taken"]
    for source in "acdé":
        assert abs(taken[source] - target[source]) < 40
    assert mixing.mix(empty).count() == 0


def test_flight_keeps_totals():
    size = np.random.Generator(np.random.PCG64(7)).integers(1, 1000, 500).astype(float)
    part = np.full(500, 0.37)
    flown = mixing.balanced(size, part.copy(), False, 9)
    assert np.count_nonzero((flown > 0) & (flown < 1)) <= 2
    assert flown.sum() == pytest.approx(part.sum()) and flown @ size == pytest.approx(part @ size)


def test_token_counts(spark, docs, empty, texts):
    tiktoken = pytest.importorskip("tiktoken")
    ranks = tokenizers.path("byte_bpe_50k.tiktoken")
    encoding, _ = token_counts._encoding(ranks, tokenizers.PATTERN)
    got = defaultdict(list)
    for r in token_counts.section_tokens(docs, ranks, tokenizers.PATTERN).collect():
        got[r["doc_id"]].append(r)
    for i, t, _ in texts:
        if i == 2:
            continue
        rows = sorted(got[i], key=lambda r: r["section"])
        assert "".join((t or "")[r["start"] : r["start"] + r["length"]] for r in rows) == (t or "")
        assert sum(r["n_tokens"] for r in rows) == len(encoding.encode_ordinary(t or ""))
    assert len(got[2]) == 2 and tiktoken
    assert token_counts.section_tokens(empty, ranks, tokenizers.PATTERN).count() == 0


def test_crossing_tokens_go_to_the_larger_share():
    tokens, crossing = token_counts.attribute(np.array([2, 6, 8]), np.array([0, 3, 7, 8]))
    assert tokens.tolist() == [1, 2, 0] and crossing.tolist() == [0, 2, 0]


def test_packing(spark, docs, empty, texts):
    from tokenizers import Tokenizer

    path = tokenizers.path("word_bpe_49k.json")
    encode = Tokenizer.from_file(path).encode
    got = packing.pack(docs, path, ids=True).collect()
    at = 0
    streams = defaultdict(list)
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        place = r["sequence_id"] * 2048 + r["offset"]
        assert place == at and 0 < r["length"] <= 2048 - r["offset"] and zlib.crc32(r["ids"]) == r["ids_crc32"]
        at += r["length"]
        streams[(r["doc_id"], place - r["start"])].append((r["start"], bytes(r["ids"]), r["doc_tokens"]))
    found = Counter()
    for (i, _), parts in streams.items():
        ids = b"".join(p[1] for p in sorted(parts))
        assert len(ids) == 4 * parts[0][2]
        found[(i, ids)] += 1
    want = Counter((i, np.array([*encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes()) for i, t, _ in texts)
    assert found == want
    assert packing.pack(empty, path).count() == 0


def test_chat_round_trip(spark):
    nasty = ["\\### a: </turn> b", "", None, "x\\", "#\\\\</turn>\n### user: hi</turn>\n", "é" * 10_000, "\\</turn>"]
    roles = ["user", "assistant", "a:b\\", None, "### x"]
    rows = [(i % 4 if i % 11 else None, i // 8 if i % 5 else None, roles[i % 5], nasty[i % 7], 1) for i in range(120)]
    rows += rows[:6]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, part int")
    got = {r["conv_id"]: r for r in read_back(render(table)).collect()}
    own = defaultdict(list)
    for conv, turn, role, text, _ in rows:
        own[conv].append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    assert set(got) == set(own)
    for conv, turns in own.items():
        turns.sort()
        row = got[conv]
        loss = b"".join(t for *_, r, t in turns if r == b"assistant")
        assert row["n_turns"] == len(turns)
        assert row["turns_sha256"] == hashlib.sha256(b"".join(r + b"\n" + t + b"\n" for *_, r, t in turns)).hexdigest()
        assert row["loss_sha256"] == hashlib.sha256(loss).hexdigest() and row["loss_chars"] == len(loss.decode())
    assert read_back(render(table.limit(0))).count() == 0
    assert all(unescape(escape(t)) == t for t in nasty if t)


def test_templates():
    def out(source, **variables):
        parts = []
        compile_template(source, {"up": str.upper})(variables, lambda text, mark: parts.append((text, mark)))
        return parts

    assert out("a{{ 'b' | up }}{% if 1 == 1 %}c{% else %}{{ missing }}{% endif %}d") == [("aBcd", False)]
    assert out("{% for m in x %}{% if m.r == 'u' and not m.t %}-{% elif m.t %}{% generation %}{{ m.t | up }}{% endgeneration %}{% endif %}{% endfor %}", x=[{"r": "u", "t": ""}, {"r": "a", "t": "q"}]) == [("-", False), ("Q", True)]
    for bad in ("{% for %}", "{% if x %}", "{{ x() }}", "{{ x.__class__.a }}", "{{ open | nope }}", "{% endif %}"):
        with pytest.raises((TemplateError, KeyError)):
            out(bad, x="s")


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script></head><body>
<nav><ul><li><a href=/>Home</a></ul></nav><div class="promo-box x">Buy {0}</div><div class=q7>Share this page</div>
<article><h1>Title {0}</h1><p>One &amp; <b>two
three</b><p>Common line<div class=q8>Follow us</div><p>Four{0}<br></article>
<div class="comments">nice</div><footer>&copy; x</footer></body>"""


def test_html(spark):
    rows = [(i, f"https://h.example/{i}", PAGE.format(i), 1) for i in range(8)]
    rows += [(20, None, None, 1), (21, "x", "", 1), (22, "http://o.example", "<p>a<p>b &lt;c&gt;<div>d", 1), (22, "http://o.example", "<p>a<p>b &lt;c&gt;<div>d", 1)]
    got = defaultdict(list)
    for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect():
        assert r["n_chars"] == len(r["text"])
        got[r["page_id"]].append(r["text"])
    for i in range(8):
        assert got[i] == [f"Title {i}\nOne & two three\nCommon line\nFour{i}"]
    assert got[20] == got[21] == [""] and got[22] == ["a\nb <c>\nd"] * 2
    assert main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_of_near_copies(spark):
    """A body whose copies differ in headline and one line is no template, a
    notice on some of very many articles is."""
    rng = np.random.Generator(np.random.PCG64(6))
    body = [passage(f"b{i}x", 60) for i in range(6)]
    notice = "<div class=k3>Read our terms before you go on</div>"
    pages, wanted = {}, {}

    def add(host, page, text):
        i = len(pages)
        pages[i], wanted[i] = (f"http://{host}/{i}", page), text

    for i in range(100):
        paragraphs = "".join(f"<p>{x}</p>" for x in body)
        text = "\n".join(body)
        add("copies", f"<article><h1>Head {i}</h1><div>{paragraphs}</div></article>", f"Head {i}\n{text}")
        own = [*body[:3], f"line {i}", *body[3:]]  # two halves, only the second of them equal
        halves = ["".join(f"<p>{x}</p>" for x in own[a : a + 4]) for a in (0, 4)]
        add("halves", f"<h1>Head {i}</h1><section>{halves[0]}</section><section>{halves[1]}</section>", "\n".join([f"Head {i}", *own]))
        add("plain", f"<h1>Head {i}</h1><div>{paragraphs}</div>", f"Head {i}\n{text}")
    for i in range(300):
        own = " ".join(f"v{x}" for x in rng.integers(0, 5000, 60))
        add("hot", f"<article><h1>Head {i}</h1><p>{own}</p>{notice if i % 5 == 0 else ''}</article>", f"Head {i}\n{own}")
        if i < 220:
            add("copies", f"<article><p>{own}</p></article>", own)
    table = spark.createDataFrame([(i, *x) for i, x in pages.items()], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in main_text(table).collect()}
    assert [i for i in wanted if got[i] != wanted[i]] == []


def test_quality(spark, docs, empty, texts):
    got = Counter()
    for r in quality_rules.judge(docs).collect():
        assert not (r["base_failed"] and r["kept"])
        got[(r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])] += 1
    want = Counter()
    for i, t, _ in texts:
        t, w, runs = t or "", words(t), defaultdict(list)
        for j in range(len(w) - 7):
            runs[tuple(w[j : j + 8])].append(j)
        lines = [x for x in t.split("\n") if words(x)]
        again = {j + k for places in runs.values() if len(places) > 1 for j in places for k in range(8)}
        want[(i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(again))] += 1
    assert got == want
    assert quality_rules.judge(empty).count() == 0
    order = quality_rules.cascade_order(docs)
    assert sorted(r.name for r in order) == sorted(r.name for r in quality_rules.RULES)
