"""What the n-gram join keeps on the way."""

import os

from veilscan.llm import ngram_join


def test_rows_of_buckets_name_no_other_buckets_and_go(spark, monkeypatch):
    kept = []

    def recorded(df):
        out = write(df)
        kept.append((set(df.columns), [f.dataType.typeName() for f in df.schema], out))
        return out

    write = ngram_join.keep
    monkeypatch.setattr(ngram_join, "keep", recorded)
    # neighbours share most words but do not link, and those of one half do
    lines = [f"w{i} x{i} y{i} z{i} v{i} u{i}" for i in range(40)]
    rows = [(10 * k + j, " ".join(lines[k : k + 20] + [f"end{j}"] * (j // 2))) for k in range(20) for j in range(4)]
    result = ngram_join.link_documents(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r["doc_id"]: r["component_id"] for r in result.collect()}
    sets = {i: {tuple(w[p : p + 5]) for p in range(len(w) - 4)} for i, w in ((i, t.split()) for i, t in rows)}
    low = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    low[a] = low[b] = min(low[a], low[b])
        if all(low[low[i]] == low[i] for i in low):
            break
    assert got == low
    of_buckets = [(types, table) for columns, types, table in kept if "bucket" in columns]
    assert of_buckets and not any("array" in types for types, _ in of_buckets)
    for _, table in of_buckets:
        assert not os.path.exists(table._kept_at.removeprefix("file:"))
