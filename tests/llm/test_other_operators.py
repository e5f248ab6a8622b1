"""Vector searches, the archive, and the pipeline."""

from __future__ import annotations

import base64
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from bandloom.llm import neighbours, topk, warc

VECTORS = "vec_id long, embedding array<float>"


def vectors(n, dim, seed, odd=True):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(12, dim))
    rows = [(i, (centre[rng.integers(12)] + 0.3 * rng.normal(size=dim)).astype(np.float32).tolist()) for i in range(n)]
    for i in range(0, n, 7):  # ties and repeated vectors
        rows[i] = (rows[i][0], rows[0][1])
    if odd:
        rows += [(1000 * n, None), (1001 * n, []), (1002 * n, [None] * dim), (1003 * n, [float("nan")] * dim), (1004 * n, [float("inf")] * dim), (1005 * n, [0.0] * dim), (None, rows[-1][1]), (50 * n, [1.0, 2.0]), (51 * n + 1, [2.0, 1.0])]
    return rows


def usable(rows, zero):
    ok = lambda v: v and all(x is not None and np.isfinite(x) for x in v) and (zero or any(x != 0 for x in v))
    return [(i, np.array(v, np.float64)) for i, v in rows if i is not None and ok(v)]


@pytest.mark.parametrize(("n", "dim", "every"), [(300, 20, 10), (2, 3, 1), (40, 33, 50)])
def test_top_k(spark, n, dim, every):
    rows = vectors(n, dim, n)
    got = topk.exact_top_k(spark.createDataFrame(rows, VECTORS).withColumn("score", F.lit(1)).repartition(3), every=every, query_block=7, row_block=64).collect()
    good = usable(rows, True)
    want = []
    for i, q in good:
        if i % every == 0:
            scored = sorted((-int(np.floor(256 * q) @ np.floor(256 * v)), j) for j, v in good if j != i and len(v) == len(q))
            want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored[:5])]
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == sorted(want)


def test_top_k_large_numbers_and_empty(spark):
    rows = [(0, [3e6, 1.0]), (1, [3e6, 0.5]), (2, [-3e6, 2.0]), (3, [2e6, 7.0])]
    got = topk.exact_top_k(spark.createDataFrame(rows, VECTORS), every=1).where("query_id = 0").orderBy("rank").collect()
    ints = {i: [int(np.floor(256 * float(np.float32(x)))) for x in v] for i, v in rows}
    dot = lambda a, b: sum(x * y for x, y in zip(ints[a], ints[b], strict=True))
    assert [(r["vec_id"], r["score"]) for r in got] == sorted(((j, dot(0, j)) for j in (1, 2, 3)), key=lambda x: -x[1])
    assert topk.exact_top_k(spark.createDataFrame([], VECTORS)).count() == 0


@pytest.mark.parametrize(("n", "dim"), [(3000, 16), (5, 4)])
def test_nearest(spark, n, dim):
    rows = vectors(n, dim, n)
    got = neighbours.nearest(spark.createDataFrame(rows, VECTORS).repartition(3), every=50 if n > 100 else 1, sample=1500).collect()
    good = usable(rows, False)
    found, total = 0, 0
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append(r)
    for i, q in good:
        if i % (50 if n > 100 else 1) == 0:
            near = sorted((float(np.sqrt(((v - q) ** 2).sum())), j) for j, v in good if j != i and len(v) == len(q))[:10]
            mine = sorted(by.get(i, []), key=lambda r: r["rank"])
            assert [r["rank"] for r in mine] == list(range(1, len(mine) + 1))
            assert all(r["score"] == pytest.approx(float(np.sqrt(((dict(good)[r["vec_id"]] - q) ** 2).sum())), rel=1e-12) for r in mine if r["vec_id"] != i)
            assert [(r["score"], r["vec_id"]) for r in mine] == sorted((r["score"], r["vec_id"]) for r in mine)
            found += len({j for _, j in near} & {r["vec_id"] for r in mine})
            total += len(near)
    assert found >= 0.9 * total


@pytest.mark.parametrize(("recall", "leaf_rows"), [(0.98, None), (0.0, 1)])
def test_nearest_fills_every_list(spark, recall, leaf_rows):
    rng = np.random.default_rng(8)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(8000, 12)).astype(np.float32))]
    if leaf_rows:  # far single rows have leaves of their own, which hold fewer than k rows
        rows = [(i, (np.array(v) + (1e4 * (1 + i) if i % 40 == 0 else 0)).tolist()) for i, v in rows]
    got = neighbours.nearest(spark.createDataFrame(rows, VECTORS).repartition(3), every=40, recall=recall)
    counts = {r["query_id"]: r["count"] for r in got.groupBy("query_id").count().collect()}
    assert counts == {i: 10 for i in range(0, 8000, 40)}


def test_nearest_prunes_clustered_vectors(spark):
    """Well below half of the rows are compared, and nine in ten neighbours are found among all rows."""
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(200, 16)) * 4
    x = (centre[rng.integers(200, size=50_000)] + rng.normal(size=(50_000, 16))).astype(np.float32).astype(np.float64)
    rows = spark.createDataFrame(pa.table({"vec_id": pa.array(np.arange(len(x))), "embedding": pa.array(list(x.astype(np.float32)), pa.list_(pa.float32()))})).repartition(4)
    got = neighbours.nearest(rows, every=500).toArrow()
    q = np.arange(0, 50_000, 500)
    d = neighbours.distances(x[q], x)
    d[np.arange(len(q)), q] = np.inf
    near = np.argsort(d, 1)[:, :10]
    mine = set(zip(got["query_id"].to_pylist(), got["vec_id"].to_pylist(), strict=True))
    assert len(mine) == 1000 and sum((a, b) in mine for a, own in zip(q.tolist(), near.tolist(), strict=True) for b in own) >= 900
    dim, tree, ids, sample = neighbours.fit_tree(neighbours.clean(rows, "vec_id", "embedding"), k=10, sample=8192, recall=0.98)
    size = np.bincount(tree.assign(x), minlength=tree.leaves)
    held = np.bincount(tree.assign(sample), minlength=tree.leaves)
    visited = np.mean([size[tree.visit(v, tree.visits, held, 11)].sum() for v in x[q]]) / len(x)
    assert tree.leaves > 100 and visited < 0.25


def test_repeated_queries_count_once(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=6).astype(np.float32).tolist()) for i in range(400)]
    rows += [rows[0], rows[0], rows[7]]
    df = spark.createDataFrame(rows, VECTORS)
    for got, k in ((neighbours.nearest(df), 10), (topk.exact_top_k(df, every=100), 5)):
        own = got.where("query_id = 0").collect()
        assert len(own) == k and sorted(r["rank"] for r in own) == list(range(1, k + 1))
        assert len({r["vec_id"] for r in own} - {7}) >= k - 2  # only the repeated candidate can stand twice


def test_nearest_splits_a_hot_leaf(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "PART", 50)
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=4) * (1e-3 if i % 2 else 1)).astype(np.float32).tolist()) for i in range(1200)]
    got = neighbours.nearest(spark.createDataFrame(rows, VECTORS).repartition(3), every=2, recall=1.0).collect()
    x = {i: np.array(v, np.float64) for i, v in rows}
    found = 0
    for i in range(0, 1200, 60):
        near = sorted((float(((x[i] - v) ** 2).sum()), j) for j, v in x.items() if j != i)[:10]
        mine = {r["vec_id"] for r in got if r["query_id"] == i}
        assert len(mine) == 10
        found += len(mine & {j for _, j in near})
    assert found >= 190


def test_nearest_of_nothing(spark):
    assert neighbours.nearest(spark.createDataFrame([], VECTORS)).count() == 0


def test_tree_visits_every_leaf_once():
    x = np.random.default_rng(0).normal(size=(500, 8))
    tree = neighbours.Tree.fit(x, 20, 4, 0)
    walk = tree.visit(x[0], tree.leaves)
    assert tree.leaves > 1 and sorted(walk) == list(range(tree.leaves)) and walk[0] == tree.assign(x[:1])[0]


@pytest.mark.parametrize("least", [0, 4])
def test_warc(spark, tmp_path, least):
    rng = random.Random(1)
    bodies = ["<p>é</p>", "", "<b>same</b>" * 50, "x"]
    rows = [(i, f"http://h/{i}\r\n", rng.choice(bodies) + (str(i) if i % 3 == 0 else "")) for i in range(60)]
    rows += [(61, None, None), (62, "u", None), (7, "again", "twice"), (7, "again", "twice"), (None, "n", "<b>same</b>" * 50), (None, "n", "alone")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).repartition(3)
    warc.write_archive(df, f"{tmp_path}/a", min_payload=least)
    records = warc.read_archive(spark, f"{tmp_path}/a", with_revisits=least == 0)
    first = {}
    for i, _, h in rows:
        b = (h or "").encode()
        first[b] = min((x for x in (first.get(b), i) if x is not None), default=None)
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        again = len(b) >= least and i != first[b]
        want.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", first[b] if again else None))
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, warc.summary(spark, f"{tmp_path}/a").collect()), key=key) == sorted(want, key=key)
    assert spark.read.parquet(f"{tmp_path}/a/payloads").count() == len({(h or "").encode() for _, _, h in rows})
    for r in records.collect():
        head, body = bytes(r["record"]).split(b"\r\n\r\n", 1)
        size = int(head.split(b"Content-Length: ")[1].split(b"\r\n")[0])
        assert head.startswith(b"WARC/1.1\r\n") and body[size:] == b"\r\n\r\n"
        assert b"revisit" in head or body[:size] == bytes(r["payload"])
        assert (r["payload"] is None) == (b"revisit" in head and least > 0)
        assert r["payload"] is None or r["payload_bytes"] == len(r["payload"]) and base64.b32encode(hashlib.sha1(r["payload"]).digest()).decode() == r["sha1"]


def test_warc_of_nothing_and_damage(spark, tmp_path):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_archive(empty, f"{tmp_path}/e")
    assert warc.summary(spark, f"{tmp_path}/e").count() == 0
    warc.write_archive(spark.createDataFrame([(1, "u", "body")], empty.schema), f"{tmp_path}/d")
    bad = spark.read.parquet(f"{tmp_path}/d/payloads").withColumn("payload", F.lit(b"other"))
    bad.write.parquet(f"{tmp_path}/d2/payloads")
    spark.read.parquet(f"{tmp_path}/d/headers").write.parquet(f"{tmp_path}/d2/headers")
    with pytest.raises(Exception, match="damaged"):
        warc.read_archive(spark, f"{tmp_path}/d2").collect()
    spark.read.parquet(f"{tmp_path}/d/headers").write.parquet(f"{tmp_path}/d3/headers")
    spark.read.parquet(f"{tmp_path}/d/payloads").limit(0).write.parquet(f"{tmp_path}/d3/payloads")
    with pytest.raises(Exception, match="missing"):
        warc.summary(spark, f"{tmp_path}/d3").collect()


def test_pipeline(spark, tmp_path):
    import corpus_pipeline
    from tests.llm.test_text_operators import DOCS, corpus

    docs, labels = corpus(300, 4)
    passage = " ".join(f"shared{i}" for i in range(60))
    docs = [(i, t + (" " + passage if i % 10 == 0 else ""), *rest) for i, t, *rest in docs]
    docs += [(1000 + i, docs[i][1], *docs[i][2:]) for i in range(0, 60)] + [(2000, None, None, None, None), (2001, "", "en", "s1", 0)]
    spark.createDataFrame(docs, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept, frames = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (_, f) in enumerate(corpus_pipeline.STAGES):
        f(spark, kept, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        kept = spark.read.parquet(f"{tmp_path}/{k}")
        frames.append(kept)
        if k < 4:
            assert kept.columns == corpus_pipeline.COLUMNS
    bad = {i for i, q, t in labels if q == 0 or t == 1}
    first = {r["doc_id"] for r in frames[0].select("doc_id").collect()}
    assert len(first & bad) <= 0.05 * len(bad) and len(first - bad) >= 0.95 * (len(docs) - len(bad) - len([i for i in range(60) if i in bad]))
    second = {r["doc_id"] for r in frames[1].select("doc_id").collect()}
    assert not any(i in second and i + 1000 in second for i in range(60))
    third = frames[2].collect()
    assert {r["doc_id"] for r in third} == second and not any("shared10 shared11 shared12" in (r["text"] or "") for r in third)
    ids = {r["doc_id"]: r["text"] for r in frames[3].collect()}
    assert all(r["text"] == (ids[r["doc_id"]] or "") and len(r["ids"]) == r["n_tokens"] for r in frames[4].collect())
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == frames[4].count()


def test_pipeline_of_odd_tables(spark, tmp_path):
    import corpus_pipeline
    from tests.llm.test_text_operators import DOCS

    labels = "doc_id long, quality int, toxic int"
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/e/documents.parquet")
    spark.createDataFrame([], labels).write.parquet(f"{tmp_path}/e/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/e").count() == 0
    rows = [(None, None, None, None, None), (None, "a b c", None, None, None), (None, "d e f", "en", None, 5), (3, "", "en", "s", 0), (3, "x " * 30_000, None, "s", None), (4, "one", "de", "s", 3)]
    odd = spark.createDataFrame([(*r, 1, "l") for r in rows], DOCS + ", size int, label string")
    odd.write.parquet(f"{tmp_path}/o/documents.parquet")
    spark.createDataFrame([(None, 0, 0), (4, None, 1)], labels).write.parquet(f"{tmp_path}/o/labels.parquet")
    out = corpus_pipeline.run(spark, f"{tmp_path}/o")
    assert out.columns == ["doc_id", "n_tokens", "ids", "text"] and {r["text"] for r in out.collect()} <= {"", "a b c", "d e f", "one"} | {r["text"] for r in out.where("doc_id = 3").collect()}


def test_near_dedup_keeps_one_row_of_a_class(spark):
    import corpus_pipeline
    from tests.llm.test_text_operators import DOCS

    text = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    row = lambda i, t: (i, t, "en", "s1", len(t or ""))
    docs = [row(5, text(0))] * 3 + [row(7, text(1))]  # repeated rows
    docs += [row(None, text(2))] * 2 + [row(None, text(3)), row(3, text(3))]  # null ids, repeated, alone and copied
    docs += [row(9, text(4)), row(9, text(5)), row(9, text(5)), row(8, text(5))]  # one id, two documents
    docs += [row(11, text(6)), row(10, text(6) + " more")] + [row(12, "")] * 2 + [row(None, None), row(13, None)]
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(docs, DOCS).repartition(5), "")
    want = [(5, text(0)), (7, text(1)), (None, text(2)), (None, text(3)), (9, text(4)), (8, text(5)), (10, text(6) + " more"), (12, ""), (None, None), (13, None)]
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in got.collect()))) == sorted(map(str, want))
    # the next stage takes no text from a document whose row stood twice
    out = corpus_pipeline.substring_dedup(spark, got, "")
    assert {r["text"] for r in out.where("doc_id in (5, 7)").collect()} == {text(0), text(1)}


def test_pipeline_mixing_cuts_no_document(spark):
    import corpus_pipeline
    from bandloom.llm import mixing
    from tests.llm.test_text_operators import DOCS

    rng = random.Random(9)
    docs = [(i, "\n".join(f"w{i}x{j}" for j in range(rng.choice([3, 40, 500]))), "en", rng.choice("abc"), 0) for i in range(90)]
    df = spark.createDataFrame(docs, DOCS)
    got, texts = corpus_pipeline.source_mixing(spark, df, "").collect(), {i: t for i, t, *_ in docs}
    assert all(r["text"] == texts[r["doc_id"]] and r["n_chars"] == len(r["text"]) for r in got)
    for source, goal in {(r["source"], r["target"]) for r in mixing.mix(df).collect()}:
        assert abs(sum(len(r["text"].split()) for r in got if r["source"] == source) - goal) <= 251


def test_queries_are_registered():
    from bandloom.llm.queries import ORACLE, QUERIES

    assert [sum(q.startswith(f"op{n}_") for q in QUERIES) for n in range(1, 11)] == [1] * 10 and set(ORACLE) <= set(QUERIES)
