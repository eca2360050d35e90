"""Queries do the whole job: results against brute force that shares no cut with them."""

import numpy as np
import pytest

from loomgraph.engine import Engine, hashed_embedding
from loomgraph.operators.ranking import linked_references
from loomgraph.plans import catalog

SF_DIR = "/root/testdata/sf0.001"


def best_of(ids, scores, k):
    order = sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:k]
    return [(int(ids[i]), float(scores[i]), r + 1) for r, i in enumerate(order)]


def vector_lists(con, metric, k, kept=lambda i, label: True):
    rows = con.sql("SELECT vec_id, embedding, label FROM embeddings").fetchall()
    use = [r for r in rows if kept(r[0], r[2])]
    x = np.array([r[1] for r in use], dtype=np.float32).astype(np.float64)
    out = {}
    for i, v, _ in rows:
        if i % 50 == 0:
            q = np.array(v, dtype=np.float32).astype(np.float64)
            s = 1 - ((x - q) ** 2).sum(1) if metric == "l2" else x @ q / np.linalg.norm(x, axis=1) / np.linalg.norm(q)
            out[i] = best_of([r[0] for r in use], np.round(s, 9), k)
    return out


@pytest.mark.parametrize("name, metric, kept", [
    ("knn_topk", "cosine", lambda i, label: True),
    ("knn_filtered", "cosine", lambda i, label: label in (1, 3) and i not in (0, 1, 2)),
    ("knn_l2_score", "l2", lambda i, label: True),
])
def test_every_fiftieth_vector_is_asked(spark, con, name, metric, kept):
    want, got = vector_lists(con, metric, 10, kept), {}
    for r in catalog.QUERIES[name](spark, SF_DIR).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append((r.id, r.score, r.rank))
    assert len(want) == 10 and got.keys() == want.keys()
    for q in want:
        assert [(i, k) for i, _, k in got[q]] == [(i, k) for i, _, k in want[q]]
        assert np.allclose([s for _, s, _ in got[q]], [s for _, s, _ in want[q]], atol=2e-9)


def test_hybrid_pairs_every_text_with_every_asked_vector(spark, con):
    vec = vector_lists(con, "cosine", 20)
    fts = {}
    for q, i, r in con.sql(catalog.ORACLES["bm25_search"].replace("rank <= 10", "rank <= 20")).project("qid, id, rank").fetchall():
        fts.setdefault(q, {})[i] = r
    want = set()
    for q in range(5):
        for v in vec:
            score, first = {}, {}
            for place, ranks in ((0, {i: r for i, _, r in vec[v]}), (1, fts.get(q, {}))):
                for i, r in ranks.items():
                    score[i] = score.get(i, 0) + 1 / (60 + r)
                    first.setdefault(i, (place, r))
            order = sorted(score, key=lambda i: (-round(score[i], 12), first[i], i))[:10]
            want |= {(q, v, i, r + 1) for r, i in enumerate(order)}
    assert {(r.qid, r.vid, r.id, r.rank) for r in catalog.QUERIES["rrf_hybrid"](spark, SF_DIR).collect()} == want


def test_every_record_is_resolved_against_all_others(spark, con):
    rows = con.sql("SELECT vec_id, embedding, label FROM embeddings ORDER BY vec_id").fetchall()
    x = np.array([r[1] for r in rows], dtype=np.float32).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(x @ x.T, 9)
    want = {}
    for a, (i, _, label) in enumerate(rows):
        near = [(s[a, b], j) for b, (j, _, other) in enumerate(rows) if other == label and j != i]
        merged = bool(near) and max(near)[0] >= 0.3
        want[i] = (label, max(near)[1] if merged else i, merged)
    assert {r.id: (r.label, r.resolved, r.merged) for r in catalog.QUERIES["resolve_entities"](spark, SF_DIR).collect()} == want


def test_references_by_text_and_vectors_without_the_document_itself(spark):
    docs = spark.createDataFrame([
        ("u", "doc:a", "Alpha", "the kiln manual", "k"), ("u", "doc:b", "Beta", "other words", "k"), ("u", "doc:c", "Gamma", "more words", "k"),
        ("w", "doc:z", "Kiln manual", "kiln manual", "k"), ("w", "doc:y", "Yes", "no words", "k"), ("w", "doc:x", "Xenon", "nothing", "k"),
    ], "universe_id string, id string, title string, text string, kind string")
    records = spark.createDataFrame([("u", "doc:a", [1.0, 0.0]), ("u", "doc:b", [0.9, 0.1]), ("w", "doc:z", [1.0, 0.0])], "universe_id string, id string, v array<double>")
    refs = spark.createDataFrame([("u", "doc:c", "kiln manual", [1.0, 0.0]), ("u", "doc:a", "kiln manual", [1.0, 0.0]), ("u", "doc:b", "absent", [0.0, 1.0])], "universe_id string, document string, ref string, qv array<double>")
    both = round(2 / 61, 12)  # first by the body's words and first by vectors
    got = {(r.document, r.ref): (r.universe_id, r.id, r.score) for r in linked_references(refs, docs, records, 0.0).collect()}
    assert got == {("doc:c", "kiln manual"): ("u", "doc:a", both), ("doc:a", "kiln manual"): ("u", "doc:b", round(1 / 62, 12)), ("doc:b", "absent"): ("u", "doc:a", round(1 / 62, 12))}
    assert [r.document for r in linked_references(refs, docs, records, 0.03).collect()] == ["doc:c"]


def test_references_reach_bodies_and_summaries(spark, con):
    got = catalog.QUERIES["link_references"](spark, SF_DIR).collect()
    assert len({(r.universe_id, r.document, r.ref) for r in got}) == len(got)
    have = {r[0] for r in con.sql("SELECT DISTINCT source_id FROM vector_records WHERE kind = 'doc_summary'").fetchall()}
    assert {r.id in have for r in got} == {True, False} and len({r.score for r in got}) > 1


def test_every_universe_has_its_own_vector_list(spark, tmp_path):
    near, far = hashed_embedding("kiln glaze"), hashed_embedding("kiln")
    rows = [(f"v{u}{i}", "topic", f"{u}{i}", u, "other", "other", near if u == "big" else far, None, None, None, f"{u}{i}", None, 1) for u, n in (("big", 40), ("small", 3)) for i in range(n)]
    schema = "id string, kind string, source_id string, universe_id string, title string, text string, vector array<float>, keywords array<string>, domain string, topics array<string>, graph_node_id string, file_id string, created_at long"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "vector_records.parquet"))
    got = Engine(spark, str(tmp_path)).vector_search("kiln glaze", ["topic"], 4, depth=0).orderBy("rank").collect()
    assert [(r.universe_id, r.id) for r in got] == [("big", "big0"), ("small", "small0"), ("big", "big1"), ("small", "small1")]


def test_pages_of_files_of_any_length(spark, tmp_path):
    rows = [("f", 398_500, 404_001), ("f", 500_000, 502_000), ("g", 0, 2_000), ("g", 1_999, 2_001)]
    spark.createDataFrame(rows, "file_id string, start_offset long, end_offset long").write.parquet(str(tmp_path / "chunks.parquet"))
    got = {(r.file_id, r.start_offset): (r.page_start, r.page_end) for r in catalog.QUERIES["page_range_overlap"](spark, str(tmp_path)).collect()}
    assert got == {("f", 398_500): (200, 203), ("f", 500_000): (251, 251), ("g", 0): (1, 1), ("g", 1_999): (1, 2)}


def test_mentions_of_names_and_aliases_in_texts_and_chunks(spark, tmp_path):
    entities = [("e1", "Acme-Works", ["AW Ltd.", "ab", "acme-works"], "doc:f"), ("e2", "Kiln", None, "doc:g"), ("e3", r"C\E+", [], "doc:g")]
    spark.createDataFrame(entities, "id string, name string, aliases array<string>, document_id string").write.parquet(str(tmp_path / "entities.parquet"))
    spark.createDataFrame([(7, "g", r"kiln, KILN; kilns my_kiln c\e+")], "doc_id long, file_id string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([("k0", "f", "ACME-Works and aw ltd. ab"), ("k1", "f", "kiln")], "id string, file_id string, text string").write.parquet(str(tmp_path / "chunks.parquet"))
    spark.createDataFrame([("r2", "entity", "e2", "Kiln and a kiln"), ("r1", "topic", "e1", "AW Ltd.")], "id string, kind string, source_id string, text string").write.parquet(str(tmp_path / "vector_records.parquet"))
    got = {(r.chunk, r.id, r["count"]) for r in catalog.QUERIES["mention_counts"](spark, str(tmp_path)).collect()}
    assert got == {("7", "e2", 2), ("7", "e3", 1), ("k0", "e1", 2), ("r2", "e2", 2)}
