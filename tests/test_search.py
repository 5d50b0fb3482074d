from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from clausemill.operators import embed, evaluate, knn, search


def vectors(spark, matrix, id_col, scope=None):
    rows = [(i, [float(x) for x in v], None if scope is None else scope[i]) for i, v in enumerate(matrix)]
    frame = spark.createDataFrame(rows, f"{id_col} long, vector array<float>, scope int")
    return frame if scope is not None else frame.drop("scope")


def brute(left, right, scope, k, threshold=None):
    left, right = left.astype(np.float32).astype(float), right.astype(np.float32).astype(float)
    sims = (left / np.linalg.norm(left, axis=1, keepdims=True)) @ (right / np.linalg.norm(right, axis=1, keepdims=True)).T
    out = []
    for i in range(len(left)):
        for s in sorted(set(scope)):
            hits = [(-round(sims[i, j], 4), j) for j in range(len(right)) if scope[j] == s and (threshold is None or sims[i, j] >= threshold)]
            out += [(i, s, j, -n, r + 1) for r, (n, j) in enumerate(sorted(hits)[:k])]
    return sorted(out)


@pytest.mark.parametrize("block_rows", [7, 64, 10_000])
def test_exact_join_equals_brute_force(spark, block_rows):
    rng = np.random.default_rng(3)
    left, right = rng.standard_normal((40, 12)), rng.standard_normal((130, 12))
    right[20:70] = right[20]  # a third of all rows are copies: ties go by id
    scope = [int(x) for x in rng.integers(0, 3, 130)]
    for threshold in (None, 0.3):
        got = knn.knn_join_exact(vectors(spark, left, "left_id"), vectors(spark, right, "right_id", scope), 4, threshold=threshold, block_rows=block_rows)
        assert sorted((r.left_id, r.scope, r.right_id, r.similarity, r.rank) for r in got.collect()) == brute(left, right, scope, 4, threshold)


def test_zero_and_missing_vectors_never_match(spark):
    left = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0])], "left_id long, vector array<float>")
    right = spark.createDataFrame([(1, [0.0, 0.0]), (2, [2.0, 0.0]), (3, None)], "right_id long, vector array<float>")
    assert [(r.left_id, r.right_id, r.similarity) for r in knn.knn_join_exact(left, right, 3).collect()] == [(1, 2, 1.0)]


def test_string_ids_and_self_join(spark):
    rows = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.1]), ("c", [0.0, 1.0])], "id string, vector array<float>")
    got = knn.knn_join_exact(rows.withColumnRenamed("id", "left_id"), rows.withColumnRenamed("id", "right_id"), 1, skip_self=True)
    assert {(r.left_id, r.right_id) for r in got.collect()} == {("a", "b"), ("b", "a"), ("c", "b")}


def test_approx_join_is_a_subset_with_exact_similarities(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((60, 16))
    left, right = base + 0.05 * rng.standard_normal((60, 16)), base
    right[:25] = right[0]  # one bucket holds a third of the rows
    lf, rf = vectors(spark, left, "left_id"), vectors(spark, right, "right_id")
    exact = knn.knn_join_exact(lf, rf, 100, threshold=0.9)
    approx = knn.knn_join_approx(lf, rf, 100, dim=16, threshold=0.9, block_rows=8)
    found = {(r.left_id, r.right_id, r.similarity) for r in approx.collect()}
    wanted = {(r.left_id, r.right_id, r.similarity) for r in exact.collect()}
    assert found <= wanted
    row = knn.recall(approx, exact).first()
    assert row.exact_pairs == len(wanted) and row.found_pairs == len(found) and row.recall > 0.9


def test_request_limits():
    assert search.search_limit(0) == 5 and search.search_limit(None) == 5 and search.search_limit(50) == 50
    for bad in (lambda: search.match_limit(0), lambda: search.search_limit(51), lambda: search.check_threshold(1.1), lambda: search.check_query(" ")):
        with pytest.raises(search.InvalidRequest):
            bad()


def org_tables(spark):
    chunks = spark.createDataFrame(
        [(1, 10, 100, [1.0, 0.0]), (2, 10, 100, [0.8, 0.6]), (3, 20, 200, [1.0, 0.0]), (4, 30, 100, [1.0, 0.0]), (5, 20, 100, [1.0, 0.0])],
        "chunk_id long, document_id long, organization_id long, embedding array<float>",
    )
    documents = spark.createDataFrame(
        [(10, 100, "processed"), (20, 200, "processed"), (30, 100, "uploaded")], "document_id long, organization_id long, status string"
    ).select("*", F.lit("n").alias("document_name"), F.lit("t").alias("document_type"), F.lit("1").alias("version"))
    clauses = spark.createDataFrame([(7, [1.0, 0.0])], "clause_id long, embedding array<float>")
    return clauses, chunks, documents


def test_matching_keeps_tenants_apart(spark):
    clauses, chunks, documents = org_tables(spark)
    got = search.match_clause_to_policy(clauses, chunks, documents)
    assert sorted((r.organization_id, r.chunk_id, r.rank) for r in got.collect()) == [(100, 1, 1), (100, 2, 2), (200, 3, 1)]
    strict = search.match_clause_to_policy(clauses, chunks, documents, similarity_threshold=0.9)
    assert {r.chunk_id for r in strict.collect()} == {1, 3}


def test_list_filter_is_anded_as_coded(spark):
    points = spark.createDataFrame([(1, "A", [1.0, 0.0]), (2, "B", [1.0, 0.1])], "id long, regulator string, vector array<float>")
    both = {"regulator": ["A", "B"]}
    assert search.payload_filter_search(points, [1.0, 0.0], filters=both).count() == 0
    assert search.payload_filter_search(points, [1.0, 0.0], filters=both, mode="any").count() == 2


def test_text_fallback_equals_brute_force(spark):
    texts = [
        "The bank shall retain customer records for five years after the end of the relationship, and more.",
        "the BANK shall retain customer records for five years after the end of the relationship AND more text follows here",
        "xthe bank shally retain", "a_b and 100% of it", "a-b and 100 pct of it", "Yes", "yes or no", "", "tiny", "q", "back\\slash text",
        "foobar bazqux", "foo bar", "%", "été à la plage avec nous",
    ]
    contents = [*texts, "retain customer", "bank shall retain customer records", "o", "ÉTÉ à la", "a_b", "%bar", "ank shall ret", "", "foo", "no such words here at all"]
    clauses = spark.createDataFrame(list(enumerate(texts)), "clause_id long, text string")
    chunks = spark.createDataFrame(list(enumerate(contents)), "chunk_id long, content string")
    want = (
        chunks.join(clauses, F.expr("text ilike concat('%', replace(substring(content, 1, 80), '\\\\', ''), '%')"))
        .groupBy("chunk_id").agg(F.slice(F.array_sort(F.collect_list("clause_id")), 1, 3).alias("ids")).collect()
    )
    expected = {(r.chunk_id, i, n + 1) for r in want for n, i in enumerate(r.ids)}
    got = {(r.chunk_id, r.clause_id, r.rank) for r in search.text_fallback_match(chunks, clauses, top_k=3).collect()}
    assert got == expected and len(got) > 30


def test_embedding(spark):
    rows = spark.createDataFrame([(1, "Keep records, keep them"), (2, ""), (3, None)], "id int, text string")
    got = {r.id: np.array(r.embedding) for r in embed.embed_documents(rows, dim=32).collect()}
    assert np.linalg.norm(got[1]) == pytest.approx(1.0, abs=1e-6)
    assert not got[2].any() and not got[3].any() and len(got[1]) == 32
    asked = spark.createDataFrame([(1, " what "), (2, "  ")], "id int, query string")
    prefixed = embed.embed_query(asked, embedder=lambda c: F.array(F.length(c).cast("float"))).collect()
    assert [(r.id, r.vector) for r in prefixed] == [(1, [float(len(embed.QUERY_PREFIX) + 4)])]


def clause_rows(spark):
    meta = lambda t: {"a": t, "b": None}
    return spark.createDataFrame(
        [
            (1, "1", 10, "s", "t", "one", 2, 2, meta("x"), [1.0, 0.0]),
            (1, "1", 20, "s2", "t2", " two ", 1, 5, meta(None), [0.0, 1.0]),
            (1, "2", 30, "s", "t", " kept as is ", 1, 1, meta("y"), [0.5, 0.5]),
        ],
        "version_id long, clause_number string, seq long, section string, title string, text string, page_number int, page_end int, "
        "metadata struct<a:string,b:string>, embedding array<float>",
    )


def test_merging_clauses_re_embeds_only_merged_ones(spark):
    counted = lambda c: F.array(F.length(c).cast("float"), F.lit(0.0).cast("float"))
    got = {r.clause_number: r for r in embed.dedupe_regulatory_clauses(clause_rows(spark), embedder=counted).collect()}
    one = got["1"]
    assert (one.text, one.page_number, one.page_end, one.section, one.metadata.a) == ("one two", 1, 5, "s", None)
    assert one.embedding == [7.0, 0.0]
    assert (got["2"].text, got["2"].embedding) == (" kept as is ", [0.5, 0.5])


def test_failed_embedding_falls_back_to_the_mean(spark):
    failing = lambda c: F.lit(None).cast("array<float>")
    got = {r.clause_number: r.embedding for r in embed.dedupe_regulatory_clauses(clause_rows(spark), embedder=failing).collect()}
    assert got == {"1": [0.5, 0.5], "2": [0.5, 0.5]}


def test_retrieval_metrics(spark):
    cases = spark.createDataFrame([(1, ["Seven YEARS"]), (2, ["zzz"]), (3, ["x"])], "query_id int, snippets array<string>")
    results = spark.createDataFrame([(1, 1, "other"), (1, 2, "keep seven years"), (2, 1, "abc")], "query_id int, rank int, text string")
    got = {r.query_id: tuple(r)[1:] for r in evaluate.evaluate_cases(results, cases).collect()}
    assert got == {1: (False, True, True, 0.5, "other"), 2: (False, False, False, 0.0, "abc"), 3: (False, False, False, 0.0, "")}
    empty = evaluate.retrieval_summary(evaluate.evaluate_cases(results, cases.limit(0))).first()
    assert tuple(empty) == (0.0, 0.0, 0.0, 0.0)


def test_rank_goes_by_the_unrounded_similarity(spark):
    near = [1.0, 0.0], [1.0, 0.009], [0.0, 1.0]
    rows = spark.createDataFrame([(2, near[0]), (1, near[1]), (3, near[2])], "right_id long, vector array<float>")
    asked = spark.createDataFrame([(9, [1.0, 0.0])], "left_id long, vector array<float>")
    assert [(r.right_id, r.similarity) for r in knn.knn_join_exact(asked, rows, 1).collect()] == [(2, 1.0)]
    catalog = rows.withColumnsRenamed({"right_id": "clause_id", "vector": "embedding"})
    assert [r.clause_id for r in search.search_topk(catalog, [1.0, 0.0], top_k=2).collect()] == [2, 1]


def test_vectors_of_another_dimension_are_left_out(spark):
    rows = spark.createDataFrame(
        [(1, [1.0, 0.0, 0.0, 0.0]), (2, []), (3, [0.0, 1.0, 0.0, 0.0]), (4, [1.0, 1.0, 0.0, 0.0]), (5, None), (6, [1.0])], "id long, vector array<float>"
    )
    right, left = rows.withColumnRenamed("id", "right_id"), rows.withColumnRenamed("id", "left_id")
    got = knn.knn_join_exact(left, right, 1).collect()
    assert sorted((r.left_id, r.right_id, r.similarity) for r in got) == [(1, 1, 1.0), (3, 3, 1.0), (4, 4, 1.0)]
    got = knn.knn_join_approx(left, right, 1, dim=4).collect()
    assert sorted((r.left_id, r.right_id) for r in got) == [(1, 1), (3, 3), (4, 4)]


def test_a_query_meets_its_own_scope_only(spark):
    import random

    rng = random.Random(6)
    vectors = lambda n: [(i, i % 3 and i % 5, [rng.gauss(0, 1) for _ in range(6)]) for i in range(n)]
    left = spark.createDataFrame(vectors(60), "left_id long, scope long, vector array<double>")
    right = spark.createDataFrame(vectors(150), "right_id long, scope long, vector array<double>")
    got = knn.knn_join_scoped(left, right, 4, block_rows=7)
    want = knn.knn_join_exact(left.drop("scope"), right, 4).join(left.select("left_id", "scope"), ["left_id", "scope"], "left_semi")
    key = lambda frame: sorted(tuple(r) for r in frame.select("left_id", "scope", "right_id", "similarity", "rank").collect())
    assert key(got) == key(want) and len(key(got)) == 240


def test_a_block_gives_each_left_row_and_scope_no_more_than_k_rows(spark):
    """However many right rows pass, and however many of them are alike."""
    import pyarrow as pa

    from clausemill.operators.cells import RIGHT_TILE, stream_kernel

    rng = np.random.default_rng(6)
    left, right = rng.standard_normal((300, 8)), rng.standard_normal((3 * RIGHT_TILE, 8))
    right[100 : 2 * RIGHT_TILE] = right[100]
    right[5] = 0.0
    scope = np.sort(rng.integers(0, 3, len(right)))
    schema = pa.schema([("left_id", pa.int64()), ("scope", pa.int32()), ("right_id", pa.int64()), ("similarity", pa.float64())])
    batches = [
        pa.record_batch({
            "block": np.zeros(len(left), np.int32), "side": np.zeros(len(left), np.int32), "scope": pa.nulls(len(left), pa.int32()),
            "left_id": np.arange(len(left)), "left_vector": pa.array(left.tolist()), "right_id": pa.nulls(len(left), pa.int64()),
            "right_vector": pa.nulls(len(left), pa.list_(pa.float64())),
        })
    ]
    for at in range(0, len(right), 5000):
        n = len(right[at : at + 5000])
        batches.append(
            pa.record_batch({
                "block": np.zeros(n, np.int32), "side": np.ones(n, np.int32), "scope": pa.array(scope[at : at + n], pa.int32()),
                "left_id": pa.nulls(n, pa.int64()), "left_vector": pa.nulls(n, pa.list_(pa.float64())),
                "right_id": np.arange(at, at + n), "right_vector": pa.array(right[at : at + n].tolist()),
            })
        )
    got = [r for b in stream_kernel(4, None, schema, True)(iter(batches)) for r in b.to_pylist()]
    assert len(got) == len(left) * 3 * 4
    with np.errstate(invalid="ignore"):
        sims = (left / np.linalg.norm(left, axis=1, keepdims=True)) @ (right / np.linalg.norm(right, axis=1, keepdims=True)).T
    sims[np.arange(len(left)), np.arange(len(left))] = np.nan
    for i in range(0, len(left), 7):
        for s in range(3):
            some = [j for j in np.flatnonzero(scope == s) if not np.isnan(sims[i, j])]
            want = sorted(some, key=lambda j: (-round(sims[i, j], 12), j))[:4]
            assert [r["right_id"] for r in got if r["left_id"] == i and r["scope"] == s] == want
