"""Findings of the third round: what failed or differed on odd and larger tables."""

from __future__ import annotations

import hashlib
import random

import duckdb
import numpy as np

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.llm import compact_windows
from tessera.operators import graph, graph_models, mining, mining_blocks, offsets, scope
from tessera.plans import evaluation, models, structure
from tessera.sources import storage
from tessera.sources.storage import settled
from tessera.streaming import build
from tests.test_oracles import plain


def same(spark, folder, query, sql, **tables):
    """Whether a query gives the rows of its SQL on the tables given (DataFrames)."""
    con = duckdb.connect()
    for name, d in tables.items():
        d.coalesce(2).write.parquet(f"{folder}/{name}.parquet")
        con.execute(f"create view {name} as select * from '{folder}/{name}.parquet/*.parquet'")
    got, want = (plain(d.astype(object).where(d.notna(), None)) for d in (query(spark, str(folder)).toPandas(), con.execute(sql).df()))
    assert got == want
    return got


_ODD = ["returné", "²for", "do中", "xfor", "for_", "(for)", "WİDTH", "İf x", "breaK", "freé", "plain"]


def test_categories_end_words_as_the_sql_does(spark):
    d = spark.createDataFrame([(x,) for x in _ODD], "line string")
    got = {r.line: r.c for r in d.select("line", T.code_category(d.line).alias("c")).collect()}
    assert got == dict(duckdb.connect().execute(f"select line, {structure._CATEGORY} from (select unnest({_ODD}) as line)").fetchall())
    assert got["returné"] == "exit" and got["xfor"] == "other" and got["İf x"] == "control"


def test_code_category_on_odd_pages(spark, tmp_path):
    pages = spark.createDataFrame([(k, "u", "\n".join(_ODD[k:])) for k in range(len(_ODD))] + [(99, "u", None)], "page_id long, url string, html string")
    same(spark, tmp_path, structure.code_category, structure.ORACLES["code_category"], pages=pages)


def _attention_of_odd_pages(spark):
    pages = spark.createDataFrame([(k, "u", "\n".join(_ODD[k:] + _ODD[:k])) for k in range(len(_ODD))], "page_id long, url string, html string")
    events = spark.createDataFrame([(k, k % 13, 100.0 + k % 400) for k in range(600)], "event_id long, user_id long, value double")
    return {"pages": pages, "events": events}


def test_evidence_shares_on_odd_pages(spark, tmp_path):
    same(spark, tmp_path, structure.evidence_shares, structure.ORACLES["evidence_shares"], **_attention_of_odd_pages(spark))


def test_outcome_shares_on_odd_pages(spark, tmp_path):
    same(spark, tmp_path, structure.outcome_shares, structure.ORACLES["outcome_shares"], **_attention_of_odd_pages(spark))


def _attention_of_halves():
    """640 users with one line each: 333 of control, the rest other."""
    events = [(40 * k + 1, k, 100.0) for k in range(640)]
    return events, [(k, "u", "if (x)" if k < 333 else "plain") for k in range(640)]


def test_shares_round_as_the_sql_does(spark, tmp_path):
    events, pages = _attention_of_halves()
    tables = {"pages": spark.createDataFrame(pages, "page_id long, url string, html string"), "events": spark.createDataFrame(events, "event_id long, user_id long, value double")}
    got = same(spark, tmp_path, structure.evidence_shares, structure.ORACLES["evidence_shares"], **tables)
    assert ("control", 333, 0.520312) in got


def test_outcome_shares_round_as_the_sql_does(spark, tmp_path):
    events, pages = _attention_of_halves()
    events, pages = [(e, 2 * u, v) for e, u, v in events], [(2 * k, u, h) for k, u, h in pages]  # one outcome
    tables = {"pages": spark.createDataFrame(pages, "page_id long, url string, html string"), "events": spark.createDataFrame(events, "event_id long, user_id long, value double")}
    got = same(spark, tmp_path, structure.outcome_shares, structure.ORACLES["outcome_shares"], **tables)
    assert ("control", 333, "TN", 0.520312) in got


def test_evidence_keeps_null_and_negative_lines_as_the_sql_does(spark, tmp_path):
    pages = spark.createDataFrame([(k, "u", "if (x)\nbuf") for k in range(6)], "page_id long, url string, html string")
    rows = [(None if k % 7 == 0 else -k if k % 3 == 0 else k, None if k % 11 == 0 else k % 6, None if k % 13 == 0 else 100.0 + k % 5) for k in range(300)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, value double")
    same(spark, tmp_path, structure.evidence_shares, structure.ORACLES["evidence_shares"], pages=pages, events=events)


def test_strict_split_takes_the_least_label_of_a_mixed_group(spark, tmp_path):
    texts = [None if k % 10 == 0 else "" if k % 10 == 1 else f"text {k // 3}" for k in range(120)]
    documents = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(k, None if k % 17 == 0 else k % 2) for k in range(120)], "doc_id long, quality int")
    same(spark, tmp_path, evaluation.strict_split_summary, evaluation.ORACLES["strict_split_summary"], documents=documents, labels=labels)


def _small_graphs(spark):
    nodes = spark.createDataFrame([(f"s{g}", n, "METHOD" if n == "1" else "CALL") for g in range(3) for n in ("1", "2", "10", "-3", "9" * 25, "x", "1.5", "007")], "sample_id string, node_id string, label string")
    ends = [("1", "2", "AST"), ("2", "10", "CFG"), ("2", "10", "CFG"), ("10", "-3", "CDG"), ("x", "9" * 25, "REACHING_DEF"), ("2", "gone", "CFG"), ("1.5", "007", "OTHER")]
    return nodes, spark.createDataFrame([(f"s{g}", a, b, r) for g in range(2) for a, b, r in ends], "sample_id string, src string, dst string, label string")


def test_node_order_is_by_value(spark):
    ids = ["x", "10", "-3", "2", "1.5", "007", "9" * 25, "-" + "9" * 25, "7", "", "a1"]
    d = spark.createDataFrame([(x,) for x in ids], "node_id string")
    by_value = [F.expr("try_cast(node_id as decimal(38, 0))").isNull(), F.expr("try_cast(node_id as decimal(38, 0))"), "node_id"]
    assert d.orderBy(*graph.node_order()).collect() == d.orderBy(*by_value).collect()


def test_edges_meet_their_ends_once_for_all_views(spark):
    nodes, edges = _small_graphs(spark)
    roots, rows = nodes.where("label = 'METHOD'"), lambda d: sorted(map(tuple, d.collect()))
    inner, typed = graph.inner_edges(edges, nodes), graph.view_edges(edges, nodes)
    assert inner.count() == 2 * 5 and typed.count() == 2 * (1 * 3 + 2 * 4 + 1 * 4 + 1 * 4)
    places, of_views = graph.view_places(inner, nodes, roots), graph.view_nodes(typed, nodes, roots)
    assert rows(graph.places_in_views(places)) == rows(of_views)
    kept = of_views.where("view <> 'slice-cpg'")
    assert rows(graph.model_edges(inner, places)) == rows(graph.model_edges(typed, kept))
    assert rows(graph.edge_histogram(inner)) == rows(graph.edge_histogram(typed))
    plan = graph.edge_histogram(settled(inner))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1  # of a row a sample, not of edges by view


def test_a_built_batch_leaves_no_tables_in_between(spark, tmp_path):
    graphs = spark.createDataFrame([("a", 1, [("1", "METHOD", "m"), ("2", "CALL", "c")], [(1, "1", "2", "AST")])], build.GRAPHS)
    before = len(storage._WRITTEN)
    build.build_batch(graphs, 0, str(tmp_path))
    assert len(storage._WRITTEN) == before
    assert {(r.view, r.nodes, r.edges) for r in build.built(spark, str(tmp_path), "index").collect()} == {("ast", 2, 1), ("core-cpg", 2, 1), ("dataflow-cpg", 2, 0), ("cfg", 1, 0), ("pdg", 1, 0)}


def test_banks_of_vectors_are_counted_before_they_are_rows(spark, tmp_path):
    rng = random.Random(3)
    rows = [(k, k % 10, [rng.uniform(-1, 1) for _ in range(64)]) for k in range(300)]
    rows += [(300 + k, k % 10, rows[k][2]) for k in range(40)] + [(400 + k, k % 10, [0.0] * 64) for k in range(20)]  # equal scores, zero vectors
    embeddings = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").coalesce(2)
    embeddings.write.parquet(f"{tmp_path}/embeddings.parquet")
    sides = evaluation.retrieval(spark, str(tmp_path), 1), evaluation.retrieval(spark, str(tmp_path), 0)
    pairs = mining.scored_pairs(*sides, 0.25, blocks=3)
    for query, found in ((evaluation.hard_negative_bank, mining.hard_negative_bank(pairs, 3)), (evaluation.review_queue, mining.review_queue(pairs))):
        d = query(spark, str(tmp_path))
        names = ["positive_id", "negative_id", "rank", "pair_score"]
        assert sorted(map(tuple, d.select(names).collect())) == sorted(map(tuple, found.select(names).collect()))
        assert "count(1) windowspecdefinition" not in d._jdf.queryExecution().optimizedPlan().toString()  # no window over all pairs of a positive


def test_symbols_of_all_kinds_take_one_shuffle(spark):
    attrs = [("METHOD_PARAMETER_IN", "len", "1"), ("LOCAL", "buf", "2"), ("LOCAL", "buf", "1"), ("LOCAL", "a", "2"), ("CALL", "memcpy", "3"), ("CALL", "do_it", "4"), ("CALL", "do_it", None), ("OTHER", "no", "1")]
    rows = [("s", str(k), label, {"NAME": name, "TYPE_FULL_NAME": "Node * Edge" if k == 1 else "", **({"LINE_NUMBER": line} if line else {})}) for k, (label, name, line) in enumerate(attrs)]
    nodes = settled(spark.createDataFrame(rows, "sample_id string, node_id string, label string, attrs map<string,string>"))
    found = scope.scope_symbols(nodes, "full-anon")
    want = [("a", "VAR_2", 2), ("buf", "VAR_1", 2), ("do_it", "FUNC_1", 6), ("Edge", "TYPE_2", 4), ("len", "PARAM_1", 1), ("Node", "TYPE_1", 4)]
    assert sorted(tuple(r)[1:] for r in found.where("priority <> 5").collect()) == sorted(want)
    shuffles = lambda d: d._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    assert shuffles(found) == 1
    codes = settled(spark.createDataFrame([("s", "1", "do_it(buf, len)"), ("s", "2", None), ("t", "1", "buf"), (None, "1", "buf")], "sample_id string, node_id string, code string"))
    d = scope.normalized_codes(codes, settled(found), "full-anon")
    assert shuffles(d) <= 2  # of symbols and codes, not of tokens
    unknown = "UNKNOWN_ID_" + hashlib.sha256(b"buf").hexdigest()[:8]
    assert {(r.sample_id, r.node_id): r.text for r in d.collect()} == {("s", "1"): "FUNC_1 ( VAR_1 , PARAM_1 )", ("s", "2"): "", ("t", "1"): unknown, (None, "1"): unknown}


def test_chunks_of_texts_are_those_of_their_tokens(spark):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = [(0, None), (1, ""), (2, "one"), (3, "a b c d\ne f g h"), (4, "a b c\nd e\n\nf g h i é 中"), (5, " ".join(str(k) for k in range(90))), (5, "short one\nhere it is"), (5, None), (6, "two rows"), (6, "two rows"), (7, "x \ud83d y\n" * 40)]
    texts = [(k, t.encode("utf-8", "ignore").decode() if t else t) for k, t in texts]
    texts += [(10 + n, " ".join(["word"] * n)) for n in range(1, 30)] + [(None, "no id\nat all " * 5)]
    d = settled(spark.createDataFrame(texts, "id long, text string"))
    for size, overlap in ((8, 4), (5, 0), (7, 6), (512, 256)):
        got, want = offsets.text_chunks(d, path, size, overlap), offsets.chunk_lines(offsets.token_spans(d, path), size, overlap)
        assert got.dtypes == want.dtypes
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_chunk_evidence_shuffles_windows_not_tokens(spark, tmp_path):
    spark.createDataFrame([(1, "a b c " * 500)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    d = models.chunk_evidence(spark, str(tmp_path))
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan and d.count() == 5


def test_messages_of_all_relations_are_one_sum(spark):
    states = settled(spark.createDataFrame([("s", "1", [1.0, 2.0]), ("s", "2", [3.0, 4.0]), ("s", "3", [5.0, 6.0]), ("t", "1", [7.0, 8.0])], "sample_id string, node_id string, state array<double>"))
    edges = settled(spark.createDataFrame([("s", "1", "3", 0), ("s", "2", "3", 0), ("s", "2", "3", 0), ("s", "2", "3", 1), ("s", "3", "1", 1), ("s", "1", "gone", 0)], "sample_id string, src string, dst string, edge_type int"))
    d = graph_models._with_relations(states, graph_models._weighed(edges), [np.eye(2), 10 * np.eye(2)], 2)
    got = {(r.sample_id, r.node_id): (list(r.state), list(r.got)) for r in d.collect()}
    assert set(got) == {("s", "1"), ("s", "2"), ("s", "3"), ("t", "1")}
    assert got["t", "1"] == ([7.0, 8.0], [0.0, 0.0]) and got["s", "2"][1] == [0.0, 0.0] and got["s", "1"] == ([1.0, 2.0], [50.0, 60.0])
    assert got["s", "3"][0] == [5.0, 6.0] and np.allclose(got["s", "3"][1], [7 / 3 + 30, 10 / 3 + 40])
    assert d._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1  # of edges and states alone


def test_a_passage_of_many_documents_stays_in_the_smallest_id_alone(spark):
    """In a group of more than SMALL texts, too, each is held against the smallest id, also where copies of a text come first."""
    rng = random.Random(5)
    words = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    passage = words(70)
    rows = [(k, " ".join(words(60) + passage + words(60))) for k in range(60)] + [(100 + k, " ".join(words(80))) for k in range(5)]
    rows += [(200, rows[0][1]), (201, rows[7][1]), (None, rows[9][1]), (None, " ".join(words(40) + passage))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    left = [r for r in compact_windows.passage_dedup(docs).collect() if set(passage[8:-8]) & set(r.text.split())]
    assert [r.doc_id for r in left] == [0]
    found = compact_windows.passage_query(docs).collect()
    assert {r.doc_id for r in found if r.other_id == 0} >= {*range(1, 60), None} and {r.component_id for r in found if r.doc_id is not None} == {0}
    both = compact_windows.passage_query(docs, both_sides=True)
    assert both.dtypes == compact_windows.passage_query(docs).dtypes
    rows = [(r.doc_id, r.start_word, r.other_id, r.other_start_word) for r in both.collect()]
    assert {0, *range(1, 60), 200, 201, None} == {r[0] for r in rows} and {(c, d, a, b) for a, b, c, d in rows} == set(rows)


def test_equal_rows_are_scored_once(spark):
    """Copies of a few rows under shifted ids: the rows of all pairs, and only kinds of rows are scored."""
    r = random.Random(5)
    kinds = [([float(r.random() < 0.5) for _ in range(4)], [float(r.randrange(3)) for _ in range(2)], [float(r.randrange(2))], r.choice([None, 0.25, 0.5])) for _ in range(30)]
    side = lambda first, n: spark.createDataFrame([(first + k, *r.choice(kinds)) for k in range(n)], "id long, motif array<double>, structure array<double>, scale array<double>, fp double")
    p, n = side(0, 120), side(1000, 900)
    columns = ["positive_id", "negative_id", "rank", "pair_score"]
    for least, most, share in ((0.2, 3, (0.05, 0.3)), (0.0, 1 << 40, (0.0, 0.2)), (0.3, 70, (0.3, 0.9))):
        bank, plan = mining_blocks.mined_bank(p, n, least, most, share, block=8)
        want = mining.hard_negative_bank(mining.scored_pairs(p, n, least), most, share)
        got = [tuple(x) for x in bank.select(*columns).collect()]
        assert len(got) == len(set(got)) and set(got) == {tuple(x) for x in want.select(*columns).collect()}
        assert plan.agg(F.sum(F.col("p_rows") * F.col("n_rows"))).first()[0] <= 2 * 30 * 30


def test_histogram_matrix_counts_labels_in_one_pass(spark):
    """No pivot and no numbering of items where only labels of nodes are counted."""
    plan = structure.histogram_matrix(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "pivot" not in plan and plan.count("row_number()") == 1  # once, for edges
