"""Readers, graphs, anonymisation, folds and small expected values."""

from __future__ import annotations

import json
import math
import os
import random
import shutil
import subprocess
import sys
import time
import tracemalloc
from functools import partial

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import batching, encoding, ensembles, graph, metrics, mining, mining_blocks, offsets, ordering, prep, report, scope, training, windows
from tessera.sources import graphml, sinks, tables
from tessera.streaming import build, ingest

GRAPHML = """<?xml version="1.0"?><graphml xmlns="http://graphml.graphdrawing.org/xmlns">
<key id="k0" for="node" attr.name="labelV" attr.type="string"/><key id="k1" for="node" attr.name="NAME" attr.type="string"/><key id="k2" for="edge" attr.name="labelE" attr.type="string"/>
<graph id="G" edgedefault="directed">
<node id="1"><data key="k0">METHOD</data><data key="k1">first</data><data key="k1">target</data></node>
<node id="2"><data key="k1"></data></node><node id="2"><data key="k0">CALL</data><data key="k1">strcpy</data></node>
<edge source="1" target="2"><data key="k2">AST</data></edge><edge source="2" target="1"/></graph></graphml>"""


def test_graphml(spark, tmp_path):
    (tmp_path / "a.graphml").write_text(GRAPHML)
    nodes, edges = graphml.read_graphml(spark, str(tmp_path))
    assert sorted((r.sample_id, r.node_id, r.label, r.attrs) for r in nodes.collect()) == [("a", "1", "METHOD", {"NAME": "target"}), ("a", "2", "CALL", {"NAME": "strcpy"})]
    assert sorted((r.edge_pos, r.src, r.dst, r.label) for r in edges.collect()) == [(0, "1", "2", "AST"), (1, "2", "1", "UNKNOWN")]


def test_readers(spark, tmp_path):
    (tmp_path / "labels.csv").write_text("sample_id,base_id,label,graphml_path\n s1 ,b, 1,x\ns2,b,0,y\n")
    assert [tuple(r) for r in tables.labels(spark, f"{tmp_path}/labels.csv").collect()] == [("s1", "b", 1, "x"), ("s2", "b", 0, "y")]
    assert tables.exclusions(spark, None).count() == 0
    for k, (name, reason) in enumerate((("b", "late"), ("a", "early"))):
        (tmp_path / "ex").mkdir(exist_ok=True)
        (tmp_path / "ex" / f"{name}.csv").write_text(f"sample_id,reason\ns,{reason}\n" + "".join(f"x{k}{i},r\n" for i in range(50)))
    assert {r.sample_id: r.reason for r in tables.exclusions(spark, f"{tmp_path}/ex").collect()}["s"] == "late"
    (tmp_path / "over.csv").write_text("sample_id,line_offset,notes\ns1,4,n\n")
    (tmp_path / "other.csv").write_text("id,offset,why\ns1,4,n\n")
    assert [tuple(r) for r in tables.override_rows(spark, f"{tmp_path}/over.csv").collect()] == [("s1", "4", "n")]
    with pytest.raises(Exception, match="header"):
        tables.override_rows(spark, f"{tmp_path}/other.csv").collect()
    (tmp_path / "m.jsonl").write_text('{"sample_id":"a","label":1}\n\n')
    assert tables.manifest(spark, f"{tmp_path}/m.jsonl").count() == 1
    (tmp_path / "att.json").write_text(json.dumps({"s": [{"line": 3, "score": 0.5}], "t": []}))
    assert [tuple(r) for r in tables.node_attention(spark, f"{tmp_path}/att.json").collect()] == [("s", 3, 0.5)]
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "x.c").write_bytes(b"int a;\n\xff")
    assert [r.text for r in tables.source_lines(tables.source_texts(spark, f"{tmp_path}/c")).collect()] == ["int a;", "�"]


def test_lexer_and_names(spark):
    row = spark.sql("""select 'if (row_cap<top) q->w += 0x1fU; // c\n "a//b" 1.5e3f /* z */ <operator>.add @' as c, 'inputWidth-row_Cnt' as n""")
    r = row.select(T.lex(row.c).alias("t"), T.semantic_tags(row.n).alias("s"), T.split_identifier(row.n).alias("p"), T.normalize_source(row.c).alias("z")).first()
    assert r.t == ["if", "(", "row_cap", "<", "top", ")", "q", "->", "w", "+=", "0x1fU", ";", '"a//b"', "1.5e3f", "<operator>.add", "@"]
    assert r.p == ["input", "width", "row", "cnt"]
    assert r.s == ["SEM_SRC", "SEM_DIM", "SEM_COUNT"]
    assert r.z.startswith("if(row_cap<top)q->w+=0x1fU;")


def scope_graph(spark):
    rows = [("1", "METHOD", {"NAME": "f"}), ("2", "METHOD_PARAMETER_IN", {"NAME": "output", "LINE_NUMBER": "1", "COLUMN_NUMBER": "1"}), ("3", "METHOD_PARAMETER_IN", {"NAME": "input", "LINE_NUMBER": "1", "COLUMN_NUMBER": "2"}), ("4", "METHOD_PARAMETER_IN", {"NAME": "row_cap", "LINE_NUMBER": "1", "COLUMN_NUMBER": "3"}), ("5", "LOCAL", {"NAME": "end_idx", "LINE_NUMBER": "2"}), ("6", "CALL", {"NAME": "memmove", "LINE_NUMBER": "3"}), ("7", "CALL", {"NAME": "g_malloc", "LINE_NUMBER": "4"}), ("8", "CALL", {"NAME": "fill_payload", "LINE_NUMBER": "5"}), ("9", "LOCAL", {"NAME": "grid", "TYPE_FULL_NAME": "Mesh *", "LINE_NUMBER": "6"})]
    return spark.createDataFrame([("s", *r) for r in rows], "sample_id string, node_id string, label string, attrs map<string, string>")


def test_anonymised_texts(spark):
    symbols = scope.scope_symbols(scope_graph(spark), "semantic-anon")
    codes = spark.createDataFrame([("s", "a", "while (row_cap > end_idx)"), ("s", "b", "memmove(output, input, 77)"), ("s", "c", "g_malloc(fill_payload(grid), \"x\")"), ("s", "d", "Mesh *w")], "sample_id string, node_id string, code string")
    got = {r.node_id: r.text for r in scope.normalized_codes(codes, symbols, "semantic-anon").collect()}
    assert got["a"] == "while ( PARAM_3 SEM_SIZE > VAR_1 SEM_OFFSET SEM_INDEX )"
    assert got["b"] == "memmove API_COPY ( PARAM_1 SEM_DST , PARAM_2 SEM_SRC , NUM )"
    assert got["c"] == "API_ALLOC ( USER_FUNC_1 SEM_BUF ( VAR_2 ) , STR )"
    assert got["d"].startswith("USER_TYPE_1 * UNKNOWN_ID_")
    with pytest.raises(ValueError, match="mode"):
        scope.scope_symbols(scope_graph(spark), "other")


def test_closure_ends_on_cycles(spark):
    e = spark.createDataFrame([("s", "1", "2", "AST"), ("s", "2", "3", "AST"), ("s", "3", "1", "AST"), ("s", "3", "9", "CFG")], "sample_id string, src string, dst string, label string")
    roots = spark.createDataFrame([("s", "1")], "sample_id string, node_id string")
    assert {r.node_id for r in graph.closure(e, roots).collect()} == {"1", "2", "3"}


CALLS = {"open": "file = probe()", "pull": "got = recv(sock, page, 512)", "loop": "retry(got)", "tail": "finish()", "far": "later()"}


def page_slice(spark, calls, extra=()):
    """The slice of a method `fill` whose block holds five calls in a ring of control flow; `got` is read in `loop`, written in `pull`."""
    nodes = [("fill", "METHOD", "fill"), ("body", "BLOCK", ""), ("sock", "IDENTIFIER", "sock"), ("page", "IDENTIFIER", "page"), ("got", "IDENTIFIER", "got"), ("why", "CONTROL_STRUCTURE", "if (got)"), ("lost", "RETURN", "return")]
    nodes += [(k, "CALL", v) for k, v in calls.items()] + list(extra)
    ring = ["open", "pull", "loop", "tail", "far"]
    edges = [("fill", "body", "AST"), ("body", "why", "AST"), ("why", "lost", "AST"), ("pull", "sock", "AST"), ("pull", "page", "AST"), ("loop", "got", "AST")]
    edges += [("body", k, "AST") for k in ring] + [("body", k[0], "AST") for k in extra]
    edges += [(a, b, "CFG") for a, b in zip(ring, ring[1:] + ring[:1])]
    edges += [("pull", "loop", "REACHING_DEF"), ("loop", "tail", "REACHING_DEF"), ("tail", "far", "REACHING_DEF"), ("why", "pull", "CDG")]
    n = spark.createDataFrame([("s", *x) for x in nodes], "sample_id string, node_id string, label string, code string")
    e = spark.createDataFrame([("s", *x, k) for k, x in enumerate(edges)], "sample_id string, src string, dst string, label string, edge_pos int")
    return {r.node_id for r in graph.risk_slice(n, e, n, n.where("node_id = 'fill'")).collect()}


def test_slices(spark):
    # recv is the seed: its flow neighbours (open, loop), two definitions on (loop, tail), what decides it (why), the calls' operands, and the way up
    assert page_slice(spark, CALLS) == {"fill", "body", "why", "open", "pull", "loop", "tail", "sock", "page", "got"}
    quiet = CALLS | {"pull": "got = ask(sock, page)"}
    assert page_slice(spark, quiet) == {"fill", "body"}  # no seed: the method and its block
    assert page_slice(spark, quiet, [("cell", "IDENTIFIER", "rows[n]")]) == {"fill", "body", "cell"}  # a memory access stands in
    assert "cell" not in page_slice(spark, CALLS, [("cell", "IDENTIFIER", "rows[n]")])  # but not beside a risky call


def test_dictionary_goes_on(spark):
    d = spark.createDataFrame([("b", 0), ("a", 1), ("b", 2), ("c", 3)], "text string, pos int")
    first = graph.dictionary(d.where("pos < 2"), ["pos"])
    assert {(r.text_id, r.text) for r in graph.dictionary(d, ["pos"], known=first).collect()} == {(0, "b"), (1, "a"), (2, "c")}


def test_split_sizes(spark):
    # 25 quiet and 35 loud rows: 20 and 28 to train, 2.5 and 3.5 to validation by rounding to even, the rest to test
    rows = spark.createDataFrame([(f"row{i}", int(i >= 25), f"file{i // 5}") for i in range(60)], "sample_id string, label int, source_hash string")
    n = {(r.label, r.part): r["count"] for r in prep.stratified_split(rows).groupBy("label", "part").count().collect()}
    assert n == {(0, "train"): 20, (0, "val"): 2, (0, "test"): 3, (1, "train"): 28, (1, "val"): 4, (1, "test"): 3}
    grouped = prep.grouped_split(rows)
    assert prep.leaking_groups(grouped).count() == 0
    assert {r.source_hash: r["count"] for r in grouped.groupBy("source_hash").count().collect()} == {f"file{k}": 5 for k in range(12)}
    with pytest.raises(Exception, match="several labels"):
        prep.grouped_split(rows.selectExpr("sample_id", "label", "'one' as source_hash")).collect()


def test_source_maps(spark):
    known = spark.createDataFrame([("a", "a.c"), ("b", "b.c")], "sample_id string, source_path string")
    good = spark.createDataFrame([("a", "3", "n")], "sample_id string, line_offset string, notes string")
    m = prep.source_map(known, prep.validated_overrides(good, known), spark.createDataFrame([("a", "p.c")], "sample_id string, prepared_source_path string"))
    assert {(r.sample_id, r.line_offset, r.offset_source, r.mapping_status) for r in m.collect()} == {("a", 3, "override", "ok"), ("b", 0, "default", "missing_prepared_source")}
    for bad in ([("z", "1", "")], [("a", "-1", "")], [("a", "x", "")], [("a", "1", ""), ("a", "2", "")]):
        with pytest.raises(Exception, match="sample_id|line_offset"):
            prep.validated_overrides(spark.createDataFrame(bad, "sample_id string, line_offset string, notes string"), known).collect()


def by_hand(rows):
    """Best thresholds, ROC AUC and average precision of (label, probability) rows, pair by pair and threshold by threshold."""
    at = {}
    for t in {p for _, p in rows}:
        tp, fp = (sum(p >= t and y == label for y, p in rows) for label in (1, 0))
        pos, neg = (sum(y == label for y, _ in rows) for label in (1, 0))
        root = math.sqrt((tp + fp) * pos * neg * (pos + neg - tp - fp))
        at[t] = (2 * tp / (tp + fp + pos), (tp * (neg - fp) - fp * (pos - tp)) / root if root else 0.0, tp, fp)
    ups, downs = ([p for y, p in rows if y == label] for label in (1, 0))
    auc = sum((a > b) + (a == b) / 2 for a in ups for b in downs) / (len(ups) * len(downs)) if ups and downs else None
    steps, ap, before = sorted(at, reverse=True), 0.0, 0
    for t in steps:
        ap += (at[t][2] - before) / max(len(ups), 1) * at[t][2] / (at[t][2] + at[t][3])
        before = at[t][2]
    return *(max((round(at[t][k], 9), t)[::1] for t in at)[1] for k in (0, 1)), auc, ap if ups else None


def test_curves_of_skewed_keys(spark):
    r = random.Random(11)
    rows = [("hot", int(r.random() < 0.3), r.randrange(400) / 400) for _ in range(3000)]
    rows += [(f"cold{k}", int(r.random() < 0.5), r.randrange(9) / 8) for k in range(12) for _ in range(8)] + [("one-sided", 1, 0.25), ("one-sided", 1, 0.75), (None, 0, 0.5), (None, 1, 0.5)]
    d = spark.createDataFrame(rows, "k string, label int, probability double")
    f1, mcc = ({x.k: x.threshold for x in metrics.best_threshold(d, ["k"], m).collect()} for m in ("f1", "mcc"))
    auc, ap = {x.k: x.roc_auc for x in metrics.roc_auc(d, ["k"]).collect()}, {x.k: x.average_precision for x in metrics.average_precision(d, ["k"]).collect()}
    keys = {k for k, _, _ in rows}
    assert set(f1) == set(mcc) == set(auc) == set(ap) == keys
    for key in keys:
        want = by_hand([(y, p) for k, y, p in rows if k == key])
        assert (f1[key], mcc[key]) == want[:2]
        assert auc[key] == (None if want[2] is None else pytest.approx(want[2], abs=1e-6))
        assert ap[key] == (None if want[3] is None else pytest.approx(want[3], abs=1e-6))
    assert metrics.curve(d.limit(0), ["k"]).count() == 0


def test_a_running_sum_is_spread(spark):
    """One key holds all but a few rows; its sums are right and come from many tasks."""
    d = spark.range(20_000).selectExpr("if(id % 1000 = 7, 'cold', if(id = 13, null, 'hot')) as k", "id", "id % 10 as v")
    out = ordering.running(d, ["k"], ["id"], {"so_far": F.col("v"), "count": F.lit(1).cast("long")}).withColumn("task", F.spark_partition_id()).collect()
    sums, n = {}, {}
    for x in sorted(out, key=lambda x: x.id):
        sums[x.k], n[x.k] = sums.get(x.k, 0) + x.v, n.get(x.k, 0) + 1
        assert (x.so_far, x["count"]) == (sums[x.k], n[x.k])
    most, top = ordering.running(d, ["k"], ["id"], {"top": F.when(F.col("v") == 3, F.col("id"))}, largest=True).collect(), {}
    for x in sorted(most, key=lambda x: x.id):
        top[x.k] = x.id if x.v == 3 else top.get(x.k)
        assert x.top == top[x.k]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        spread = ordering.running(d, ["k"], ["id"], {"so_far": F.col("v")}).where("k = 'hot'").select(F.spark_partition_id().alias("task")).distinct()
        assert spread.count() > 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def batches_by_hand(sizes, nodes, edges, skip, rows=None):
    out, batch, n, e, c, shut = [], -1, 0, 0, 0, True
    for a, b in sizes:
        big = a > nodes or b > edges
        if big and skip:
            out.append(None)
            continue
        if shut or big or n + a > nodes or e + b > edges or (rows and c >= rows):
            batch, n, e, c = batch + 1, 0, 0, 0
        n, e, c, shut = n + a, e + b, c + 1, big
        out.append(batch)
    return out


@pytest.mark.parametrize(("skip", "rows", "most"), [(True, None, None), (False, None, None), (False, 3, None), (True, 2, 5)])
def test_batches(spark, skip, rows, most):
    r = random.Random(5)
    groups = {g: [(r.choice([0, 1, 2, 5, 9, 14]), r.choice([0, 3, 7, 31])) for _ in range(n)] for g, n in (("long", 300), ("short", 4), ("one", 1), (None, 17))}
    d = spark.createDataFrame([(g, i, a, b, "kept") for g, v in groups.items() for i, (a, b) in enumerate(v)], "g string, i int, nodes int, edges int, batch string")
    got = {(x.g, x.i): x.batch_id for x in batching.greedy_batches(d.repartition(5), "g", ["i"], 13, 30, skip, rows, most).collect()}
    want = {(g, i): b for g, v in groups.items() for i, b in enumerate(batches_by_hand(v, 13, 30, skip, rows)) if b is not None and (most is None or b < most)}
    assert got == want
    assert {(x.g, x.i) for x in batching.oversized(d, 13, 30).collect()} == {(g, i) for g, v in groups.items() for i, (a, b) in enumerate(v) if a > 13 or b > 30}
    assert batching.greedy_batches(d.limit(0), "g", ["i"], 13, 30).count() == 0


def test_one_group_of_a_million_rows(spark):
    d = spark.range(1_000_000).selectExpr("'all' as g", "id", "cast(1 + id % 7 as int) as nodes", "cast(id * 37 % 11 as int) as edges")
    out = batching.greedy_batches(d, "g", ["id"], 400_000, 500_000)
    want = batches_by_hand([(1 + i % 7, i * 37 % 11) for i in range(1_000_000)], 400_000, 500_000, True)
    counts = {}
    for b in want:
        counts[b] = counts.get(b, 0) + 1
    first = {x.batch_id: (x.n, x.low) for x in out.groupBy("batch_id").agg(F.count("*").alias("n"), F.min("id").alias("low")).collect()}
    assert first == {b: (n, want.index(b)) for b, n in counts.items()} and len(counts) == 11
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert out.select(F.spark_partition_id().alias("task")).distinct().count() > 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_the_end_of_training(spark):
    scores = [0.31, 0.58, 0.57, 0.58, 0.44, 0.97, 0.99]  # two epochs without a better one end it: the seventh and sixth are not seen
    h = spark.createDataFrame(list(enumerate(scores)), "epoch int, m double")
    assert tuple(batching.early_stop(h, "m", 2).first()) == (1, 3, 0.58)
    assert tuple(batching.early_stop(h, "m", 4).first()) == (6, 6, 0.99)


def test_windows(spark):
    d = spark.range(1).selectExpr("transform(sequence(0, 10), x -> cast(x as string)) as t", "transform(sequence(0, 19), x -> cast(x as string)) as u", "cast(array() as array<string>) as e")
    r = d.select(windows.token_windows(d.t, 5, 2).alias("w"), windows.token_windows(d.e, 5, 2).alias("z")).first()
    assert [(w.start, w.tokens[-1]) for w in r.w] == [(0, "4"), (3, "7"), (6, "10")]
    assert r.z == []
    assert [(w.start, w.tokens) for w in d.select(windows.token_windows(d.e, 5, 2, empty=True).alias("w")).first().w] == [(0, [])]
    with pytest.raises(ValueError, match="overlap"):
        windows.token_windows(d.t, 5, 5)


def test_pair_metrics(spark):
    # gaps: x-k 1.25, x-m -0.5, y-k 0.25, y-o 0.0 (no win); of k, m, o two are taken for positive; of five positives two have pairs
    pairs = spark.createDataFrame([("x", "k"), ("x", "m"), ("y", "k"), ("y", "o")], "positive_id string, negative_id string")
    scores = spark.createDataFrame([("x", 1.5, 0.8), ("y", 0.5, 0.6), ("k", 0.25, 0.55), ("m", 2.0, 0.9), ("o", 0.5, 0.45), ("z", 9.0, 1.0)], "id string, logit double, probability double")
    r = mining.pair_metrics(pairs, scores, spark.createDataFrame([(x,) for x in "xyzuv"], "id string")).first()
    assert tuple(r) == (0.5, 0.666667, 0.25, 0.4, 2.0)


def test_reports_and_sinks(spark, tmp_path):
    a = spark.createDataFrame([("s", 3, 0.5), ("s", 3, 0.9), ("s", -1, 9.0), ("s", 4, 0.9), ("s", 5, -1.0)], "sample_id string, line int, score double")
    top = report.line_topk(a, 3)
    assert [(r.line, r.score) for r in top.orderBy("rank").collect()] == [(3, 0.9), (4, 0.9), (5, 0.0)]
    assert "&lt;x" in sinks.heat_map_html([{"line": 1, "text": "<x", "score": 1.0}], "t")
    v = spark.createDataFrame([("s", "ast", "1")], "sample_id string, view string, node_id string")
    sinks.write_views(v, v, f"{tmp_path}/v")
    sinks.write_views(v.selectExpr("sample_id", "'cfg' as view", "node_id"), v, f"{tmp_path}/v")
    assert {r.view for r in spark.read.parquet(f"{tmp_path}/v/nodes").collect()} == {"ast", "cfg"}
    old = spark.createDataFrame([("s", "ast", 1), ("t", "ast", 2)], "sample_id string, view string, nodes int")
    assert {tuple(r) for r in sinks.upserted_index(old, spark.createDataFrame([("s", "cfg", 5)], old.schema)).collect()} == {("t", "ast", 2), ("s", "cfg", 5)}


def test_ingest_resumes(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "1.json").write_text('{"sample_id":"a","label":1,"text":"x // c"}\n')
    run = lambda: ingest.ingest(spark, str(src), f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    run()
    (src / "2.json").write_text('{"sample_id":"a","label":0,"text":"y"}\n{"sample_id":"b","label":0,"text":"z"}\n')
    run()
    run()
    assert {(r.sample_id, r.label, r.n_chars) for r in ingest.latest(spark, f"{tmp_path}/out").collect()} == {("a", 0, 1), ("b", 0, 1)}


def test_normalized_nodes(spark):
    g = spark.createDataFrame([("s", "1", "METHOD", {"NAME": "f", "SIGNATURE": "int (GetBits *)"}), ("s", "2", "BLOCK", {"CODE": "x"}), ("s", "3", "METHOD_RETURN", {"TYPE_FULL_NAME": "GetBits *"}), ("s", "4", "CALL", {"NAME": "free", "CODE": "free(p)"}), ("s", "5", "LOCAL", {"NAME": "p", "TYPE_FULL_NAME": "GetBits *"}), ("s", "6", "RETURN", {})], "sample_id string, node_id string, label string, attrs map<string, string>")
    got = {r.node_id: r.text for r in scope.normalized_nodes(g, scope.scope_symbols(g, "full-anon"), "full-anon").collect()}
    assert got == {"1": "<METHOD int ( TYPE_1 * )>", "2": "<BLOCK>", "3": "<RET TYPE_1 *>", "4": "API_FREE ( VAR_1 )", "5": "VAR_1", "6": "<RETURN>"}
    raw = {r.node_id: r.text for r in scope.normalized_nodes(g, None, "raw").collect()}
    assert (raw["1"], raw["2"], raw["6"]) == ("f int (GetBits *)", "<BLOCK>", "<RETURN>")
    with pytest.raises(ValueError, match="symbols"):
        scope.normalized_nodes(g, None, "full-anon")


def test_seed_types(spark):
    rows = [("f", "call", "CALL", "x", "net.Recvfrom", ""), ("f", "slot", "LOCAL", "", "", "row[7]"), ("g", "slot", "IDENTIFIER", "", "", "cur->next"), ("g", "text", "LITERAL", "", "", "a[1]"), ("g", "call", "CALL", "emit", "", "emit(w)"), ("h", "call", "CALL", "join", "", "join(w)")]
    n = spark.createDataFrame(rows, "sample_id string, node_id string, label string, name string, method_full_name string, code string")
    assert {(r.sample_id, r.node_id): r.seed_type for r in graph.seed_types(n).collect()} == {("f", "call"): 1, ("f", "slot"): 0, ("g", "slot"): 2, ("g", "text"): 0, ("g", "call"): 0, ("h", "call"): 0}


def test_registry_digest_and_rebuilds(spark):
    d = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "text_id long, text string")
    swapped = spark.createDataFrame([(0, "b"), (1, "a"), (2, "c")], "text_id long, text string")
    assert graph.registry_digest(d, 2).first().digest != graph.registry_digest(swapped, 2).first().digest
    samples = spark.createDataFrame([(s, "f") for s in "abcd"], "sample_id string, fingerprint string")
    markers = spark.createDataFrame([("a", "1", "f"), ("b", "1", "old"), ("c", "1", "f")], "sample_id string, commit_id string, fingerprint string")
    index = spark.createDataFrame([(s, "ast", "1") for s in "abc"], "sample_id string, view string, commit_id string")
    payloads = spark.createDataFrame([("a", "ast", "1", 2), ("b", "ast", "1", 2), ("c", "ast", "1", 9)], "sample_id string, view string, commit_id string, max_text_id int")
    assert {r.sample_id for r in graph.incomplete_samples(samples, markers, index, payloads, 1, 3).collect()} == {"b", "c", "d"}


def test_logistic_stack(spark):
    rows = [(f"s{i}", i % 2, [0.2 + 0.5 * (i % 2) + 0.01 * (i % 7), 0.5]) for i in range(40)]
    out = ensembles.logistic_stack(spark.createDataFrame(rows, "sample_id string, label int, probabilities array<double>"), 2, folds=3).withColumn("k", F.lit("x"))
    assert out.count() == 40
    assert metrics.roc_auc(out, ["k"]).first().roc_auc == 1.0


def test_a_label_is_split_by_many_tasks(spark):
    rows = spark.range(2000).select(F.col("id").cast("string").alias("sample_id"), F.when(F.col("id") < 1900, 1).alias("label"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = prep.stratified_split(rows).select("label", "part", F.spark_partition_id().alias("task")).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len({r.task for r in out if r.label == 1}) > 1
    assert [sum(r.label == label and r.part == p for r in out) for label in (1, None) for p in ("train", "val", "test")] == [1520, 190, 190, 80, 10, 10]


def sided(spark, rows):
    return spark.createDataFrame(rows, "id long, motif array<double>, structure array<double>, scale array<double>, fp double")


def test_mining_by_blocks_gives_the_rows_of_all_pairs(spark):
    r = random.Random(8)
    kinds = [[float(r.random() < 0.4) for _ in range(6)] for _ in range(12)] + [[0.0] * 6]
    row = lambda k: (k, r.choice(kinds), [float(r.randrange(4)) for _ in range(3)], [float(r.randrange(3))], r.choice([None, 0.0, 0.25, 0.5, 1.0]))
    p, n = [row(k) for k in range(60)], [row(1000 + k) for k in range(400)]
    p += [(99, None, [1.0] * 3, [0.0], None), (98, [1.0, None] + [0.0] * 4, [1.0] * 3, [0.0], None)]  # no number, no score
    P, N = sided(spark, p), sided(spark, n)
    for least, most, share in ((0.2, 3, (0.05, 0.3)), (0.6, 2, (0.0, 0.1)), (0.0, 5, (0.5, 0.9)), (2.0, 1, (0.05, 0.3))):
        columns = ["positive_id", "negative_id", "rank", "pair_score", "motif_similarity", "structure_similarity", "scale_similarity", "false_positive_probability"]
        want = {tuple(x) for x in mining.hard_negative_bank(mining.scored_pairs(P, N, least), most, share).select(*columns).collect()}
        got = [tuple(x) for x in mining_blocks.mined_bank(P, N, least, most, share, block=16)[0].select(*columns).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert mining_blocks.mined_bank(P.limit(0), N, 0.2, 3)[0].count() == 0
    assert mining_blocks.mined_bank(P, N.limit(0), 0.2, 3)[0].count() == 0


def test_few_pairs_are_scored_where_rows_are_alike(spark):
    """Flags and counts of 40 kinds: under a third of the pairs are scored, counting twice what is scored twice."""
    d = spark.range(6000).selectExpr("id", "id % 40 as kind")
    side = lambda k: d.where(f"id % 3 = {k}").selectExpr("id", "transform(sequence(0, 12), i -> cast(hash(kind, i) & 1 as double)) as motif", "transform(sequence(0, 3), i -> cast(1 + abs(hash(kind, i)) % 9 as double)) as structure", "transform(sequence(0, 5), i -> cast(abs(hash(kind, i)) % 5 as double)) as scale", "id % 10 / 10D as fp")
    bank, plan = mining_blocks.mined_bank(side(0), side(1), 0.5, 3, block=50)
    want = mining.hard_negative_bank(mining.scored_pairs(side(0), side(1), 0.5), 3)
    columns = ["positive_id", "negative_id", "rank", "pair_score"]
    assert {tuple(x) for x in bank.select(*columns).collect()} == {tuple(x) for x in want.select(*columns).collect()}
    assert plan.agg(F.sum(F.col("p_rows") * F.col("n_rows"))).first()[0] < 2000 * 2000 / 3


def numeric_gradient(loss, p):
    out = np.zeros_like(p)
    for k in range(len(p)):
        step = np.zeros_like(p)
        step[k] = 1e-6
        out[k] = (loss(p + step) - loss(p - step)) / 2e-6
    return out


def plain_training(plan, rows, pairs, epochs):
    """(losses, parameters) after each epoch: the loss written out row by row, its gradient by differences, and the optimiser's formulas."""
    features = {i: np.array(x, float) for i, _, x in rows}

    def risk(p, x):
        at, layers = 0, list(zip(plan.widths, plan.widths[1:]))
        for k, (a, b) in enumerate(layers):
            w, c = p[at : at + a * b].reshape(a, b), p[at + a * b : at + a * b + b]
            at += a * b + b
            x = [sum(x[i] * w[i, j] for i in range(a)) + c[j] for j in range(b)]
            x = [max(v, 0.0) for v in x] if k + 1 < len(layers) else x
        return x[1] - x[0]

    p = training.initial(plan)
    m, v, out = np.zeros_like(p), np.zeros_like(p), []
    for e in range(epochs):
        rank = training.rank_weight(plan, e)

        def loss(p):
            main = weight = 0.0
            for i, y, _ in rows:
                w = plan.class_weight[y]
                main, weight = main + w * math.log(1 + math.exp(-risk(p, features[i]) if y else risk(p, features[i]))), weight + w
            replay = [0.5 * (math.log(1 + math.exp(-risk(p, features[a]))) + math.log(1 + math.exp(risk(p, features[b])))) for a, b in pairs]
            order = [math.log(1 + math.exp(plan.margin - risk(p, features[a]) + risk(p, features[b]))) for a, b in pairs]  # noqa: B023
            return main / weight + (plan.lambda_replay * sum(replay) + rank * sum(order)) / len(pairs)  # noqa: B023

        before, g = loss(p), numeric_gradient(loss, p)
        g *= min(1.0, plan.clip / (np.linalg.norm(g) + 1e-6))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p * (1 - plan.learning_rate * plan.weight_decay) - plan.learning_rate * (m / (1 - 0.9 ** (e + 1))) / (np.sqrt(v / (1 - 0.999 ** (e + 1))) + 1e-8)
        out.append((before, p))
    return out


@pytest.mark.parametrize("widths", [(3, 2), (3, 4, 2)])
def test_training_is_the_plain_loop_and_goes_on_after_a_kill(spark, tmp_path, widths):
    r = random.Random(3)
    rows = [(f"r{k}", k % 3 == 0, [r.uniform(-1, 1) + (k % 3 == 0) for _ in range(3)]) for k in range(30)]
    rows = [(i, int(y), x) for i, y, x in rows]
    pairs = [("r0", "r1"), ("r3", "r2"), ("r3", "r4"), ("r9", "r10")]
    plan = training.Plan(widths, epochs=5, learning_rate=0.03, clip=0.4, class_weight=(0.7, 1.9), lambda_replay=0.5, lambda_rank=0.4, rank_warmup=1, rank_ramp=3)
    odd = [("none", None, [1.0] * 3), ("short", 1, [1.0]), ("hole", 0, [1.0, None, 2.0]), ("other", 7, [0.0] * 3)]
    d = spark.createDataFrame(rows + odd, "sample_id string, label int, features array<double>").repartition(3)
    b = spark.createDataFrame([*pairs, ("r0", "gone"), (None, "r1")], "positive_id string, negative_id string")
    want = plain_training(plan, rows, pairs, 5)
    first = training.train(d, training.Plan(**{**plan.__dict__, "epochs": 2}), f"file://{tmp_path}/run", b)  # killed after two epochs
    assert first.count() == 2
    (tmp_path / "run" / "epoch=3").mkdir()
    (tmp_path / "run" / "epoch=3" / "part-left.parquet").write_bytes(b"half a file")
    got = training.train(d, plan, f"file://{tmp_path}/run", b).orderBy("epoch").collect()
    assert [x.epoch for x in got] == [1, 2, 3, 4, 5]
    for x, (loss, parameters) in zip(got, want):
        assert x.loss == pytest.approx(loss, abs=1e-6)
        assert np.allclose(x.parameters, parameters, atol=2e-5 if len(widths) > 2 else 2e-6)
    again = training.train(d, plan, f"file://{tmp_path}/run", b).orderBy("epoch").collect()
    assert again == got


def test_training_ends_by_patience_and_guards(spark, tmp_path):
    r = random.Random(6)
    rows = [(f"r{k}", k % 2, [r.gauss(k % 2, 1.0), r.gauss(0, 1)]) for k in range(200)]
    d = spark.createDataFrame(rows, "sample_id string, label int, features array<double>")
    plan = training.Plan((2, 2), epochs=6, patience=2, learning_rate=0.2, metric="f1", steps=2)
    val = d.where("hash(sample_id) % 3 = 0")
    e = training.train(d, plan, f"file://{tmp_path}/a", validation=val).orderBy("epoch").collect()
    scores = [x.score for x in e]
    best = max(range(len(scores)), key=lambda k: (scores[k], -k))
    assert e[-1].best_epoch == best + 1 and (len(e) == 6 or len(e) == best + 3)
    assert e[0].step == 2 and sum(x.rows for x in e[:1]) == 200
    shut = training.train(d, training.Plan(**{**plan.__dict__, "recall_max": -1.0, "epochs": 3}), f"file://{tmp_path}/b", validation=val).orderBy("epoch").collect()
    assert [(x.guarded_out, x.best_epoch, x.remaining_patience) for x in shut] == [(True, 1, 2)] * 3
    out = training.evaluated(plan, training.train(d, plan, f"file://{tmp_path}/a", validation=val), val, d).collect()
    assert {x.threshold_key for x in out} == {"fixed_0_5", "val_f1", "val_mcc"} and all(x.samples == 200 for x in out)


def test_shared_tables_go(spark, tmp_path):
    """temporary() deletes at its end, a process that stops its session and ends leaves nothing."""
    from tessera.sources import storage

    with storage.temporary(spark):
        kept = storage.settled(spark.range(5))
        path = kept.inputFiles()[0].split("/settled-")[0].removeprefix("file:").replace("///", "/")
        assert kept.count() == 5
        inside = set(os.listdir(path))
    assert len(inside - set(os.listdir(path))) == 1
    code = f"""
from tessera.session import build_session
from tessera.sources import storage
s = build_session("x", "local[1]", spark_checkpoint_dir="file://{tmp_path}/shared")
storage.settled(s.range(3)); storage.settled(s.range(4)).count()
import os
own, = [x for x in os.listdir("{tmp_path}/shared") if x.startswith("tessera-")]
assert len(os.listdir("{tmp_path}/shared/" + own)) == 2
s.stop()
"""
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120, env=os.environ | {"PYTHONPATH": os.path.dirname(os.path.dirname(os.path.abspath(__file__)))}, stderr=subprocess.DEVNULL)
    for _ in range(50):
        left = [x for x in os.listdir(tmp_path / "shared") if x.startswith("tessera-")]
        if not left:
            break
        time.sleep(0.2)
    assert left == []


class CountingEncoder(encoding.HashedEncoder):
    """Leaves a file for each text that it is asked for."""

    def __init__(self, path):
        super().__init__(3)
        self.path = path

    def ids(self, text):
        with open(f"{self.path}/{len(os.listdir(self.path))}-{os.getpid()}-{time.time_ns()}", "w") as f:
            f.write(text)
        return super().ids(text)


def test_encoding_goes_on_after_a_kill(spark, tmp_path):
    (tmp_path / "asked").mkdir()
    asked = lambda: sorted(open(f.path).read() for f in os.scandir(tmp_path / "asked"))
    load, path = partial(CountingEncoder, f"{tmp_path}/asked"), f"{tmp_path}/cache"
    rows = [(f"d{k}", " ".join(f"{'x' * (j % 9 + 1)}" for j in range(k * 7))) for k in range(30)] + [("none", None), ("none2", ""), ("d3", "zz later"), (None, "no id")]
    d = spark.createDataFrame(rows, "id string, text string").repartition(3)
    encoding.encoded_into(d.where("hash(id) % 2 = 0"), load, path, {"model": "m"}, 5, size=10, overlap=4)
    before = asked()
    (tmp_path / "cache" / "vectors" / "part=2" / "_temporary").mkdir(parents=True, exist_ok=True)
    (tmp_path / "cache" / "vectors" / "part=2" / "_temporary" / "part-half.parquet").write_bytes(b"cut off")
    v = {r.id: r for r in encoding.encoded_into(d, load, path, {"model": "m"}, 5, size=10, overlap=4).collect()}
    assert len(before) > 5 and len(asked()) == 32  # each id once
    assert encoding.encoded_into(d, load, path, {"model": "m"}, 5, size=10, overlap=4).count() == 32 and len(asked()) == 32
    with pytest.raises(ValueError, match="made with"):
        encoding.encoded_into(d, load, path, {"model": "other"}, 5)
    assert set(v) == {f"d{k}" for k in range(30)} | {"none", "none2"}
    plain = encoding.HashedEncoder(3)
    for name, text in {k: t or "" for k, t in reversed(rows) if k}.items():
        ids = plain.ids(text).tolist()
        windows, at = [], 0
        while True:  # by the rule, one after the other
            windows.append([0, *ids[at : at + 10], 1])
            if at + 10 >= len(ids):
                break
            at += 6
        means = [np.mean([[(i * k % 17) / 17 - 0.5 for k in (3, 4, 5)] for i in w], axis=0) for w in windows]
        assert v[name].n_windows == len(windows) and np.allclose(v[name].vector, np.mean(means, axis=0))
    assert encoding.encoded(d.limit(0), load).count() == 0


class Endless:
    """A GraphML file of n nodes that is never there as a whole."""

    def __init__(self, n):
        self.parts = self.pieces(n)

    @staticmethod
    def pieces(n):
        yield "<graphml><key id='k' attr.name='CODE'/><graph>"
        for k in range(n):
            yield f"<node id='{k}'><data key='k'>{'x' * 200}{k}</data></node>"
        yield "<edge source='0' target='1'/></graph></graphml>"

    def read(self, size):
        out = ""
        while len(out) < size:
            piece = next(self.parts, None)
            if piece is None:
                break
            out += piece
        return out.encode()


def test_a_large_graph_streams():
    tracemalloc.start()
    count = last = 0
    for kind, place, a, b, attrs in graphml.elements(Endless(100_000), 1 << 16):  # 24 MB
        count, last = count + 1, (kind, place, a, b, attrs)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (count, last) == (100_001, ("edge", 0, "0", "1", []))
    assert peak < 3 << 20


def test_graphml_of_odd_files(spark, tmp_path):
    (tmp_path / "g").mkdir()
    (tmp_path / "g" / "empty.graphml").write_text("<graphml/>")
    (tmp_path / "g" / "late.graphml").write_text("<graphml><graph><node id='n'><data key='k'>1</data></node></graph><key id='k' attr.name='X'/></graphml>")
    nodes, edges = graphml.read_graphml(spark, str(tmp_path / "g"))
    assert [tuple(r) for r in nodes.collect()] == [("late", "n", "UNKNOWN", {"k": "1"})] and edges.count() == 0
    (tmp_path / "g" / "broken.graphml").write_text("<graphml><node>")
    with pytest.raises(Exception, match="broken.graphml"):
        graphml.read_graphml(spark, str(tmp_path / "g"))[0].collect()


def test_only_changed_samples_are_built(spark, tmp_path):
    node = lambda i, label="CALL": {"node_id": i, "label": label, "code": ""}
    edge = lambda k, a, b, label: {"edge_pos": k, "src": a, "dst": b, "label": label}
    graph_of = lambda s, v, *more: json.dumps({"sample_id": s, "version": v, "nodes": [node("1", "METHOD"), node("2"), node("3")], "edges": [edge(0, "1", "2", "AST"), *more]})
    cfg, tree = edge(1, "1", "2", "CFG"), edge(1, "2", "3", "AST")
    (tmp_path / "in").mkdir()
    run = lambda: build.build_views(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    index = lambda: {(r.sample_id, r.view): (r.nodes, r.edges, r.batch) for r in build.built(spark, f"{tmp_path}/out", "index").collect()}
    (tmp_path / "in" / "1.json").write_text("\n".join([graph_of("a", 1), graph_of("b", 1, cfg), graph_of("b", 3, tree), graph_of("b", 2)]))
    run()
    assert index()["a", "ast"] == (2, 1, 0) and index()["b", "ast"] == (3, 2, 0) and index()["b", "cfg"] == (1, 0, 0)  # the highest version
    (tmp_path / "in" / "2.json").write_text("\n".join([graph_of("a", 2), graph_of("b", 2, cfg), graph_of("c", 1, cfg)]))
    run()
    run()
    found = index()
    assert found["a", "ast"] == (2, 1, 0)  # the same graph again
    assert found["b", "ast"] == (3, 2, 0)  # an older version
    assert found["c", "cfg"] == (2, 1, 1)
    again = spark.read.schema(build.GRAPHS).json(f"{tmp_path}/in/2.json")
    build.build_batch(again, 1, f"{tmp_path}/out")
    assert index() == found
    shutil.copytree(tmp_path / "out" / "index" / "batch=0", tmp_path / "out" / "index" / "batch=7")  # a batch that was cut off before its markers
    assert index() == found


def test_forests_on_several_splits(spark):
    r = random.Random(2)
    rows = [(f"s{k}", k % 3 == 0, float(k % 3 == 0) + r.gauss(0, 0.3), r.random(), None if k == 5 else 0.0) for k in range(1200)]
    d = spark.createDataFrame([(a, int(y), *x) for a, y, *x in rows], "sample_id string, label int, a double, b double, c double")
    clear = mining.forest_audit(d, ["a", "b", "c"], [3, 4], trees=8, depth=4).collect()
    noise = mining.forest_audit(d.where("int(substr(sample_id, 2)) < 200"), ["b"], [3, 5, 8], trees=8, depth=8).collect()
    assert {(x.offset, x.part) for x in clear} == {(o, p) for o in (3, 4) for p in ("train", "val", "test")}
    assert sum(x.n for x in clear if x.offset == 3) == 1199
    assert all(x.roc_auc > 0.85 and abs(x.gap) < 0.15 for x in clear)
    assert all(x.gap == pytest.approx(x.train_auc - x.roc_auc, abs=2e-6) for x in clear + noise)
    assert max(x.gap for x in noise) > 0.1  # learnt by heart


def test_baselines_rank_what_is_there(spark):
    r = random.Random(9)
    rows = [(f"s{k}", k % 2, ("train", "train", "val", "test")[k // 2 % 4], (k % 2) + r.gauss(0, 0.3), r.gauss(0, 1)) for k in range(400)]
    d = spark.createDataFrame(rows, "sample_id string, label int, part string, good double, bad double")
    out = {(x.feature_group, x.part): x for x in mining.weak_baselines(d, {"good": ["good"], "bad": ["bad"]}, epochs=20).collect()}
    assert all(out["good", p].roc_auc > 0.95 for p in ("train", "val", "test")) and abs(out["bad", "test"].roc_auc - 0.5) < 0.2
    risk = [(y, x) for _, y, p, x, _ in rows if p == "test"]
    assert out["good", "test"].roc_auc == pytest.approx(by_hand(risk)[2], abs=1e-6)  # one feature with a positive weight: its own order


def test_token_spans_are_the_library_s(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    r = random.Random(1)
    texts = ["", None, "int main()\n{\n  return 0;\n}\n", "Hé 日本\n  x 😀<|endoftext|>b", "\n\n\n", "é" * 700 + "\n" + "word " * 300]
    texts += ["".join(r.choice("ab é日😀\n\t(){}") for _ in range(200)) for _ in range(20)]
    d = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = offsets.token_spans(d, path).orderBy("id", "pos").collect()
    by_text = {}
    for x in got:
        by_text.setdefault(int(x.id), []).append(x)
    assert set(by_text) == {k for k, t in enumerate(texts) if t}
    for k, rows in by_text.items():
        e = library.encode(texts[k], add_special_tokens=False)
        assert [x.token for x in sorted(rows, key=lambda x: x.pos)] == e.ids
        assert [(x.char_start, x.char_end) for x in sorted(rows, key=lambda x: x.pos)] == e.offsets
        assert all(x.first_line == texts[k].count("\n", 0, x.char_start) + 1 for x in rows)
    chunks = {(int(x.id), x.chunk): x for x in offsets.chunk_lines(offsets.token_spans(d, path), 10, 4).collect()}
    for k, rows in by_text.items():
        rows = sorted(rows, key=lambda x: x.pos)
        starts = [s for s in range(0, len(rows), 6) if s == 0 or s + 4 < len(rows)]
        assert sorted(c for i, c in chunks if i == k) == list(range(len(starts)))
        for c, s in enumerate(starts):
            part = rows[s : s + 10]
            x = chunks[k, c]
            assert (x.n_tokens, x.char_start, x.char_end, x.first_line, x.last_line) == (len(part), part[0].char_start, max(p.char_end for p in part), part[0].first_line, max(p.last_line for p in part))
    with pytest.raises(ValueError, match="byte-level"):
        offsets.spans(np.array([5]), np.full(10, 3), "ab")


def test_logistic_stack_is_the_optimum(spark):
    """Out-of-fold probabilities against Newton's method on the same folds."""
    import hashlib

    r = random.Random(12)
    rows = [(f"m{k}", int(r.random() < 0.4), [min(0.99, max(0.01, r.gauss(0.5, 0.2))) for _ in range(2)]) for k in range(60)]
    rows = [(i, y, [min(0.99, max(0.01, p + 0.2 * y)) for p in ps]) for i, y, ps in rows]
    d = spark.createDataFrame(rows, "sample_id string, label int, probabilities array<double>")
    got = {x.sample_id: x.probability for x in ensembles.logistic_stack(d, 2, "logit", folds=3, c=2.0, seed=5).collect()}
    fold = {}
    for label in (0, 1):
        order = sorted((hashlib.sha256(f"5{i}".encode()).hexdigest(), i) for i, y, _ in rows if y == label)
        fold |= {i: k % 3 for k, (_, i) in enumerate(order)}
    x = {i: np.array([math.log(p / (1 - p)) for p in ps] + [1.0]) for i, _, ps in rows}
    strength = 1 / (2.0 * 60 * 2 / 3) * np.array([1.0, 1.0, 0.0])
    for f in range(3):
        train = [(x[i], y) for i, y, _ in rows if fold[i] != f]
        w = np.zeros(3)
        for _ in range(50):
            p = [1 / (1 + math.exp(-v @ w)) for v, _ in train]
            g = sum((q - y) * v for q, (v, y) in zip(p, train)) / len(train) + strength * w
            h = sum(q * (1 - q) * np.outer(v, v) for q, (v, _) in zip(p, train)) / len(train) + np.diag(strength)
            w = w - np.linalg.solve(h, g)
        for i, _, _ in rows:
            if fold[i] == f:
                assert got[i] == pytest.approx(1 / (1 + math.exp(-x[i] @ w)), abs=2e-4)


def test_metrics_of_a_later_evaluation_go_first(spark, tmp_path):
    for run, first, later in (("a", {"f1": 0.5, "mcc": 0.1}, {"f1": 0.6, "pr_auc": 0.7}), ("b", {"f1": 0.4, "mcc": 0.2}, None)):
        (tmp_path / run).mkdir()
        (tmp_path / run / "metrics.json").write_text(json.dumps(first, indent=1))
        if later:
            (tmp_path / run / "final_test_metrics.json").write_text(json.dumps(later))
    d = tables.run_metrics(spark, f"{tmp_path}/*/metrics.json", f"{tmp_path}/*/final_test_metrics.json")
    assert {(r.run, r.f1, r.mcc, r.pr_auc) for r in d.collect()} == {("a", 0.6, 0.1, 0.7), ("b", 0.4, 0.2, None)}


def test_mean_losses(spark):
    d = spark.createDataFrame([(1.0, 3), (2.0, 1)], "loss double, n int")
    assert metrics.weighted_mean_loss(d).first().loss == 1.25
    assert metrics.weighted_mean_loss(d.limit(0)).first().loss == 0.0
    with pytest.raises(Exception, match="without samples"):
        metrics.weighted_mean_loss(spark.createDataFrame([(1.0, 0)], "loss double, n int")).collect()


@pytest.mark.parametrize(("n", "sample"), [(10, 3), (97, 10), (12, 12), (5, 40), (8, 1)])
def test_cache_stats_of_evenly_spaced_rows(spark, n, sample):
    r = np.random.default_rng(n)
    x = np.round(r.normal(size=(n, 4)), 3) * (r.random(n) > 0.3)[:, None]
    d = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, v array<double>")
    part = x[np.linspace(0, n - 1, min(n, sample)).astype(int)]
    got = windows.cache_stats(d, "id", "v", sample).first()
    assert got.rows == len(part)
    assert (got.abs_mean, got.mean_std, got.zero_rate) == (pytest.approx(np.abs(part).mean(), abs=1e-6), pytest.approx(part.std(0).mean(), abs=1e-6), pytest.approx((part == 0).all(1).mean()))
