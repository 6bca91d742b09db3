"""Program graphs as tables: nodes(sample_id, node_id, label, attrs...) and edges(sample_id, src, dst, label, edge_pos)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..sources.storage import settled
from .ordering import numbered


def node_order(node_id: str = "node_id") -> list[Column]:
    """Numeric ids first, by value, then the others as text. Numbers below 10^18 are compared as longs, which is what most ids are;
    only the others are read as decimals."""
    number, limit = F.expr(f"try_cast({node_id} as decimal(38, 0))"), 10**18
    small = F.when(F.col(node_id).rlike("^[0-9]{1,18}$"), F.col(node_id).cast("long")).when((number > -limit) & (number < limit), number.cast("long"))
    kind = F.when(small.isNotNull(), 1).when(number.isNull(), 3).when(number < 0, 0).otherwise(2)
    return [kind, small, F.when(small.isNull(), number), F.col(node_id)]


def closure(edges: DataFrame, roots: DataFrame, relation: str = "AST", max_rounds: int = 10_000) -> DataFrame:
    """(sample_id, root, node_id): nodes that a root reaches over a relation, itself included. Cycles end, since only
    nodes not seen before go on."""
    step = edges.where(F.col("label") == relation).select("sample_id", F.col("src").alias("node_id"), F.col("dst").alias("next"))
    step = settled(step)  # each round reads it
    start = settled(roots.select("sample_id", F.col("node_id").alias("root"), "node_id").distinct())
    return _grown(start, lambda front: front.join(step, ["sample_id", "node_id"]).select("sample_id", "root", F.col("next").alias("node_id")), max_rounds)


def _grown(start: DataFrame, grow: Callable[[DataFrame], DataFrame], max_rounds: int) -> DataFrame:
    """start and all that rounds of grow add to it. Each front is written once; every eighth round their union is, so plans
    stay short and what was found is read, not written, in between."""
    parts, front = [start], start
    for k in range(max_rounds):
        seen = reduce(DataFrame.unionByName, parts)
        front = settled(grow(front).distinct().join(seen, start.columns, "left_anti"))
        if front.isEmpty():
            return seen
        parts = [settled(seen), front] if k % 8 == 7 else [*parts, front]
    raise RuntimeError(f"not closed after {max_rounds} rounds")


def primary_method(nodes: DataFrame, reached: DataFrame) -> DataFrame:
    """(sample_id, node_id, closure_size): of the internal named methods, the one with the largest closure, then the
    longest code, then the first in node order. nodes: also name, code, is_external; reached: closure of the methods."""
    internal = (F.col("label") == "METHOD") & (F.lower(F.coalesce("is_external", F.lit("false"))) != "true") & (F.coalesce("name", F.lit("")) != "<global>")
    sizes = reached.groupBy("sample_id", F.col("root").alias("node_id")).agg(F.count("*").alias("closure_size"))
    d = nodes.where(internal).join(sizes, ["sample_id", "node_id"])
    order = Window.partitionBy("sample_id").orderBy(F.desc("closure_size"), F.desc(F.length(F.coalesce("code", F.lit("")))), *node_order())
    return d.withColumn("__r", F.row_number().over(order)).where("__r = 1").select("sample_id", "node_id", "closure_size")


def relation_table(edges: DataFrame) -> DataFrame:
    rows = [(v, r, k) for v, rels in fixed.VIEW_RELATIONS.items() for k, r in enumerate(rels)]
    return edges.sparkSession.createDataFrame(rows, "view string, label string, relation_id int")


def inner_edges(edges: DataFrame, members: DataFrame) -> DataFrame:
    """The edges that some view has, with both ends among members (sample_id, node_id): a row an edge, however many views have it."""
    at = lambda side: members.select("sample_id", F.col("node_id").alias(side))
    known = edges.where(F.col("label").isin(sorted({r for rels in fixed.VIEW_RELATIONS.values() for r in rels})))
    return known.join(at("src"), ["sample_id", "src"], "left_semi").join(at("dst"), ["sample_id", "dst"], "left_semi")


def in_views(inner: DataFrame) -> DataFrame:
    """A row for each view that an edge is in, with view and relation_id."""
    return inner.join(F.broadcast(relation_table(inner)), "label")  # a fixed table


def view_edges(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(sample_id, view, src, dst, label, relation_id): edges of each view with both ends among members (sample_id, node_id)."""
    return in_views(inner_edges(edges, members))


def _of_view(edges: DataFrame, view: str, relation: str | None = None) -> Column:
    """Whether an edge is in a view (of a relation); edges: view_edges, or inner_edges, which name no view."""
    meant = F.col("label").isin(fixed.VIEW_RELATIONS[view]) if relation is None else F.col("label") == relation
    return meant & (F.col("view") == view) if "view" in edges.columns else meant


def view_places(edges: DataFrame, members: DataFrame, roots: DataFrame, sliced: DataFrame | None = None) -> DataFrame:
    """(sample_id, node_id, places): a row a node, with an array of view and local_id. cfg and pdg hold the root and the ends of edges, slice-cpg
    the slice, the others all members; local ids count up in node order. edges: view_edges or inner_edges."""
    bit = {v: 1 << k for k, v in enumerate(fixed.VIEW_RELATIONS)}
    flow = edges.withColumn("__in", sum((F.when(_of_view(edges, v), bit[v]).otherwise(0) for v in ("cfg", "pdg")), F.lit(0))).where(F.col("__in") > 0)
    at = lambda d, node, views: d.select("sample_id", F.col(node).alias("node_id"), views.alias("__in"))
    parts = [
        at(members, "node_id", F.lit(sum(bit[v] for v in ("ast", "core-cpg", "dataflow-cpg")))),
        at(flow, "src", F.col("__in")),
        at(flow, "dst", F.col("__in")),
        at(roots, "node_id", F.lit(bit["cfg"] | bit["pdg"])),
    ]
    if sliced is not None:
        parts.append(at(sliced, "node_id", F.lit(bit["slice-cpg"])))
    d = reduce(DataFrame.unionByName, parts).groupBy("sample_id", "node_id").agg(F.bit_or("__in").alias("__in"))
    before = Window.partitionBy("sample_id").orderBy(*node_order()).rowsBetween(Window.unboundedPreceding, 0)
    inside = {v: F.col("__in").bitwiseAND(b) > 0 for v, b in bit.items() if v != "slice-cpg" or sliced is not None}
    place = [F.when(has, F.struct(F.lit(v).alias("view"), (F.count_if(has).over(before) - 1).cast("int").alias("local_id"))) for v, has in inside.items()]
    return d.select("sample_id", "node_id", F.filter(F.array(*place), F.isnotnull).alias("places"))


def view_nodes(typed: DataFrame, members: DataFrame, roots: DataFrame, sliced: DataFrame | None = None) -> DataFrame:
    """(sample_id, view, node_id, local_id): view_places, a row for each view that a node is in."""
    return places_in_views(view_places(typed, members, roots, sliced))


def places_in_views(places: DataFrame) -> DataFrame:
    rest = [c for c in places.columns if c not in ("sample_id", "node_id", "places")]
    return places.select("sample_id", "node_id", *rest, F.explode("places").alias("p")).select("sample_id", "p.view", "node_id", "p.local_id", *rest)


def with_slice_mask(nodes: DataFrame, sliced: DataFrame) -> DataFrame:
    """nodes of all views with in_slice: whether the node is in its sample's slice. sliced: sample_id, node_id."""
    s = sliced.select("sample_id", "node_id").distinct().withColumn("in_slice", F.lit(True))
    return nodes.join(s, ["sample_id", "node_id"], "left").withColumn("in_slice", F.coalesce("in_slice", F.lit(False)))


def model_edges(typed: DataFrame, nodes: DataFrame) -> DataFrame:
    """(sample_id, view, src, dst, edge_type) in local ids, both directions. Typed views (*-cpg) number relations, their
    reverses and one self-loop per node; untyped ones have type 0 and keep repeats. typed: view_edges with view_nodes, or inner_edges with
    view_places, where an edge meets its ends once for all views."""
    if "places" in nodes.columns:
        ids = lambda side: nodes.select("sample_id", F.col("node_id").alias(side), F.map_from_entries("places").alias(f"m_{side}"))
        e = in_views(typed.join(ids("src"), ["sample_id", "src"]).join(ids("dst"), ["sample_id", "dst"]))
        e = e.withColumns({f"l_{side}": F.try_element_at(F.col(f"m_{side}"), F.col("view")) for side in ("src", "dst")}).where("l_src is not null and l_dst is not null")
        nodes = places_in_views(nodes)
    else:
        ids = lambda side: nodes.select("sample_id", "view", F.col("node_id").alias(side), F.col("local_id").alias(f"l_{side}"))
        e = typed.join(ids("src"), ["sample_id", "view", "src"]).join(ids("dst"), ["sample_id", "view", "dst"])
    count = F.create_map(*[F.lit(x) for v, r in fixed.VIEW_RELATIONS.items() for x in (v, len(r))])
    is_typed = F.col("view").endswith("-cpg")
    kind = lambda c: F.when(is_typed, c).otherwise(F.lit(0))
    both = F.array(F.struct(F.col("l_src").alias("src"), F.col("l_dst").alias("dst"), kind(F.col("relation_id")).alias("edge_type")), F.struct(F.col("l_dst").alias("src"), F.col("l_src").alias("dst"), kind(F.col("relation_id") + count[F.col("view")]).alias("edge_type")))
    loops = nodes.where(is_typed).select("sample_id", "view", F.col("local_id").alias("src"), F.col("local_id").alias("dst"), (2 * count[F.col("view")]).alias("edge_type"))
    return e.select("sample_id", "view", F.explode(both).alias("e")).select("sample_id", "view", "e.*").unionByName(loops)


def hops(edges: DataFrame, seeds: DataFrame, members: DataFrame, relation: str, radius: int) -> DataFrame:
    """(sample_id, node_id) within radius steps of the seeds over one relation, either way, without the seeds."""
    e = edges.where(F.col("label") == relation)
    either = e.select("sample_id", F.col("src").alias("node_id"), F.col("dst").alias("next")).unionByName(e.select("sample_id", F.col("dst").alias("node_id"), F.col("src").alias("next")))
    seen = front = seeds.select("sample_id", "node_id").distinct()
    for _ in range(radius):
        front = front.join(either, ["sample_id", "node_id"]).select("sample_id", F.col("next").alias("node_id")).distinct().join(members.select("sample_id", "node_id"), ["sample_id", "node_id"], "left_semi").join(seen, ["sample_id", "node_id"], "left_anti")
        seen = seen.unionByName(front)
    return seen.join(seeds.select("sample_id", "node_id"), ["sample_id", "node_id"], "left_anti")


def is_risky_call(label: Column, code: Column) -> Column:
    lowered = F.lower(F.coalesce(code, F.lit("")))
    return (label == "CALL") & reduce(lambda a, b: a | b, [lowered.contains(t) for t in fixed.RISKY_CALLS])


def is_memory_access(label: Column, code: Column) -> Column:
    lowered = F.lower(F.coalesce(code, F.lit("")))
    return label.isin(fixed.MEMORY_LABELS) & reduce(lambda a, b: a | b, [lowered.contains(t) for t in fixed.MEMORY_SYNTAX])


def slice_seeds(nodes: DataFrame) -> DataFrame:
    """(sample_id, node_id, seed_type): risky calls (1), or memory accesses (2) in samples that have none."""
    risky, memory = is_risky_call(F.col("label"), F.col("code")), is_memory_access(F.col("label"), F.col("code"))
    d = nodes.withColumn("__risky", risky).withColumn("__memory", memory).withColumn("__any", F.max("__risky").over(Window.partitionBy("sample_id")))
    kind = F.when(F.col("__risky"), 1).when(~F.col("__any") & F.col("__memory"), 2)
    return d.withColumn("seed_type", kind).where("seed_type is not null").select("sample_id", "node_id", "seed_type")


def risk_slice(nodes: DataFrame, edges: DataFrame, members: DataFrame, roots: DataFrame, max_depth: int = 10_000) -> DataFrame:
    """(sample_id, node_id) of the slice around the seeds: two data-flow hops, one control-dependence and one control-flow
    hop, AST children of what carries code, and AST ancestors; without seeds the root and its children."""
    inside = nodes.join(members.select("sample_id", "node_id"), ["sample_id", "node_id"], "left_semi")
    seeds = settled(slice_seeds(inside).select("sample_id", "node_id"))
    tree = edges.where(F.col("label") == "AST")
    children = tree.select("sample_id", F.col("src").alias("node_id"), F.col("dst").alias("child"))
    parents = tree.groupBy("sample_id", F.col("dst").alias("node_id")).agg(F.max_by("src", "edge_pos").alias("parent"))  # the last edge wins
    with_seeds = roots.join(seeds.select("sample_id").distinct(), "sample_id", "left_semi").select("sample_id", "node_id")
    shell = roots.join(seeds.select("sample_id").distinct(), "sample_id", "left_anti").select("sample_id", "node_id")
    shell = shell.unionByName(shell.join(children, ["sample_id", "node_id"]).select("sample_id", F.col("child").alias("node_id")))
    core = reduce(DataFrame.unionByName, [with_seeds, seeds, *[hops(edges, seeds, members, r, k) for r, k in (("REACHING_DEF", 2), ("CDG", 1), ("CFG", 1))]]).distinct()
    carriers = core.join(nodes.where(F.col("label").isin(fixed.AST_CHILD_LABELS)).select("sample_id", "node_id"), ["sample_id", "node_id"], "left_semi")
    found = settled(core.unionByName(carriers.join(children, ["sample_id", "node_id"]).select("sample_id", F.col("child").alias("node_id"))).distinct())
    found = _grown(found, lambda front: front.join(parents, ["sample_id", "node_id"]).select("sample_id", F.col("parent").alias("node_id")), max_depth)
    return found.unionByName(shell).distinct().join(members.select("sample_id", "node_id"), ["sample_id", "node_id"], "left_semi")


def edge_histogram(typed: DataFrame) -> DataFrame:
    """(sample_id, view, relation, n) of forward edges, zero-filled over the relations of each typed view. typed: view_edges or inner_edges."""
    kinds = [(v, r) for v, rels in fixed.VIEW_RELATIONS.items() if v.endswith("-cpg") for r in rels]
    distinct = list(dict.fromkeys(kinds if "view" in typed.columns else [("core-cpg", r) for _, r in kinds]))
    n = typed.groupBy("sample_id").agg(*[F.count_if(_of_view(typed, v, r)).alias(f"__{v}/{r}") for v, r in distinct])
    of = lambda v, r: F.col(f"`__{v if 'view' in typed.columns else 'core-cpg'}/{r}`")
    rows = F.explode(F.array(*[F.struct(F.lit(v).alias("view"), F.lit(r).alias("relation"), of(v, r).alias("n")) for v, r in kinds])).alias("x")
    return n.select("sample_id", rows).select("sample_id", "x.*")


def node_histogram(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("sample_id", "label").agg(F.count("*").alias("n"))


def dictionary(texts: DataFrame, order: list[str], col: str = "text", known: DataFrame | None = None) -> DataFrame:
    """(text_id, text): distinct texts numbered by where each is first seen; known ones keep their ids and new ones go on
    after them."""
    first = texts.groupBy(F.col(col).alias("text")).agg(F.min(F.struct(*order)).alias("at"))
    base = F.lit(0).cast("long")
    if known is not None:
        first = first.join(known.select("text"), "text", "left_anti")
        top = known.agg((F.coalesce(F.max("text_id"), F.lit(-1)) + 1).alias("base"))
        base = F.col("base")
    d = numbered(first, "text_id", "at")
    if known is not None:
        d = d.join(F.broadcast(top))  # one row
    d = d.select((base + F.col("text_id")).alias("text_id"), "text")
    return d if known is None else known.select("text_id", "text").unionByName(d)


def seed_types(nodes: DataFrame) -> DataFrame:
    """(sample_id, node_id, seed_type) that models are given: 1 risky call, 2 memory access where a sample has no risky
    call, else 0. Name, last part of the full method name and code count, with a list of their own. nodes: also name,
    method_full_name, code."""
    part = lambda c: F.lower(F.coalesce(c, F.lit("")))
    text = F.concat_ws(" ", part(F.col("name")), part(F.element_at(F.split(F.coalesce("method_full_name", F.lit("")), r"\."), -1)), part(F.col("code")))
    has = lambda words: reduce(lambda a, b: a | b, [F.col("__text").contains(w) for w in words])
    d = nodes.withColumn("__text", text).withColumn("__risky", (F.col("label") == "CALL") & has(fixed.RISKY_CALLS))
    d = d.withColumn("__any", F.max("__risky").over(Window.partitionBy("sample_id")))
    memory = F.col("label").isin(fixed.MEMORY_LABELS) & has(fixed.SEED_MEMORY_SYNTAX)
    return d.select("sample_id", "node_id", F.when(F.col("__risky"), 1).when(~F.col("__any") & memory, 2).otherwise(0).alias("seed_type"))


def registry_digest(registry: DataFrame, span: int = 100_000) -> DataFrame:
    """One row: an order-sensitive digest of a registry (text_id, text), in two levels: of the texts of each span of ids,
    each closed by a zero character, and of those digests in order. No task holds more than a span."""
    block = registry.groupBy(F.floor(F.col("text_id") / span).alias("b")).agg(F.array_sort(F.collect_list(F.struct("text_id", "text"))).alias("t"))
    inner = block.select("b", F.sha2(F.concat_ws("", F.transform("t", lambda x: F.concat(x["text"], F.lit("\u0000")))), 256).alias("d"))
    outer = inner.agg(F.array_sort(F.collect_list(F.struct("b", "d"))).alias("t"))  # one digest a span
    return outer.select(F.sha2(F.array_join(F.transform("t", lambda x: x["d"]), ""), 256).alias("digest"))


def incomplete_samples(samples: DataFrame, markers: DataFrame, index: DataFrame, payloads: DataFrame, views: int, registry_size: int) -> DataFrame:
    """sample_id of what must be built again: no marker, not all views, differing commits, or ids beyond the registry.
    markers: sample_id, commit_id, fingerprint; index: sample_id, view, commit_id; payloads: sample_id, view, commit_id,
    max_text_id; samples: sample_id, fingerprint."""
    i = index.select("sample_id", "view", F.col("commit_id").alias("i")).join(payloads.select("sample_id", "view", F.col("commit_id").alias("p"), "max_text_id"), ["sample_id", "view"], "full_outer")
    i = i.join(markers.select("sample_id", F.col("commit_id").alias("m"), F.col("fingerprint").alias("f")), "sample_id", "left")
    ok = F.coalesce((F.col("i") == F.col("p")) & (F.col("i") == F.col("m")) & (F.col("max_text_id") < registry_size), F.lit(False))
    whole = i.groupBy("sample_id", "f").agg(F.min(ok).alias("ok"), F.count("*").alias("n")).where(F.col("ok") & (F.col("n") == views))
    return samples.join(whole.select("sample_id", F.col("f").alias("fingerprint")), ["sample_id", "fingerprint"], "left_anti").select("sample_id")
