"""How the library's inputs are read out of the general tables: samples, predictions, vectors, graphs, attention."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import source_hash


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample_id, label, source_hash of labelled documents."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    return docs.join(labels, "doc_id").select(F.col("doc_id").cast("string").alias("sample_id"), F.col("quality").alias("label"), source_hash(F.col("text")).alias("source_hash"))


def predictions(spark: SparkSession, sf_dir: str, models: int = 4) -> DataFrame:
    """part, model, sample_id, label, probability of four models."""
    e = table(spark, sf_dir, "embeddings")
    part = F.when(F.col("vec_id") % 10 == 8, "val").when(F.col("vec_id") % 10 == 9, "test").otherwise("train")
    p = F.array(*[F.struct(F.lit(k).alias("model"), F.round((1 + F.col("embedding")[k].cast("double")) / 2, 6).alias("probability")) for k in range(models)])
    return e.select(part.alias("part"), F.col("vec_id").cast("string").alias("sample_id"), (F.col("label") >= 5).cast("int").alias("label"), F.explode(p).alias("m")).select("part", "m.model", "sample_id", "label", "m.probability")


PREDICTIONS_SQL = """predictions as (select case when vec_id % 10 = 8 then 'val' when vec_id % 10 = 9 then 'test' else 'train' end as part, m.k::int as model,
 vec_id::varchar as sample_id, (label >= 5)::int as label, round((1 + embedding[m.k + 1]::double) / 2, 6) as probability
 from embeddings, (select unnest(range(4)) as k) m)"""


def retrieval(spark: SparkSession, sf_dir: str, label: int) -> DataFrame:
    """id, motif, structure, scale, fp of the vectors of one class (labels from 5 on are positive)."""
    wide = lambda a, b: F.transform(F.slice("embedding", a + 1, b - a), lambda x: x.cast("double"))
    e = table(spark, sf_dir, "embeddings").where((F.col("label") >= 5) == F.lit(label == 1))
    return e.select(F.col("vec_id").alias("id"), wide(0, 13).alias("motif"), wide(13, 17).alias("structure"), wide(17, 23).alias("scale"), F.round((1 + F.col("embedding")[63].cast("double")) / 2, 6).alias("fp"))


def attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("sample_id"), (F.col("event_id") % 40).cast("long").alias("line"), F.round(F.col("value") / 500, 6).alias("score"))


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate", "l_returnflag", "l_linestatus")
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_partkey", "l_suppkey", "l_returnflag", F.row_number().over(order).alias("i"))


def graph_nodes(spark: SparkSession, sf_dir: str, items: DataFrame | None = None) -> DataFrame:
    """An order is a method, its items are calls on a part, parts are identifiers (ids: 1, then 10 + i and 1000 + i)."""
    items = _items(spark, sf_dir) if items is None else items
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_type")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("sample_id"), F.lit("1").alias("node_id"), F.lit("METHOD").alias("label"), F.col("o_orderpriority").alias("name"), F.col("o_orderstatus").alias("code"))
    li = items.join(parts, "l_partkey")
    both = li.select(F.col("l_orderkey").cast("string").alias("sample_id"), "i", "p_name", "p_type", F.explode(F.array(F.lit("CALL"), F.lit("IDENTIFIER"))).alias("label"))
    call = F.col("label") == "CALL"  # plain columns: without ids, items need not be numbered
    both = both.select("sample_id", (F.when(call, 10).otherwise(1000) + F.col("i")).cast("string").alias("node_id"), "label", F.col("p_name").alias("name"), F.when(call, F.lower("p_type")).otherwise(F.col("p_name")).alias("code"))
    return o.unionByName(both)


def graph_edges(spark: SparkSession, sf_dir: str, items: DataFrame | None = None) -> DataFrame:
    """AST order to item to part; CFG from item to the next; CDG from a returned item to the next; REACHING_DEF to the
    next item of the same supplier parity."""
    items = _items(spark, sf_dir) if items is None else items
    by = Window.partitionBy("l_orderkey").orderBy("i")
    same = Window.partitionBy("l_orderkey", F.col("l_suppkey") % 2).orderBy("i")
    d = items.withColumn("next", F.lead("i").over(by)).withColumn("reach", F.lead("i").over(same))
    sample = F.col("l_orderkey").cast("string").alias("sample_id")
    edge = lambda s, t, label: F.struct(s.cast("string").alias("src"), t.cast("string").alias("dst"), F.lit(label).alias("label"))
    call = 10 + F.col("i")
    all_ = F.array(
        edge(F.lit(1), call, "AST"),
        edge(call, 1000 + F.col("i"), "AST"),
        F.when(F.col("next").isNotNull(), edge(call, 10 + F.col("next"), "CFG")),
        F.when(F.col("next").isNotNull() & (F.col("l_returnflag") == "R"), edge(call, 10 + F.col("next"), "CDG")),
        F.when(F.col("reach").isNotNull(), edge(call, 10 + F.col("reach"), "REACHING_DEF")),
    )
    return d.select(sample, F.col("i").alias("edge_pos"), F.explode(F.filter(all_, F.isnotnull)).alias("e")).select("sample_id", "edge_pos", "e.*")


GRAPH_SQL = """items as (select l_orderkey, l_partkey, l_suppkey, l_returnflag, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey,
 l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) as i from lineitem),
 nodes as (select o_orderkey::varchar as sample_id, '1' as node_id, 'METHOD' as label, o_orderpriority as name, o_orderstatus as code from orders
 union all select l_orderkey::varchar, (10 + i)::varchar, 'CALL', p_name, lower(p_type) from items join part on p_partkey = l_partkey
 union all select l_orderkey::varchar, (1000 + i)::varchar, 'IDENTIFIER', p_name, p_name from items join part on p_partkey = l_partkey),
 linked as (select *, lead(i) over (partition by l_orderkey order by i) as nxt, lead(i) over (partition by l_orderkey, l_suppkey % 2 order by i) as reach from items),
 edges as (select l_orderkey::varchar as sample_id, '1' as src, (10 + i)::varchar as dst, 'AST' as label from linked
 union all select l_orderkey::varchar, (10 + i)::varchar, (1000 + i)::varchar, 'AST' from linked
 union all select l_orderkey::varchar, (10 + i)::varchar, (10 + nxt)::varchar, 'CFG' from linked where nxt is not null
 union all select l_orderkey::varchar, (10 + i)::varchar, (10 + nxt)::varchar, 'CDG' from linked where nxt is not null and l_returnflag = 'R'
 union all select l_orderkey::varchar, (10 + i)::varchar, (10 + reach)::varchar, 'REACHING_DEF' from linked where reach is not null)"""
