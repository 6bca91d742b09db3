"""Embedding near-dedup by product quantisation: coarse inverted lists, residual codes, table-lookup distances, exact rerank."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import numbered
from .components import components
from .storage import settled

COSINE = 0.9
#: Rows per list that the number of lists aims at, the most lists, least probes of a query, subspaces, rows of a block.
LIST_ROWS, MAX_LISTS, PROBES, SUBSPACES, BLOCK = 128, 16_384, 8, 8, 1024
#: Training rows per list, and the most in all (the bound of what the driver holds); training rows of a codebook.
TRAIN_PER_LIST, MAX_TRAIN, TRAIN_CODES = 32, 131_072, 16_384
#: Centroids nearer to each other than this share of the distance of a link are one list.
APART = 0.75
_PAIRS = 1 << 15


def kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 8) -> np.ndarray:
    """Centroids of x, from k of its rows; an empty one is put on a row that is far from its own."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].astype(np.float32)
    for _ in range(rounds):
        near, far = _nearest(x, c)
        n = np.bincount(near, minlength=len(c))
        sums = np.zeros_like(c, dtype=np.float64)
        np.add.at(sums, near, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c).astype(np.float32)
        if (n == 0).any():
            c[n == 0] = x[np.argsort(-far, kind="stable")[: (n == 0).sum()]]
    return c


def _nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    near, far = np.empty(len(x), np.int64), np.empty(len(x), np.float32)
    for k in range(0, len(x), 4096):
        d = ((c * c).sum(1)[None] - 2 * x[k : k + 4096] @ c.T).astype(np.float32)
        near[k : k + 4096] = d.argmin(1)
        far[k : k + 4096] = d.min(1)
    return near, far + (x * x).sum(1)


def apart(c: np.ndarray, least: float) -> np.ndarray:
    """Centroids of which no two are nearer than `least`, with one at most that far from each given one. So a dense group,
    in which k-means puts many centroids, is one list or a few, which its members all ask."""
    kept: list[int] = []
    free = np.ones(len(c), bool)
    for k in range(len(c)):
        if free[k]:
            kept.append(k)
            free &= ((c - c[k]) ** 2).sum(1) >= least**2
    return c[kept]


def train(sample: np.ndarray, lists: int, subspaces: int = SUBSPACES, seed: int = 0, least: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """(coarse centroids, codebooks of shape (subspaces, up to 256, dimensions / subspaces)) from unit vectors in random
    order. Codebooks are fitted on the first TRAIN_CODES of them."""
    coarse = apart(kmeans(sample, lists, seed), least)
    few = sample[:TRAIN_CODES]
    residual = few - coarse[_nearest(few, coarse)[0]]
    books = [kmeans(part, 256, seed + 1) for part in np.split(residual, subspaces, axis=1)]
    return coarse, np.stack(books)


def _unit(rows: pd.Series) -> np.ndarray:
    x = np.stack([np.asarray(r, np.float64) for r in rows])
    return x / np.linalg.norm(x, axis=1)[:, None]


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest node that each of n nodes reaches over the edges (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _block(queries: pd.DataFrame, rows: pd.DataFrame, coarse: np.ndarray, books: np.ndarray, cosine: float) -> pd.DataFrame:
    """Links of one block of queries with one block of a list: (id, root, n) per vector that has some."""
    none = pd.DataFrame({"id": pd.Series(dtype="int64"), "root": pd.Series(dtype="int64"), "n": pd.Series(dtype="int64")})
    if not len(queries) or not len(rows):
        return none
    cell = int(rows["cell"].iloc[0])
    q, v = _unit(queries["embedding"]), _unit(rows["embedding"])
    codes = np.stack([np.frombuffer(c, np.uint8) for c in rows["codes"]])
    subspaces, size, width = books.shape
    r = (q - coarse[cell]).reshape(len(q), subspaces, width)
    tables = ((r[:, :, None, :] - books[None]) ** 2).sum(3) if len(q) * subspaces * size * width < 1 << 24 else np.stack([((x[:, None, :] - books) ** 2).sum(2) for x in r])
    near = np.zeros((len(q), len(v)))
    for m in range(subspaces):
        near += tables[:, m, codes[:, m]]
    # |q - v| <= |q - code(v)| + |code(v) - v|: no true link is beyond the stored error of v's code
    reach = (np.sqrt(2 - 2 * cosine) + rows["error"].to_numpy() + 1e-5) ** 2
    qi, vi = np.nonzero(near <= reach[None])
    q_id, v_id = queries["id"].to_numpy(), rows["id"].to_numpy()
    # A pair whose either end probes the other's list is met twice; the smaller id's query counts it then.
    asks = [np.frombuffer(p, np.int32) for p in rows["probes"]]
    probes = np.full((len(asks), max(map(len, asks))), -1, np.int32)
    for k, p in enumerate(asks):
        probes[k, : len(p)] = p
    home = queries["home"].to_numpy()
    keep = q_id[qi] != v_id[vi]
    qi, vi = qi[keep], vi[keep]
    twice = (probes[vi] == home[qi][:, None]).any(1)
    keep = ~twice | (q_id[qi] < v_id[vi])
    qi, vi = qi[keep], vi[keep]
    linked = np.zeros(len(qi), bool)
    for k in range(0, len(qi), _PAIRS):
        linked[k : k + _PAIRS] = np.einsum("ij,ij->i", q[qi[k : k + _PAIRS]], v[vi[k : k + _PAIRS]]) >= cosine
    qi, vi = qi[linked], vi[linked]
    if not len(qi):
        return none
    ids, at = np.unique(np.concatenate([q_id[qi], v_id[vi]]), return_inverse=True)
    a, b = at[: len(qi)], at[len(qi) :]
    n = np.bincount(a, rows["copies"].to_numpy()[vi], len(ids)) + np.bincount(b, queries["copies"].to_numpy()[qi], len(ids))
    return pd.DataFrame({"id": ids, "root": ids[_forest(a, b, len(ids))], "n": n.astype(np.int64)})


def _links(unique: DataFrame, dimensions: int, n: int, cosine: float, probes: int) -> tuple[DataFrame, DataFrame]:
    """(id, n) and (id, root): links counted and a forest of them, between unique(id, copies, embedding) of one length."""
    spark = unique.sparkSession
    lists = int(min(MAX_LISTS, max(4, 2 ** int(np.ceil(np.log2(n / LIST_ROWS))) if n > LIST_ROWS else 4)))
    sample = unique.orderBy(F.xxhash64("id")).limit(min(MAX_TRAIN, max(1024, TRAIN_PER_LIST * lists))).select("embedding").toPandas()
    subspaces = next(m for m in (SUBSPACES, 4, 2, 1) if dimensions % m == 0)
    reach = float(np.sqrt(2 - 2 * cosine))
    coarse, books = train(_unit(sample["embedding"]).astype(np.float32), lists, subspaces, least=APART * reach)
    probes = min(probes, len(coarse))
    shared = spark.sparkContext.broadcast((coarse, books))  # at most MAX_LISTS centroids and 256 codes a subspace

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coarse, books = shared.value
        for whole in batches:
            for at in range(0, len(whole), 2048):
                batch = whole.iloc[at : at + 2048]
                x = _unit(batch["embedding"]).astype(np.float32)
                d = (coarse * coarse).sum(1)[None] - 2 * x @ coarse.T
                order = np.argpartition(d, probes - 1, axis=1)[:, :probes]
                order = np.take_along_axis(order, np.argsort(np.take_along_axis(d, order, 1), axis=1, kind="stable"), 1).astype(np.int32)
                asks = [np.concatenate([o, np.setdiff1d(np.flatnonzero(row <= reach**2 - 1), o).astype(np.int32)]) for o, row in zip(order, d, strict=True)]
                residual = (x - coarse[order[:, 0]]).reshape(len(x), len(books), -1)
                codes = np.stack([_nearest(residual[:, m], books[m])[0] for m in range(len(books))], axis=1).astype(np.uint8)
                coded = np.stack([books[m][codes[:, m]] for m in range(len(books))], axis=1)
                out = batch.assign(home=order[:, 0], codes=[c.tobytes() for c in codes], error=np.sqrt(((residual - coded) ** 2).sum((1, 2))).astype(float), probes=[p.tobytes() for p in asks], asks=asks)
                yield out[["id", "copies", "embedding", "home", "codes", "error", "probes", "asks"]]

    kind = unique.schema["embedding"].dataType.simpleString()
    indexed = settled(unique.mapInPandas(index, f"id long, copies long, embedding {kind}, home int, codes binary, error double, probes binary, asks array<int>"))
    asked = indexed.select("id", "copies", "embedding", "home", F.explode("asks").alias("cell"))
    sizes = indexed.groupBy(F.col("home").alias("cell")).agg(F.count("*").alias("stored"))
    sizes = sizes.join(asked.groupBy("cell").agg(F.count("*").alias("queries")), "cell")
    sizes = F.broadcast(settled(sizes.select("cell", F.ceil(F.col("stored") / BLOCK).cast("int").alias("lb"), F.ceil(F.col("queries") / BLOCK).cast("int").alias("qb"))))  # one row a list
    part = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    stored = indexed.withColumn("cell", F.col("home")).join(sizes, "cell").withColumn("l", part("lb")).withColumn("q", every("qb")).select("cell", "l", "q", "id", "copies", "embedding", "codes", "error", "probes")
    asked = asked.join(sizes, "cell").withColumn("q", part("qb")).withColumn("l", every("lb")).select("cell", "l", "q", "id", "copies", "embedding", "home")

    def search(queries: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        return _block(queries, block, *shared.value, cosine)

    key = ["cell", "l", "q"]
    asked, stored = asked.toDF(*asked.columns), stored.toDF(*stored.columns)  # columns of their own on either side
    met = settled(asked.groupBy(*key).cogroup(stored.groupBy(*key)).applyInPandas(search, "id long, root long, n long"))
    return met.groupBy("id").agg(F.sum("n").alias("n")), met.select("id", "root")


def embedding_groups(vectors: DataFrame, cosine: float = COSINE, probes: int = PROBES, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per row of vectors; links are pairs found with cosine >= `cosine`.

    Equal vectors are one row of the index with a count. It is stored in the list of its nearest coarse centroid with the
    codes of its residual, and asks the `probes` nearest lists and any other whose centroid is as near as a link. Lists and
    their queries are cut into blocks of BLOCK rows, so a large list is many tasks; a block gives counts and a spanning
    forest, never its pairs. Centroids come from a sample of at most MAX_TRAIN rows with the smallest hashes, codebooks from
    TRAIN_CODES of them; every row is indexed. The number of lists follows the number of rows (LIST_ROWS each, up to
    MAX_LISTS; lists grow beyond that). Vectors of different lengths have no cosine: each length has an index of its own.

    Vectors that are null, zero, or hold nulls or non-finite numbers have no links and are their own component. Rows that
    share an id are rows of their own (a link between them counts); null ids link like others and name a component only
    where it has no other id, kept is true there. Other columns do not matter. An empty table gives no rows.
    """
    given = vectors.schema[vector_col].dataType.simpleString()
    kind = given if given == "array<float>" else "array<double>"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(kind).alias("embedding"))
    good = F.expr("size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x <> 0)")
    rows = settled(rows.withColumn("good", F.coalesce(good, F.lit(False))))
    own = rows.where("not good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    distinct = rows.where("good").groupBy("embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    unique = numbered(distinct, "id", F.xxhash64("embedding"), "embedding")
    unique = settled(unique.withColumn("d", F.size("embedding")))
    lengths = unique.groupBy("d").agg(F.count("*").alias("n")).orderBy("d").collect()  # one row a length
    found = [_links(unique.where(F.col("d") == r["d"]).select("id", "copies", "embedding"), r["d"], r["n"], cosine, probes) for r in lengths if r["n"] > 1]
    classes = unique.select("embedding", "id", "least", "copies", F.lit(0).cast("long").alias("n"), F.col("id").alias("c"))
    if found:
        counts, forest = (reduce(DataFrame.unionByName, x) for x in zip(*found, strict=True))
        nodes = components(forest.select(F.col("id").alias("src"), F.col("root").alias("dst")))
        joined = unique.join(counts, "id", "left").join(nodes, F.col("id") == F.col("node"), "left")
        classes = settled(joined.select("embedding", "id", "least", "copies", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("component", "id").alias("c")))
    names = classes.groupBy("c").agg(F.min("least").alias("component_id"))
    named = classes.join(names, "c").select("embedding", (F.col("n") + F.col("copies") - 1).alias("n_links"), "component_id")
    kept = F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull())
    out = rows.where("good").select("vec_id", "embedding").join(named, "embedding").select("vec_id", "n_links", "component_id", kept.alias("kept"))
    return out.unionByName(own)
