"""Approximate nearest neighbours by a forest of hash prefixes.

Each tree gives a vector a long string of symbols; a symbol is the nearest signed axis of a random
rotation onto SUBSPACE dimensions (a cross-polytope hash, 2 * SUBSPACE values). A tree is the
sorted array of its strings. A query descends every tree to its longest matching prefix and then
ascends all trees in step, to the greatest depth at which the trees together hold enough
candidates; all candidates at that depth are scored exactly, none is capped. How many are enough is
measured: the exact neighbours of a bounded sample of queries tell how many candidates find TARGET of them.

Trees are cut into cells, the shortest prefixes that hold at most CHUNK vectors. A query that stays
within its cell goes there alone, one that ascends above it to every cell under its prefix.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import require, stored

TREES, SUBSPACE, SYMBOLS, CHUNK, SEED = 20, 16, 5, 8_192, 11
#: Share of the exact neighbours that the candidates must hold, and queries of the sample that measures it.
TARGET, SAMPLE = 0.96, 128
_BITS = int(math.log2(2 * SUBSPACE))


def _rotations(dim: int, trees: int, symbols: int) -> np.ndarray:
    rng = np.random.default_rng(SEED)
    return np.stack([np.linalg.qr(rng.standard_normal((dim, max(1, min(SUBSPACE, dim)))))[0] for _ in range(trees * symbols)])


def _labels(dim: int, trees: int, symbols: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns = _rotations(dim, trees, symbols)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                vectors = np.asarray(part.column(1).flatten(), np.float64).reshape(-1, dim)
                label = np.zeros((trees, len(vectors)), np.int64)
                for t in range(trees):
                    for s in range(symbols):
                        turned = vectors @ turns[t * symbols + s]
                        axis = np.abs(turned).argmax(1)
                        label[t] = (label[t] << _BITS) | (2 * axis + (turned[np.arange(len(vectors)), axis] > 0))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(vectors) + 1, dtype=np.int32) * trees), pa.array(label.T.reshape(-1)))], ["rep", "labels"])

    return run


def _search(symbols: int, most: int):
    schema = {"query": "int64", "vec_id": "int64", "score": "float64"}

    def run(index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if index.empty or queries.empty:
            return pd.DataFrame([], columns=list(schema)).astype(schema)
        index = index.sort_values(["label", "rep"], kind="stable")
        label, ids = index["label"].to_numpy(), index["ids"].to_numpy()
        smallest = np.fromiter((x[0] for x in ids), np.int64, len(ids))
        vectors = np.stack(index["embedding"].to_numpy()).astype(np.float64)
        norms = np.sqrt((vectors * vectors).sum(1))
        out = []
        for query, own, depth, vector in zip(queries["rep"], queries["label"], queries["depth"], queries["vector"], strict=True):
            free = _BITS * (symbols - depth)
            low = (own >> free) << free
            a, b = np.searchsorted(label, (low, low + (1 << free)))
            if a == b:
                continue
            vector = np.asarray(vector, np.float64)
            near = vectors[a:b] @ vector / norms[a:b]
            keep = a + (np.argpartition(-near, 4 * most)[: 4 * most] if b - a > 4 * most else np.arange(b - a))
            if b - a > 4 * most:  # ties at the edge stay
                keep = a + np.flatnonzero(near >= near[keep - a].min() * (1 - 1e-12) - 1e-12)
            exact = (vectors[keep] * vector).sum(1) / (norms[keep] * np.sqrt((vector * vector).sum()))
            for i in np.lexsort((smallest[keep], -exact))[:most]:
                out += [(query, vec_id, exact[i]) for vec_id in ids[keep[i]]]
        return pd.DataFrame(out, columns=list(schema)).astype(schema)

    return run


def _prefix(label, depth, symbols: int):
    """Column: the first `depth` symbols of a label."""
    return F.shiftright(label, _BITS * (symbols - depth)) if isinstance(depth, int) else F.call_function("shiftright", label, (F.lit(symbols) - depth) * _BITS)


def _nearest_of(queries: np.ndarray, own: np.ndarray, most: int):
    """(query's place, rep, score): of each batch the `most` best rows for every query but itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rep = batch.column(0).to_numpy()
            vectors = np.asarray(batch.column(1).flatten(), np.float64).reshape(len(rep), -1)
            cos = queries @ (vectors / np.sqrt((vectors * vectors).sum(1))[:, None]).T
            cos[own[:, None] == rep] = -2
            best = np.argsort(-cos, 1, kind="stable")[:, :most]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(own), dtype=np.int32), best.shape[1])), pa.array(rep[best.reshape(-1)]), pa.array(np.take_along_axis(cos, best, 1).reshape(-1))], ["place", "rep", "score"])

    return run


def enough(vectors: DataFrame, labels: DataFrame, table: DataFrame, k: int, symbols: int, target: float = TARGET, sample: int = SAMPLE) -> int:
    """The fewest candidates, over all trees, that hold `target` of the k nearest of a sample of queries.

    vectors: k1, k2, rep, embedding, asked; labels: rep, labels; table: tree, label, n, depth. At most `sample` queries, their k
    neighbours and these rows' labels reach the driver, whatever the table's size.
    """
    asked = vectors.where("asked").orderBy("k1", "k2").limit(sample).select("rep", "embedding").join(labels, "rep").collect()
    if not asked:
        return 1
    own, queries = np.array([r.rep for r in asked]), np.array([r.embedding for r in asked], np.float64)
    queries /= np.sqrt((queries * queries).sum(1))[:, None]
    found = vectors.select("rep", "embedding").mapInArrow(_nearest_of(queries, own, k), "place int, rep long, score double")
    rank = F.row_number().over(Window.partitionBy("place").orderBy(F.desc("score"), "rep"))
    near = found.where("score > -2").withColumn("n", rank).where(F.col("n") <= k).join(labels, "rep").select("place", "labels").collect()
    if not near:
        return 1
    # The deepest prefix that a neighbour shares with its query in some tree.
    place = np.array([r.place for r in near])
    apart = np.array([r.labels for r in near], np.int64) ^ np.array([asked[p].labels for p in place], np.int64)
    reach = np.zeros(len(near), np.int64)
    for depth in range(1, symbols + 1):
        reach[((apart >> (_BITS * (symbols - depth))) == 0).any(1)] = depth
    paths = vectors.sparkSession.createDataFrame([(i, tree, depth, int(label) >> (_BITS * (symbols - depth))) for i, r in enumerate(asked) for tree, label in enumerate(r.labels) for depth in range(1, symbols + 1)], "place int, tree int, depth int, label long")
    held = np.zeros((len(asked), symbols + 1))
    for r in paths.join(table, ["tree", "depth", "label"]).groupBy("place", "depth").agg(F.sum("n").alias("n")).collect():
        held[r.place, r.depth] = r.n
    for least in np.unique(held[:, 1:]):
        depth = ((held >= least) * np.arange(symbols + 1)).max(1)
        if (reach >= depth[place]).mean() >= target:
            return int(least)
    return int(held.max()) + 1


def nearest(embeddings: DataFrame, is_query, k: int = 5, trees: int = TREES, target: float = TARGET, chunk: int = CHUNK) -> DataFrame:
    """query_id, rank, vec_id, score, depth: the k largest cosines found for each row of embeddings (vec_id, embedding) where is_query.

    Candidates: every other vec_id; ties go to the smaller. depth: symbols of the prefix that the query's
    candidates share with it in some tree; 0 is the root, all vectors. Null ids, and vectors
    that are null, zero, of another length than most, or hold null or non-finite components, take no
    part. Equal vectors are indexed once with their k + 1 smallest ids, so copies neither crowd
    a cell nor hide; repeated rows count once. A task holds at most about `chunk` vectors and as many queries. Fewer
    candidates than k give fewer rows; an empty table gives none. Other columns are ignored.
    """
    require(embeddings, "vec_id", "embedding")
    good = embeddings.select("vec_id", "embedding", is_query.alias("is_query")).where("vec_id is not null and embedding is not null and size(embedding) > 0").where(~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))).where(F.exists("embedding", lambda x: x != 0))
    sizes = good.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    spark = embeddings.sparkSession
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, depth int")
    dim, symbols = sizes[0].d, SYMBOLS
    keyed = good.where(F.size("embedding") == dim).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "is_query", F.xxhash64("embedding").alias("k1"), F.xxhash64(F.lit(1), "embedding").alias("k2"))
    low = Window.partitionBy("k1", "k2").orderBy("vec_id")
    smallest = keyed.select("k1", "k2", "vec_id").distinct().withColumn("n", F.row_number().over(low)).where(F.col("n") <= k + 1).groupBy("k1", "k2").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    first = keyed.groupBy("k1", "k2").agg(F.first("embedding").alias("embedding"))
    asked = stored(keyed.where("is_query").select(F.col("vec_id").alias("query_id"), "k1", "k2").distinct())
    # rep numbers the vectors, before they are stored, so none collide.
    vectors = stored(smallest.join(first, ["k1", "k2"]).join(asked.select("k1", "k2").distinct().withColumn("asked", F.lit(True)), ["k1", "k2"], "left").select("k1", "k2", F.monotonically_increasing_id().alias("rep"), "ids", "embedding", F.coalesce("asked", F.lit(False)).alias("asked")))
    labels = stored(vectors.select("rep", "embedding").mapInArrow(_labels(dim, trees, symbols), "rep long, labels array<long>"))
    strings = labels.select("rep", F.posexplode("labels").alias("tree", "label"))
    counts = [strings.groupBy("tree", "label").agg(F.count("*").alias("n")).withColumn("depth", F.lit(symbols))]
    for depth in range(symbols - 1, 0, -1):
        counts.append(counts[-1].groupBy("tree", F.shiftright("label", _BITS).alias("label")).agg(F.sum("n").alias("n")).withColumn("depth", F.lit(depth)))
    table = counts[0].select("tree", "label", "n", "depth")
    for c in counts[1:]:
        table = table.unionByName(c.select("tree", "label", "n", "depth"))
    table = stored(table)
    least = enough(vectors, labels, table, k, symbols, target)

    # Every string's cell: one symbol more than its longest prefix with over `chunk` vectors.
    crowded = stored(table.where(F.col("n") > chunk).select("tree", "label", "depth"))
    deepest = crowded.agg(F.max("depth")).first()[0] or 0
    celled = strings.withColumn("cell_depth", F.lit(1))
    if deepest:
        over = strings.withColumn("depth", F.explode(F.sequence(F.lit(1), F.lit(deepest)))).withColumn("prefix", _prefix(F.col("label"), F.col("depth"), symbols))
        over = over.join(crowded.withColumnRenamed("label", "prefix"), ["tree", "prefix", "depth"]).groupBy("rep", "tree").agg(F.max("depth").alias("over"))
        celled = strings.join(over, ["rep", "tree"], "left").select("rep", "tree", "label", F.least(F.coalesce(F.col("over") + 1, F.lit(1)), F.lit(symbols)).alias("cell_depth"))
    celled = stored(celled.withColumn("cell", _prefix(F.col("label"), F.col("cell_depth"), symbols)))
    cells = stored(celled.groupBy("tree", "cell_depth", "cell").agg(F.ceil(F.count("*") / chunk).cast("int").alias("chunks")))
    under = cells.withColumn("kept_depth", F.explode(F.sequence(F.lit(0), F.col("cell_depth")))).withColumn("kept", F.call_function("shiftright", F.col("cell"), (F.col("cell_depth") - F.col("kept_depth")) * _BITS))

    # Depths of queries, and the cells under the prefixes that they keep.
    queries = vectors.where("asked").select("rep").join(celled, "rep")
    paths = queries.withColumn("depth", F.explode(F.sequence(F.lit(1), F.lit(symbols)))).select("rep", "tree", "depth", _prefix(F.col("label"), F.col("depth"), symbols).alias("label"))
    held = paths.join(table, ["tree", "label", "depth"]).groupBy("rep", "depth").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    depths = held.groupBy("rep").agg(F.max("depth").alias("depth"))
    queries = stored(queries.join(depths, "rep", "left").withColumn("depth", F.coalesce("depth", F.lit(0))).where("depth > 0 or tree = 0"))
    kept = queries.select("rep", "tree", "label", "depth", F.least("depth", "cell_depth").alias("kept_depth")).withColumn("kept", _prefix(F.col("label"), F.col("kept_depth"), symbols))
    routed = kept.join(under, ["tree", "kept_depth", "kept"]).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select("rep", "label", "depth", "tree", "cell_depth", "cell", "chunk")
    routed = stored(routed)
    group = ["tree", "cell_depth", "cell", "chunk"]
    # Where more than `chunk` queries meet in one part, they are dealt over several copies of it.
    parts = stored(routed.groupBy(*group).agg(F.ceil(F.count("*") / chunk).cast("int").alias("copies")))
    mine = celled.join(cells, ["tree", "cell_depth", "cell"]).withColumn("chunk", F.pmod(F.xxhash64("rep", F.lit(5)), F.col("chunks")).cast("int"))
    index = mine.join(parts, group).join(vectors.select("rep", "ids", "embedding").hint("merge"), "rep").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).select("rep", "label", "ids", "embedding", *group, "copy")
    sought = routed.join(parts, group).withColumn("copy", F.pmod(F.xxhash64("rep", F.lit(6)), F.col("copies")).cast("int")).join(vectors.where("asked").select("rep", F.col("embedding").alias("vector")), "rep").select("rep", "label", "depth", "vector", *group, "copy")
    found = index.groupBy(*group, "copy").cogroup(sought.groupBy(*group, "copy")).applyInPandas(_search(symbols, k + 1), "query long, vec_id long, score double")
    hits = found.groupBy("query", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    hits = hits.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).drop("n").join(queries.select(F.col("rep").alias("query"), "depth").distinct(), "query")
    own = asked.join(vectors.select("k1", "k2", F.col("rep").alias("query")), ["k1", "k2"]).select("query_id", "query")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return own.join(hits, "query").where("query_id <> vec_id").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "depth")
