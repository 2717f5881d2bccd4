"""Near-duplicate documents by SuperMinHash signatures, banding, exact verification and union-find.

SuperMinHash: every shingle carries a random permutation of the m registers and writes
rank + r at the register of each rank, r uniform in [0, 1); a register keeps its minimum. The
ranks of one shingle are correlated (each register gets another rank), which lowers the
variance below MinHash's. Ranks are visited in order and a document stops as soon as no
register can fall any further, so long documents need little more than one visit a shingle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, require, row_key, stored
from .components import connected_components
from .textkernel import U, Words, mix, shingles, slices, trimmed

BANDS, ROWS, WORDS, NUMERATOR, BLOCK = 32, 4, 5, 80, 256
#: Shingles of a block, beyond a single larger text.
BLOCK_SHINGLES = 400_000
_UNSET = np.uint32(0xFFFFFFFF)


def superminhash(elements: np.ndarray, offsets: np.ndarray, registers: int) -> np.ndarray:
    """Signatures (rows x registers, uint32: 8 bits of rank, 24 bits of r) of sets of 64-bit elements.

    Rows without elements keep the largest value throughout. registers: 255 at most.
    """
    m, rows = registers, len(offsets) - 1
    sig = np.full((rows, m), _UNSET, np.uint32)
    flat = sig.reshape(-1)
    live = np.repeat(np.arange(rows), np.diff(offsets))
    seeds, perm = elements, None
    for rank in range(m):
        if not len(live):
            break
        draw = mix(seeds + U((0x9E3779B97F4A7C15 * (rank + 1)) % 2**64))
        pick = (rank + (draw & U(0xFFFFFFFF)) % U(m - rank)).astype(np.int64) if rank else ((draw & U(0xFFFFFFFF)) % U(m)).astype(np.int64)
        value = (U(rank << 24) + (draw >> U(40))).astype(np.uint32)
        if perm is None:
            register = pick
        else:
            each = np.arange(len(live))
            register = perm[each, pick].astype(np.int64)
            perm[each, pick] = perm[:, rank]
        np.minimum.at(flat, live * m + register, value)
        open_rows = sig.max(axis=1) >= U((rank + 1) << 24)
        keep = open_rows[live]
        if perm is None:
            left = int(keep.sum())
            perm = np.tile(np.arange(m, dtype=np.uint8), (left, 1))
            perm[np.arange(left), pick[keep]] = 0
        elif not keep.all():
            perm = perm[keep]
        if not keep.all():
            live, seeds = live[keep], seeds[keep]
    return sig


def band_hashes(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit hash of each band of the signatures, different from band to band."""
    out = np.zeros((len(sig), bands), np.uint64)
    for k in range(rows):
        out = mix(out + sig[:, k : bands * rows : rows].astype(np.uint64) + U(k + 1))
    return mix(out + np.arange(1, bands + 1, dtype=np.uint64) * U(0xD1342543DE82EF95))


def _lists(values: np.ndarray) -> pa.Array:
    flat = pa.array(np.ascontiguousarray(values).reshape(-1).view(np.int64))
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]), flat)


def _sketch(words: int, bands: int, rows: int):
    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets, offs = shingles(Words(part.column(2)), words)
                sizes = np.diff(offs)
                one, two = np.zeros(len(sizes), np.uint64), np.zeros(len(sizes), np.uint64)
                full = np.flatnonzero(sizes)
                if len(full):
                    one[full] = np.add.reduceat(mix(sets + U(1)), offs[:-1][full])
                    two[full] = np.add.reduceat(mix(sets * U(3) + U(5)), offs[:-1][full])
                bandings = band_hashes(superminhash(sets, offs, bands * rows), bands, rows)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sizes.astype(np.int64)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), _lists(bandings)], ["rk", "doc_id", "n_shingles", "h1", "h2", "bands"])

    return run


def _links_within(texts: list[str], known: list[int], words: int, numerator: int) -> list[tuple[int, int]]:
    """Pairs with 100 * intersection >= numerator * union, on full sets, that join what `known`, the
    components so far, keeps apart: a spanning forest at most."""
    sets, offs = shingles(Words(pa.array(texts, pa.large_string())), words)
    sizes, n = np.diff(offs), len(texts)
    owner = np.repeat(np.arange(n), sizes)
    _, code, counts = np.unique(sets, return_inverse=True, return_counts=True)
    shared = counts[code] > 1
    code, owner = code[shared], owner[shared]
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    code = np.cumsum(np.concatenate(([0], code[1:] != code[:-1]))) if len(code) else code
    both = np.zeros((n, n), np.float32)
    for at in range(0, int(code[-1]) + 1 if len(code) else 0, 4096):
        a, b = np.searchsorted(code, (at, at + 4096))
        grid = np.zeros((n, 4096), np.float32)
        grid[owner[a:b], code[a:b] - at] = 1
        both += grid @ grid.T
    both = both.astype(np.int64)
    union = sizes[:, None] + sizes[None, :] - both
    one, two = np.nonzero(np.triu(100 * both >= numerator * union, 1) & (sizes[:, None] > 0))
    least: dict[int, int] = {}
    root = [least.setdefault(c, i) for i, c in enumerate(known)]

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    forest = []
    for i, j in zip(one.tolist(), two.tolist(), strict=True):
        p, q = find(i), find(j)
        if p != q:
            root[max(p, q)] = min(p, q)
            forest.append((i, j))
    return forest


def _verify(words: int, numerator: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["own", "node"])  # so tasks that share block 0 find the same links in it
        known = group["component"].tolist()
        found = _links_within(group["text"].tolist(), known, words, numerator)
        return pd.DataFrame({"a": [min(known[i], known[j]) for i, j in found], "b": [max(known[i], known[j]) for i, j in found]}, dtype="int64")

    return run


def _dealt(members: DataFrame, block: int) -> DataFrame:
    """hub, blocks for the groups of members (hub, node, size) that need more blocks than one."""
    blocks = F.ceil(F.greatest(F.count("*") / F.lit(block), F.sum("size") / F.lit(BLOCK_SHINGLES))).cast("int")
    return members.groupBy("hub").agg(F.least(blocks, F.count("*")).cast("int").alias("blocks")).where("blocks > 1")


def _links(members: DataFrame, dealt: DataFrame, texts: DataFrame, words: int, numerator: int, every: bool) -> DataFrame:
    """Verified links inside the groups of members (hub, node, component), as pairs (a, b) of components.

    A group is dealt into blocks (dealt: hub, blocks) by a hash of the node. Every block is
    compared with itself and with block 0, work that grows in proportion to the group; with
    `every`, all pairs of blocks are compared. A task holds two blocks at most.
    """
    spread = members.join(dealt, "hub", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("i", F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks")).cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(j, F.col("i")).alias("i"), F.greatest(j, F.col("i")).alias("j")))
    tasks = others if every else F.when(F.col("i") == 0, others).otherwise(F.array(F.struct(F.lit(0).alias("i"), F.col("i").alias("j"))))
    tasks = spread.select("hub", "node", "component", F.col("i").alias("own"), F.explode(tasks).alias("t"))
    full = tasks.join(texts.hint("merge"), "node").select("hub", "t.i", "t.j", "own", "node", "component", "text")
    return full.groupBy("hub", "i", "j").applyInPandas(_verify(words, numerator), "a long, b long")


def _joined(stars: DataFrame) -> DataFrame:
    """stars (star, hub, node, size) with each hub replaced by the least hub that it shares a bucket with itself,
    so the many stars of one cluster become one group; star keeps the bucket's own hub."""
    upper = stored(stars.groupBy(F.col("node").alias("hub")).agg(F.min("hub").alias("upper")))  # stored, so a hot hub's side can be split
    out = stored(stars.join(upper, "hub").select("star", F.least("hub", "upper").alias("hub"), "node", "size"))
    discard(upper, stars)
    return out


def near_duplicates(docs: DataFrame, words: int = WORDS, numerator: int = NUMERATOR, bands: int = BANDS, rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id, kept and rk (the row's key) for every row of docs (doc_id, text).

    Two rows are linked when 100 * |intersection| >= numerator * |union| of their distinct shingles of
    `words` words (A-Z lower-cased; fewer words make one shingle). component_id is the smallest
    doc_id reachable over links; kept marks the row that has it. Candidates share a band of the
    signature (at 0.8, 32 bands of 4 miss a pair with probability 5e-8); links are confirmed on full
    sets. Rows with equal sets are collapsed first, so copies cost one comparison altogether. doc_id is
    of any type that has an order.

    Null or wordless text: n_shingles 0, linked with nothing, kept. Null doc_id: linked with nothing,
    component_id null, kept. Repeated rows (same doc_id and text) are one document and share their
    fate. Empty tables give no rows; other columns are ignored.
    """
    require(docs, "doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    base = docs.select(row_key("doc_id", "text").alias("rk"), "doc_id", "text")
    sketch = stored(base.mapInArrow(_sketch(words, bands, rows), f"rk binary, doc_id {kind}, n_shingles long, h1 long, h2 long, bands array<long>"))
    able = sketch.where("n_shingles > 0 and doc_id is not null")
    # One node per distinct set, with the text of its first row. Nodes are numbered before they are stored, so none collide.
    sets = stored(able.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "rk")).alias("first"), F.first("n_shingles").alias("size"), F.first("bands").alias("bands")).select(F.monotonically_increasing_id().alias("node"), "h1", "h2", "first.doc_id", "first.rk", "size", "bands"))
    banded = sets.select("node", "size", F.explode("bands").alias("band"))
    hubs = banded.groupBy("band").agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1").select("band", "hub")
    # The joins that carry most rows are merge joins at every size, so their cost grows in proportion.
    stars = stored(banded.join(hubs.hint("merge"), "band").select(F.col("hub").alias("star"), "hub", "node", "size").distinct())
    wanted = sets.select("node", "rk").join(stars.select("node").distinct().hint("merge"), "node", "left_semi")
    texts = stored(base.select("rk", "text").join(wanted.hint("merge"), "rk").groupBy("node").agg(F.first("text").alias("text")))
    groups = _joined(_joined(stars))
    members = stored(groups.select("hub", "node", "size").distinct())
    dealt = stored(_dealt(members, block))
    labels = connected_components(_links(members.withColumn("component", F.col("node")), dealt, texts, words, numerator, False))
    named = sets.select("h1", "h2", "node", "doc_id").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    # Two nodes of one bucket are in one group. Groups of more than two blocks had only some pairs of
    # blocks compared: their buckets that are not yet one component have all pairs compared.
    large = dealt.where("blocks > 2").select("hub")
    doubtful = groups.join(large, "hub", "left_semi").select(F.col("star").alias("hub"), "node", "size").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    split = stored(doubtful.groupBy("hub").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("hub"))
    if split.limit(1).count():
        again = stored(doubtful.join(split, "hub", "left_semi").distinct())
        joined = connected_components(_links(again, stored(_dealt(again, block)), texts, words, numerator, True))
        named = named.join(joined.select(F.col("node").alias("component"), F.col("component").alias("joined")), "component", "left").withColumn("component", F.coalesce("joined", "component")).drop("joined")
        discard(again)
    named = stored(named)
    discard(texts, groups, members, dealt, split)
    least = stored(named.groupBy("component").agg(F.min("doc_id").alias("component_id")))
    of_set = stored(named.join(least, "component").select("h1", "h2", "component_id"))
    discard(named, least, sets)
    linked = able.select("rk", "doc_id", "n_shingles", "h1", "h2").join(of_set, ["h1", "h2"]).select("doc_id", "n_shingles", "component_id", "rk")
    alone = sketch.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "rk")
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))).select("doc_id", "n_shingles", "component_id", "kept", "rk")
