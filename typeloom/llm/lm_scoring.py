"""Documents scored by the cross-entropy difference of two n-gram models.

A target model (rows named as in-domain) and a background model (all rows) are matched: same
order, same smoothing, one vocabulary, which is every word of the corpus, so the models grow with the input.
score = background loss - target loss, in bits a token.

Rows are dealt into blocks. Each block counts its distinct n-grams and their contexts, sends them sorted by 64-bit
hash to buckets, where the blocks' counts are added up, and gets the sums of its own back.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import require
from .textkernel import _ODD, U, Words, mix

ORDER = 2
#: Bytes of text in a block, blocks whose counts make up a bucket, and the power of a context's count that its unseen successors weigh.
BLOCK_BYTES, BLOCKS_PER_BUCKET, HEAPS = 8_000_000, 2, 0.75


def _grams(column: pa.Array, order: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Keys of words, then of the contexts and n-grams of 2 to `order` tokens that end with the next one (contexts of
    single words are their words), and tokens of each row: a boundary, then the row's words.

    The boundary of the next row closes a row, so each token is once a context and once predicted. Tokens before a row are boundaries.
    """
    words = Words(column, cut=True, glyphs=True)
    tokens = np.diff(words.first) + 1
    stream = np.full(int(tokens.sum()), _ODD[3])
    stream[np.arange(len(words.starts)) + np.repeat(np.arange(1, len(tokens) + 1), tokens - 1)] = words.hashes()
    following = np.append(stream[1:], _ODD[3])
    place = np.arange(len(stream)) - np.repeat(np.cumsum(tokens) - tokens, tokens)
    context, more = stream, []
    for n in range(2, order + 1):
        if n > 2:
            before = np.full(len(stream), _ODD[3])
            before[n - 2 :] = stream[: len(stream) - n + 2]
            context = mix(context * _ODD[6] + mix(np.where(place >= n - 2, before, _ODD[3]) + _ODD[7]))
            more.append(mix(context + _ODD[8] * U(n)))
        more.append(mix(context * _ODD[4] + mix(following + _ODD[5] * U(n))))
    return mix(stream + _ODD[9]), more, tokens


def _buckets(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's keys begin in sorted keys (buckets + 1 entries)."""
    return np.searchsorted((keys >> U(32)) * U(buckets) >> U(32), np.arange(buckets + 1, dtype=np.uint64))


def _deflated(*columns: np.ndarray) -> bytes:
    """Unsigned 64-bit columns of one length, byte planes apart, compressed."""
    planes = np.concatenate([c.astype("<u8").view(np.uint8).reshape(-1, 8).T for c in columns])
    return len(columns[0]).to_bytes(8, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def _inflated(data: bytes, columns: int) -> list[np.ndarray]:
    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.decompress(data[8:], columns * 8 * n, "zstd", asbytes=True), np.uint8).reshape(columns, 8, n)
    return [np.ascontiguousarray(p.T).view("<u8").reshape(-1) for p in planes]


def _counted(buckets: int, order: int):
    """(docs of a block, its in-domain ids) to the block's distinct keys with their counts, by bucket. Key 0 counts all tokens."""

    def run(key: tuple, docs: pa.Table, good: pa.Table) -> pa.Table:
        docs = docs.combine_chunks()
        if not docs.num_rows:
            return pa.table({"block": pa.array([], pa.int32()), "bucket": pa.array([], pa.int32()), "counts": pa.array([], pa.binary())})
        words, more, tokens = _grams(docs.column("text"), order)
        inside = np.repeat(pc.is_in(docs.column("doc_id"), good.column("doc_id").combine_chunks()).to_numpy(), tokens)
        keys, background = np.unique(np.concatenate((words, *more, np.zeros(1, np.uint64))), return_counts=True)
        background[0] = len(words)
        target = np.zeros(len(keys), np.int64)
        own, seen = np.unique(np.concatenate([k[inside] for k in (words, *more)]), return_counts=True)
        target[np.searchsorted(keys, own)] = seen
        target[0] = inside.sum()
        at = _buckets(keys, buckets)
        some = np.flatnonzero(np.diff(at))
        sent = [_deflated(np.diff(keys[a:b], prepend=U(0)), background[a:b], target[a:b]) for a, b in zip(at[some].tolist(), at[some + 1].tolist(), strict=True)]
        return pa.table({"block": pa.array([key[0].as_py()] * len(some), pa.int32()), "bucket": pa.array(some, pa.int32()), "counts": pa.array(sent, pa.binary())})

    return run


def _summed(part: pa.Table) -> pa.Table:
    """Every block's keys of a bucket: their counts over all blocks, in the block's order."""
    got = [_inflated(c, 3) for c in part.column("counts").to_pylist()]
    keys, which = np.unique(np.concatenate([np.cumsum(g[0], dtype=np.uint64) for g in got]), return_inverse=True)
    background, target = (np.bincount(which, np.concatenate([g[k] for g in got]), len(keys)).astype(np.uint64) for k in (1, 2))
    ends = np.cumsum([len(g[0]) for g in got])
    back = [_deflated(background[w], target[w]) for w in np.split(which, ends[:-1])]
    return pa.table({"block": part.column("block"), "bucket": part.column("bucket"), "counts": pa.array(back, pa.binary())})


def _losses(docs: pa.Table, counts: pa.Table, order: int) -> pa.Table:
    words, more, tokens = _grams(docs.column("text"), order)
    which = np.unique(np.concatenate((words, *more, np.zeros(1, np.uint64))), return_inverse=True)[1]
    got = [_inflated(c, 2) for c in counts.sort_by("bucket").column("counts").to_pylist()]
    own = np.repeat(np.arange(len(tokens)), tokens)
    at, *rest = np.split(which[:-1], np.arange(1, len(more) + 1) * len(words))
    after = np.append(at[1:], at[0])
    background, target = (np.concatenate([g[k] for g in got]).astype(np.float64) for k in (0, 1))
    shared = background / background[0]  # of a word: its share of all tokens
    losses = []
    for count in (background, target):
        mass = np.maximum(1, count**HEAPS)
        chance = ((count + mass[0] * shared) / (count[0] + mass[0]))[after]
        for n in range(2, order + 1):
            context, gram = (at, rest[0]) if n == 2 else (rest[2 * n - 5], rest[2 * n - 4])
            chance = (count[gram] + mass[context] * chance) / (count[context] + mass[context])
        losses.append(np.bincount(own, -np.log2(chance), len(tokens)) / tokens)
    return pa.table({"doc_id": docs.column("doc_id"), "n_tokens": pa.array(tokens), "loss_target": losses[1], "loss_background": losses[0], "score": losses[0] - losses[1]})


def score_words(docs: DataFrame, in_domain: DataFrame, block_bytes: int = BLOCK_BYTES, order: int = ORDER) -> DataFrame:
    """doc_id, n_tokens, loss_target, loss_background, score for each row of docs (doc_id, text).

    in_domain (doc_id) names the target's rows; repeated and null ids there change nothing. Tokens are
    words with A-Z lower-cased, ASCII punctuation apart, every character of a script without blanks, and a
    boundary, so an empty or null text has one token. With c counts and m = max(1, c ** HEAPS),
    p(w | u v) = (c(u v w) + m(u v) p(w | v)) / (c(u v) + m(u v)), and so on down to p(w) = (c(w) + m q(w)) / (all + m), where q
    is w's share of all rows' tokens; both models alike. order: tokens of the longest n-grams. Losses are bits a
    token. Repeated rows count each time and score alike. Empty docs give no rows. Other columns are ignored.
    """
    require(docs, "doc_id", "text")
    blocks = max(1, -(-(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes))
    buckets = -(-blocks // BLOCKS_PER_BUCKET)

    def block(key: Column) -> Column:
        return F.pmod(key, F.lit(blocks)).cast("int").alias("block")

    kind = docs.schema["doc_id"].dataType
    mine = docs.select(block(F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id"))), "doc_id", "text")
    good = in_domain.where("doc_id is not null").select(F.col("doc_id").cast(kind).alias("doc_id")).distinct().select(block(F.xxhash64("doc_id")), "doc_id")
    table = "block int, bucket int, counts binary"
    counted = mine.groupBy("block").cogroup(good.groupBy("block")).applyInArrow(_counted(buckets, order), table)
    summed = counted.groupBy("bucket").applyInArrow(_summed, table)

    def scored(mine: pa.Table, sums: pa.Table) -> pa.Table:
        return _losses(mine.combine_chunks(), sums, order)

    return mine.groupBy("block").cogroup(summed.groupBy("block")).applyInArrow(scored, f"doc_id {kind.simpleString()}, n_tokens long, loss_target double, loss_background double, score double")
