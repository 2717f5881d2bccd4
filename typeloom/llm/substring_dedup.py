"""Repeated passages removed by sliding spans of sentences, and by word n-grams wherever they stand.

A sentence ends at `.`, `!` or `?` before white space and at a line's end. In a sentence of over
PIECE words a further end follows every later word whose hash says so (one in CUT), so a long
passage without punctuation holds several that don't depend on where it stands. A run counts if it has
SPAN sentences and LEAST_WORDS words at least. Of every sentence the shortest run that starts with it
and the shortest that ends with it are hashed to 128 bits and joined globally by hash; a sentence covered by any
repeated run that isn't the run's first occurrence (by doc_id, row key, position) is removed. The shortest
runs inside a longer one cover all of it and are repeated where it is, so the result is that of hashing every run.

Runs depend on where sentences end, so n-grams of GRAM words are hashed as well: of every
`passage` - GRAM + 1 neighbouring ones that with the smallest hash (winnowing), so two texts that share
`passage` words share a hash, whatever surrounds them. The words of a repeated n-gram are removed
as sentences are. Here every character of a script without blanks is a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import require, stored
from .textkernel import _ODD, U, Words, mix, power_tables, slices, trimmed

SPAN, PIECE, CUT, LEAST_WORDS, HOT = 2, 25, 6, 30, 1_000
GRAM, PASSAGE = 24, 51
#: Added to the size of a run that counts words, not sentences.
_IN_WORDS = 1 << 30
_STOP = np.zeros(256, bool)
_STOP[[33, 46, 63]] = True


def sentence_starts(words: Words, hashes: np.ndarray, piece: int = PIECE, cut: int = CUT) -> np.ndarray:
    """Index of the first word of each sentence; hashes: words.hashes()."""
    n = len(words.starts)
    if not n:
        return np.zeros(0, np.int64)
    lines = np.concatenate(([0], np.cumsum(words.raw == 10)))
    begins = np.ones(n, bool)
    begins[1:] = _STOP[words.raw[words.ends[:-1] - 1]] | (lines[words.starts[1:]] > lines[words.ends[:-1]])
    begins[words.first[:-1][words.first[:-1] < n]] = True
    at = np.flatnonzero(begins)
    place = np.arange(n) - np.repeat(at, np.diff(np.append(at, n)))
    begins[1:] |= (place[1:] > piece) & (hashes[:-1] % U(cut) == 0)
    return np.flatnonzero(begins)


def _extreme(of: np.ufunc, x: np.ndarray, size: int) -> np.ndarray:
    """of (minimum or maximum) over x[i : i + size] for each i; shorter at the end."""
    x, done = x.copy(), 1
    while done < size:
        step = min(done, size - done)
        kept = max(0, len(x) - step)
        x[:kept] = of(x[:kept], x[step:])
        done += step
    return x


def winnowed(words: Words, passage: int, gram: int = GRAM) -> tuple[np.ndarray, list[np.ndarray]]:
    """Index of the first word of each chosen n-gram, and two hashes of it.

    Of every passage - gram + 1 neighbouring n-grams of a row (all, if it has fewer) the smallest are chosen.
    """
    n, width = len(words.starts), passage - gram + 1
    hashes = words.hashes()
    power, inverse = power_tables(n + 1)
    both = []
    for salt in (_ODD[3], _ODD[4]):
        total = np.concatenate(([U(0)], np.cumsum(mix(hashes + salt) * power[:n])))
        both.append(mix((total[gram:] - total[: max(0, n + 1 - gram)]) * inverse[: max(0, n + 1 - gram)] + salt))
    code = both[0]
    row = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))[: len(code)]
    first, last = words.first[:-1][row], words.first[1:][row] - gram  # of the row's n-grams
    at = np.arange(len(code))
    least = _extreme(np.minimum, code, width)
    chosen = np.where(at + width - 1 <= last, least, U(0))
    chosen = _extreme(np.maximum, chosen[::-1], width)[::-1]  # the largest minimum of the windows that hold an n-gram
    few = np.flatnonzero((at == first) & (at <= last) & (last - first + 1 < width))
    for i in few.tolist():
        chosen[i : last[i] + 1] = code[i : last[i] + 1].min()
    own = np.flatnonzero((code == chosen) & (at <= last))
    return own, [b[own].view(np.int64) for b in both]


def shortest_runs(words: Words, at: np.ndarray, span: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last sentence of the shortest run that starts with each sentence, then of those that end with one and are others.

    at: index of the first word of each sentence. Runs stay in their row and have `span` sentences and `least` words at least.
    """
    many = len(at)
    ends = np.append(at[1:], len(words.starts))
    row = np.searchsorted(words.first, at, "right") - 1
    first = np.arange(many)
    last = np.maximum(np.searchsorted(ends, at + least), first + span - 1)
    fits = (last < many) & (row[np.minimum(last, many - 1)] == row)
    begin = np.minimum(np.searchsorted(at, ends - least, "right") - 1, first - span + 1)
    other = (begin >= 0) & (row[np.maximum(begin, 0)] == row) & (last[np.maximum(begin, 0)] != first)
    return np.concatenate((first[fits], begin[other])), np.concatenate((last[fits], first[other]))


def _runs(span: int, piece: int, least: int, passage: int | None):
    names = ["doc_id", "rk", "at", "size", "h1", "h2"]

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(part.column(2))
                hashes = words.hashes()
                at = sentence_starts(words, hashes, piece)
                many = len(at)
                if not many:
                    continue

                def placed(row: np.ndarray, at: np.ndarray, size: np.ndarray, both: list[np.ndarray]) -> pa.RecordBatch:
                    return pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), part.column(1).take(pa.array(row)), pa.array(at.astype(np.int32)), pa.array(size.astype(np.int32)), *map(pa.array, both)], names)  # noqa: B023

                if passage:
                    finer = Words(part.column(2), glyphs=True)
                    own, both = winnowed(finer, passage)
                    row = np.searchsorted(finer.first, own, "right") - 1
                    yield placed(row, own - finer.first[row], np.full(len(own), GRAM + _IN_WORDS), both)
                ends = np.append(at[1:], len(words.starts))
                place = np.arange(len(words.starts)) - np.repeat(at, ends - at)
                code = mix(np.add.reduceat(hashes * (mix(place.astype(np.uint64) + _ODD[0]) | U(1)), at) + (ends - at).astype(np.uint64))
                first, last = shortest_runs(words, at, span, least)
                size = last - first + 1
                power, inverse = power_tables(many + 1)
                both = []
                for salt in (_ODD[1], _ODD[2]):
                    total = np.concatenate(([U(0)], np.cumsum(mix(code + salt) * power[:many])))
                    both.append(mix((total[last + 1] - total[first]) * inverse[first] + size.astype(np.uint64) * salt).view(np.int64))
                row = np.searchsorted(words.first, at, "right") - 1
                yield placed(row[first], first - np.searchsorted(row, row[first]), size, both)

    return run


def _removed(piece: int):
    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(part.column(1))
                at = sentence_starts(words, words.hashes(), piece)
                of = np.searchsorted(at, words.first)
                texts, gone = part.column(1).to_pylist(), part.column(2).to_pylist()
                finer = Words(part.column(1), glyphs=True) if any(run & _IN_WORDS for out in gone if out for run in out) else words
                removed = [0] * len(texts)
                for r, out in enumerate(gone):
                    if out:
                        begin, end = int(words.offs[r]), int(words.offs[r + 1])
                        cuts = np.append(words.starts[at[of[r] : of[r + 1]]], end)
                        parts = np.append(finer.starts[finer.first[r] : finer.first[r + 1]], end)
                        drop = np.zeros(end - begin, bool)
                        for run in out:
                            places, i, size = (parts, run >> 32, run & (_IN_WORDS - 1)) if run & _IN_WORDS else (cuts, run >> 32, run & 0xFFFFFFFF)
                            drop[places[i] - begin : places[i + size] - begin] = True
                        removed[r] = int(np.logical_or.reduceat(drop, cuts[:-1] - begin).sum())
                        left = words.raw[begin:end][~drop].tobytes().decode("utf-8").rstrip()
                        texts[r] = left if not drop[cuts[0] - begin :].all() else ""
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string()), pa.array(np.diff(of)), pa.array(removed, pa.int64())], ["doc_id", "text", "n_sentences", "n_removed"])

    return run


def remove_repeated_spans(docs: DataFrame, span: int = SPAN, piece: int = PIECE, least_words: int = LEAST_WORDS, passage: int | None = None) -> DataFrame:
    """doc_id, text without repeated spans, n_sentences, n_removed for each row of docs (doc_id, text).

    Runs stay inside their document. Words compare with A-Z lower-cased and by any
    white space. The first occurrence stays everywhere, so a passage survives once. Null text stays
    null with 0 sentences; an empty text stays empty; where all sentences go, the text is empty.
    Repeated rows (same doc_id and text) count as one occurrence and are treated alike; rows of
    one doc_id with different texts are told apart. Null doc_ids come first. Other columns are ignored.
    passage: so many words (more than GRAM) that two places share are always found, though up to
    passage - GRAM of them may stay at either end if sentences end elsewhere; n_removed counts sentences that lose
    a word. None: runs of sentences only. A text's n-gram that overlaps its own first occurrence stays.
    """
    require(docs, "doc_id", "text")
    if passage is not None and passage <= GRAM:
        raise ValueError(f"a passage must have more than {GRAM} words")
    kind = docs.schema["doc_id"].dataType.simpleString()
    # A row is known by doc_id and rk together.
    base = docs.select("doc_id", F.xxhash64(F.lit(3), F.coalesce("text", F.lit(""))).alias("rk"), "text")
    runs = base.mapInArrow(_runs(span, piece, least_words, passage), f"doc_id {kind}, rk long, at int, size int, h1 long, h2 long")
    # Only counts meet all runs; first occurrences are sought among those that are repeated. A repeated row's runs are too, but are their own first.
    repeated = stored(runs.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1"))
    # A run with over 1 / HOT of the repeated rows (fewer than HOT runs) is dealt over several keys, each of about that share.
    share = F.ceil(F.col("n") * HOT / F.lit(repeated.agg(F.sum("n")).first()[0] or 1)).cast("int")
    dealt = repeated.withColumn("deals", share)
    hot = F.broadcast(stored(dealt.where("deals > 1").select("h1", "h2", "deals")))

    def key(deal: Column) -> Column:
        return F.when(F.col("deals") > 1, F.xxhash64("h2", deal)).otherwise(F.col("h2")).alias("key")

    mine = F.pmod(F.xxhash64("doc_id", "rk", "at"), F.col("deals")).cast("int")
    keyed = runs.join(hot, ["h1", "h2"], "left").select("doc_id", "rk", "at", "size", "h1", key(mine))
    keys = dealt.withColumn("deal", F.explode(F.sequence(F.lit(0), F.col("deals") - 1))).select("h1", "h2", key(F.col("deal")))
    found = stored(keyed.join(keys.hint("merge"), ["h1", "key"]))
    first = found.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "rk", "at")).alias("first")).select("h1", "h2", F.col("first.doc_id").alias("doc_id0"), F.col("first.rk").alias("rk0"), F.col("first.at").alias("at0"))
    firsts = first.join(keys, ["h1", "h2"]).drop("h2")
    again = found.join(firsts.hint("merge"), ["h1", "key"]).where(f"not (doc_id <=> doc_id0 and rk = rk0) or abs(at - at0) >= if(size >= {_IN_WORDS}, size - {_IN_WORDS}, 1)")
    # One number for each run, position and size; the positions it covers are spread out where the text is.
    # A set, as equal rows give equal runs: it holds no more than the runs of one text.
    gone = again.select("doc_id", "rk", F.shiftleft(F.col("at").cast("long"), 32).bitwiseOR(F.col("size").cast("long")).alias("s")).groupBy(F.col("doc_id").alias("doc_id1"), F.col("rk").alias("rk1")).agg(F.collect_set("s").alias("gone"))
    return base.join(gone.hint("merge"), F.col("doc_id").eqNullSafe(F.col("doc_id1")) & (F.col("rk") == F.col("rk1")), "left").select("doc_id", "text", "gone").mapInArrow(_removed(piece), f"doc_id {kind}, text string, n_sentences long, n_removed long")
