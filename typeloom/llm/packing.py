"""Hierarchical multi-length packing of tokenised documents into power-of-two windows.

Documents are routed to tiers by size: whole windows of the longest tier first, then the rest
to the shortest window that holds it. From the longest tier down, every window's gap is filled
with the largest waiting documents of shorter tiers that fit, and at last by cutting one, so
windows hold no padding. What is left when a group ends is cut at powers of two. The windows of
a tier are dealt into step groups of equal tokens, balanced by their attention cost.
"""

from __future__ import annotations

import json
import os
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import require
from .textkernel import Words, slices, text_bytes, trimmed

TIERS, END, STEP_TOKENS, GROUP_TOKENS, CACHE, SLICE, ENCODED = (2048, 1024, 512, 256), 1, 16_384, 4_000_000, 400_000, 1_500_000, 4_096
# The form of tokenizers whose words can be encoded one by one.
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
WORD = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long, step_group long"


def by_words(path: str) -> bool:
    """Whether the tokenizer's file says that it lower-cases, drops white space and cuts by WORD, so that a text's ids are its words' ids."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    steps = (spec.get("normalizer") or {}).get("normalizers") or []
    cuts = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    blank = [x.get("content") for x in steps if x["type"] == "Replace" and x.get("pattern") == {"Regex": r"\s+"}]
    first, rest = cuts[0], cuts[1:]
    cut = (first.get("type"), first.get("pattern"), first.get("behavior"), first.get("invert")) == ("Split", {"Regex": WORD}, "Removed", True)
    return [x["type"] for x in steps] == NORMALIZERS and blank == [" "] and cut and all(x["type"] == "ByteLevel" and not x["add_prefix_space"] and not x["use_regex"] for x in rest)


class WordTokenizer:
    """Token ids of whole texts, with the distinct words of a batch encoded once.

    Only for tokenizers of the form that by_words() finds: words part at white space, and ASCII letters and digits
    from other ASCII punctuation than the apostrophe. All others encode whole texts. Texts that may hold a
    special token's string are split at white space only and not folded, so the tokenizer finds it.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_words = by_words(path)
        self.clear()

    def clear(self) -> None:
        self.keys, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # known words, sorted by key
        self.sizes, self.pool = np.zeros(0, np.int32), np.zeros(0, np.int32)

    def _encode(self, raw: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and ids of the words raw[starts:ends], ENCODED at a time."""
        sizes, ids = [self.sizes[:0]], [self.pool[:0]]
        for at in range(0, len(starts), ENCODED):
            words = [raw[s:e].decode("utf-8", "replace") for s, e in zip(starts[at : at + ENCODED].tolist(), ends[at : at + ENCODED].tolist(), strict=True)]
            got = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
            sizes.append(np.fromiter(map(len, got), np.int32, len(got)))
            ids.append(np.fromiter(chain.from_iterable(got), np.int32))
        return np.concatenate(sizes), np.concatenate(ids)

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """ids of all rows one after the other, and the offset of each row in them."""
        if not self.by_words:
            got = [e.ids for e in self.tokenizer.encode_batch_fast(column.fill_null("").to_pylist(), add_special_tokens=False)]
            return np.fromiter(chain.from_iterable(got), np.int32), np.concatenate(([0], np.cumsum([len(x) for x in got], dtype=np.int64)))
        raw = text_bytes(column)[0].tobytes()
        plain = b"<|" not in raw
        words = Words(column, cut=plain)
        keys, first, which = np.unique(words.hashes(lower=plain), return_index=True, return_inverse=True)
        if len(self.keys) > CACHE:
            self.clear()
        place = np.searchsorted(self.keys, keys)
        held = place < len(self.keys)
        held[held] = self.keys[place[held]] == keys[held]
        new = np.flatnonzero(~held)
        added = np.arange(len(new)) + len(self.sizes)
        sizes, ids = self._encode(raw, words.starts[first[new]], words.ends[first[new]])
        self.keys, self.slots = np.insert(self.keys, place[new], keys[new]), np.insert(self.slots, place[new], added)
        self.sizes, self.pool = np.concatenate((self.sizes, sizes)), np.concatenate((self.pool, ids))
        slot = self.slots[np.searchsorted(self.keys, keys)][which]
        sizes = self.sizes[slot]
        after = np.concatenate(([0], np.cumsum(sizes)))
        pool_at = np.cumsum(self.sizes) - self.sizes
        ids = self.pool[np.repeat(pool_at[slot] - after[:-1], sizes) + np.arange(after[-1])]
        return ids, after[words.first]


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer_for(path: str) -> WordTokenizer:
    """The worker's tokenizer of this file, with the words it has met in earlier tasks."""
    if path not in _tokenizers:
        _tokenizers.clear()
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def pack(sizes: list[int], tiers: tuple[int, ...] = TIERS) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Windows (length, [(document, start, length)]) that hold every token of documents of these sizes once."""
    top, done = tiers[0], []
    waiting: dict[int, list[tuple[int, int]]] = {}
    lengths: list[int] = []

    def put(doc: int, start: int, size: int) -> None:
        if size not in waiting:
            waiting[size] = []
            insort(lengths, size)
        waiting[size].append((doc, start))

    def take(size: int) -> tuple[int, int]:
        found = waiting[size].pop()
        if not waiting[size]:
            del waiting[size], lengths[bisect_left(lengths, size)]
        return found

    for doc, size in enumerate(sizes):
        for k in range(size // top):
            done.append((top, [(doc, k * top, top)]))
        if size % top:
            put(doc, size - size % top, size % top)
    while lengths:
        size = lengths[-1]
        window = min(t for t in tiers if t >= size)
        doc, start = take(size)
        pieces, gap = [(doc, start, size)], window - size
        while gap and lengths:
            fits = bisect_right(lengths, gap)
            size = lengths[fits - 1] if fits else lengths[-1]
            doc, start = take(size)
            pieces.append((doc, start, min(size, gap)))
            if size > gap:
                put(doc, start + gap, size - gap)
            gap -= min(size, gap)
        if not gap:
            done.append((window, pieces))
            continue
        left = window - gap
        while left:
            part = min(top, 1 << (left.bit_length() - 1))
            own, room = [], part
            while room:
                doc, start, size = pieces.pop(0)
                own.append((doc, start, min(size, room)))
                if size > room:
                    pieces.insert(0, (doc, start + room, size - room))
                room -= min(size, room)
            done.append((part, own))
            left -= part
    return done


def step_groups(windows: list[tuple[int, list[tuple[int, int, int]]]], tokens: int) -> list[int]:
    """A group for each window: groups of one tier hold `tokens` tokens (the last may hold fewer), dealt
    to and fro by attention cost."""
    group, base = [0] * len(windows), 0
    for length in sorted({w for w, _ in windows}, reverse=True):
        own = sorted((i for i, (w, _) in enumerate(windows) if w == length), key=lambda i: (-sum(n * n for _, _, n in windows[i][1]), i))
        many = -(-len(own) * length // tokens)
        for k, i in enumerate(own):
            lap, at = divmod(k, many)
            group[i] = base + (many - 1 - at if lap % 2 else at)
        base += many
    return group


def packed(docs: DataFrame, tokenizer: str, id_column: str = "doc_id", tiers: tuple[int, ...] = TIERS, end: int = END, step_tokens: int = STEP_TOKENS, group_tokens: int = GROUP_TOKENS, in_order: bool = False) -> DataFrame:
    """One row for each piece: the document's id and PIECES.

    docs needs the id column and text. tokenizer is the path of a tokenizers file, the same on all
    machines; `end` closes every document. Null or empty text: the end id alone. Repeated rows are
    packed each by itself; a null id is carried through; no rows give no pieces; other columns are
    ignored. Every partition packs its rows in groups of about group_tokens tokens, so memory is
    bounded and nothing is shuffled; only the end of a group falls below the shortest tier.
    sequence_id and step_group are unique: partition number and a counter. in_order: the rows' order
    counts; groups end as soon as they hold group_tokens, and their sequences are numbered by first document.
    """
    require(docs, id_column, "text")
    tiers = tuple(sorted(tiers, reverse=True))
    if any(t & (t - 1) for t in tiers):
        raise ValueError("tiers must be powers of two")

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenize = tokenizer_for(tokenizer)
        where = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        rows: list[tuple[object, np.ndarray]] = []
        held, sequences, groups = 0, where, where

        def flush() -> pa.RecordBatch:
            nonlocal sequences, groups
            windows = pack([len(ids) for _, ids in rows], tiers)
            if in_order:
                windows.sort(key=lambda w: min(doc for doc, _, _ in w[1]))
            dealt = step_groups(windows, step_tokens)
            out: list[tuple] = []
            for k, (length, pieces) in enumerate(windows):
                offset = 0
                for doc, start, size in pieces:
                    name, ids = rows[doc]
                    out.append((name, start, size, zlib.crc32(ids[start : start + size].astype("<u4").tobytes()), len(ids), sequences + k, offset, length, groups + dealt[k]))
                    offset += size
            sequences += len(windows)
            groups += max(dealt, default=-1) + 1
            columns = list(zip(*out, strict=True)) or [()] * 9
            kind = names_type or pa.int64()
            return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *(pa.array(c, pa.int64()) for c in columns[1:])], [id_column, *(f.split()[0] for f in PIECES.split(", "))])

        names_type = None
        for batch in batches:
            names_type = batch.column(0).type
            for part in slices(batch, "text", SLICE):
                ids, offs = tokenize(part.column(1))
                for k, name in enumerate(part.column(0).to_pylist()):
                    rows.append((name, np.append(ids[offs[k] : offs[k + 1]], np.int32(end))))
                    held += len(rows[-1][1])
                    if in_order and held >= group_tokens:
                        yield flush()
                        rows, held = [], 0
                if held >= group_tokens:
                    yield flush()
                    rows, held = [], 0
        if rows:
            yield flush()

    schema = f"{id_column} {docs.schema[id_column].dataType.simpleString()}, {PIECES}"
    return docs.select(id_column, "text").mapInArrow(run, schema)
