"""Language identification by cross-parsing against suffix automata of labelled text.

The automaton of a language accepts exactly the substrings of its training text. A document
is parsed greedily into the longest phrases found there (Ziv and Merhav's cross-parsing);
phrases * log2(training length) / document length estimates the cross entropy, and the language
that needs the fewest bits wins. No phrase costs less than a letter of the common alphabet, and a
symbol that a sample lacks costs a phrase of the longest sample, so a short sample has no advantage.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import require, stored
from .textkernel import code_points, slices, trimmed

UNKNOWN = "und"
#: Fitting reads at most this many rows a language, and this many characters of them.
ROWS_PER_LANGUAGE, CHARS_PER_LANGUAGE = 256, 16_384
#: A row gives at most this many pieces, spread over its whole text.
PIECES = 16
#: So many times the rows of a sample are drawn by hash before they are ranked.
DRAWN = 8
#: So many letters have one symbol each; rarer ones of a sample have two, dealt in the order of their code points.
SINGLES, LANE, SLICE = 53, 512, 1_500_000
#: A letter of no sample shares the first symbol of a rarer one this near by.
NEAR = 64
_cache: dict[int, tuple] = {}


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the smallest automaton of all substrings; state 0 is the root."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        new = len(moves)
        moves.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(moves)
                moves.append(dict(moves[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return moves


def _fold(texts: pa.Array, classes: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of lower-cased texts (runs of non-letters are one 0), offsets, whether a row has a letter."""
    points, offs = code_points(pc.utf8_lower(texts.cast(pa.large_string()).fill_null("")))
    points = np.minimum(points, len(classes) - 1)
    symbols = classes[points]
    keep = symbols > 0
    letters = np.concatenate(([0], np.cumsum(keep)))[offs]
    keep[1:] |= symbols[:-1] > 0
    keep[offs[:-1][offs[:-1] < len(symbols)]] = True
    before = np.concatenate(([0], np.cumsum(keep)))
    symbols, offs = symbols[keep], before[offs]
    more = second[points[keep]]
    if more.any():
        at = np.concatenate(([0], np.cumsum(1 + (more > 0))))
        both = np.empty(at[-1], symbols.dtype)
        both[at[:-1]] = symbols
        both[at[1:][more > 0] - 1] = more[more > 0]
        symbols, offs = both, at[offs]
    return symbols, offs, np.diff(letters) > 0


def _alphabet(samples: dict[str, str]) -> tuple[np.ndarray, np.ndarray, int]:
    """The first and second symbol (0: none) of every code point, and the number of symbols.

    0 is what isn't a letter, 1 a letter of no sample. The SINGLES most frequent letters have a symbol
    each; the others two of about the square root of their number, so all letters of the samples differ.
    """
    count = Counter(c for text in samples.values() for c in text.lower() if c.isalpha())
    ranked = [ord(c) for c, _ in sorted(count.items(), key=lambda x: (-x[1], x[0]))]
    rare = np.array(sorted(ranked[SINGLES:]), np.int64)
    side = math.isqrt(max(0, len(rare) - 1)) + 1 if len(rare) else 0
    singles = min(SINGLES, len(ranked))
    symbols = 2 + singles + (2 * side + 1 if side else 0)
    first, second = (np.zeros(0x110000, np.min_scalar_type(symbols)) for _ in range(2))
    letters = np.flatnonzero(np.fromiter((chr(i).isalpha() for i in range(len(first))), bool, len(first)))
    first[letters] = 1
    if side:
        place = np.searchsorted(rare, letters)
        low, high = np.maximum(place - 1, 0), np.minimum(place, len(rare) - 1)
        near = np.where(np.abs(letters - rare[low]) <= np.abs(letters - rare[high]), low, high)
        close = np.abs(letters - rare[near]) <= NEAR
        first[letters[close]] = 2 + singles + near[close] // side
        second[letters[close]] = symbols - 1
        first[rare] = 2 + singles + np.arange(len(rare)) // side
        second[rare] = 2 + singles + side + np.arange(len(rare)) % side
    for k, c in enumerate(ranked[:SINGLES]):
        first[c], second[c] = 2 + k, 0
    return first, second, symbols


def _machines(samples: dict[str, str]) -> tuple:
    """(languages, alphabet, table, roots, columns, bits): one table for all automata.

    A state is the place of its row in the table; a row has a column for each symbol of its sample, one for
    all others (0) and one for padding (the last). columns: of every symbol and padding for each language. An entry
    is next state << 2 | phrases ended.
    """
    key = hash(tuple(samples.items()))
    if key not in _cache:
        first, second, many = _alphabet(samples)
        tables, roots, columns, bits, base = [], [], [], [], 0
        for text in samples.values():
            symbols, _, _ = _fold(pa.array([text]), first, second)
            own = np.unique(symbols)
            own = own[own != 1]
            column = np.zeros(many + 1, np.int32)
            column[own] = np.arange(1, len(own) + 1)
            column[many] = width = len(own) + 1
            width += 1
            moves = suffix_automaton(column[symbols].tolist())
            table = np.full((len(moves), width), -1, np.int64)
            for state, out in enumerate(moves):
                for c, to in out.items():
                    table[state, c] = (base + to * width) << 2
            table[:, 0] = -1
            root = table[0].copy()
            fresh = np.where(root >= 0, root | 1, base << 2 | 2)
            table = np.where(table >= 0, table, fresh)
            table[0] = np.where(root >= 0, root, base << 2 | 1)
            table[:, -1] = (base + np.arange(len(moves)) * width) << 2
            tables.append(table.astype(np.int32).reshape(-1))
            roots.append(base)
            columns.append(column)
            bits.append(np.log2(max(2, len(symbols))))
            base += table.size
            if base >= 1 << 29:
                raise ValueError(f"the automata of {len(samples)} languages don't fit one table; give fewer characters of each")
        _cache.clear()
        _cache[key] = (list(samples), (first, second), np.concatenate(tables), np.array(roots, np.int32), np.stack(columns), np.array(bits))
    return _cache[key]


def _parse(texts: pa.Array, samples: dict[str, str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Phrases and symbols absent from the sample (rows x languages), symbols of each row, whether it has a letter.

    Whole texts are parsed in lanes of LANE symbols side by side, each as if a phrase began with it. Then lanes are
    parsed again from the state in which the lane before them ended, only until they meet their first parse, for as long as a
    lane's end still changes: the phrases are those of one parse of the whole text.
    """
    languages, alphabet, table, roots, columns, _ = _machines(samples)
    symbols, offs, letter = _fold(texts, *alphabet)
    sizes = np.diff(offs)
    lanes = -(-sizes // LANE)
    first = np.concatenate(([0], np.cumsum(lanes)))
    row = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(symbols)) - offs[row]
    pad = columns.shape[1] - 1
    grid = np.full((LANE, int(first[-1])), pad, np.min_scalar_type(pad))
    grid[place % LANE, first[row] + place // LANE] = symbols
    states = np.empty((LANE + 1, len(roots), grid.shape[1]), np.int32)  # before each symbol, and at the end
    states[0] = roots[:, None]
    phrases = np.zeros(states.shape[1:], np.int32)
    for k, symbol in enumerate(grid):
        move = table[states[k] + columns[:, symbol]]
        phrases += move & 3
        states[k + 1] = move >> 2
    if not len(sizes):
        return np.zeros((0, len(languages))), np.zeros((0, len(languages))), sizes, letter
    follows = np.ones(grid.shape[1], bool)
    follows[first[:-1][first[:-1] < grid.shape[1]]] = False
    wrong = np.zeros(phrases.shape, bool)
    wrong[:, 1:] = states[LANE][:, :-1] != states[0][:, 1:]
    wrong &= follows
    while wrong.any():
        lang, lane = np.nonzero(wrong)
        state = states[LANE][lang, lane - 1]
        ends = states[LANE].copy()
        for k in range(LANE):
            own = states[k][lang, lane]
            apart = state != own
            if not apart.any():
                break
            lang, lane, state, own = lang[apart], lane[apart], state[apart], own[apart]
            column = columns[lang, grid[k, lane]]
            move, was = table[state + column], table[own + column]
            states[k][lang, lane] = state
            phrases[lang, lane] += (move & 3) - (was & 3)
            state = move >> 2
            if k == LANE - 1:
                states[LANE][lang, lane] = state
        changed = (states[LANE] != ends)[:, :-1]
        wrong[:] = False
        wrong[:, 1:] = changed & follows[1:]
    owner = np.repeat(np.arange(len(sizes)), lanes)
    absent = np.stack([np.bincount(row, (c == 0)[symbols], len(sizes)) for c in columns], 1)
    # A phrase is still open at a text's end unless an absent symbol was the last.
    full = sizes > 0
    unfinished = np.zeros((len(sizes), len(languages)))
    unfinished[full] = (states[LANE][:, first[1:][full] - 1] != roots[:, None]).T
    return np.stack([np.bincount(owner, p, len(sizes)) for p in phrases], 1) + unfinished, absent, sizes, letter


def cross_parse(texts: pa.Array, samples: dict[str, str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Normalised phrases (rows x languages), symbols of each row, whether it has a letter."""
    phrases, _, sizes, letter = _parse(texts, samples)
    return phrases * _machines(samples)[-1] / np.maximum(sizes, 1)[:, None], sizes, letter


def costs(texts: pa.Array, samples: dict[str, str]) -> tuple[np.ndarray, np.ndarray]:
    """Bits a symbol (rows x languages), whether a row has a letter. Every language is charged alike for what its sample lacks."""
    phrases, absent, sizes, letter = _parse(texts, samples)
    bits = _machines(samples)[-1]
    least = np.log2(1 + len({c for text in samples.values() for c in text.lower() if c.isalpha()}))
    own = np.maximum(bits, least)
    return (phrases * own + absent * (own.max() - own)) / np.maximum(sizes, 1)[:, None], letter


def learn(labelled: DataFrame, rows: int = ROWS_PER_LANGUAGE, chars: int = CHARS_PER_LANGUAGE) -> dict[str, str]:
    """A training text for each lang of labelled (doc_id, text, lang), from a bounded sample.

    The sample is the `rows` usable documents with the smallest hash of each language, among about DRAWN times as many that
    the hash alone draws, so ranking reads no more however large the table is. Of each, runs of other
    characters than letters count as one blank, and up to PIECES pieces of an equal share of `chars` (64 at least)
    are spread over the whole text. Every row begins with the piece that its hash says and goes round from there; all rows
    give one piece, then all a second, until `chars` are together; null lang, null or letterless text takes no part. The result
    (languages x chars characters) is the whole model; automata are built where they are used.
    """
    require(labelled, "doc_id", "text", "lang")
    share = max(64, chars // rows)
    known = labelled.where("lang is not null and text is not null").select("lang", F.xxhash64("doc_id").alias("h"), "text")
    part = stored(known.groupBy("lang").agg((F.lit(float(DRAWN * rows)) / F.count("*")).alias("part")))  # stored, so its size is known
    drawn = known.join(part, "lang").where(F.col("h") / F.lit(2.0**64) + 0.5 <= F.col("part"))
    usable = drawn.select("lang", "h", F.trim(F.regexp_replace("text", "\\P{L}+", " ")).alias("text")).where("text <> ''")
    sized = usable.withColumn("size", F.length("text")).withColumn("many", F.least(F.lit(PIECES), F.ceil(F.col("size") / share)).cast("int"))
    gap = (F.col("size") - share) / F.greatest(F.col("many") - 1, F.lit(1))
    pieces = sized.select("lang", "h", F.transform(F.sequence(F.lit(0), F.col("many") - 1), lambda k: F.substring("text", F.greatest(F.lit(1), F.floor(k * gap).cast("int") + 1), F.lit(share))).alias("pieces"))
    order = Window.partitionBy("lang").orderBy("h", "pieces")
    found: dict[str, list[list[str]]] = {}
    for lang, h, own in pieces.withColumn("n", F.row_number().over(order)).where(F.col("n") <= rows).orderBy("lang", "n").select("lang", "h", "pieces").collect():
        found.setdefault(lang, []).append(own[h % len(own) :] + own[: h % len(own)])
    return {lang: "\n".join(own[k] for k in range(PIECES) for own in texts if k < len(own))[:chars] for lang, texts in found.items()}


def identify(docs: DataFrame, samples: dict[str, str]) -> DataFrame:
    """docs (any columns, among them text) with lang_pred and score, one row for each.

    score is 1 - best / second best of the bits needed, 0 to 1. Null, empty or
    letterless text, or no samples at all: `und` and 0. Ties go to the first language by name.
    Existing columns lang_pred and score are replaced. Row order and other columns stay.
    """
    require(docs, "text")
    docs = docs.drop("lang_pred", "score")
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    samples = dict(sorted(samples.items()))

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                names, scores = [UNKNOWN] * part.num_rows, np.zeros(part.num_rows)
                if samples:
                    bits, letter = costs(part.column(part.schema.get_field_index("text")), samples)
                    two = np.sort(bits, 1)[:, :2]
                    best = bits.argmin(1)
                    languages = list(samples)
                    names = [languages[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), letter.tolist(), strict=True)]
                    scores = np.clip(1 - two[:, 0] / two[:, -1], 0, 1) if two.shape[1] > 1 else np.ones(len(two))
                    scores = np.where(letter, scores, 0.0)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names, pa.string()), pa.array(scores)], [*part.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, schema)
