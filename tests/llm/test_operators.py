"""The training-data operators against brute force, on small hand-made tables with every odd case."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from typeloom.llm import ann, components, language_id, line_dedup, lm_scoring, media, mixing, near_dedup, packing, queries, substring_dedup, textkernel, url_filter

DRAW = random.Random(5)
VOCABULARY = [f"w{i}" for i in range(400)]


def words(n):
    return [DRAW.choice(VOCABULARY) for _ in range(n)]


def changed(text, share):
    return " ".join(DRAW.choice(VOCABULARY) if DRAW.random() < share else w for w in text.split())


def corpus():
    base = [" ".join(words(n)) for n in (3, 6, 30, 60, 200, 900)]
    texts = [None, "", "  \n\t", "a", "A", "a b", "A  b", "x" * 5000, *base, *base]
    for t in base[2:]:
        texts += [changed(t, s) for s in (0.01, 0.02, 0.03, 0.05, 0.05, 0.1)]
    texts += [f"{base[3]} {' '.join(words(k))}" for k in range(0, 20, 3)] + [base[4].upper(), base[4].replace(" ", "\n")]
    return [(i, t) for i, t in enumerate(texts)]


def frame(spark, rows, schema, more=True):
    """With extra columns whose names clash with what operators make."""
    df = spark.createDataFrame(rows, schema)
    return df.withColumns({c: F.lit("extra") for c in ("score", "component_id", "n_removed", "slot", "place", "n", "h1", "start", "rank") if c not in df.columns}) if more else df


def test_words_and_hashes():
    texts = ["Ab  cD\x0be", None, "", " x", "\u00a0y z", "e\x1cf"]
    w = textkernel.Words(pa.array(texts))
    got = [w.raw[a:b].tobytes() for a, b in zip(w.starts, w.ends, strict=True)]
    assert got == [x for t in texts if t for x in t.encode().split()]
    assert w.first.tolist() == [0, 3, 3, 3, 4, 6, 7]
    h = textkernel.Words(pa.array(["ab AB ba", "ab"])).hashes()
    assert h[0] == h[1] == h[3] != h[2]
    sliced = pa.array(["zz", "ab", None, "q ab"])[1:]
    assert textkernel.Words(sliced).hashes()[[0, 2]].tolist() == [h[0], h[0]]


def test_superminhash_estimates_similarity():
    draw = np.random.default_rng(3)
    for share in (0.3, 0.6, 0.9):
        both, own = int(400 * share), int(400 * (1 - share) / 2)
        x = draw.integers(0, 2**63, both + 2 * own, dtype=np.uint64)
        sets = np.concatenate([x[: both + own], x[:both], x[both + own :]])
        sig = near_dedup.superminhash(sets, np.array([0, both + own, len(sets)]), 128)
        assert abs((sig[0] == sig[1]).mean() - both / (both + 2 * own)) < 0.13
    tiny = near_dedup.superminhash(np.array([7], np.uint64), np.array([0, 1, 1]), 16)
    assert sorted(tiny[0] >> 24) == list(range(16)) and (tiny[1] == 0xFFFFFFFF).all()


def brute_components(rows, k, numerator):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= numerator * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


@pytest.mark.parametrize(("k", "block"), [(4, 256), (5, 3)])
def test_near_duplicates(spark, k, block):
    rows = corpus()
    got = near_dedup.near_duplicates(frame(spark, [*rows, rows[9], (None, rows[9][1])], "doc_id long, text string"), words=k, block=block).collect()
    assert len(got) == len(rows) + 2
    want = brute_components(rows, k, 80)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id is not None} == want
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 100)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 200: 100}


def brute_spans(rows, span, piece, least):
    done, seen, gone = {}, {}, {}
    for i, t in rows:
        sentences, now, since, at = [], [], 0, 0
        raw = (t or "").encode()
        for w in raw.split():
            start = raw.index(w, at)
            ends = bool(now) and (now[-1][-1:] in (b".", b"!", b"?") or b"\n" in raw[at:start])
            since = 0 if ends else since
            if ends or now and since > piece and int(textkernel.Words(pa.array([now[-1].decode()])).hashes()[0]) % substring_dedup.CUT == 0:
                sentences.append(now)
                now = []
            now.append(w)
            since += 1
            at = start + len(w)
        done[i] = [*sentences, now] if now else sentences
    runs = []
    for i, ss in done.items():
        for p in range(len(ss)):
            for n in range(span, len(ss) - p + 1):
                if sum(map(len, ss[p : p + n])) >= least:
                    runs.append((i, p, n, tuple(x.lower() for s in ss[p : p + n] for x in [b"|", *s])))
    for i, p, n, r in sorted(runs, key=lambda x: x[:2]):
        if r in seen:
            gone.setdefault(i, set()).update(range(p, p + n))
        else:
            seen[r] = (i, p)
    return {i: (len(done[i]), len(gone.get(i, ())), [b" ".join(s).decode() for n, s in enumerate(done[i]) if n not in gone.get(i, ())]) for i, _ in rows}


def test_repeated_spans(spark):
    passage = ". ".join(" ".join(words(9)).capitalize() for _ in range(6)) + "."
    long = " ".join(words(120))
    rows = [(i, " ".join(" ".join(words(7)) + "." for _ in range(4)) + f" {passage if i % 2 else long} Tail {i} here we go on.\nShort.") for i in range(12)]
    bare = " ".join(words(60))
    rows += [(60 + i, f"{' '.join(words(3 + 7 * i))} {bare} {' '.join(words(9))}") for i in range(6)]
    rows += [(50, None), (51, ""), (52, passage), (53, passage.upper()), (54, "Short. Short. Short. Short."), (55, long)]
    got = {r.doc_id: (r.n_sentences, r.n_removed, (r.text or "").split()) for r in substring_dedup.remove_repeated_spans(frame(spark, rows, "doc_id long, text string"), least_words=10).collect()}
    want = brute_spans(rows, substring_dedup.SPAN, substring_dedup.PIECE, 10)
    assert {i: (a, b, " ".join(t)) for i, (a, b, t) in got.items()} == {i: (a, b, " ".join(t)) for i, (a, b, t) in want.items()}
    assert all(got[60 + i][1] >= 2 for i in range(1, 6))
    assert got[52][1] == 6 and got[53][1] == 6 and got[54][1] == 0 and got[1][1] == 0 and got[3][1] == 6


@pytest.mark.parametrize("least", [1, 10, 25])
def test_every_run_of_sentences_counts(spark, least):
    """Passages of short and long sentences, and mixtures of them: all runs of all lengths, by brute force."""
    draw = random.Random(least)
    sentence = [" ".join(words(draw.choice([1, 2, 4, 5, 12, 30]))) + "." for _ in range(60)]
    part = lambda at: sentence[at : at + draw.randrange(1, 7)] + [f"only {at} {draw.random()}."]
    rows = [(i, " ".join(x for _ in range(3) for x in part(draw.randrange(55)))) for i in range(60)]
    twelve_five_four = ". ".join(" ".join(words(n)) for n in (12, 5, 4)) + "."
    rows += [(100 + i, f"{' '.join(words(8))}. {twelve_five_four} {' '.join(words(9))}.") for i in range(3)]
    got = substring_dedup.remove_repeated_spans(frame(spark, rows, "doc_id long, text string"), least_words=least).collect()
    assert {r.doc_id: (r.n_sentences, r.n_removed, r.text.split()) for r in got} == {i: (a, b, " ".join(t).split()) for i, (a, b, t) in brute_spans(rows, substring_dedup.SPAN, substring_dedup.PIECE, least).items()}
    if least == 10:
        assert [r.n_removed for r in sorted(got, key=lambda r: r.doc_id) if r.doc_id >= 100] == [0, 3, 3]


def test_repeated_rows_are_one_document(spark):
    text = ". ".join(" ".join(f"{x}{k}" for k in range(12)) for x in "abc") + "."
    rows = [(1, text)] * 1000 + [(2, text)] * 3 + [(None, "Null ids come first. " + " ".join(words(20))), (None, text), (2, text + " More.")]
    got = substring_dedup.remove_repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_sentences, r.n_removed) for r in got) == sorted([(1, 3, 3)] * 1000 + [(2, 3, 3)] * 3 + [(0, rows[1003][1].count(".") + 1, 0), (0, 3, 0), (2, 4, 3)])


def test_passages_of_51_words_are_always_found(spark):
    """Whatever stands before them, with and without punctuation, and in a script without blanks."""
    rows = []
    for k in range(120):
        one, two = " ".join(words(27)), " ".join(words(24))
        shared = f"{one}. {two}." if k % 2 else f"{one} {two}"
        rows += [(10 * k, f"{' '.join(words(30))}. {shared} {' '.join(words(5))}"), (10 * k + 1, f"{' '.join(words(10 + k))} {shared} {' '.join(words(9))}")]
    han = lambda n: "".join(chr(DRAW.randrange(0x4E00, 0x9FA0)) for _ in range(n))
    for k in range(120, 140):
        shared = han(51 if k % 2 else 300)
        rows += [(10 * k, han(40) + shared + "\u3002" + han(9)), (10 * k + 1, han(7 + k) + shared + han(20))]
    rows += [(5000, " ".join(words(300))), (5001, "same " * 15), (5002, None), (5003, " ")]
    texts = dict(rows)
    for r in substring_dedup.remove_repeated_spans(frame(spark, rows, "doc_id long, text string"), passage=51).collect():
        twice = r.doc_id % 10 == 1 and r.doc_id < 5000
        assert (r.n_removed > 0) == twice, r.doc_id
        if twice:
            finer = textkernel.Words(pa.array([texts[r.doc_id], r.text]), glyphs=True)
            assert np.diff(finer.first)[0] - np.diff(finer.first)[1] >= substring_dedup.GRAM
        else:
            assert r.text == texts[r.doc_id]


def test_nearest(spark):
    draw = np.random.default_rng(1)
    vectors = [(i, v.tolist()) for i, v in enumerate(draw.standard_normal((300, 16)))]
    vectors += [(1000 + i, vectors[0][1]) for i in range(60)] + [(2000, None), (2001, [0.0] * 16), (2002, [math.nan] + [1.0] * 15), (2003, [1.0, None] + [1.0] * 14), (2004, [1.0]), (2005, []), (None, vectors[1][1]), vectors[3]]
    got = ann.nearest(frame(spark, vectors, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).collect()
    good = {i: np.array(v) for i, v in vectors if i is not None and v and len(v) == 16 and None not in v and np.isfinite(v).all() and any(v)}
    for q in (i for i in good if i % 50 == 0):
        cos = {i: float((v * good[q]).sum() / (np.sqrt((v * v).sum()) * np.sqrt((good[q] * good[q]).sum()))) for i, v in good.items() if i != q}
        want = sorted(cos, key=lambda i: (-cos[i], i))[:5]
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r.vec_id for r in mine] == want and [r["rank"] for r in mine] == [1, 2, 3, 4, 5]
        assert [r.score for r in mine] == pytest.approx([cos[i] for i in want], abs=1e-12)
    assert not ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<double>"), F.lit(True)).collect()


def recall(x, got):
    """Share of the exact five nearest that were found, of every 50th row."""
    hits = 0
    for q in range(0, len(x), 50):
        cos = x @ x[q]
        cos[q] = -9
        hits += len({r.vec_id for r in got if r.query_id == q} & set(np.argsort(-cos)[:5].tolist()))
    return hits / (5 * len(range(0, len(x), 50)))


@pytest.mark.parametrize("chunk", [8192, 40])
def test_recall_of_the_forest(spark, chunk):
    """Isotropic vectors, the hardest case, need shallow prefixes; clusters are found deep down. Small cells change nothing."""
    draw = np.random.default_rng(2)
    for clustered in (False, True):
        x = draw.standard_normal((3000, 64))
        if clustered:
            x = np.repeat(draw.standard_normal((150, 64)), 20, 0) + 0.15 * x
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
        got = ann.nearest(df, F.col("vec_id") % 50 == 0, chunk=chunk).collect()
        assert recall(x, got) >= 0.9
        depth = {r.query_id: r.depth for r in got}
        assert len(depth) == 60 and np.mean(list(depth.values())) >= (2 if clustered else 0.5)


PFAIR = [
    ([1.0], [700], 256),
    ([5, 3, 1, 1], 90, 256),
    ([2.0**i for i in range(8)], [3 * 2**i for i in range(8)], 256),
    ([math.sqrt(i) for i in range(1, 21)], [int(6000 * math.sqrt(i) / 61) for i in range(1, 21)], 256),
    ([math.sqrt(i) for i in range(1, 21)], [int(12000 * math.sqrt(i) / 61) for i in range(1, 21)], 4096),
    ([1, 1e-9, 0.37, 0.2], [4000, 30, 1500, 800], 1024),
    ([0.3, 0.0007, 0.6], [100, 900, 50], 512),
]


@pytest.mark.parametrize(("weights", "blocks", "segment"), PFAIR)
def test_schedule_is_pfair(spark, weights, blocks, segment):
    """Windows, one block a slot, and less than one block from the true targets until the first source ends."""
    names = [f"s{i:02}" for i in range(len(weights))]
    q = {r.source: r.q for r in mixing.shares(spark.createDataFrame([(s, float(w)) for s, w in zip(names, weights, strict=True)], "source string, weight double")).collect()}
    n = dict(zip(names, blocks if isinstance(blocks, list) else [blocks] * len(names), strict=True))
    got = mixing.schedule(spark.createDataFrame([(s, q[s], n[s]) for s in names], "source string, q long, n long"), segment).collect()
    slots = {r.slot: r.source for r in got}
    assert len(slots) == len(got) == sum(n.values()) == len({(r.source, r.k) for r in got})
    whole, scheduled = sum(q.values()), mixing.STRETCH * sum(n.values())
    assert all(r.k * whole // q[r.source] <= r.slot < -(-(r.k + 1) * whole // q[r.source]) for r in got if r.slot < scheduled)
    for s in names:
        own = [r.slot for r in sorted((r for r in got if r.source == s), key=lambda r: r.k)]
        assert own == sorted(own)
    share = {s: w / sum(weights) for s, w in zip(names, weights, strict=True)}
    done = Counter()
    for t in range(int(min(n[s] / share[s] for s in names))):
        done[slots[t]] += 1
        assert all(abs(share[s] * (t + 1) - done[s]) < 1 for s in names)


def test_segments_join_to_one_schedule(spark):
    """Wherever segments are cut, the same blocks are placed, without gaps while all sources last."""
    plan = spark.createDataFrame([("a", 700, 300), ("b", 200, 90), ("c", 60, 27), ("d", 40, 18)], "source string, q long, n long")
    for segment in (256, 512, 4096):
        got = mixing.schedule(plan, segment).collect()
        assert sorted(r.slot for r in got)[:400] == list(range(400)) and len({r.slot for r in got}) == 435


def test_mixed(spark):
    rows = [(i, "hot" if i % 3 else None if i % 2 else "b") for i in range(500)] + [(None, "b"), (1, "hot")]
    got = mixing.mixed(frame(spark, rows, "doc_id long, source string"), block_rows=4).collect()
    assert len(got) == len(rows) and len({r.place for r in got}) == len(rows)
    for r in got:
        assert r.release <= r.slot < r.deadline
    assert {r.source for r in got} == {"hot", "b", ""}
    weights = spark.createDataFrame([("b", 3.0), ("", None), ("zz", 9.0), ("hot", math.nan)], "source string, weight double")
    given = mixing.mixed(frame(spark, rows, "doc_id long, source string"), weights, 4).collect()
    assert len(given) == len(rows) == len({r.place for r in given})
    assert not mixing.mixed(spark.createDataFrame([], "doc_id long, source string")).collect()


def test_boilerplate(spark):
    line = "All rights reserved by somebody"
    rows = [(i, f"site{i}", f"Own line of document {i} here\n  all  RIGHTS reserved by Somebody\n\nshort") for i in range(12)]
    rows += [(50, None, line), (51, "site1", None), (52, "site1", ""), (53, "site2", f"{line}\n{line}")] + [(60 + i, "one", "Only on one site but often seen") for i in range(30)]
    df = frame(spark, rows, "doc_id long, source string, text string")
    got = {r.doc_id: r for r in line_dedup.without_boilerplate(df).collect()}
    assert got[0].text == rows[0][2] and got[0].n_removed == 0
    assert all(got[i].text == f"Own line of document {i} here\n" and got[i].n_removed == 2 for i in range(1, 12))
    assert (got[50].text, got[50].n_removed) == ("", 1) and got[51].text is None and got[52].text == "" and got[53].n_removed == 2
    assert all(got[60 + i].n_removed == 0 for i in range(30)) and got[0].rank == "extra"
    assert {r.n_removed for r in line_dedup.without_boilerplate(df, sites=13).collect()} == {0}
    assert line_dedup.without_boilerplate(df, keep_first=False).where("doc_id = 0").first().n_removed == 2


def brute_boilerplate(rows, sites):
    """Exact distinct sites of every line, without sketches or hashes; text and lines gone by row."""
    clean = lambda x: re.sub(r"[ \t\r\f\x0b]+", " ", x).strip(" ").lower()
    seen, first = {}, {}
    for i, site, text in sorted(rows):
        for at, raw in enumerate(text.split("\n")):
            x = clean(raw)
            if len(x) >= 20 or any(c.isalnum() for c in x):
                seen.setdefault(x, set()).add(site)
                first.setdefault(x, (i, at))
    out = {}
    for i, _, text in rows:
        left = [raw for at, raw in enumerate(text.split("\n")) if len(seen.get(x := clean(raw), ())) < sites or first[x] == (i, at)]
        out[i] = ("\n".join(left), len(text.split("\n")) - len(left))
    return out


def test_boilerplate_near_the_threshold(spark):
    """Lines of 7 to 13 sites around a threshold of 10, in odd white space, and one very long text."""
    draw = random.Random(2)
    odd = ["{}", "\t{}", "{}\r", " {} ", "{}\x0b", "\f {}\t\r"]
    texts = {i: [f"own {i}"] for i in range(40)}
    for k in range(60):
        for i in draw.sample(range(40), draw.randrange(7, 14)):
            texts[i].append(draw.choice(odd).format(f"line\t number  {k}"))
    texts[3] += [f"line {j}" if j % 3 else "line number 1" for j in range(20_000)]
    rows = [(i, f"s{i}", "\n".join(t)) for i, t in texts.items()]
    got = line_dedup.without_boilerplate(frame(spark, rows, "doc_id long, source string, text string").withColumn("_typeloom_rk", F.lit("mine")).withColumn("N_Removed", F.lit(7)))
    assert {r.doc_id: (r.text, r.n_removed) for r in got.collect()} == brute_boilerplate(rows, 10)
    assert got.columns[-1] == "n_removed" and {r._typeloom_rk for r in got.collect()} == {"mine"}


def brute_phrases(text, train):
    n = at = 0
    while at < len(text):
        size = 1
        while at + size < len(text) and text[at : at + size + 1] in train:
            size += 1
        n, at = n + 1, at + size
    return n


def test_cross_parsing_counts_phrases():
    samples = {"x": "abracadabra hocus pocus", "y": "the quick brown fox jumps over the lazy dog"}
    texts = ["abra the fox", "zzz quick", "hocus", "a", "\u00e9a\u00e9b", "", None, "..."]
    bits, sizes, letter = language_id.cross_parse(pa.array(texts), samples)
    for row, text in enumerate(texts):
        folded = "".join(c if c.isalpha() else " " for c in (text or "").lower())
        folded = " ".join(folded.split()) if text and text[0].isalpha() and text[-1].isalpha() else None
        if folded:
            for k, train in enumerate(samples.values()):
                got = round(bits[row, k] * sizes[row] / np.log2(max(2, len(train))))
                assert abs(got - brute_phrases(folded, train)) <= (1 if any(c not in train for c in folded) else 0)
    assert letter.tolist() == [True] * 5 + [False] * 3


def test_phrases_of_whole_texts():
    """Texts of many lanes, among them some whose phrases are longer than several lanes, counted exactly."""
    draw = random.Random(8)
    text = lambda n, of="abcd efgh": " ".join("".join(draw.choice(of) for _ in range(n)).split())
    samples = {"x": text(900), "y": text(2500, "ab c"), "z": "ab" * 1500}
    texts = [text(n) for n in (5, 511, 512, 513, 2000, 9000)] + [samples["y"][300:2300], "ab" * 1200, "ba" * 1300 + "c", samples["x"], "a" * 3000]
    phrases, _, sizes, _ = language_id._parse(pa.array([*texts, None, ""]), samples)
    assert sizes.tolist() == [*map(len, texts), 0, 0]
    assert phrases.tolist() == [[brute_phrases(t, train) for train in samples.values()] for t in texts] + [[0] * 3] * 2


def test_languages(spark):
    german, english = "der die das und nicht ein eine ist auf von mit f\u00fcr ".split(), "the of and to in is that it was for on are ".split()
    say = lambda own, n: " ".join(DRAW.choice(own) for _ in range(n))
    rows = [(i, say(german if i % 2 else english, 40), "de" if i % 2 else "en") for i in range(60)] + [(100, None, "de"), (101, "12 34", "en"), (102, say(english, 400), None)]
    df = frame(spark, rows, "doc_id long, text string, lang string")
    samples = language_id.learn(df.where("doc_id < 40"))
    got = {r.doc_id: r for r in language_id.identify(df, samples).collect()}
    assert all(got[i].lang_pred == rows[i][2] and 0 <= got[i].score <= 1 for i in range(60)) and got[102].lang_pred == "en"
    assert [(got[i].lang_pred, got[i].score) for i in (100, 101)] == [("und", 0.0)] * 2
    assert {r.lang_pred for r in language_id.identify(df, {}).collect()} == {"und"}


def test_short_samples_do_not_win(spark):
    german, english = "der die das und nicht ein eine ist auf von mit f\u00fcr ".split(), "the of and to in is that it was for on are ".split()
    say = lambda own, n: " ".join(DRAW.choice(own) for _ in range(n))
    rows = [(i, say(german if i % 2 else english, 400), "de" if i % 2 else "en") for i in range(40)]
    short = [(100, "ok", "aa"), (101, "-" * 256, "ab"), (102, "1" * 256 + " ok " + "=" * 300, "ac"), (103, "e", "ad"), (104, "the quick brown fox jumps over the lazy dog", "ae")]
    samples = language_id.learn(spark.createDataFrame(rows + short, "doc_id long, text string, lang string"))
    assert sorted(samples) == ["aa", "ac", "ad", "ae", "de", "en"] and samples["ac"] == "ok"
    got = language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), samples).collect()
    assert all(r.lang_pred == r.lang for r in got)


def test_large_alphabets_are_told_apart(spark):
    """Ideographs of which a sample holds each a few times at most, against Hangul and two Latin alphabets."""
    ideographs, hangul = [chr(0x4E00 + 7 * k) for k in range(2000)], [chr(0xAC00 + 5 * k) for k in range(1500)]
    own = {"ja": [chr(0x3041 + k) for k in range(80)], "ko": hangul, "zh": ideographs, "de": list("abcdefghijklmnopqrstuvwxyz"), "ru": [chr(0x430 + k) for k in range(32)]}
    rows = [(k * 1000 + i, "".join(DRAW.choice(letters) for _ in range(100)), lang) for k, (lang, letters) in enumerate(own.items()) for i in range(80)]
    samples = language_id.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    seen = Counter(samples["zh"])
    rare = [c for c in ideographs if c not in seen or seen[c] <= 3]
    texts = [(i, "".join(DRAW.choice(rare) for _ in range(50)), "zh") for i in range(100)] + [(200 + i, "".join(DRAW.choice(hangul) for _ in range(50)), "ko") for i in range(20)] + rows
    got = language_id.identify(spark.createDataFrame(texts, "doc_id long, text string, lang string"), samples).collect()
    assert all(r.lang_pred == r.lang for r in got)
    first, second, _ = language_id._alphabet(samples)
    letters = sorted({ord(c) for t in samples.values() for c in t if c.isalpha()})
    assert len({(first[c], second[c]) for c in letters}) == len(letters) > 3000


def test_samples_spread_over_rows_and_texts(spark):
    letters = [chr(ord("a") + k) for k in range(20)]
    rows = [(i, "".join(c * 200 for c in letters), "x") for i in range(300)] + [(500, "-" * 4000 + "zz", "y")]
    samples = language_id.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), rows=8, chars=8 * 128)
    assert samples["y"] == "zz" and len(samples["x"]) == 8 * 128
    assert len(set(samples["x"]) & set(letters)) >= 4 and set(samples["x"][:128]) != {"a"}  # not the texts' beginnings
    whole = language_id.learn(spark.createDataFrame(rows[:4], "doc_id long, text string, lang string"))
    assert len(set(whole["x"]) & set(letters)) >= language_id.PIECES


@pytest.mark.parametrize("lengths", [url_filter.MOST_LENGTHS, 1])
def test_url_rules(spark, monkeypatch, lengths):
    """Also where every prefix of a path is tried."""
    monkeypatch.setattr(url_filter, "MOST_LENGTHS", lengths)
    rules = queries.URL_RULES
    urls = ["http://a.example.com/en/742?x=/y", "http://example.com/en/1", "HTTP://EXAMPLE.COM/en/", "https://b.example.net/de/81#t", "https://x.net/de/8", "ftp://org/es/1", "http://xorg/es/1", "http://sub.x.org/es/", "//no", None, "", "http://", "http://example.com", "a://b://c/d", "http://h?/en/", "http://example.com/EN/7"] * 2
    df = frame(spark, list(enumerate(urls)), "page_id long, url string").withColumns({c: F.lit("own") for c in ("best", "Host", "RULE", "short", "digest", "suffix", "cut", "page")})
    assert url_filter.judged(df, spark.createDataFrame(rules, "host string, path string, verdict string")).select("best", "page", "digest").distinct().collect() == [("own", "own", "own")]
    for got in url_filter.judged(df, spark.createDataFrame(rules, "host string, path string, verdict string")).collect():
        url = urls[got.page_id] or ""
        rest = url.split("://", 1)[1] if "://" in url else ""
        cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:].split("?")[0].split("#")[0]
        fits = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
        best = max(fits, key=lambda r: len(r[0] + r[1]), default=None)
        assert (got.host, got.path, got.rule, got.verdict) == (host, path, best and best[0] + best[1], best[2] if best else "allow")


def test_media_round_trip(spark):
    for payload in (b" " * 192, bytes(range(192)) * 3):
        assert media.decode_png(media.encode_png(payload)) == payload
    with pytest.raises(ValueError):
        media.decode_png(media.encode_png(b"x" * 192)[:-20])
    page = '<p>One &amp; two<img src="media:sha256-d1" alt="first">three</p><script>no</script><figure><img src="x.png"><img src="media:sha256-d2"><figcaption>Cap <b>it</b></figcaption></figure>end'
    items = [(i["kind"], i["text"], i["digest"], i["caption"]) for i in media.parse_html(page)]
    assert items == [("text", "One & two", None, None), ("media", None, "d1", "first"), ("text", "three", None, None), ("media", None, None, "Cap it"), ("media", None, "d2", "Cap it"), ("text", "end", None, None)]
    assert media.parse_html(None) == media.parse_html("") == []


def test_media_query(spark, tmp_path):
    rows = [(0, None), (1, ""), (2, "a" * 192), (3, "\u00e9" * 100), (4, "a" * 192), (5, "long " * 3000), (None, "x"), (6, "\n<b> & </p>\n \n<script>x\ny"), (7, "</figure>&amp;")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op8_media_columns(spark, str(tmp_path)).collect()}
    import hashlib

    for i, t in rows:
        raw = (t or "").encode()
        payload = raw + b" " * (192 if not raw else -len(raw) % 192)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert (r.media_bytes, r.media_sha256) == (len(media.encode_png(payload)), hashlib.sha256(media.encode_png(payload)).hexdigest())
        lines = [bool(x.strip()) for x in (t or "").split("\n")]
        assert (r.position, r.n_items, r.caption) == (int(lines[0]), sum(lines) + 1, f"{len(t or '')} characters in {len(lines)} lines")
    assert got[2][1:] == got[4][1:]


def test_payloads_are_stored_once_a_task(spark):
    rows = [(f"{i % 3:064x}", bytes([i % 3]) * 192) for i in range(900)]
    stored = media.media_table(spark.createDataFrame(rows, "digest string, payload binary").coalesce(1))
    assert sorted(r.digest for r in stored.collect()) == sorted({d for d, _ in rows})


def test_figures_in_real_pages(spark):
    """Pages of the table with several images put into them: everything stays in place, text as without images."""
    import hashlib

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "html").limit(30).collect()
    payloads = [bytes([k]) * 192 * (k + 1) for k in range(4)]
    digests = [hashlib.sha256(x).hexdigest() for x in payloads]
    img = lambda k, more="": f'<img src="{media.SCHEME}{digests[k]}"{more}>'
    figure = f"<figure>{img(0)}{img(1)}<figcaption>Two <i>of</i>\n them</figcaption></figure>"
    more = f'</p>{img(2, " alt=&quot;A&amp;B&quot;")}{img(3)}<img src="/elsewhere.png" alt="far">'
    shown = [(r.page_id, (cut := r.html.partition("</h1>"))[0] + cut[1] + (figure if cut[1] else "") + cut[2].replace("</p>", more, 1)) for r in pages]
    assert sum(figure in x and more in x for _, x in shown) > 10
    # The digest of one payload is not in the store.
    store = media.media_table(spark.createDataFrame(list(zip(digests[:3], payloads[:3], strict=True)), "digest string, payload binary"))
    got = media.interleaved(spark.createDataFrame([*shown, (None, None)], "page_id long, html string"), store).collect()
    assert len({r.page_id for r in got}) == len(pages)
    for page in pages:
        own = sorted((r for r in got if r.page_id == page.page_id), key=lambda r: r.position)
        assert [r.position for r in own] == list(range(own[0].n_items))
        assert " ".join(r.text for r in own if r.kind == "text") == " ".join(i["text"] for i in media.parse_html(page.html))
        images = [r for r in own if r.kind == "media"]
        changed = dict(shown)[page.page_id]
        order = sorted((changed.index(x), k) for k, x in enumerate([*digests, "/elsewhere.png"]) if x in changed)
        assert [r.digest for r in images] == [digests[k] if k < 4 else None for _, k in order]
        captions = {0: "Two of them", 1: "Two of them", 2: '"A&B"', 3: None, 4: "far"}
        assert [r.caption for r in images] == [captions[k] for _, k in order]
        assert [r.n_samples for r in images] == [len(payloads[k]) if k < 3 else None for _, k in order]


def test_other_tokenizers_encode_whole_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    assert packing.by_words(queries.tokenizer_path()) and not packing.by_words(path)
    plain, texts = Tokenizer.from_file(path), ["Two  Words", None, "", "\u00e9 x\ny"]
    ids, offs = packing.WordTokenizer(path)(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(offs, offs[1:])] == [plain.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_pack():
    for sizes in ([], [1], [2048], [5000, 300, 300, 7], [DRAW.randrange(1, 6000) for _ in range(200)]):
        windows = packing.pack(sizes)
        seen = {i: [] for i in range(len(sizes))}
        for length, pieces in windows:
            assert length & (length - 1) == 0 and length <= 2048 and sum(p[2] for p in pieces) == length
            for doc, start, size in pieces:
                seen[doc].append((start, size))
        for doc, size in enumerate(sizes):
            at = 0
            for start, n in sorted(seen[doc]):
                assert start == at
                at += n
            assert at == size
        groups = packing.step_groups(windows, 16_384)
        total = Counter()
        for (length, _), g in zip(windows, groups, strict=True):
            total[g] += length
        assert all(t <= 16_384 for t in total.values())


def test_word_tokenizer(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "CACHE", 40)
    monkeypatch.setattr(packing, "ENCODED", 7)
    plain, own = Tokenizer.from_file(queries.tokenizer_path()), packing.WordTokenizer(queries.tokenizer_path())
    marks = [*"aBz09.,;!?'\"-_/<>|&#@ \t\n\x0b\x1c\x85", "'s", "'LL", "n't", "\u00a0", "\u2014", "\u2019", "\u0301", "\u0338", "\u00c9", "\u0130", "\u00df", "\u4e2d", "\u00bd", "\u0663", "\U0001f600", "\u200d", "\ufb01", "\u212a", "<|endoftext|>"]
    for k in range(300):
        some = marks if k % 3 == 0 else marks[:-1]
        texts = [None, ""] + ["".join(DRAW.choices(some, k=DRAW.randrange(40))) for _ in range(4)]
        ids, offs = own(pa.array(texts, pa.string()))
        for i, t in enumerate(texts):
            assert ids[offs[i] : offs[i + 1]].tolist() == plain.encode(t or "", add_special_tokens=False).ids, repr(t)


def test_packed_query(spark, tmp_path):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(queries.tokenizer_path())
    texts = [None, "", "It's we're I'M don't,ok", "x\u2014y \u2026. a..b \u00c0\u00c9 12ab,3", "a\u0301b \u2260 c,\u0301d", "tab\tnew\nline\x0bq x\u00a0y", "\U0001f600,ok", " ".join(words(6000)), "a <|endoftext|>, b"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op9_packing(spark, str(tmp_path)).collect()
    by_sequence = Counter()
    for i, t in enumerate(texts):
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 1]
        at = 0
        for r in sorted((r for r in got if r.doc_id == i), key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == by_sequence[r.sequence_id]
        by_sequence[r.sequence_id] += r.length


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_word_scores(spark, order):
    """Every word counts, in any script, however many blocks the rows are dealt into."""
    rare = ["\u0436\u0443\u043a \u0438\u0434\u0451\u0442", "\u043c\u0430\u043c\u0430 \u043c\u044b\u043b\u0430", "\u9f98\u9f96", "\u9f99\u9f97"]
    rows = [(i, " ".join(words(5 + 3 * i)) + ", Bee.") for i in range(12)] + [(20 + i, t) for i, t in enumerate(rare)] + [(30, None), (31, ""), (None, "a b"), (0, "again a b a b"), (3, "b b b a b")]
    target = spark.createDataFrame([(0,), (3,), (3,), (20,), (22,), (None,), (99,)], "doc_id int")
    split = lambda t: "".join(f" {c} " if c in ",." or c > "\u9000" else c for c in (t or "").lower()).split()
    streams = [(i, [*[""] * (order - 1 or 1), *split(t), ""]) for i, t in rows]
    lead = order - 1 or 1

    def model(own):
        """Counts of n-grams that end with a predicted token, and of their contexts."""
        grams, contexts = Counter(), Counter()
        for s in own:
            for j in range(lead, len(s)):
                for n in range(1, order + 1):
                    grams[tuple(s[j - n + 1 : j + 1])] += 1
                    contexts[tuple(s[j - n + 1 : j])] += 1
        return grams, contexts

    every, mine = model([s for _, s in streams]), model([s for i, s in streams if i in (0, 3, 20, 22)])
    mass = lambda c: max(1, c**lm_scoring.HEAPS)

    def chance(counts, context, w):
        grams, contexts = counts
        lower = chance(counts, context[1:], w) if context else every[0][(w,)] / every[1][()]
        return (grams[(*context, w)] + mass(contexts[context]) * lower) / (contexts[context] + mass(contexts[context]))

    def loss(counts, s):
        return sum(-math.log2(chance(counts, tuple(s[j - order + 1 : j]), s[j])) for j in range(lead, len(s))) / (len(s) - lead)

    want = sorted((i is None, i or 0, len(s) - lead, round(loss(mine, s), 6), round(loss(every, s), 6)) for i, s in streams)
    for size in (10**6, 60):
        got = lm_scoring.score_words(frame(spark, rows, "doc_id long, text string"), target, size, order).collect()
        assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, round(r.loss_target, 6), round(r.loss_background, 6)) for r in got) == want
        by_id = {r.doc_id: r.score for r in got}
        assert by_id[20] > by_id[21] and by_id[22] > by_id[23]
