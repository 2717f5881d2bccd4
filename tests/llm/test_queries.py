"""Registered queries and the pipeline, on the driver's small tables."""

import itertools
import math
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from tests.test_queries import SF, TABLES, rows
from tests.llm.test_operators import brute_boilerplate, brute_phrases
from typeloom.llm import language_id, queries


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = __spark_entry__.queries()[name](spark, SF).toPandas()
    assert rows(got) == rows(c.execute(__spark_entry__.oracle_sql()[name]).df())


def test_all_are_registered():
    assert [n for n in __spark_entry__.queries() if n.startswith("op")] == list(queries.queries()) and "pipeline" in __spark_entry__.queries()


def test_held_out_languages(spark):
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    got = queries.op5_language_id(spark, SF).join(truth, "doc_id").where("held_out")
    assert got.count() and got.where(F.col("lang_pred") == F.col("lang")).count() >= 0.97 * got.count()


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, SF).persist()
        assert docs.columns == columns, name
        if name in ("line_dedup", "mixing"):
            assert docs.count() == before.count()
        if name == "mixing":
            assert sorted(r.doc_id for r in docs.collect()) == sorted(r.doc_id for r in before.collect())
    kept = {r.doc_id for r in docs.collect()}
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()} == kept


def test_documents_without_labels_stay(spark):
    rows = [(1, "Some words", None), (2, "12 34", None), (3, None, None), (4, "\u4f60", None), (5, "", None), (6, "a", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = corpus_pipeline.identify_language(spark, docs, SF)
    assert sorted((r.doc_id, r.lang) for r in got.collect()) == [(1, None), (4, None), (6, None)] and got.columns == docs.columns
    labelled = docs.withColumn("lang", F.when(F.col("doc_id") == 1, "en"))
    assert sorted((r.doc_id, r.lang) for r in corpus_pipeline.identify_language(spark, labelled, SF).collect()) == [(1, "en"), (4, "en"), (6, "en")]


def test_sequences_follow_the_mix(spark, tmp_path, monkeypatch):
    """However the files of the mix are reread, no document of a later run of tokens comes before one of an earlier."""
    monkeypatch.setattr(corpus_pipeline, "GROUP_TOKENS", 2048)
    rows = [(i, " ".join(f"word{(i * 7 + k) % 90}" for k in range(20 + i * 37 % 300)), "en", f"s{i % 7 if i % 3 else 0}", 0) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    place = {r.row.doc_id: r.place for r in corpus_pipeline._placed(docs).collect()}
    docs.repartition(9, F.rand(3)).write.parquet(f"{tmp_path}/mix")
    pieces = corpus_pipeline.pack_sequences(spark, spark.read.parquet(f"{tmp_path}/mix"), SF).collect()
    assert {r.doc_id for r in pieces} == set(place)
    tokens = {r.doc_id: r.doc_tokens for r in pieces}
    rank, at = {}, 0
    for i in sorted(place, key=place.get):
        rank[i], at = at, at + tokens[i]
    # Both orders in tokens: they differ by a run and a document at most.
    slack, at = 2048 + 2 * max(tokens.values()), 0
    for r in sorted(pieces, key=lambda r: (r.sequence_id, r.offset)):
        assert abs(rank[r.doc_id] + r.start - at) <= slack
        at += r.length


def test_one_row_of_each_group_of_copies(spark):
    text = " ".join(f"word{k}" for k in range(40))
    rows = [(1, text, "a"), (1, text, "b"), (1, text + " more", "a"), (None, text, "a"), (None, text, "a"), (None, "other words of a null id here", "a"), (None, "other words of a null id here", "b"), (5, "", "a"), (6, "", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    left = sorted((r.doc_id or 0, r.text[:5], r.source) for r in got.collect())
    assert got.columns == docs.columns and left == [(0, "other", "a"), (1, "word0", "a"), (5, "", "a"), (6, "", "a")]


def test_short_boilerplate_goes_in_the_pipeline(spark):
    rows = [(i, f"Own line {i}\nAccept all cookies\n---\n}}\nEnd of {i}", None, f"site{i}", 0) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r for r in corpus_pipeline.drop_boilerplate(spark, docs, SF).collect()}
    assert got[0].text == rows[0][1] and all(got[i].text == f"Own line {i}\n---\n}}\nEnd of {i}" for i in range(1, 12))
    assert all(r.n_chars == len(r.text) for r in got.values())


CLASHES = ("key", "row", "place", "lang_pred", "score", "N_Removed", "gone", "component_id", "slot", "_typeloom_key", "doc")


@pytest.fixture(scope="module")
def odd(spark):
    """Documents with every odd case: nulls in any column, empty and long texts, ties, repeated rows, clashing columns."""
    draw = random.Random(11)
    english, german = "the of and to in is that it was for".split(), "der die und in den von zu das mit sich".split()
    say = lambda own, n: " ".join(draw.choice(own) + (draw.choice("abcdef") * 2 if draw.random() < 0.5 else "") for _ in range(n))
    rows = []
    for i in range(70):
        lang = draw.choice(["en", "de"])
        text = "\n".join([f"Own {i} {say(english if lang == 'en' else german, 40)}", "Follow us everywhere" if i % 2 else "", say(english if lang == "en" else german, 30)])
        rows.append((i, text, lang if i % 5 else None, f"site{i % 14}" if i % 3 else "site0", len(text)))
    rows += [(100 + i, rows[i][1].replace("Own", "own") + (" end" if i % 2 else ""), rows[i][2], "copies", 5) for i in range(12)]
    rows += [(200, None, "en", "site1", None), (201, "", None, None, 0), (202, "12 -- 34", "de", "site2", 8), (203, " \n\t", None, "site3", 4), (None, rows[7][1], None, "site4", 1), (None, rows[7][1], None, "site4", 1), (None, None, None, None, None), (204, "x" * 30_000 + " der die das", None, "site5", 1), (205, "\n".join(f"Line {k} of a long text und so" for k in range(4000)), "de", "site6", 1)]
    rows += [rows[3], rows[3], (3, rows[3][1], "xx", "elsewhere", 9), (3, rows[4][1], "en", "site0", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit("mine") for c in CLASHES}).repartition(5, "n_chars").cache()


def test_language_stage(spark, odd):
    got = corpus_pipeline.identify_language(spark, odd, SF)
    assert got.columns == odd.columns and {r.key for r in got.collect()} == {"mine"}
    kept = [r for r in odd.collect() if any(c.isalpha() for c in r.text or "")]
    assert Counter(map(str, got.drop("lang").collect())) == Counter(str(r) for r in odd.drop("lang").collect() if any(c.isalpha() for c in r.text or ""))
    samples = dict(sorted(language_id.learn(odd.select("doc_id", "text", "lang")).items()))
    fold = lambda t: " ".join("".join(c if c.isalpha() else " " for c in t.lower()).split())
    own = {lang: fold(t) for lang, t in samples.items()}
    least = math.log2(1 + len({c for t in own.values() for c in t if c.isalpha()}))
    bits = {lang: max(math.log2(len(t)), least) for lang, t in own.items()}

    def best(text):
        text = fold(text)
        cost = {lang: brute_phrases(text, t) * bits[lang] + sum(c not in t for c in text) * (max(bits.values()) - bits[lang]) for lang, t in own.items()}
        return min(cost, key=lambda x: (cost[x], x))

    told = Counter((r.doc_id, r.text, r.lang) for r in got.collect())
    short = [r for r in kept if len(r.text) < 1000 and r.text[0].isalpha() and r.text[-1].isalpha()]
    assert len(short) > 60 and all(told[r.doc_id, r.text, r.lang or best(r.text)] for r in short)


def test_boilerplate_stage(spark, odd):
    got = corpus_pipeline.drop_boilerplate(spark, odd, SF)
    assert got.columns == odd.columns and {r.row for r in got.collect()} == {"mine"}
    own = [r for r in odd.collect() if r.doc_id is not None and r.text is not None]
    distinct = {(r.doc_id, r.text) for r in own}
    twice = {i for i, n in Counter(i for i, _ in distinct).items() if n > 1}
    sites = {}
    # Rows without an id come first and don't change which lines go; a null site is none.
    rows = [(r.doc_id, r.source, r.text) for r in own if r.doc_id not in twice]
    for _, site, text in [(r.doc_id, r.source, r.text) for r in odd.collect() if r.text is not None]:
        for line in text.split("\n"):
            sites.setdefault(line, set()).add(site)
    gone = {x for x, s in sites.items() if len(s - {None}) >= 10 and any(c.isalpha() for c in x)}
    assert gone == {"Follow us everywhere"}
    left = {(r.doc_id, r.text, r.n_chars) for r in got.collect()}
    firsts = 0
    for i, _, text in rows:
        clean = "\n".join(x for x in text.split("\n") if x not in gone)
        firsts += (i, text, len(text)) in left and clean != text
        assert (i, clean, len(clean)) in left or (i, text, len(text)) in left
    assert firsts <= 1 and got.count() == odd.count()
    assert brute_boilerplate([(0, "a", "x"), (1, "b", "x")], 2) == {0: ("x", 0), 1: ("", 1)}


def test_near_duplicate_stage(spark, odd):
    got = corpus_pipeline.drop_near_duplicates(spark, odd, SF)
    assert got.columns == odd.columns
    nodes = sorted({(r.doc_id is None, r.doc_id or 0, r.text or "") for r in odd.collect()})
    sets = []
    for _, _, text in nodes:
        w = text.lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(nodes)))
    for a, b in itertools.combinations(range(len(nodes)), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            one, two = sorted((find(root, a), find(root, b)))
            root[two] = one
    want = sorted(nodes[i] for i in range(len(nodes)) if find(root, i) == i)
    mine = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in got.collect())
    # Of a group without smaller ids that share one, any text may stay; groups and ids are the same.
    assert [x[:2] for x in mine] == [x[:2] for x in want] and len(mine) < len(nodes)
    index = {n: i for i, n in enumerate(nodes)}
    assert sorted(find(root, index[x]) for x in mine) == sorted(find(root, index[x]) for x in want)


def find(root, x):
    while root[x] != x:
        x = root[x]
    return x


def test_mixing_stage(spark, odd):
    """Whatever the columns, all rows stay, and every block of the output holds its sources' share by less than one block."""
    more = odd.unionByName(odd.withColumn("doc_id", F.col("doc_id") + 1000)).unionByName(odd.withColumn("doc_id", F.col("doc_id") + 2000))
    got = corpus_pipeline.mix_sources(spark, more, SF)
    assert got.columns == odd.columns and Counter(map(str, got.collect())) == Counter(map(str, more.collect()))
    order = [r.source or "" for r in got.collect()]
    rows_of = Counter(order)
    weights = {x: math.sqrt(n) for x, n in rows_of.items()}
    total, size = sum(weights.values()), corpus_pipeline.mixing.BLOCK_ROWS
    # Slots are blocks of one source each: until a source ends, no prefix may be off by a block and the one under way.
    first_end = min(math.ceil(rows_of[x] / size) / weights[x] * total for x in weights)
    seen = Counter()
    for at, x in enumerate(order[: int((first_end - 1) * size)], 1):
        seen[x] += 1
        assert all(abs(seen[y] - weights[y] / total * at) < 2 * size for y in weights)


def test_packing_stage(spark, odd):
    from tokenizers import Tokenizer

    pieces = corpus_pipeline.pack_sequences(spark, odd, SF).collect()
    plain = Tokenizer.from_file(queries.tokenizer_path())
    whole = Counter()
    for r in odd.collect():
        ids = np.array([*plain.encode(r.text or "", add_special_tokens=False).ids, 1], np.uint32)
        whole[r.doc_id, len(ids)] += len(ids)
    packed = Counter()
    for r in pieces:
        packed[r.doc_id, r.doc_tokens] += r.length
    assert packed == whole
    texts = {(r.doc_id, len(plain.encode(r.text or "", add_special_tokens=False).ids) + 1): r.text or "" for r in odd.collect()}
    for r in pieces:
        ids = np.array([*plain.encode(texts[r.doc_id, r.doc_tokens], add_special_tokens=False).ids, 1], "<u4")
        assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    for _, own in itertools.groupby(sorted(pieces, key=lambda r: (r.sequence_id, r.offset)), key=lambda r: r.sequence_id):
        own = list(own)
        assert [r.offset for r in own] == [0, *itertools.accumulate(r.length for r in own)][:-1] and sum(r.length for r in own) == own[0].sequence_length


def test_stages_of_empty_tables(spark, odd):
    for _, stage in corpus_pipeline.STAGES:
        assert not stage(spark, odd.limit(0), SF).collect()


@pytest.mark.parametrize("name", [n for n in queries.queries() if n != "op3_lsh_forest"])
def test_empty_tables(spark, tmp_path, name):
    for t in ("documents", "pages", "labels"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert queries.queries()[name](spark, str(tmp_path)).count() == 0
