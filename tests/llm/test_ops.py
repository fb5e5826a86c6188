"""Edge cases and brute-force comparisons on small fixtures."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from signalloom.llm import ann, common, fingerprints, langid, licenses, mixing, neardup, packing, sharding, store, token_counts, tokens
from signalloom.llm.queries import MIX_WEIGHTS, source_domain, tokenizer

RNG = random.Random(1)
WORDS = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "der", "die", "und"]
LONG = " ".join(RNG.choice(WORDS) for _ in range(30_000))
NEAR = [f"w{i}" for i in range(200)]
TEXTS = [None, "", "  \n", "12 34", "one", "Tie tie", "Tie tie", LONG, LONG, " ".join(NEAR), " ".join(NEAR[:-2]), " ".join(NEAR[:100]) + " X " + " ".join(NEAR[100:]),
         "é" * 500, "naïve <|endoftext|> text\x1c here x", "ab " * 300, "That it. Released under the MIT License.", "日本語の文章です。"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n int, comp string, key string, v string, label int"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i != 5 else None, t, "en" if i % 2 else None, None if i == 3 else f"src{i % 4}", None, 1, "c", "k", "v", 0) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[9]], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_cached_encoding_is_the_librarys(name):
    from tokenizers import Tokenizer

    whole, own = Tokenizer.from_file(tokenizer(name)), tokens.encoder(tokenizer(name))
    alphabet = " \n\n  ab!?;:#$%&*\t\r\x0b\x1c\x85  　aAbé.,'sß12½²'`<|_Σςǅ́日🙂-"
    texts = [t for t in TEXTS if t] + ["".join(RNG.choice(alphabet) for _ in range(RNG.randint(0, 60))) for _ in range(1500)]
    for text in texts:
        assert np.frombuffer(own.encode(text), "<u2").tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@pytest.mark.parametrize("group", [1, 300, 1 << 23])
def test_encoding_many_texts_at_once(name, group, monkeypatch):
    import pyarrow as pa
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokens, "GROUP_BYTES", group)
    monkeypatch.setattr(tokens, "MAX_CACHED", 200)
    whole, own, rng = Tokenizer.from_file(tokenizer(name)), tokens.CachedEncoder(tokenizer(name)), random.Random(5)
    pieces = [*" \n\tab.,'1\x1c\x85\xa0\u2003\u3000\u2026×÷Éé\u0301日", " word", "Word,", "\n\n", "\nÉa", "é. ", "'ll", "<|endoftext|>", "a.\u0301", "\r\n", "y" * 300]
    texts = [None, "", *("".join(rng.choice(pieces) for _ in range(rng.randint(0, 30))) for _ in range(400)), "", None]
    got = list(own.encode_all(pa.array(["before", *texts]).slice(1)))
    assert [np.frombuffer(x, "<u2").tolist() for x in got] == [whole.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert list(own.encode_all(pa.array([], pa.string()))) == [] and list(own.encode_all(pa.array([None, ""]))) == [b"", b""]


def test_words_of_many_texts_are_looked_up_once(monkeypatch):
    import pyarrow as pa

    own, asked = tokens.CachedEncoder(tokenizer("byte_bpe_50k.json")), []
    ids = own._ids
    monkeypatch.setattr(own, "_ids", lambda units: asked.extend(units) or ids(units))
    text = "One, two one\nOne: naïve?"
    want = own.encode(text)
    asked.clear()
    assert list(own.encode_all(pa.array([text] * 1000))) == [want] * 1000
    assert sorted(asked) == ["\n", " naïve", " one", " two", ",", ":", "?", "One"]


def test_packing_looks_up_each_word_of_a_batch_once(spark, monkeypatch):
    import pyarrow as pa
    from tokenizers import Tokenizer

    class Table:
        select = lambda self, *columns: self
        mapInArrow = lambda self, run, schema: run

    path, asked, ids = tokenizer("byte_bpe_50k.json"), [], tokens.CachedEncoder._ids
    monkeypatch.setattr(tokens.CachedEncoder, "_ids", lambda self, units: asked.extend(units) or ids(self, units))
    texts = [None if i % 7 == 3 else f"one two {i % 5}, one" for i in range(600)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(600)), pa.array(texts)], names=["doc_id", "text"])
    *parts, counted = packing.tokenize(Table(), path, 1)(iter([batch]))
    rows = [r for part in parts for r in part.to_pylist()]
    want = [Tokenizer.from_file(path).encode(t or "", add_special_tokens=False).ids + [1] for t in texts[:35]] * 18
    assert [(r["doc_id"], r["n"], np.frombuffer(r["ids"], "<u2").tolist()) for r in rows] == [(i, len(x), x) for i, x in enumerate(want[:600])]
    df = np.frombuffer(counted.column(2)[0].as_py(), "<i8")
    assert df[1] == 600 and df.sum() == sum(len(set(x)) for x in want[:600])
    assert len(asked) < 20


def test_crc_combination():
    a, b = RNG.randbytes(777), RNG.randbytes(1235)
    assert tokens.crc32_combine(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_joined_crcs_of_many_strings():
    pieces = [[RNG.randbytes(RNG.randint(1, 9000)) for _ in range(n)] for n in (1, 5, 2, 1, 40)]
    flat = [p for own in pieces for p in own]
    crcs, sizes = np.array([zlib.crc32(p) for p in flat], np.int64), np.array([len(p) for p in flat])
    first = np.cumsum([0, *map(len, pieces[:-1])])
    assert tokens.crc32_joined(crcs, sizes, first).tolist() == [zlib.crc32(b"".join(own)) for own in pieces]


def test_token_counts(docs, empty):
    from tokenizers import models

    vocabulary = token_counts.unigram_vocabulary(tokenizer("piece_bpe_32k.model"))
    model = models.Unigram([("<unk>", min(vocabulary.values()) - 10), *vocabulary.items()], 0, False)
    got = [x["n_tokens"] for x in token_counts.token_counts(docs, vocabulary).collect()]
    assert got[:3] == [0, 0, 0] and len(got) == len(TEXTS) + 1
    for text, n in zip(TEXTS, got):
        if text and text.isascii():
            assert n == sum(len(model.tokenize("▁" + w)) for w in text.split())
    assert token_counts.token_counts(empty, vocabulary).count() == 0


def test_nearest_is_exact_with_copies_ties_and_bad_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(8).astype(np.float32).tolist(), "x") for i in range(300)]
    rows += [(i, [1.0] * 8, "x") for i in range(300, 420)] + [(500, None, "x"), (550, [0.0] * 8, "x"), (600, [float("nan")] * 8, "x"), (650, [None] + [1.0] * 7, "x"), (None, [1.0] * 8, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, key string")
    got = {}
    for x in ann.nearest(df).orderBy("query_id", "rank").collect():
        got.setdefault(x["query_id"], []).append((x["vec_id"], x["score"]))
    good = [(i, np.array(v, float)) for i, v, _ in rows[:420]]
    for q, v in good:
        if q % 50 == 0:
            want = sorted((-float((v * x).sum() / (np.sqrt((v * v).sum()) * np.sqrt((x * x).sum()))), i) for i, x in good if i != q)[:5]
            assert [(i, -s) for s, i in want] == got.pop(q)
    assert not got
    assert ann.nearest(df.where("false")).count() == 0


@pytest.mark.parametrize("clusters", [0, 40])
def test_windows_hold_nearest_neighbours(spark, clusters):
    """Recall of the windows alone against brute force, and the share of the table that they meet."""
    rng = np.random.default_rng(5)
    x = rng.standard_normal((8000, 48)).astype(np.float32)
    if clusters:
        x = x * 0.2 + rng.standard_normal((clusters, 48)).astype(np.float32)[rng.integers(0, clusters, 8000)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {}
    for r in ann.nearest(df, query_modulus=40, curves=48, block=16, recall=0.96).collect():
        got.setdefault(r["query_id"], {})[r["vec_id"]] = r["score"]
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    found = 0
    for q, near in got.items():
        s = u @ u[q]
        s[q] = -2
        found += len(set(np.argsort(-s)[:5].tolist()) & set(near))
        assert len(near) == 5 and all(abs(s[i] - v) < 1e-6 for i, v in near.items())
    assert len(got) == 200 and found >= 0.94 * 5 * len(got)
    # The width of the windows: some of the table's 500 blocks on a curve.
    rows = spark.createDataFrame([(i, 48, i % 40 == 0, v.tobytes()) for i, v in enumerate(x)], "pid long, dim long, q boolean, v binary")
    blocks = ann._blocks(rows, "<f4", ann._centres(rows, "<f4"), 48, 16, 2)
    reach = ann.reach_for(blocks, ann._truth(rows, "<f4", 5, 128), 0.96)
    assert blocks.where("curve = 0").count() >= 500 and 48 * (2 * reach + 1) < (500 if clusters == 0 else 250), reach


def test_hilbert_order_visits_neighbours():
    cells = np.stack(np.meshgrid(range(8), range(8), range(8), indexing="ij"), -1).reshape(-1, 3)
    at = np.argsort(ann.hilbert_index(cells, 3))
    assert (np.abs(np.diff(cells[at], axis=0)).sum(axis=1) == 1).all()


def test_fingerprints(docs, empty):
    rows = fingerprints.edit_fingerprints(docs, rows_per_bucket=3).collect()
    assert len(rows) == len(TEXTS) + 1
    order = sorted([(-1 if i == 5 else i, t or "") for i, t in enumerate(TEXTS)] + [(9, TEXTS[9])])
    want = []
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        want.append((i, len(t), hashlib.sha256((t[: len(t) - len(t) // 2] + after[: len(t) // 2]).encode()).hexdigest()))
    assert sorted((-1 if x["doc_id"] is None else x["doc_id"], x["n_chars"], x["edited_sha256"]) for x in rows) == sorted(want)
    by = {x["doc_id"]: x for x in rows}
    assert by[6]["fingerprint"] == by[None]["fingerprint"] and by[7]["fingerprint"] == by[8]["fingerprint"] and by[7]["near_next"] == 1.0
    assert 0 < by[9]["near_next"] <= 1 and all(0 <= x["near_edited"] <= 1 for x in rows)
    assert fingerprints.edit_fingerprints(empty).count() == 0


def test_fingerprints_have_one_unit_for_every_text(spark):
    rng = random.Random(6)
    script = "".join(chr(rng.randint(0x4E00, 0x9000)) for _ in range(3000))
    spaced = " ".join(f"w{rng.randint(0, 9999)}" for _ in range(700))
    rows = spark.createDataFrame([(1, script, script[:1500] + spaced[:1500]), (2, script, script[:10] + "x" + script[10:])], "id int, a string, b string")
    rows = fingerprints.with_fingerprint(fingerprints.with_fingerprint(rows, "a", "fa"), "b", "fb")
    near = {x["id"]: x["n"] for x in rows.select("id", fingerprints.likeness(rows.fa, rows.fb).alias("n")).collect()}
    # 1,497 of 3,215 3-mers are common, and a component takes two: about 0.22, with a deviation of 0.05.
    assert near[1] > 0.1 and near[2] > 0.8
    edited = fingerprints.edit_fingerprints(spark.createDataFrame([(1, script), (2, spaced)], "doc_id long, text string")).collect()
    assert {x["doc_id"]: x["near_edited"] > 0.1 for x in edited}[1]


def test_language_id(spark, docs, empty):
    en, de = ["the cat and the dog are in the house", "this is what they have said to them"], ["der hund und die katze sind im haus", "das ist was sie ihnen gesagt haben"]
    rows = [(i, RNG.choice(en) + f" {i}", "en") for i in range(60)] + [(i, RNG.choice(de) + f" {i}", "de") for i in range(60, 120)] + [(200, None, "en"), (201, "123 !", "de"), (None, "the house", "en")]
    got = {x["doc_id"]: x for x in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[i]["lang_pred"] == lang for i, _, lang in rows[:120])
    assert got[200]["lang_pred"] == got[201]["lang_pred"] == "und" and got[None]["lang_pred"] == "en" and not got[None]["held_out"]
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in range(120))
    assert langid.identify(empty).count() == 0 and langid.identify(docs, keep=True).count() == len(TEXTS) + 1
    assert {x["lang_pred"] for x in langid.identify(docs.withColumn("lang", docs.lang.substr(9, 1).isNull().cast("string")).where("false")).collect()} == set()


def test_every_labelled_language_is_learned(spark):
    def words(k, seed):
        own, letters = random.Random(k), "abcdefghijklmnopqrstuvwxyz"
        vocabulary = ["".join(own.choices(letters, k=5)) for _ in range(12)]
        return " ".join(random.Random(seed).choices(vocabulary, k=30))

    rows = [(100 * k + i, words(k, 100 * k + i), f"l{k:02}") for k in range(70) for i in range(8)]
    rows += [(9000 + i, " ".join([words(99, i)] * (8 + i)), "long") for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample = langid.training_rows(df, 5, 1000, "doc_id", "text", "lang")
    assert {y for _, y in sample} == {y for _, _, y in rows} and max(sum(y == z for _, z in sample) for _, y, in [*sample]) <= 5
    trained = sorted((t for _, t, y in rows if y == "long" and zlib.crc32(str(_).encode()) % 4 != 2), key=len)[:5]
    assert sorted((t for t, y in sample if y == "long"), key=len) == trained
    got = langid.identify(df, max_chars=1000).collect()
    assert sum(x["lang_pred"] == y for x, (_, _, y) in zip(sorted(got, key=lambda x: x["doc_id"]), rows)) > 0.95 * len(rows)


def _sets(text):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def _components(rows, percent):
    sets, comp = [_sets(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]) and comp[i] != comp[j]:
                comp = [comp[j] if c == comp[i] else c for c in comp]
    return [(d, len(sets[i]), min(rows[j][0] for j in range(len(rows)) if comp[j] == comp[i])) for i, (d, _) in enumerate(rows)]


def test_near_duplicates_match_brute_force(spark, docs, empty):
    rng, rows = random.Random(5), []
    for family in range(12):
        base = [rng.choice(WORDS) + str(rng.randint(0, 60)) for _ in range(rng.choice([3, 7, 9, 12, 40, 150]))]
        for _ in range(10):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 2])):
                words[rng.randrange(len(words))] = "changed" + str(rng.randint(0, 2))
            rows.append((len(rows), " ".join(words) + " shared passage of eleven words that many of these documents have"))
    rows += [(500, None), (501, ""), (502, " \t"), (503, "x"), (504, "X")]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 85).collect()
    assert sorted((x["doc_id"], x["n_shingles"], x["component_id"]) for x in got) == _components(rows, 85)
    assert all(x["kept"] == (x["doc_id"] == x["component_id"]) for x in got)
    mine = {x["doc_id"]: x for x in neardup.near_duplicates(docs).collect()}
    assert mine[8]["component_id"] == 7 and mine[10]["component_id"] == mine[11]["component_id"] == 9 and mine[None]["component_id"] == 6
    assert neardup.near_duplicates(empty).count() == 0


def test_rows_that_share_an_id_are_documents_of_their_own(spark, docs, empty):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(7, a, 1), (7, b, 2), (7, b, 3), (8, b + " end", 4), (None, a, 5), (None, "x y z", 6), (None, "x y z", 7), (9, None, 8), (9, "", 9), (10, " ", 10)]
    got = neardup.keep_one(spark.createDataFrame(rows, "doc_id long, text string, hash int"))
    assert got.columns == ["doc_id", "text", "hash"]
    kept = sorted((x["doc_id"] or 0, x["text"] or "") for x in got.collect())
    # One of the component {7: b, 8: b + end}: the smallest id.
    assert kept == sorted([(7, a), (7, b), (0, "x y z"), (9, ""), (9, ""), (10, " ")])
    assert neardup.keep_one(empty).count() == 0
    mine = neardup.keep_one(docs)
    assert mine.columns == docs.columns and {x["doc_id"] for x in mine.collect()} == {0, 1, 2, 3, 4, 6, 7, 9, 12, 13, 14, 15, 16}


def test_many_copies_without_an_id(spark):
    """Rows without an id take the time that rows with one take, and hot keys are dealt."""
    base = [f"w{i}" for i in range(40)]
    rows = [(None, " ".join(base[:20] + [f"x{i}"] + base[20:])) for i in range(3000)]
    rows = spark.createDataFrame(rows, "doc_id long, text string")
    assert [tuple(x) for x in neardup.near_duplicates(rows).groupBy("component_id", "kept").count().collect()] == [(None, False, 3000)]


def test_a_pair_of_many_lists_is_emitted_once(spark, monkeypatch):
    rng = np.random.default_rng(7)
    sizes, comps = rng.integers(95, 130, 30), rng.integers(0, 8, 30)
    lists = [(k, v) for k in range(40) for v in range(30) if rng.random() < 0.4]
    rows = spark.createDataFrame([(k, v, int(comps[v]), int(sizes[v])) for k, v in lists], "key long, node long, comp long, n long")
    bits = spark.createDataFrame([(v, *[0] * neardup.BITMAP_WORDS) for v in range(30)], "node long, " + ", ".join(f"{w} long" for w in neardup._BITS))
    met = {(a, b) for k, a in lists for j, b in lists if j == k and a < b and comps[a] != comps[b] and min(sizes[a], sizes[b]) * 100 >= max(sizes[a], sizes[b]) * 80}
    for deal in (neardup.DEAL, 3):
        monkeypatch.setattr(neardup, "DEAL", deal)
        got = [tuple(x) for x in neardup._across(rows, bits, 80).collect()]
        assert sorted(got) == sorted(met)
    many, lookup = spark.range(5000).selectExpr("if(id % 3 = 0, 1, id) as k", "id as x"), spark.range(0, 5000, 2).selectExpr("id as k", "id * 2 as y").union(spark.sql("select 1L, 7L"))
    hot = common.hot_keys(many, "k", few=10)
    assert hot == [1]
    for how in ("inner", "left"):
        assert sorted(map(str, common.hot_join(many, lookup, "k", hot, how).collect())) == sorted(map(str, many.join(lookup, "k", how).collect()))


def test_license_alignment(docs, empty):
    got = {x["doc_id"]: x for x in licenses.license_scan(docs).collect()}
    assert got[15]["license"] == "MIT" and got[15]["coverage"] == 1.0 and got[0]["license"] is None
    scan = licenses.Scanner(licenses.TEMPLATES, 0.8).scan
    assert scan(LONG + " Licensed UNDER the apache\nLicense; Version 2.0 " + LONG)[0] == "Apache-2.0"
    assert scan("licensed under the apache public license version 2.0 " * 2)[0] == "Apache-2.0"
    assert licenses.align("a b c x d".split(), "a c d".split()) == [(0, 0), (2, 1), (4, 2)]
    assert licenses.license_scan(empty).count() == 0


def test_repeated_and_incomplete_notices_are_found():
    scan = licenses.Scanner(licenses.TEMPLATES, 0.8).scan
    assert scan("x x x Released under the MIT License Released under the MIT License y") == ("MIT", 1.0, 5)
    # One of five words is missing, the next rarest stands far off as well.
    assert scan("license " + "q " * 60 + "released under the mit permit" + " q" * 60) == ("MIT", 0.8, 4)
    assert licenses.Scanner({"T": "a b c d e"}, 0.8).scan("a " + "x " * 40 + "b c d e")[0] == "T"
    for _ in range(200):
        a, b = [RNG.choices("abcd", k=RNG.randint(0, 9)) for _ in range(2)]
        got = licenses.common(a, b, 0, len(a), 0, len(b))[::-1]
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        assert len(got) == best[-1][-1] and all(a[i] == b[j] for i, j in got) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:]))


def test_licences_are_found_with_their_spans(docs):
    """Texts with 0 to 3 planted licences, some with changed words, among words that licences use."""
    rng = random.Random(12)
    scanner, filler = licenses.Scanner(licenses.TEMPLATES, 0.8), "the of and software under any use copy this a to license terms public river stone".split()
    names = [n for n in licenses.TEMPLATES if n not in ("BSD", "MIT-text", "Apache-2.0", "BSD-2-Clause/full", "GPL-2.0/header", "GPL-3.0/header", "LGPL-3.0/header", "AGPL-3.0/header")]
    for _ in range(60):
        text, planted = " ".join(rng.choices(filler, k=rng.randint(0, 60))), []
        for _ in range(rng.randint(0, 3)):
            name = rng.choice(names)
            words = licenses.TEMPLATES[name].split()
            if len(words) > 20:
                for _ in range(rng.randint(0, len(words) // 12)):
                    words[rng.randrange(len(words))] = "qqq"
            text += " qqq. "
            planted.append((name, len(text), len(text) + len(" ".join(words))))
            text += " ".join(words) + " qqq " + " ".join(rng.choices(filler, k=rng.randint(0, 60)))
        got = scanner.scan_all(text)[1]
        assert [f.name for f in got] == [n for n, _, _ in planted], (text, got)
        for f, (_, a, b) in zip(got, planted):
            # At most some words of the ends are cut off or added.
            assert min(f.end, b) - max(f.start, a) >= 0.7 * (b - a) and f.end - f.start <= 1.3 * (b - a) + 20
    # Gaps count: scattered words are no notice, one word more is.
    assert scanner.scan("the license was released under pressure; MIT under license")[0] is None
    assert scanner.scan("Released under the permissive MIT License")[:2] == ("MIT", 5 / 6)
    text = "İ x. Released under the MIT License y"
    (found,) = scanner.scan_all(text)[1]
    assert text[found.start : found.end] == "Released under the MIT License"
    row = {x["doc_id"]: x for x in licenses.license_scan(docs).collect()}[15]
    assert [TEXTS[15][f["start"] : f["end"]] for f in row["found"]] == ["Released under the MIT License"]


def test_mixing_keeps_budgets(docs, empty, spark):
    many = spark.range(4000).selectExpr("id as doc_id", "repeat('x', cast(id % 50 as int)) as text", "array('en','de','fr')[id % 3] as lang", "concat('src', if(id % 3 = 0, 0, id % 7)) as source")
    out = mixing.mix(many, source_domain(many.source), MIX_WEIGHTS, max_epochs=2)
    tok = {x["doc_id"]: max(1, -(-(x["doc_id"] % 50) // 4)) for x in many.select("doc_id").collect()}
    have, used = {}, {}
    domain = {x["doc_id"]: x["d"] for x in many.select("doc_id", source_domain(many.source).alias("d")).collect()}
    for x in many.collect():
        leaf = (domain[x["doc_id"]], x["lang"], x["source"])
        have[leaf] = have.get(leaf, 0) + tok[x["doc_id"]]
    for x in out.collect():
        leaf = (x["_domain"], x["lang"], x["source"])
        used[leaf] = used.get(leaf, 0) + tok[x["doc_id"]]
    budgets = mixing.leaf_budgets({k: 2.0 * v for k, v in have.items()}, MIX_WEIGHTS, 0.6 * sum(have.values()))
    assert all(used.get(k, 0) <= budgets[k] + 1e-6 and used.get(k, 0) > budgets[k] - 13 for k in have)
    assert out.groupBy("doc_id", "_epoch").count().where("count > 1").count() == 0
    assert mixing.mix(docs, source_domain(docs.source), MIX_WEIGHTS).count() <= len(TEXTS) + 1
    assert mixing.mix(empty, source_domain(empty.source), MIX_WEIGHTS).count() == 0


def test_shortages_go_to_siblings_first():
    room = {("a", "x"): 1.0, ("a", "y"): 100.0, ("b", "x"): 100.0}
    assert mixing.leaf_budgets(room, [{"*": 1.0}, {"*": 1.0}], 20.0) == {("a", "x"): 1.0, ("a", "y"): 9.0, ("b", "x"): 10.0}
    room[("a", "y")] = 2.0
    assert mixing.leaf_budgets(room, [{"*": 1.0}, {"*": 1.0}], 20.0) == {("a", "x"): 1.0, ("a", "y"): 2.0, ("b", "x"): 17.0}


def test_store_round_trip(docs, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    got = store.round_trip(docs, tokenizer("word_bpe_49k.json")).orderBy("start").collect()
    ids = lambda x: np.array(t.encode(x or "", add_special_tokens=False).ids + [2], "<u4")
    want = {(None if i == 5 else i): ids(x) for i, x in enumerate(TEXTS)}
    at = 0
    for x in got:
        assert (x["start"], x["n_tokens"], x["ids_crc32"]) == (at, len(want[x["doc_id"]]), zlib.crc32(want[x["doc_id"]].tobytes())) and x["verified"]
        at += x["n_tokens"]
    assert [x["doc_id"] for x in got][1:] == sorted([i for i in range(len(TEXTS)) if i != 5] + [9])
    assert store.round_trip(empty, tokenizer("word_bpe_49k.json")).count() == 0


def test_store_with_a_lost_recipe_is_refused(spark, docs, tmp_path):
    at = str(tmp_path / "store")
    store.write_store(docs, tokenizer("word_bpe_49k.json"), at)
    assert store.read_store(spark, at).count() == len(TEXTS) + 1
    recipes = spark.read.parquet(f"{at}/recipes").where("start > 0").toPandas()
    spark.createDataFrame(recipes, "doc_id long, start long, n_tokens long, digests array<binary>, root binary").write.mode("overwrite").parquet(f"{at}/recipes")
    with pytest.raises(ValueError, match="manifest"):
        store.read_store(spark, at)


def test_altered_stores_are_refused(spark, docs, tmp_path):
    """A recipe repeated, exchanged or altered, a chunk lost or altered."""
    whole = str(tmp_path / "whole")
    store.write_store(docs, tokenizer("word_bpe_49k.json"), whole)
    parts = {p: spark.read.parquet(f"{whole}/{p}").toPandas() for p in ("chunks", "recipes", "manifest")}
    schemas = {p: spark.read.parquet(f"{whole}/{p}").schema for p in parts}

    def altered(name, part, change):
        at = str(tmp_path / name)
        for p, rows in parts.items():
            rows = rows.sort_values("start").reset_index(drop=True) if p == "recipes" else rows.reset_index(drop=True)
            rows = change(rows.copy()) if p == part else rows
            rows = [tuple(None if v != v else int(v) if f.dataType.typeName() == "long" else v if not hasattr(v, "tolist") else v.tolist() for v, f in zip(r, schemas[p])) if p != "recipes"
                    else (None if r[0] != r[0] else int(r[0]), int(r[1]), int(r[2]), list(r[3]), r[4]) for r in rows.itertuples(index=False)]
            spark.createDataFrame(rows, schemas[p]).write.parquet(f"{at}/{p}")
        return at

    def exchanged(rows):
        rows.loc[[2, 3], "doc_id"] = rows.loc[[3, 2], "doc_id"].to_numpy()
        return rows

    def fewer(rows):
        rows.loc[4, "n_tokens"] += 1
        return rows

    def other(rows):
        rows.at[0, "ids"] = rows.at[0, "ids"][:-2] + b"\x07\x00"
        return rows

    assert store.read_store(spark, altered("same", "recipes", lambda r: r)).count() == len(TEXTS) + 1
    import pandas as pd

    for name, part, change in [("twice", "recipes", lambda r: pd.concat([r, r.iloc[:1]])), ("exchanged", "recipes", exchanged), ("fewer", "recipes", fewer), ("manifest", "manifest", lambda r: r.assign(tokens=r.tokens + 1))]:
        with pytest.raises(ValueError, match="manifest"):
            store.read_store(spark, altered(name, part, change))
    for name, change in [("lost", lambda r: r.iloc[1:]), ("other", other)]:
        at = altered(name, "chunks", change)
        assert store.read_store(spark, at, strict=False).where("not verified").count() >= 1
        with pytest.raises(Exception, match="chunks of their recipes"):
            store.read_store(spark, at).collect()


def test_chunks_survive_an_insertion():
    a = np.random.default_rng(0).integers(0, 49_000, 20_000).astype("<u2")
    b = np.insert(a, 5, [1, 2, 3])
    cuts = lambda x: {store.digest(p.tobytes()) for p in np.split(x, store.cut_points(x)[:-1])}
    assert len(cuts(a) & cuts(b)) > 0.9 * len(cuts(a)) and store.cut_points(a)[-1] == len(a)


def test_sharding(docs, empty):
    rows = sharding.shuffle_into_shards(docs, n_shards=5).collect()
    counts = [sum(x["shard"] == s for x in rows) for s in range(5)]
    assert len(rows) == len(TEXTS) + 1 and max(counts) - min(counts) <= 1
    assert all(sorted(x["slot"] for x in rows if x["shard"] == s) == list(range(counts[s])) for s in range(5))
    assert all(x["size"] == 16 + len((TEXTS[x["doc_id"]] or "").encode()) for x in rows if x["doc_id"] is not None)
    assert sharding.shuffle_into_shards(empty).count() == 0


def test_communication_matrix_margins_and_law():
    total = np.zeros((3, 4))
    for seed in range(400):
        m = np.array(sharding.communication_matrix([5, 10, 15], [8, 8, 7, 7], seed))
        assert m.sum(axis=1).tolist() == [5, 10, 15] and m.sum(axis=0).tolist() == [8, 8, 7, 7]
        total += m
    assert np.allclose(total / 400, np.outer([5, 10, 15], [8, 8, 7, 7]) / 30, atol=0.25)


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    rows = packing.pack(docs, tokenizer("byte_bpe_50k.json"), window=64).collect()
    want = {(None if i == 5 else i): np.array(t.encode(x or "", add_special_tokens=False).ids + [1], "<u4") for i, x in enumerate(TEXTS)}
    assert sum(x["length"] for x in rows) == sum(map(len, want.values())) + len(want[9])
    for x in rows:
        own = want[x["doc_id"]]
        assert zlib.crc32(own[x["start"] : x["start"] + x["length"]].tobytes()) == x["ids_crc32"] and x["doc_tokens"] == len(own)
    by = {}
    for x in rows:
        by.setdefault(x["sequence_id"], []).append((x["offset"], x["length"]))
    for pieces in by.values():
        assert sum(n for _, n in pieces) <= 64 and all(o == sum(n for p, n in pieces if p < o) for o, _ in pieces)
    assert packing.pack(empty, tokenizer("byte_bpe_50k.json")).count() == 0


def test_packing_scores_all_terms_of_a_seed(spark):
    from tokenizers import Tokenizer

    words = sorted(w[1:] for w in Tokenizer.from_file(tokenizer("byte_bpe_50k.json")).get_vocab() if w[0] == "Ġ" and w[1:].isascii() and w[1:].isalpha() and len(w) > 4)
    # 30 words of its own, more than the 24 rarest, and 10 that its topic shares.
    rows = [(i, " ".join(["and", *words[30 * i : 30 * i + 30], *words[-10 * (i % 6) - 10 : -10 * (i % 6) - 1]])) for i in range(60)]
    by = {}
    for x in packing.pack(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), tokenizer("byte_bpe_50k.json"), window=210).collect():
        by.setdefault(x["sequence_id"], set()).add(x["doc_id"] % 6)
    assert sum(len(own) <= 2 for own in by.values()) > 0.6 * len(by)


def _bm25(docs):
    """BM25 of every document (columns) for every document's distinct terms (rows), term by term."""
    n, mean, df = len(docs), sum(map(len, docs)) / len(docs), {}
    for d in docs:
        for t in set(d):
            df[t] = df.get(t, 0) + 1
    out = np.zeros((n, n))
    for j, d in enumerate(docs):
        weight = {t: d.count(t) * 2.2 / (d.count(t) + 1.2 * (0.25 + 0.75 * len(d) / mean)) * np.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) for t in set(d)}
        for i, q in enumerate(docs):
            out[i, j] = sum(weight.get(t, 0.0) for t in set(q))
    return out, df, mean


def test_packing_scores_and_choices_match_brute_force():
    rng = np.random.default_rng(4)
    docs = [np.minimum(rng.zipf(1.3, int(rng.integers(1, 90))), 5000).tolist() for _ in range(150)] + [[7] * 40] * 3
    want, df, mean = _bm25(docs)
    frequencies = np.bincount(list(df), list(df.values()), minlength=1 << 16).astype(np.int64)
    got = packing.Bm25(frequencies, len(docs), mean).scores([np.array(d, "<u2") for d in docs])
    others = ~np.eye(len(docs), dtype=bool)  # what a document scores for itself is never asked
    assert np.allclose(got[others], want[others], atol=1e-3)
    # Each window's seed takes the best of what is unused, one after another.
    sizes, room, window, used, seed, order = [len(d) for d in docs], 10, 64, set(), None, []
    while len(order) < len(docs):
        free = [i for i in range(len(docs)) if i not in used]
        d = free[0] if seed is None else min(free, key=lambda i: (-got[seed, i], i))
        order.append(d)
        used.add(d)
        left, seed = sizes[d], d if seed is None else seed
        while left:
            take = min(left, room)
            left, room = left - take, room - take
            if room == 0:
                room, seed = window, d
    assert list(packing.fill_order(got, sizes, 10, window)) == order


def test_packing_shards_hold_neighbours(spark):
    """Recall at 3 of the whole corpus' BM25 neighbours in a seed's shard, against shards dealt by chance."""
    rng = random.Random(8)
    words = [f"{a}{b}" for a in "bcdfghjklmnp" for b in ("aro", "ent", "ilo", "uma", "ost")]
    topics = [rng.sample(words, 12) for _ in range(30)]
    docs = [[rng.choice(topics[i % 30]) for _ in range(60)] for i in range(900)]
    vocabulary = {w: k for k, w in enumerate(words)}
    arrays = [np.array([vocabulary[w] for w in d], "<u2") for d in docs]
    df = np.bincount(np.concatenate([np.unique(a) for a in arrays]), minlength=1 << 16)
    bm25 = packing.Bm25(df, len(docs), 60.0)
    router = packing.Pivots(bm25, [bm25.weights([arrays[i]])[:2] for i in rng.sample(range(900), 64)])
    shard = np.empty(900, int)
    shard[np.argsort(router.keys(arrays), kind="stable")] = np.arange(900) // 90
    scores = bm25.scores(arrays)
    np.fill_diagonal(scores, -1)
    top = np.argsort(-scores, axis=1)[:, :3]
    assert (shard[top] == shard[:, None]).mean() > 0.5  # by chance: 0.1


def test_packing_brings_scattered_topics_together(spark):
    rng = random.Random(2)
    topics = [[f"{chr(97 + t % 26)}{rng.randint(100, 999)}" for _ in range(12)] for t in range(40)]
    rows = [(i, " ".join(rng.choice(topics[i % 40]) for _ in range(40))) for i in range(1200)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), tokenizer("byte_bpe_50k.json"), window=512).collect()
    by, last = {}, max(x["sequence_id"] for x in got)
    for x in got:
        by.setdefault(x["sequence_id"], []).append(x)
    assert all(sum(x["length"] for x in pieces) == 512 for q, pieces in by.items() if q < last) and sorted(by) == list(range(last + 1))
    same = [len({x["doc_id"] % 40 for x in pieces}) == 1 for pieces in by.values()]
    assert sum(same) > 0.6 * len(same)


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    told = corpus_pipeline.language_id(spark, docs, "")
    kept = corpus_pipeline.near_dedup(spark, told, "")
    mixed = corpus_pipeline.mix_sources(spark, kept, "")
    assert told.columns == kept.columns == mixed.columns == docs.columns
    assert docs.count() >= told.count() >= kept.count() > mixed.count() > 0
    rows = [(x["doc_id"], x["text"]) for x in told.collect()]
    assert {x["doc_id"] for x in kept.collect()} == {c for _, _, c in _components(rows, 80)} | {d for d, t in rows if not _sets(t)}
    assert corpus_pipeline.pack_sequences(spark, mixed, "").select("doc_id").distinct().count() == mixed.count()


def _segment(word, vocabulary, unknown):
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        options = [(best[-1][0] + unknown, best[-1][1] + 1)]
        for n in range(1, min(end, 24) + 1):
            piece = vocabulary.get(word[end - n : end])
            if piece is not None:
                options.append((best[end - n][0] + piece, best[end - n][1] + 1))
        best.append(min(options, key=lambda o: (-o[0], o[1])))
    return best[-1][1]


def test_token_counts_match_a_plain_recurrence():
    vocabulary = {w: -float(len(w)) ** 0.5 - i * 0.01 for i, w in enumerate(["a", "b", "ab", "ba", "aab", "bb", "abab", "▁", "▁a", "日", "日本", "é"])}
    counter, unknown = token_counts.TrieCounter(vocabulary), min(vocabulary.values()) - 10
    words = ["".join(RNG.choices("abc日本é", k=RNG.randint(1, 30))) for _ in range(300)] + ["".join(RNG.choices("abc日本é", k=n)) for n in (255, 256, 257, 700, 9000)]
    words += [words[-1][:300], words[-1][:256] + "ab"]
    assert counter.count(words) == [_segment("▁" + w, vocabulary, unknown) for w in words]
    assert counter.count([" ".join(words)]) == [sum(_segment("▁" + w, vocabulary, unknown) for w in words)] and max(map(len, counter.known)) <= 256


def _order_minhash(text, k=3, components=64):
    """The fingerprint by its definition, with the public xxhash library."""
    import re
    import struct

    import xxhash

    def signed(x):
        return x - (1 << 64) if x >> 63 else x

    def chain(*values):
        h = 42
        for kind, v in values:
            h = xxhash.xxh64_intdigest(v.encode() if kind == "s" else struct.pack("<q" if kind == "l" else "<i", v), seed=h)
        return signed(h)

    words = [p for w in re.split("[ \\t\\n\\x0b\\x0c\\r]", text or "") if w for p in ([w[i : i + 4] for i in range(len(w) - 3)] if len(w) > 64 else [w])]
    words += [""] * (k - len(words) if 0 < len(words) < k else 0)
    bits, seen, packed = fingerprints.POSITION_BITS, {}, []
    for i in range(len(words) - k + 1):
        h = chain(*(("s", w) for w in words[i : i + k])) >> bits
        o = seen[h] = seen.get(h, -1) + 1
        packed.append(((chain(("l", h), ("i", o)) >> bits if o else h) << bits) | i)
    packed.sort()
    out = []
    for j in range(components if packed else 0):
        first = sum(x < -(1 << 63) + j * ((1 << 64) // components) for x in packed)
        x, y = packed[first % len(packed)], packed[(first + 1) % len(packed)]
        x, y = sorted((x, y), key=lambda v: v & fingerprints.POSITION_MASK)
        out.append(f"{chain(('l', x >> bits), ('l', y >> bits)) & 0xFFFF:04x}")
    return "".join(out)


def test_fingerprints_match_their_definition(spark):
    rng = random.Random(3)
    texts = [None, "", " \t", "one", "a b", "a b c", "a b c a b c a b c a b c", "x" * 200 + " y z", " ".join(rng.choice("abcd") for _ in range(300)), "é日 本\x0bq\rw"]
    texts += [" ".join(f"w{rng.randint(0, 400)}" for _ in range(n)) for n in (5, 64, 700)]
    rows = fingerprints.with_fingerprint(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), "text", "f").collect()
    assert {x["id"]: x["f"] for x in rows} == {i: _order_minhash(t) for i, t in enumerate(texts)}


def test_likeness_estimates_order_minhash_similarity():
    """The estimate's deviation, for texts of distinct words whose similarity has a closed form."""
    rng, errors = np.random.default_rng(1), {20: [], 400: [], 3000: []}
    for n, own in errors.items():
        for edits in (1, 3, n // 10, n // 4) * 8:
            a = rng.integers(0, 1 << 40, n)
            b = a.copy()
            b[rng.choice(n, edits, replace=False)] = rng.integers(0, 1 << 40, edits)
            fa, fb = (_order_minhash(" ".join(map(str, x)), 1) for x in (a, b))
            own.append(np.mean([fa[i : i + 4] == fb[i : i + 4] for i in range(0, 256, 4)]) - _two_of_union(n, edits))
    # 64 independent orders would deviate by at most 0.0625.
    assert np.std(errors[3000]) < 0.07 and np.std(errors[400]) < 0.08 and np.std(errors[20]) < 0.16
    assert all(abs(np.mean(e)) < 0.05 for e in errors.values())


def _two_of_union(n, edits):
    """The two smallest of both sets agree if the two smallest of the union are common (the order is too)."""
    common, union = n - edits, n + edits
    return common * (common - 1) / (union * (union - 1))


def test_folded_weights_are_the_kernel_machine():
    """Scores of the folded model against kernel matrices, landmarks and ridge regression written out."""
    rows = [(" ".join(RNG.choices(WORDS[: 6 + 2 * (i % 3)], k=8)) + f" {i}", f"l{i % 3}") for i in range(40)]
    model = langid.fit(rows, dims=1 << 14, landmarks=9, ridge=1e-3)

    def features(t):
        x = np.zeros(1 << 14, np.uint8)
        langid.presence(t, x)
        return {*np.flatnonzero(x).tolist()}

    def kernel(a, b):
        return np.array([[len(x & y) / np.sqrt(len(x) * len(y)) for y in b] for x in a])

    by = {y: [features(t) for t, z in rows if z == y] for y in ("l0", "l1", "l2")}
    marks = [by[y][r] for r in range(3) for y in ("l0", "l1", "l2")]
    values, vectors = np.linalg.eigh(kernel(marks, marks))
    whiten = vectors / np.sqrt(values)
    train = kernel([features(t) for t, _ in rows], marks) @ whiten
    y = np.array([[1.0 if z == k else -1.0 for k in ("l0", "l1", "l2")] for _, z in rows])
    f = train - train.mean(axis=0)
    beta = np.linalg.solve(f.T @ f + 1e-3 * len(rows) * np.eye(f.shape[1]), f.T @ (y - y.mean(axis=0)))
    for text in ["alpha beta der", "theta und die", "gamma", rows[5][0]]:
        z = (kernel([features(text)], marks) @ whiten - train.mean(axis=0)) @ beta + y.mean(axis=0)
        e = np.exp(6 * (z - z.max()))[0]
        lang, score = model.predict([text])
        assert lang == [f"l{int(e.argmax())}"] and abs(score[0] - e.max() / e.sum()) < 1e-3


def test_budgets_of_a_table_are_those_in_memory(spark):
    rng = random.Random(9)
    for _ in range(6):
        have = {(f"d{rng.randint(0, 2)}", f"l{rng.randint(0, 3)}", f"s{rng.randint(0, 5)}"): rng.randint(1, 200) for _ in range(30)}
        weights = [{"d0": 0.5, "*": rng.choice([0.2, 1.0])}, {"l1": 0.0, "*": 1.0}, {"s3": 4.0, "*": 1.0}]
        epochs, share = rng.choice([(1, 0.6), (2, 0.9), (1, 1.0)])
        rows = spark.createDataFrame([(*k, t, float(t * epochs)) for k, t in have.items()], "d string, l string, s string, t long, room double")
        got = {(x["d"], x["l"], x["s"]): x["budget"] for x in mixing.budgets(rows, weights, share).collect()}
        want = mixing.leaf_budgets({k: float(t * epochs) for k, t in have.items()}, weights, share * sum(have.values()))
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_mixing_takes_prefixes_of_the_seeded_order(spark, monkeypatch):
    """Chosen documents of a leaf against its whole seeded order; columns that clash with inner names."""
    monkeypatch.setattr(mixing, "ROWS_PER_RANGE", 2)
    names = ["doc_id", "text", "lang", "source", "d", "l", "s", "tokens", "row", "key", "range", "_epoch", "_Domain", "id"]
    rows = [(i, "y" * (i * 7 % 90), "en", f"src{i % 3}", *[str(i)] * 10) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"`{c}` string" for c in names[4:]))
    out = mixing.mix(docs, source_domain(docs.source), MIX_WEIGHTS)
    assert out.columns == [*names, "__epoch", "__domain", "_tokens"] and out.where("d <> cast(doc_id as string)").count() == 0
    chosen = {x["doc_id"] for x in out.collect()}
    tokens_of = {i: max(1, -(-(i * 7 % 90) // 4)) for i in range(3000)}
    key = spark.range(3000).selectExpr("id", "xxhash64(7, 0, id, cast(greatest(ceil((id * 7 % 90) / 4), 1) as long), cast(null as long)) as k").collect()
    order = {x["id"]: x["k"] & (1 << 64) - 1 for x in key}
    have = {(("web", "news", "reference")[s], "en", f"src{s}"): sum(tokens_of[i] for i in range(s, 3000, 3)) for s in range(3)}
    budget = mixing.leaf_budgets({k: float(v) for k, v in have.items()}, MIX_WEIGHTS, 0.6 * sum(have.values()))
    for s, leaf in enumerate(have):
        if budget[leaf] < have[leaf]:
            left, want = int(budget[leaf]), set()
            for i in sorted(range(s, 3000, 3), key=order.get):
                left -= tokens_of[i]
                if left < 0:
                    break
                want.add(i)
            assert len(chosen & set(range(s, 3000, 3)) ^ want) <= 2  # inside the last range keys are ordered as signed numbers
        else:
            assert chosen >= set(range(s, 3000, 3))


def test_hypergeometric_law():
    import math

    def log_probability(x, good, bad, draws):
        p = draws / (good + bad)
        q = (good + bad - draws) / (good + bad)
        return sharding._binomial_log(x, good, p, q) + sharding._binomial_log(draws - x, bad, p, q) - sharding._binomial_log(draws, good + bad, p, q)

    for good, bad, draws in [(5, 9, 6), (40, 3, 11), (1000, 70, 500)]:
        for x in range(max(0, draws - bad), min(good, draws) + 1):
            exact = math.comb(good, x) * math.comb(bad, draws - x) / math.comb(good + bad, draws)
            assert abs(math.exp(log_probability(x, good, bad, draws)) - exact) <= 1e-12 + 1e-10 * exact
    good, bad, draws = 10**9, 39 * 10**9, 4 * 10**7
    mode, total = 10**6, 0.0
    p = up = math.exp(log_probability(mode, good, bad, draws))
    total, x, y, down = p, mode, mode, p
    for _ in range(12_000):
        up *= (good - x) * (draws - x) / ((x + 1) * (bad - draws + x + 1))
        x += 1
        down *= y * (bad - draws + y) / ((good - y + 1) * (draws - y + 1))
        y -= 1
        total += up + down
    assert abs(total - 1) < 1e-9


def test_sharding_numbers_equal_rows(spark):
    rows = spark.createDataFrame([(None, None)] * 900 + [(1, "a")] * 50 + [(i, f"t{i}") for i in range(50)], "doc_id long, text string")
    got = sharding.shuffle_into_shards(rows, n_shards=10, rows_per_block=50).collect()
    assert len(got) == 1000 and all(sorted(x["slot"] for x in got if x["shard"] == s) == list(range(100)) for s in range(10))
    assert sorted((x["doc_id"] or -1, x["size"], x["text_crc32"]) for x in got) == sorted((i or -1, 16 + len(t or ""), zlib.crc32((t or "").encode())) for i, t in map(tuple, rows.collect()))


def test_language_id_keeps_columns_that_clash(spark):
    rows = spark.createDataFrame([(1, "the cat", "en", "a", 0.5, (1,)), (2, None, None, "b", None, None)], "doc_id long, text string, lang string, _text string, _SCORE double, `a b` struct<`x y`: int>")
    got = langid.identify(rows, keep=True)
    assert got.columns == [*rows.columns, "_lang_pred", "__score"] and {x["_text"]: x["_lang_pred"] for x in got.collect()}["b"] == "und"


def test_pipeline_stages_on_odd_tables(spark, docs, empty):
    """Nulls, empties, repeats, clashing names and an empty table in every stage."""
    import corpus_pipeline

    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0, name
        got = stage(spark, docs, "")
        if name != "packing":
            assert got.columns == docs.columns
    assert {x["doc_id"] for x in corpus_pipeline.language_id(spark, docs, "").collect()}.isdisjoint({0, 1, 2, 3})
    assert corpus_pipeline.pack_sequences(spark, docs, "").groupBy().sum("length").first()[0] > 30_000


def test_sharding_deals_the_texts(spark):
    """Every row's text arrives in its shard, whole, null or repeated, and a shard's rows lie together by slot."""
    odd = [(1, None), (1, ""), (None, None), (None, ""), (2, "x" * 70_000), (3, "\u00e4\x00b"), (3, "a"), (4, "a")] + [(5, "same")] * 30
    docs = spark.createDataFrame(odd + [(i, f"text {i}") for i in range(10, 60)], "doc_id long, text string")
    dealt = sharding.shuffle_into_shards(docs, n_shards=4, rows_per_block=10)
    got = dealt.collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1] is None, x[1] or "")
    assert sorted(((x["doc_id"], x["text"]) for x in got), key=key) == sorted(map(tuple, docs.collect()), key=key)
    assert all(x["size"] == 16 + len((x["text"] or "").encode()) and x["text_crc32"] == zlib.crc32((x["text"] or "").encode()) for x in got)
    assert all(sorted(x["slot"] for x in got if x["shard"] == s) == list(range(22)) for s in range(4))
    again = sharding.shuffle_into_shards(docs.repartition(5), n_shards=4, rows_per_block=10).collect()
    place = lambda rows: sorted(((x["shard"], x["slot"], x["doc_id"], x["text"]) for x in rows), key=lambda x: x[:2])
    assert place(again) == place(got)
    parts = dealt.rdd.glom().map(lambda p: [(x["shard"], x["slot"]) for x in p]).collect()
    assert all(p == sorted(p) for p in parts)
