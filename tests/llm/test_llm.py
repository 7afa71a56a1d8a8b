"""The training-data operators against brute force, an exact library, and their edge cases."""

import hashlib
import math
import random
import re
import time
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quadscope.llm import _common, chat, decontaminate, jaccard, licenses, quality, queries, sentencepiece_bpe, token_counts, toxicity, urls, winnow

MODEL = queries.tokenizer("piece_bpe_32k.model")
ODD = [None, "", " ", "a", "\n\n", "é😀 ▁x", "word " * 30_000, "same text here again and more", "same text here again and more", "\x00\x01", "one two three four"]


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids and texts, empty and very long texts, repeated rows, extra columns of clashing names."""
    rows = [(None if i == 5 else i, t, "x", float(i), i) for i, t in enumerate(ODD)] + [(3, "a", "x", 3.0, 3)]
    return spark.createDataFrame(rows, "doc_id long, text string, host string, score double, n int").repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, host string, score double, n int")


@pytest.fixture(scope="module")
def some(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").cache()


def texts(df):
    return [(r.doc_id, r.text or "") for r in df.collect()]


# --- SentencePiece


def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_pieces_are_the_librarys():
    sp, model = library(), sentencepiece_bpe.load(open(MODEL, "rb").read())
    rnd = random.Random(7)
    alphabet = "  aabbc▁\n\t\x00é€😀 <s>0x1 \r\nthe ing tion aaaa"
    cases = ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(40))) for _ in range(3000)] + ["a" * n for n in range(200)] + ["ab" * n for n in range(60)]
    assert model.encode(cases) == sp.encode(cases)
    assert [t for _, _, t in model.round_trip(cases)] == [sp.decode(i) for i in sp.encode(cases)]
    for _ in range(3000):
        ids = [rnd.choice([0, 1, 2, rnd.randrange(3, 259), rnd.randrange(259, 32000), 29871]) for _ in range(rnd.randrange(12))]
        assert model.decode(ids) == sp.decode(ids)


def test_long_words_are_the_librarys():
    """Words without a space, in which many pairs are merged at once, and ties that hang on one another."""
    sp, model = library(), sentencepiece_bpe.load(open(MODEL, "rb").read())
    rnd = random.Random(8)
    cases = []
    for alphabet in ("abcdefghijklmnopqrstuvwxyz", "etaoin", "ab", "aaaab", "theingtion", "=-_#*", "0123456789", "éàçabc", "абвгдекноп", "a€b"):
        cases += ["".join(rnd.choice(alphabet) for _ in range(n)) for n in (40, 49, 50, 97, 130, 300, 300, 1000, 4000)]
    parts = ["ing", "tion", "the", "er", "ab", "con", "ment", "pre", "un", "ly", "xq", "zz", "www", "http"]
    cases += ["".join(rnd.choice(parts) for _ in range(rnd.randrange(10, 400))) for _ in range(60)] + [c * n for c in ("a", "ab", "=", " ", "é") for n in (48, 49, 60, 151, 700)]
    assert model.encode(cases) == sp.encode(cases)
    assert [model.encode([c])[0] for c in cases[:20]] == sp.encode(cases[:20])


def test_a_word_of_a_megabyte_takes_seconds():
    model, rnd = sentencepiece_bpe.load(open(MODEL, "rb").read()), random.Random(1)
    long = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1_000_000))
    whole = took(lambda: model.merge([long]))
    assert whole < 20 and whole < 10 * took(lambda: model.merge([long[:250_000]]))


def test_words_leave_the_store_and_come_back(monkeypatch):
    monkeypatch.setattr(sentencepiece_bpe, "CACHE_WORDS", 5)
    model = sentencepiece_bpe.PieceModel(open(MODEL, "rb").read())
    lines = [f"word{i} again {i % 3}" for i in range(40)] * 2
    assert [model.encode([x])[0] for x in lines] == library().encode(lines)


def test_encode_queries(odd, none, some):
    sp = library()
    for df in (odd, some):
        got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in sentencepiece_bpe.encode_digests(df, MODEL).collect()}
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        assert got == {(i, len(sp.encode(t)), sha(",".join(map(str, sp.encode(t)))), sha(sp.decode(sp.encode(t)))) for i, t in texts(df)}
    full = sentencepiece_bpe.encode(odd, MODEL)
    assert full.count() == odd.count() and all(list(r.ids) == sp.encode(ODD[r.doc_id] or "") for r in full.where("doc_id is not null").collect())
    assert sentencepiece_bpe.encode_digests(none, MODEL).count() == 0


# --- decontamination


def brute_scan(text, items, n=8):
    words = decontaminate.words_of(text)
    hit, found = set(), set()
    for name, item in items:
        w = decontaminate.words_of(item)
        for i in range(max(1, len(w) - n + 1)) if w else ():
            gram = w[i : i + n]
            for j in range(len(words) - len(gram) + 1):
                if words[j : j + len(gram)] == gram:
                    hit.update(range(j, j + len(gram)))
                    found.add(name)
    return len(words), len(hit), sorted(found)


def test_decontamination(spark, odd, none):
    rnd = random.Random(3)
    docs = [" ".join(rnd.choice("abcÉ") + rnd.choice(["", ",", "-x", "!"]) for _ in range(rnd.randrange(60))) for _ in range(60)]
    items = [(str(i), " ".join(rnd.choice("abcÉ") for _ in range(rnd.choice([0, 2, 5, 7, 8, 11])))) for i in range(25)] + [("", "A B c a b c a b c"), ("3", "a a a a a a a a a")]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    bench = spark.createDataFrame([(int(i) if i else None, t) for i, t in items] + [(99, None)], "item_id long, text string")
    wanted = {i: brute_scan(t, items) for i, t in enumerate(docs)}
    for most in (10_000, 40):  # one block, and several
        got = decontaminate.scan(df, bench, max_windows=most).collect()
        assert {r.doc_id: (r.n_words, r.n_hit, sorted(r.items)) for r in got} == wanted
        assert all(r.contaminated == (r.n_items >= 2) and r.items_sha256 == hashlib.sha256(",".join(sorted(r["items"])).encode()).hexdigest() for r in got)
        kept = {r.doc_id for r in decontaminate.remove(df, bench, min_items=1, max_windows=most).collect()}
        assert kept == {i for i, w in wanted.items() if not w[2]}
    assert decontaminate.scan(odd, bench).count() == odd.count() and decontaminate.scan(none, bench).count() == 0
    assert decontaminate.scan(df, bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.remove(odd, bench, min_items=99).columns == odd.columns


@pytest.mark.parametrize("most, piece", [(10_000, 50_000), (3, 2)])
def test_rows_are_judged_one_by_one(spark, monkeypatch, most, piece):
    """Rows of one doc_id, or of none, that differ in text; with one block of windows and with several."""
    monkeypatch.setattr(decontaminate, "PIECE", piece)
    bad, worse = "Begin: one two, three four five six seven eight. End", "nine one two three four five six seven eight nine ten"
    rows = [(1, bad), (1, "clean"), (None, bad), (None, "clean"), (2, None), (3, worse), (3, worse)]
    df = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, _row int").repartition(3)
    bench = spark.createDataFrame([(0, "One two three four five six seven eight nine"), (0, "One two three four five six seven eight nine"), (1, "five six"), (None, "")], "item_id long, text string")
    kept = decontaminate.remove(df, bench, min_items=1, max_windows=most)
    assert kept.columns == df.columns and sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted([(1, "clean"), (None, "clean"), (2, None)], key=repr)
    cut = decontaminate.remove(df, bench, mode="spans", max_windows=most)
    assert {r._row: r.text for r in cut.collect()} == {0: "Begin: . End", 1: "clean", 2: "Begin: . End", 3: "clean", 4: None, 5: "nine  ten", 6: "nine  ten"}
    assert sorted((r._row, r.n_hit, r.n_items) for r in decontaminate.scan(df, bench, key="_row", max_windows=most).collect()) == [(0, 8, 2), (1, 0, 0), (2, 8, 2), (3, 0, 0), (4, 0, 0), (5, 9, 2), (6, 9, 2)]
    with pytest.raises(ValueError):
        decontaminate.remove(df, bench, mode="words")


def test_windows_of_another_benchmark_are_not_taken(spark, monkeypatch):
    """A worker that keeps windows meets another list of items at the address of the first."""
    monkeypatch.setattr(decontaminate, "id", lambda _: 7, raising=False)
    monkeypatch.setattr(decontaminate, "_LOADED", [])
    docs = SimpleNamespace(columns=["text"], schema=None, mapInArrow=lambda run, _: run)
    docs.sparkSession = SimpleNamespace(sparkContext=SimpleNamespace(broadcast=lambda v: SimpleNamespace(value=v)))
    batch = pa.RecordBatch.from_arrays([pa.array(["one two three", "four five six"])], ["text"])
    for item, left in (("one two three", "four five six"), ("four five six", "one two three")):
        run = decontaminate.remove(docs, spark.createDataFrame([(0, item)], "item_id long, text string"), min_items=1)
        assert [t for b in run([batch]) for t in b.column(0).to_pylist()] == [left]


# --- Jaccard join


def brute_components(rows):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and 100 * len(a & b) >= 80 * len(a | b):
                up[find(i)] = find(j)
    by = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        by[find(i)].append(doc)
    return sorted(((doc, len(sets[i]), doc if not sets[i] else min((d for d in by[find(i)] if d is not None), default=None)) for i, (doc, _) in enumerate(rows)), key=repr)


def near_copies(n=240):
    rnd = random.Random(5)
    base = [[f"w{rnd.randrange(400)}" for _ in range(rnd.choice([20, 60, 90]))] for _ in range(6)]
    passage = [f"p{i}" for i in range(30)]
    out = []
    for i in range(n):
        words = list(base[min(rnd.randrange(12), 5)])
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 4])):
            words[rnd.randrange(len(words))] = f"e{rnd.randrange(50)}"
        words = passage + words if i % 3 == 0 else words
        out.append((i, " ".join(words[: len(words) - rnd.choice([0, 0, 3])])))
    return out


@pytest.mark.parametrize("chunk, hot, few, giant", [(512, 10**9, 9, 50_000), (7, 4, 3, 5), (7, 10**9, 3, 5)])
def test_components(spark, monkeypatch, chunk, hot, few, giant):
    """With production parameters, and so small ones that every hot path is taken."""
    monkeypatch.setattr(jaccard, "CHUNK", chunk)
    monkeypatch.setattr(jaccard, "FEW", few)
    monkeypatch.setattr(jaccard, "GIANT", giant)
    monkeypatch.setattr(jaccard, "HOT_LEAST", min(hot, 1000) if hot > 1000 else hot)
    rows = near_copies()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted((tuple(r) for r in jaccard.join(df).collect()), key=repr) == brute_components(rows)


def test_components_where_every_shingle_is_hot(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "HOT_LEAST", 5)
    rows = [(i, f"a text of few words that is there {'again' if i % 2 else 'anew'} and again") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in jaccard.join(df).collect()), key=repr) == brute_components(rows)


def test_many_hot_shingles_are_not_broadcast(spark, monkeypatch):
    members = spark.createDataFrame([(None, None, t, r, 5 + r, 6 + r) for t in range(20) for r in range(3)], "lead long, lead_n long, token long, ref long, n long, reach long")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        wanted = sorted(tuple(r) for r in jaccard._blocks(members).collect())
        monkeypatch.setattr(jaccard, "HOT_FEW", 3, raising=False)
        many = jaccard._blocks(members)
        assert "Broadcast" not in many._jdf.queryExecution().executedPlan().toString()
        assert wanted and sorted(tuple(r) for r in many.collect()) == wanted
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_components_of_odd_rows(odd, none):
    assert sorted((tuple(r) for r in jaccard.join(odd).collect()), key=repr) == brute_components(texts(odd))
    kept = jaccard.one_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([None, 0, 1, 2, 3, 4, 6, 7, 9, 10], key=repr)
    assert jaccard.join(none).count() == 0 and jaccard.one_of_each(none).count() == 0


@pytest.mark.parametrize("few", [500_000, 0])
def test_one_row_of_each_component_stays(spark, monkeypatch, few):
    """Rows of one doc_id are told apart by their texts, and null ids come last; with broadcasts and without."""
    monkeypatch.setattr(jaccard, "ROWS_FEW", few)
    x, y, z, w = "one two three four five six", "not a copy of anything at all here", "and this stands alone as well today", "a fourth text of its own words here"
    rows = [(3, x), (3, y), (None, x), (None, z), (9, w), (9, w), (None, z), (None, None), (4, " "), (4, " "), (3, x + " seven eight nine ten eleven")]
    df = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, _tag int").repartition(3)
    got = sorted(((r.doc_id, r.text) for r in jaccard.one_of_each(df).collect()), key=repr)
    assert got == sorted([(3, x), (3, y), (None, z), (9, w), (None, None), (4, " "), (4, " "), rows[-1]], key=repr)


def test_sets_that_share_a_name_are_told_apart(spark, monkeypatch):
    scan, seen = jaccard._scan, []

    def scanned(docs, seed):
        seen.append(seed)
        found = scan(docs, seed)
        return found if seed else found.withColumn("ref", F.when(F.col("ref").isNotNull(), F.lit(7).cast("long")))

    monkeypatch.setattr(jaccard, "_scan", scanned)
    rows = near_copies(20)
    got = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert seen == [0, 1] and sorted((tuple(r) for r in got), key=repr) == brute_components(rows)


def test_hot_keys_are_joined_by_broadcast(spark):
    left = spark.createDataFrame([(i, 5 if i % 3 else i) for i in range(5000)] + [(-1, None)], "i long, k long")
    right = spark.createDataFrame([(k, f"v{k}") for k in range(0, 5000, 2)] + [(5, "five")], "k long, v string")
    got = _common.hot_join(left, right, "k", 5001)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted((tuple(r) for r in left.join(right, "k", "left").collect()), key=repr)


def test_trees_find_what_all_pairs_find():
    rnd = np.random.default_rng(1)
    base = [rnd.integers(0, 1 << 62, rnd.integers(5, 60)).astype(np.uint64) for _ in range(8)]
    sets = [np.unique(np.concatenate([b[rnd.random(len(b)) > 0.08], rnd.integers(0, 1 << 62, 2).astype(np.uint64)])) for b in base for _ in range(9)]
    tree = jaccard.Tree(sets, np.arange(len(sets)), 1024)
    found = {(min(x, y), max(x, y)) for i, j in jaccard.traverse(tree, tree) for x, y in zip(i.tolist(), j.tolist())}
    true = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if jaccard._linked(len(np.intersect1d(sets[i], sets[j])), len(sets[i]), len(sets[j]))}
    assert true and true <= found


# --- winnowing


def test_winnowing_keeps_its_guarantee():
    rnd = random.Random(2)
    text = lambda n: "".join(rnd.choice("abcdé ") for _ in range(n))
    for _ in range(30):
        shared = text(winnow.W + winnow.K - 1)
        a, b = text(rnd.randrange(50)) + shared + text(40), text(rnd.randrange(90)) + shared
        number, _, hashes = winnow.select([a, b])
        assert set(hashes[number == 0]) & set(hashes[number == 1])


def test_selection_is_the_windows_minimum(monkeypatch):
    rnd = random.Random(4)
    cases = ["".join(rnd.choice("ab") for _ in range(n)) for n in (0, 1, 5, 15, 16, 17, 31, 32, 33, 200)] + ["a" * 90]
    number, place, hashes = winnow.select(cases)
    for i, t in enumerate(cases):
        grams = [winnow.select([t[k : k + winnow.K]])[2][0] for k in range(max(1, len(t) - winnow.K + 1))] if t else []
        want = {}
        for k in range(max(1, len(grams) - winnow.W + 1)) if grams else ():
            window = grams[k : k + winnow.W]
            at = k + max(j for j, h in enumerate(window) if h == min(window))
            want[at] = grams[at]
        assert dict(zip(place[number == i].tolist(), hashes[number == i].tolist())) == want
    long = "".join(rnd.choice("abcdef") for _ in range(3000))
    whole = winnow.select([long])
    monkeypatch.setattr(winnow, "STRETCH", 500)
    assert all((a == b).all() for a, b in zip(whole, winnow.select([long])))


def brute_fingerprint(text):
    """Position -> hash, gram by gram and window by window."""
    wide = (1 << 64) - 1
    grams = []
    for i in range(max(len(text) - winnow.K + 1, min(len(text), 1))):
        h = 0
        for j in range(winnow.K):
            h = (h * winnow._BASE + (ord(text[i + j]) if i + j < len(text) else 0) + 1) & wide
        h = (h ^ h >> 32) * 0xD6E8FEB86659FD93 & wide
        grams.append(((h ^ h >> 29) * winnow._BASE & wide) >> 24)
    out = {}
    for i in range(max(len(grams) - winnow.W + 1, min(len(grams), 1))):
        window = grams[i : i + winnow.W]
        at = i + max(j for j, h in enumerate(window) if h == min(window))
        out[at] = grams[at]
    return out


def test_likenesses_are_those_of_plain_fingerprints(spark):
    rnd = random.Random(11)
    base = "".join(rnd.choice("abcdé 😀") for _ in range(400))
    cases = ["", "a", "short", base, base[:300], base[100:], base + "!", base, "ab" * 60, "x" * 90, base[::-1], base[:150] + "ab" * 60]
    rows = {r.doc_id: r for r in winnow.compare_next(spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string").repartition(3)).collect()}

    def like(a, b):
        a, b = (set(brute_fingerprint(x).values()) for x in (a, b))
        return len(a & b) / len(a | b) if a | b else 1.0

    for i, text in enumerate(cases):
        after = cases[i - 1] if i else cases[-1]
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        assert (rows[i].near_edited, rows[i].near_next) == (pytest.approx(like(text, edited)), pytest.approx(like(text, after)))
        assert rows[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
    found = {r.doc_id: dict(zip(r.positions, r.hashes)) for r in winnow.fingerprint(spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")).collect()}
    assert found == {i: brute_fingerprint(t) for i, t in enumerate(cases)}


@pytest.mark.parametrize("heavy", [1000, 3])
def test_next_of_repeated_and_null_ids(spark, monkeypatch, heavy):
    """Rows of one doc_id, and of none, follow one another by the hash of their text, dealt over buckets or not."""
    monkeypatch.setattr(winnow, "HEAVY", heavy)
    rows = [(5, f"five {i} " * 9) for i in range(40)] + [(None, f"none {i} " * 9) for i in range(50)] + [(i, f"own {i} " * 9) for i in range(30)] + [(9, "same " * 9)] * 7
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("h", F.xxhash64("text"))
    order = sorted(((r.doc_id is None, -(r.doc_id or 0), r.h, r.text) for r in df.collect()))
    texts_ = [t for *_, t in order]
    wanted = sorted(hashlib.sha256((t[: len(t) - len(t) // 3] + after[: len(t) // 3]).encode()).hexdigest() for t, after in zip(texts_, texts_[1:] + texts_[:1]))
    assert sorted(r.edited_sha256 for r in winnow.compare_next(df.drop("h").repartition(5)).collect()) == wanted


def test_next_documents(spark, odd, none, some):
    rows = sorted(texts(some), reverse=True)
    got = {r.doc_id: r for r in winnow.compare_next(some).collect()}
    prints = defaultdict(set)
    number, _, hashes = winnow.select([t for _, t in rows])
    for n, h in zip(number.tolist(), hashes.tolist()):
        prints[n].add(h)
    for k, (i, t) in enumerate(rows):
        after = (k + 1) % len(rows)
        edited = t[: len(t) - len(t) // 3] + rows[after][1][: len(t) // 3]
        union = prints[k] | prints[after]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert got[i].near_next == pytest.approx(len(prints[k] & prints[after]) / len(union) if union else 1.0)
        assert (got[i].fingerprint == got[i].edited_fingerprint) == (t == edited)
    by = defaultdict(set)
    for i, t in rows:
        by[t].add(got[i].fingerprint)
    assert all(len(v) == 1 for v in by.values())
    assert winnow.compare_next(odd).count() == odd.count() and winnow.compare_next(none).count() == 0
    assert [r.near_next for r in winnow.compare_next(odd.where("doc_id = 7")).collect()] == [1.0]
    assert winnow.fingerprint(odd).count() == odd.count()


# --- classifiers


def test_toxicity(spark, odd, none, some, sf):
    lexicon = toxicity.learn(some, spark.read.parquet(f"{sf}/labels.parquet"), _common.fold("doc_id", 4) != 2)
    bad, good = lexicon.score("you are an 1d10t and a l0ser"), lexicon.score("the trash can and the class clown stood there")
    assert bad > 0.3 > good and lexicon.score("іdіоt") > 0.3 and lexicon.score(None) == lexicon.score("") < 0.3
    assert lexicon.score("idiot") > lexicon.score("idiot " + "fine words " * 5000)
    got = {r.doc_id: r.score for r in toxicity.score(odd, lexicon).collect()}
    assert len(got) == len(ODD) and all(0 <= s <= 1 for s in got.values())
    assert toxicity.score(none, lexicon).count() == 0 and toxicity.remove(odd, lexicon).columns == odd.columns
    seed = toxicity.learn(some, spark.read.parquet(f"{sf}/labels.parquet").limit(0), F.lit(True))
    assert seed.score("what a moron") > 0.3 > seed.score("what a day")


def brute_features(lexicon, text):
    """Every occurrence of every entry that no occurrence of an exception holds, by plain search."""
    folded = toxicity.fold(text)

    def spans(what):
        return [(i, i + len(what)) for i in range(len(folded)) if folded.startswith(what, i)]

    free = [(a, b) for e in lexicon.exceptions for a, b in spans(f" {e} ")]
    total = sum(w for entry, w in lexicon.entries for a, b in spans(entry) if not any(x <= a and b <= y for x, y in free))
    return math.log1p(total), math.log1p(1000 * total / (len(folded) + 200))


def test_lexicon_finds_what_plain_search_finds():
    rnd = random.Random(9)
    lexicon = toxicity.Lexicon([(" trash ", 1.0), (" tras", 0.5), (" can ", 2.0), (" idiot", 3.0), (" a b ", 0.25), (" b ", 0.125)], ("trash can", "can a", "a b a", "b a b a b", "idiot proof"))
    words = ["trash", "can", "a", "b", "Idiot", "1d10t", "proof", "idiots", "tr4sh", "é", "0", "trashy", "!", "сan"]
    for _ in range(400):
        text = " ".join(rnd.choice(words) for _ in range(rnd.randrange(25)))
        assert lexicon.features(text) == pytest.approx(brute_features(lexicon, text))


def took(fn, *args):
    best = float("inf")
    for _ in range(3):
        began = time.perf_counter()
        fn(*args)
        best = min(best, time.perf_counter() - began)
    return best


def test_toxicity_of_very_long_texts_is_linear():
    lexicon = toxicity.Lexicon([(" trash ", 1.0), (" x ", 2.0)])
    assert took(lexicon.score, "trash can x " * 40_000) < 10 * took(lexicon.score, "trash can x " * 10_000)


def brute_counts(text):
    """Term counts one by one; the hashes are the documented ones."""
    out, wide = defaultdict(int), (1 << 64) - 1

    def bucket(x, n):
        return ((((x ^ (x >> 31)) * 0x9E3779B97F4A7C15) & wide) >> 40) % n

    powers = [0x100000001B3]
    for _ in range(63):
        powers.append(powers[-1] * 0x100000001B3 & wide)
    raw = text.encode() + b" "
    for a, b in zip(raw, raw[1:]):
        if a and b:
            out[quality.WORDS + quality.RUNS + int(quality._CLASS[a]) * quality._N + int(quality._CLASS[b])] += 1
    words, word = [], []
    for c in raw:
        if c > 32:
            word.append(c + 32 if 65 <= c <= 90 else c)
        elif word:
            words.append(bytes(word))
            word = []
    for w in words:
        for x, y, z in zip(w, w[1:], w[2:]):
            out[quality.WORDS + bucket(x | y << 8 | z << 16, quality.RUNS)] += 1
        out[bucket(sum((c + 1) * powers[i & 63] for i, c in enumerate(w)) & wide, quality.WORDS)] += 1
    again = sum(a == b for a, b in zip(words, words[1:]))
    out[quality.TERMS - 2], out[quality.TERMS - 1] = again, len(words) - again
    return {k: v for k, v in out.items() if v}


def test_quality_terms_and_neighbours(some):
    cases = ["", "a", "A bc  bc BC\n1 2x!", "é€😀 ▁x", " lead", "word " * 70, "x" * 200 + " y", "same same"] + [t for _, t in texts(some)[:40]]
    found = quality.counts([t.encode() for t in cases])
    for row, t in zip(found, cases):
        assert {int(k): int(row[k]) for k in np.flatnonzero(row)} == brute_counts(t)
    rows = [t for _, t in texts(some)[:120]] * 2  # every labelled vector twice: ties everywhere
    model = quality.fitted(quality.counts([t.encode() for t in rows]), np.array([float(i % 3 > 0) for i in range(len(rows))]))
    vectors = model.project(quality.counts([t.encode() for t in cases]))
    top, near = model.nearest(vectors)
    for v, rows_of, sims in zip(vectors, top, near):
        plain = sorted((-round(sum(a * b for a, b in zip(v, w)) * quality.SCALE), k) for k, w in enumerate(model.vectors.tolist()))[: quality.K]
        assert [k for _, k in plain] == rows_of.tolist() and [-s / quality.SCALE for s, _ in plain] == sims.tolist()
    one, many = model.score([cases[-1]]), model.score(cases * 20)
    assert one[0] == many[len(cases) - 1] == many[-1]


def test_quality(spark, odd, none, some, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.learn(some, labels, _common.fold("doc_id", 5) != 0)
    got = {r.doc_id: r.score for r in quality.score(some, model).collect()}
    held = [(r.quality, got[r.doc_id]) for r in labels.where(_common.fold("doc_id", 5) == 0).collect() if r.doc_id in got]
    assert np.mean([q == (s >= 0.3) for q, s in held]) > 0.95
    assert model.score([None, ""]).tolist() == [model.prior] * 2
    assert quality.score(odd, model).count() == odd.count() and quality.score(none, model).count() == 0
    assert quality.learn(some, labels.limit(0), F.lit(True)).score(["x"]).tolist() == [1.0]
    assert quality.keep(odd, model).columns == odd.columns


# --- urls


def brute_rule(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(r, v) for r, v in urls.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return host, path, *(max(fits, key=lambda e: len(e[0])) if fits else (None, None))


def test_urls(spark, sf):
    odd = [None, "", "no scheme", "http://COM/x", "http://com", "http://a.example.com/en/1?x=/#f", "https://www.example.com/en/", "http://x.www.example.com/en/q", "http://notexample.com/en/", "ftp://b.net/fr/?a=1", "http://net/es/", "http://net/esx", "http://h?q=http://com/", "a://b://com/"]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(odd)], "page_id long, url string, host string").unionByName(spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", F.lit("y").alias("host")))
    model = urls.learn(pages)
    found = urls.judge(pages, model).collect()
    assert sorted((r.host, r.path, r.rule) for r in found if r.rule) == sorted(brute_rule(r.url)[:3] for r in pages.collect() if brute_rule(r.url)[2])
    by = {r.page_id: r for r in found if r.page_id < len(odd)}
    for r in pages.where(f"page_id < {len(odd)} and host = 'x'").collect():
        host, path, name, verdict = brute_rule(r.url)
        assert any((f.host, f.path, f.rule) == (host, path, name) and f.verdict == (verdict or f.verdict) for f in found if f.page_id == r.page_id)
    assert by and all(r.verdict in ("allow", "block") for r in found)
    assert urls.judge(pages.limit(0), urls.learn(pages.limit(0))).count() == 0


def plain_features(model, url):
    rest = url.split("://", 1)[1] if "://" in url else ""
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host) :])[0]
    tail = rest[len(host) + len(path) :]
    query = tail[1:].split("#")[0] if tail.startswith("?") else ""
    raw = url.encode()
    labels = host.lower().split(".")
    last = path.split("/")[-1]
    suffixes = [labels[-1], ".".join(labels[-2:]), ".".join(labels[-3:]), last.split(".")[-1] if "." in last else "", path[1:].split("/")[0]]
    entropy = -sum(n / len(raw) * math.log2(n / len(raw)) for n in Counter(raw).values())
    digits = sum(c in b"0123456789" for c in raw)
    numbers = [len(url), len(host), len(labels), len([p for p in path.split("/") if p]), digits / max(1, len(url)), entropy, len([q for q in query.split("&") if q]), float("#" in tail), len(path)]
    return numbers + [t.get(s, model.default) for s, t in zip(suffixes, model.suffixes)]


def plain_score(model, url):
    """A walk through every tree, one url at a time."""
    x, total = plain_features(model, url), model.bias
    for tree in model.trees:
        at = 0
        while tree[at][0] >= 0:
            at = 2 * at + (2 if x[tree[at][0]] > tree[at][1] else 1)
        total += tree[at][2]
    return 1 / (1 + math.exp(-total))


def test_trees_judge_as_a_plain_walk_does(spark, sf):
    odd = ["", "no scheme", "http://é.org/ü?x#y", "http://h?q=http://com/", "a://b.c/d.html?x=1&&y#z?w", "http://x/a.b/c#", "http://x.tar.gz/.htaccess"]
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url").unionByName(spark.createDataFrame([(-1 - i, u) for i, u in enumerate([*odd, None])], "page_id long, url string"))
    model = urls.learn(pages)
    assert len(model.trees) == urls.TREES
    by = {r.page_id: r.url or "" for r in pages.collect()}
    for r in urls.judge(pages, model).collect():
        assert r.score == pytest.approx(plain_score(model, by[r.page_id]))
        assert r.rule is not None or r.verdict == ("block" if r.score >= 0.5 else "allow")
    tables = urls.train([f"http://h{i}.org/" for i in range(3000)], np.arange(3000) % 2.0, np.ones(3000)).suffixes
    assert len(tables[1]) == 3000  # no suffix of the sample is left out


def test_trees_learn():
    rnd = random.Random(1)
    data = [("http://h.org/" + "x" * rnd.randrange(3, 60), rnd.random()) for _ in range(600)]
    blocked = np.array([float(len(u) > 40) for u, _ in data])
    model = urls.train([u for u, _ in data], blocked, np.ones(len(data)))
    assert np.mean((model.score([u for u, _ in data]) > 0.5) == blocked) > 0.98
    assert urls.train([], np.zeros(0), np.zeros(0)).score(["a"])[0] < 0.5


# --- licenses


def test_licenses(spark, odd, none):
    mit, bsd = licenses.TEMPLATES["MIT-text"], licenses.TEMPLATES["BSD-text"]
    noise = " ".join(f"n{i}" for i in range(400))
    worn = mit.split()
    worn[20] = "changed"
    rows = ["", "Released under the MIT License.", f"{noise} {mit.upper()} {noise} {bsd}", " ".join(worn), " ".join(mit.split()[:20]), noise, f"{noise}\nLicensed under CC BY-NC 4.0. {noise}", None]
    got = {(r.doc_id, r.license) for r in licenses.scan(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    assert got == {(1, "MIT"), (2, "MIT-text"), (2, "BSD-text"), (3, "MIT-text"), (6, "CC-BY-NC-4.0")}
    whole = {n: t for n, t in licenses.TEMPLATES.items() if n.endswith(("whole", "notice"))}
    df = spark.createDataFrame([(n, f"Copyright (c) 2001 {noise[:90]}\n" + t.replace(". ", ".\n * ").title()) for n, t in whole.items()], "doc_id string, text string")
    found = {(r.doc_id, r.license) for r in licenses.scan(df).collect()}
    assert {(n, n) for n in whole} <= found and ("ISC-whole", "MIT-whole") not in found
    assert licenses.scan(odd).count() == 0 and licenses.scan(none).count() == 0
    twice = spark.createDataFrame([(1, rows[1]), (1, rows[1])], "doc_id long, text string")
    assert licenses.scan(twice).count() == 2


def test_licenses_of_repeated_grams_and_in_blocks(spark, monkeypatch):
    """A template that repeats itself spans more words than it has distinct grams."""
    again = " ".join(["a b c d e f g"] * 6 + [f"w{i}" for i in range(12)])
    noise = " ".join(f"n{i}" for i in range(60))
    df = spark.createDataFrame([(0, f"{noise} {again} {noise}"), (1, f"{noise} x y z u v {noise}"), (2, noise)], "doc_id long, text string")
    for most in (licenses.MAX_GRAMS, 1):
        monkeypatch.setattr(licenses, "MAX_GRAMS", most)
        got = {(r.doc_id, r.license, r.containment) for r in licenses.scan(df, {"again": again, "short": "x y z u v", "": " ", "other": "not there at all today"}).collect()}
        assert got == {(0, "again", 1.0), (1, "short", 1.0)}


def test_licenses_are_sqls(spark, monkeypatch):
    import duckdb

    rnd = random.Random(6)
    rows = []
    for i in range(60):
        words = [f"n{rnd.randrange(99)}" for _ in range(rnd.randrange(120))]
        for t in rnd.sample(sorted(licenses.TEMPLATES.values()), 2):
            part = [w if rnd.random() > 0.02 else "changed" for w in t.split()]
            words[(at := rnd.randrange(len(words) + 1)) : at] = part[: rnd.choice([len(part), len(part), len(part) * 9 // 10])]
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    con = duckdb.connect()
    con.register("documents", df.toArrow())
    key = lambda r: (r[0], r[1], round(r[2], 9), *r[3:])
    got = sorted(key(r) for r in licenses.scan(df).collect())
    assert len(got) > 60 and got == sorted(key(r) for r in con.sql(queries.op7_sql()).fetchall())


def test_license_plan_has_no_python(some):
    plan = licenses.scan(some)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|MapInArrow", plan)


# --- chat


def test_chat(spark, monkeypatch):
    rows = [(1, 0, "system", "rules"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 2, None, "late"), (None, None, "ann", "x"), (2, 0, "system", "alone"), (1, 1, "ann", "hi")]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "conv_id long, turn long, role string, text string, part int, perspective string")
    got = {(r.conv_id, r.perspective): r for r in chat.rotate(df).collect()}
    assert set(got) == {(1, "ann"), (1, "bob"), (1, "unknown"), (None, "ann")}
    one = got[1, "ann"]
    assert one.text.startswith("<|system|>\nrules\n<|end|>\n<|assistant|>\nhi\n<|end|>\n<|assistant|>\nhi") and "<|user name=bob|>\n\n<|end|>" in one.text
    assert [one.text[int(a) : int(b)] for a, b in (s.split("-") for s in one.mask_spans.split(","))] == ["hi\n<|end|>\n"] * 2 and one.n_turns == 5
    assert chat.rotate(df.limit(0)).count() == 0


def brute_rotation(rows, most_turns, most_chars):
    """Plain Python: sort, count, cut, render."""
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn is None, turn or 0, role or "unknown", text or ""))
    out = []
    for conv, said in by.items():
        parts, n, c = defaultdict(list), 0, 0
        for _, _, role, text in sorted(said):
            parts[n // most_turns + c // most_chars].append((role, text))
            n, c = n + 1, c + len(text)
        for speaker in {s[2] for s in said} - {"system"}:
            for part, turns in parts.items():
                text, spans = "", []
                for role, words in turns:
                    text += "<|" + ("assistant" if role == speaker else "system" if role == "system" else "user name=" + role) + "|>\n"
                    if role == speaker:
                        spans.append((len(text), len(text) + len(words) + 9))
                    text += words + "\n<|end|>\n"
                out.append((conv, speaker, part, len(turns), text, ",".join(f"{a}-{b}" for a, b in spans), sum(b - a for a, b in spans)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("few", [100_000, 0])
def test_long_conversations_come_in_parts(spark, monkeypatch, few):
    """Skewed lengths, one turn number for all, copies, null turns and ids, many speakers."""
    for name, value in (("MAX_TURNS", 8), ("MAX_CHARS", 400), ("FEW", few), ("SALTS", 3)):
        monkeypatch.setattr(chat, name, value)
    rows = [(1, i, f"s{i % 3}", f"t{i}") for i in range(200)] + [(2, 5, "a", f"u{i}") for i in range(150)] + [(3, 1, "b", "same")] * 90
    rows += [(4, i, "s1" if i % 2 else "system", "long " * 100 if i < 12 else f"x{i}") for i in range(120)] + [(None, None if i % 3 else i, f"p{i % 40}", f"n{i}") for i in range(60)]
    rows += [(5, i, "ann", "hi") for i in range(8)] + [(6, 0, "ann", "y" * 399)] + [(7, 0, None, "y" * 400), (7, 1, "é", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    assert sorted((tuple(r) for r in chat.rotate(df).collect()), key=repr) == brute_rotation(rows, 8, 400)


def test_chat_sql_cuts_the_same_parts(spark, monkeypatch):
    import duckdb

    rows = [(1, i % 700, f"s{i % 3}", f"t{i}") for i in range(1300)] + [(2, None if i % 2 else i, "a", "z" * 300_000) for i in range(7)] + [(3, 0, "a", "hi")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    con = duckdb.connect()
    con.register("conversations", df.toArrow())
    assert sorted((tuple(r) for r in chat.rotate(df).collect()), key=repr) == sorted(con.sql(queries.OP1).fetchall(), key=repr)


# --- token counts


@pytest.mark.parametrize("block", [1, 3, 7, 1000])
def test_blocks_are_stitched(block):
    rnd = np.random.default_rng(0)
    for n in (0, 1, 5, 50):
        tokens = rnd.integers(2, 5, n)
        lengths, tail = token_counts.block_scan(tokens, 2, block)
        want = [len(p) for p in "".join("|" if t == 2 else "x" for t in tokens).split("|")]
        assert [*lengths.tolist(), tail] == want


def test_files_are_stitched(spark, tmp_path):
    stream = np.array([5, 6, 2, 7, 8, 9, 9, 9, 2, 2, 4, 4], "<u2")
    for k, (a, b) in enumerate(((0, 2), (2, 4), (4, 4), (4, 7), (7, 9), (9, 11), (11, 12))):
        (tmp_path / f"part-{k:05d}-x.txt").write_bytes(stream[a:b].tobytes())
    rows = token_counts.scan(spark, str(tmp_path)).orderBy("file", "place").collect()
    assert [(r.n_tokens, r.closed) for r in rows] == [(2, True), (5, True), (0, True), (2, False)]


@pytest.mark.parametrize("whole", [5, 6, 40])
def test_ranges_of_large_files_are_stitched(spark, tmp_path, whole):
    rnd = np.random.default_rng(3)
    stream = rnd.choice([2, 5, 6, 7], 400, p=[0.1, 0.3, 0.3, 0.3]).astype("<u2")
    for k, (a, b) in enumerate(((0, 130), (130, 132), (132, 300), (300, 300), (300, 400))):
        (tmp_path / f"part-{k:05d}-é x.txt").write_bytes(stream[a:b].tobytes())
    want = [len(p) for p in "".join("|" if t == 2 else "x" for t in stream).split("|")]
    rows = token_counts.scan(spark, str(tmp_path), whole=whole).orderBy("file", "start", "place").collect()
    assert [r.n_tokens for r in rows if r.closed] == want[:-1] and [r.n_tokens for r in rows if not r.closed] == [n for n in want[-1:] if n]


def test_a_torn_token_file_is_an_error(spark, tmp_path):
    (tmp_path / "part-00000.txt").write_bytes(b"\x05\x00\x02")
    with pytest.raises(Exception, match="buffer size"):
        token_counts.scan(spark, str(tmp_path))


def test_counts(odd, none, some):
    sp = library()
    for df in (odd, some):
        assert sorted(((r.doc_id, r.n_tokens) for r in token_counts.count(df, MODEL).collect()), key=repr) == sorted(((i, len(sp.encode(t))) for i, t in texts(df)), key=repr)
    assert token_counts.count(none, MODEL).count() == 0


def test_counts_of_rows_without_a_stable_order(spark):
    """Every run of this table's plan meets the rows in another order."""

    def mixed(batches):
        for batch in batches:
            yield batch.take(pa.array(np.random.default_rng().permutation(batch.num_rows)))

    rows = [(i, "a " * i) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sp = library()
    wanted = [(i, len(sp.encode(t))) for i, t in rows]
    for other in (df.mapInArrow(mixed, df.schema), df.dropDuplicates(["doc_id"]), df.orderBy(F.rand(1)), df.where("doc_id < 90").unionByName(df.where("doc_id >= 90"))):
        assert sorted(tuple(r) for r in token_counts.count(other, MODEL).collect()) == wanted


# --- pipeline


def plain_vote(model, text):
    """Cosine with every labelled vector, the nearest vote."""
    v = model.project(quality.counts([text.encode()]))[0]
    near = sorted((-round(float(np.dot(v, w)) * quality.SCALE), k) for k, w in enumerate(model.vectors))[: quality.K]
    votes = [(math.exp(20 * (-s / quality.SCALE - 1)), model.labels[k]) for s, k in near]
    return sum(w * y for w, y in votes) / sum(w for w, _ in votes) if near[0][0] < 0 else model.prior


def test_pipeline_of_odd_rows(spark, odd, none, sf):
    """Null ids and texts, empty and very long texts, repeated rows, clashing columns, an empty table."""
    import corpus_pipeline as p

    labels = spark.read.parquet(f"{sf}/labels.parquet")
    for docs in (odd, none):
        for name, stage in p.STAGES[:-1]:
            kept = stage(spark, docs, sf)
            assert kept.columns == docs.columns and kept.schema.simpleString() == docs.schema.simpleString()
            rows = kept.collect()
            assert {(r.doc_id, r.text) for r in rows} <= {(r.doc_id, r.text) for r in docs.collect()}
            if name == "toxicity":
                lexicon = toxicity.learn(docs, labels, _common.fold("doc_id", 4) != 2)
                wanted = [r for r in docs.collect() if lexicon.score(r.text) < 0.3]
            elif name == "quality classifier":
                model = quality.learn(docs, labels, _common.fold("doc_id", 5) != 0)
                wanted = [r for r in docs.collect() if model.score([r.text])[0] >= 0.3]
            elif name == "n-gram Jaccard join":
                # the rows 3 and 8 are copies: row 3 (there twice) of text "a", 7 and 8 of one text
                found = sorted((r.doc_id, r.text) for r in rows if r.doc_id is not None)
                assert len(rows) == (len(docs.collect()) - 2 if docs is odd else 0) and len(set(found)) == len(found)
                continue
            else:
                wanted = docs.collect()
            assert sorted(rows, key=repr) == sorted(wanted, key=repr), name
        assert p.tokenize(spark, docs, sf).count() == docs.count()


def test_pipeline_stages(spark, some, sf):
    import corpus_pipeline as p

    labels = spark.read.parquet(f"{sf}/labels.parquet")
    first = p.drop_toxic(spark, some, sf)
    lexicon = toxicity.learn(some, labels, _common.fold("doc_id", 4) != 2)
    bias, x, y = lexicon.curve
    score = lambda t: 1 / (1 + math.exp(-(bias + sum(w * f for w, f in zip((x, y), brute_features(lexicon, t))))))
    assert sorted(r.doc_id for r in first.collect()) == sorted(i for i, t in texts(some) if score(t) < 0.3) and first.count() < some.count()
    second = p.keep_quality(spark, first, sf)
    model = quality.learn(first, labels, _common.fold("doc_id", 5) != 0)
    assert sorted(r.doc_id for r in second.collect()) == sorted(i for i, t in texts(first) if plain_vote(model, t) >= 0.3) and second.count() < first.count()
    third = p.drop_near_copies(spark, second, sf)
    fourth = p.drop_contaminated(spark, third, sf)
    assert first.columns == second.columns == third.columns == fourth.columns == some.columns
    rows = texts(second)
    assert {r.doc_id for r in third.collect()} == {c for _, _, c in brute_components(rows)}
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    windows = decontaminate.WindowSet([(i, decontaminate.words_of(t)) for i, t in items])
    assert {r.doc_id for r in fourth.collect()} == {r.doc_id for r in third.collect() if not windows.scan(decontaminate.words_of(r.text))[2]}
    sp = library()
    assert {(r.doc_id, r.n_tokens) for r in p.tokenize(spark, fourth, sf).collect()} == {(i, len(sp.encode(t))) for i, t in texts(fourth)}
