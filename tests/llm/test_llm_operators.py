"""Each training-data operator against a brute-force version or a library, and on the edges of its input."""

import collections
import hashlib
import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from cuegrid.llm import bpe_counts, fingerprints, langid, licenses, maxscore, mixing, near_dup, pieces, pii, toxicity
from cuegrid.llm.common import sample_about

EDGES = ["", " ", "  ", "\n\t ", "a", " a", "a ", "a  b", "x▁y", "▁", "é😀 x​", "\x00a\x85 b", "<s> <|endoftext|><|endoftext|> </s>",
         "it's I'LL we've  don't", "long" * 3000, "ab " * 2000, " " * 500 + "z" + " " * 40, "1234567890" * 30, "a b　c   d", "Ａｂ ﬁ"]


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def some_texts(n, seed=3, length=60, vocabulary=400):
    rng = random.Random(seed)
    words = ["".join(rng.choices("etaoinshrdlu", k=rng.randint(1, 9))) for _ in range(vocabulary)]
    return [" ".join(rng.choices(words, k=rng.randint(0, length))) for _ in range(n)]


# ---- token counts and encoding: equal to the libraries

def test_token_counts_equal_the_library(docs_of):
    from tokenizers import Tokenizer

    texts = EDGES + some_texts(60)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = docs_of([(i, t, None, None) for i, t in enumerate([*texts, None])])
    got = dict(docs.select("doc_id", bpe_counts.token_counts(F.col("text"))).collect())
    assert got == {i: len(library.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate([*texts, None])}


def test_full_tables_start_afresh(monkeypatch):
    texts = some_texts(30)
    path = public_tokenizers.path("byte_bpe_50k.json")
    want = [bpe_counts.counter(path).count(t) for t in texts]
    monkeypatch.setattr(bpe_counts, "KEPT", 7)
    monkeypatch.setattr(pieces, "KEPT", 7)
    assert [bpe_counts.MergeCounter(path).count(t) for t in texts] == want
    model = public_tokenizers.path("piece_bpe_32k.model")
    small = pieces.PieceTable(model)
    assert [x for t in texts for x in small.encode([t])] == [x for t in texts for x in pieces.table(model).encode([t])]


def test_pieces_equal_the_library(docs_of):
    import sentencepiece

    texts = [*EDGES, *some_texts(60), None]
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    docs = docs_of([(i, t, None, None) for i, t in enumerate(texts)])
    want = {i: (ids := library.encode(t or ""), library.decode(ids)) for i, t in enumerate(texts)}
    assert {r[0]: (list(r[1][0]), r[1][1]) for r in docs.select("doc_id", pieces.encoded(F.col("text"))).collect()} == want
    for r in docs.select("doc_id", pieces.digests(F.col("text")).alias("d")).select("doc_id", "d.*").collect():
        ids, back = want[r[0]]
        assert (r[1], r[2], r[3]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())


# ---- near-duplicates

def shingle_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def components(texts):
    sets = {i: shingle_set(t) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in itertools.combinations(sorted(texts), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in texts}


def family(rng, base, copies, edits):
    out = []
    for _ in range(copies):
        w = base.split()
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = "".join(rng.choices("bcdfgh", k=5))
        out.append(" ".join(w))
    return out


def test_near_duplicates_equal_all_pairs(docs_of):
    rng = random.Random(5)
    texts = some_texts(60, length=50) + ["", "one", "ONE", "one two", None, "a b c d", "A b\tc  d", " "]
    for base in [" ".join(f"w{k}x{j}" for j in range(120)) for k in range(4)]:
        texts += family(rng, base, 25, 9)
    texts += [texts[0]] * 6
    rng.shuffle(texts)
    numbered = {3 * i - 50: t for i, t in enumerate(texts)}
    got = near_dup.near_duplicates(docs_of([(i, t, None, None) for i, t in numbered.items()])).collect()
    assert {r[0]: tuple(r[1:]) for r in got} == components(numbered)
    assert max(collections.Counter(r[2] for r in got).values()) > 8


def test_large_buckets_are_compared_in_blocks(docs_of, monkeypatch):
    rng = random.Random(8)
    texts = dict(enumerate(family(rng, " ".join(f"v{j}" for j in range(90)), 40, 12)))
    monkeypatch.setattr(near_dup, "BLOCK", 7)
    got = near_dup.near_duplicates(docs_of([(i, t, None, None) for i, t in texts.items()])).collect()
    assert {r[0]: tuple(r[1:]) for r in got} == components(texts)


def test_near_duplicates_edges(docs_of):
    rows = [(1, "a b c d e f", None, None), (1, "a b c d e f", None, None), (None, "a b c d e f", None, None), (7, "a b c d e f", None, None), (9, None, None, None)]
    assert rows_of(near_dup.near_duplicates(docs_of(rows))) == sorted([(1, 2, 1, True), (1, 2, 1, True), (None, 2, None, True), (7, 2, 1, False), (9, 0, 9, True)], key=repr)
    assert near_dup.near_duplicates(docs_of(rows).limit(0)).collect() == []


@pytest.mark.parametrize("n", [1, 4, 25, 300])
def test_signatures_estimate_similarity(n):
    rng = np.random.default_rng(n)
    a, b, true = [], [], []
    for _ in range(80):
        pool = rng.integers(0, 2 ** 63, 2 * n, dtype=np.uint64)
        shared = int(n * 6 / 7)
        a.append(np.unique(pool[:n]))
        b.append(np.unique(np.concatenate([pool[:shared], pool[n:2 * n - shared]])))
        true.append(len(np.intersect1d(a[-1], b[-1])) / len(np.union1d(a[-1], b[-1])))
    equal = (near_dup.signatures(a, 128) == near_dup.signatures(b, 128)).mean(axis=1)
    assert abs(equal.mean() - np.mean(true)) < 0.02
    assert np.std(equal - np.array(true)) < 0.045


# ---- fingerprints

def generalised_jaccard(x, y):
    a, b = collections.Counter(w for w in x.replace("\n", " ").split(" ") if w), collections.Counter(w for w in y.replace("\n", " ").split(" ") if w)
    union = sum((a | b).values())
    return sum((a & b).values()) / union if union else 1.0


def test_fingerprints_estimate_generalised_jaccard(docs_of):
    # texts of different vocabularies, so that the samples of the pairs are independent
    rng = random.Random(2)
    texts = []
    for k in range(120):
        words = [f"t{k}n{j}" for j in range(25)]
        texts.append(" ".join(rng.choices(words, k=90)))
        texts.append(" ".join(rng.choices(words, weights=range(1, 26), k=90)))
    rows = {i: t for i, t in enumerate(texts)}
    got = {r["doc_id"]: r for r in fingerprints.edits_and_neighbours(docs_of([(i, t, None, None) for i, t in rows.items()])).collect()}
    errors, near = [], []
    for i, t in rows.items():
        following = rows[i - 1 if i else len(rows) - 1]
        cut = len(t) // 3
        edited = t[:len(t) - cut] + following[:cut]
        assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        errors.append(got[i]["near_edited"] - generalised_jaccard(t, edited))
        near.append(got[i]["near_next"] - generalised_jaccard(t, following))
    assert abs(np.mean(errors)) < 0.015 and np.std(errors) < 0.08
    assert abs(np.mean(near)) < 0.015 and np.std(near) < 0.08


def test_fingerprints_edges(docs_of):
    rows = [(5, "x y z", None, None), (5, "x y z", None, None), (5, "p q", None, None), (None, "x y z", None, None), (2, None, None, None), (1, "", None, None)]
    got = sorted(fingerprints.edits_and_neighbours(docs_of(rows)).collect(), key=repr)
    assert len(got) == 6
    same = [r["samples"] for r in got if r["n_chars"] == 5]
    assert len(same) == 3 and same[0] == same[1] == same[2]
    assert all(r["near_edited"] == 1.0 for r in got if r["n_chars"] == 0)
    # descending ids, nulls last, equal ids by text: 5 "p q", 5 "x y z", 5 "x y z", 2, 1, null
    assert {(r["n_chars"], r["near_next"]) for r in got if r["doc_id"] == 5 and r["n_chars"] == 5} == {(5, 1.0), (5, 0.0)}
    alone = fingerprints.edits_and_neighbours(docs_of([(4, "abcdef", None, None)])).first()
    assert alone["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest() and alone["near_next"] == 1.0
    assert fingerprints.edits_and_neighbours(docs_of(rows).limit(0)).collect() == []


def test_fingerprints_of_many_rows_of_one_id(spark, docs_of):
    texts = [f"t{i:03d} " + t for i, t in enumerate(some_texts(60))]
    rows = [(None, t, None, None) for t in texts] + [(None, "same words here", None, None)] * 40 + [(7, "seven", None, None)] * 3
    made = fingerprints.edited(docs_of(rows))
    assert made.where("copies > 1").count() == 2 and made.count() == 62
    got = fingerprints.edits_and_neighbours(docs_of(rows)).collect()
    order = [t for i, t, *_ in rows if i == 7] + sorted(t for i, t, *_ in rows if i is None)
    want = []
    for t, following in zip(order, order[1:] + order[:1]):
        cut = len(t) // 3
        want.append(hashlib.sha256((t[:len(t) - cut] + following[:cut]).encode()).hexdigest())
    assert sorted(r["edited_sha256"] for r in got) == sorted(want)
    # no pairs of rows of one id: each content meets one predecessor
    keyed = fingerprints.contents(docs_of(rows)).select(*fingerprints.CONTENT).distinct()
    assert keyed.count() == 62 and {len(r["samples"]) for r in got} == {fingerprints.SAMPLES}


# ---- personal data

def luhn_number(rng, length=16):
    body = [rng.randint(0, 9) for _ in range(length - 1)]
    total = sum(d if k % 2 else sum(divmod(2 * d, 10)) for k, d in enumerate(reversed(body)))
    return "".join(map(str, [*body, (10 - total % 10) % 10]))


def test_base_rules():
    text = "é a@b.co, x@y z@w.q-r.s 1.2.3.4 1.2.3.256 9.1.2.3.4 4111 1111 1111 1111 4111-1111-1111-1112 +1 (555) 010-9999 +12 3"
    good, bad = pii.base_spans(text)
    assert [(s.kind, text[s.start:s.end]) for s in good] == [("email", "a@b.co"), ("email", "z@w.q-r.s"), ("ip", "1.2.3.4"), ("ip", "9.1.2.3"), ("phone", "+1 (555) 010-9999")]
    assert [s.kind for s in bad if s.kind != "card"] == ["ip", "phone"]
    assert pii.redacted("é a@b.co, x", good[:1]) == "é <EMAIL>, x"


def test_swallowed_numbers_are_found(spark, docs_of):
    rng = random.Random(4)
    texts = []
    for k in range(700):
        filler = [w for t in some_texts(2, seed=k) for w in t.split()] or ["word"]
        item = (f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}", luhn_number(rng), f"u{k}.{k}@mail{k % 7}.example.com", ".".join(str(rng.randint(1, 255)) for _ in range(4)), str(rng.randint(1, 9999)), str(rng.randint(10 ** 15, 10 ** 16 - 1)))[k % 6]
        at = rng.randint(0, len(filler))
        texts.append(" ".join([*filler[:at], item, *filler[at:]]))
    phone, card = "+1 (578) 555-6437", luhn_number(rng)
    texts.append(f"word {phone} {card} word")
    docs = docs_of([(i, t, None, None) for i, t in enumerate(texts)])
    model = pii.train(docs)
    assert model.trees is not None
    base, every = pii.all_spans(texts[-1], model)
    assert base == [] and [(s.kind, texts[-1][s.start:s.end]) for s in every] == [("card", card), ("phone", phone)]
    got = {r[0]: r[1] for r in docs.select("doc_id", pii.found(F.col("text"), model, spark)).collect()}
    for i, t in enumerate(texts):
        own, _ = pii.base_spans(t)
        assert got[i]["base"] == pii.joined(own) and set(got[i]["base"].split(",")) <= set(got[i]["spans"].split(",")) | {""}
    clean = [t for i, t in enumerate(texts[:-1]) if i % 6 == 4]
    assert sum(bool(pii.all_spans(t, model)[1]) for t in clean) == 0


def test_personal_data_edges(spark, docs_of):
    docs = docs_of([(1, None, None, None), (None, "", None, None), (1, "no numbers", None, None), (2, "9" * 60_000, None, None)])
    model = pii.train(docs)
    assert {r[1]["spans"] for r in docs.select("doc_id", pii.found(F.col("text"), model, spark)).collect()} == {""}
    assert pii.train(docs.limit(0)).trees is None


def test_forms_beyond_the_base_rules_are_found(spark, docs_of):
    rng = random.Random(8)
    texts = []
    for k in range(600):
        filler = [w for t in some_texts(2, seed=k) for w in t.split()] or ["word"]
        item = (f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}", luhn_number(rng), f"u{k}.{k}@mail{k % 7}.example.com", "2024-01-15", str(rng.randint(1, 9999)), str(rng.randint(10 ** 15, 10 ** 16 - 1)))[k % 6]
        at = rng.randint(0, len(filler))
        texts.append(" ".join([*filler[:at], item, *filler[at:]]))
    model = pii.train(docs_of([(i, t, None, None) for i, t in enumerate(texts)]))
    cards = [luhn_number(rng, n) for n in (13, 14, 15)]
    for kind, case in [("email", "jörg.müller@example.com"), ("phone", "(555) 010-4477"), ("phone", "555-010-4477"), ("card", "3782 822463 10005"), ("card", " ".join("4111111111111111"))] + [("card", c) for c in cards]:
        for text in (f"word {case} word", f"{case}.", f"ask ({case}), then go"):
            base, every = pii.all_spans(text, model)
            assert set(base) <= set(every)
            assert any(s.kind == kind and text[s.start:s.end] == case for s in every), (text, every)
            assert pii.redacted(text, every) == text.replace(case, f"<{kind.upper()}>"), text
    for text in ("on 2024-01-15 or 15.01.2024", "3782 822463 10006 is none", "pages 100-200 300-400", "in 1999 2000 2001", "a @ b, x@y"):
        assert pii.all_spans(text, model) == ([], []), text


def test_every_whole_text_is_learnt_with_a_generated_case(docs_of):
    words = [f"w{k}x" for k in range(300)]
    places = set()
    for seed in range(60):
        made = pii.planted(" ".join(words), seed).split(" ")
        assert [w for w in made if w in set(words)] == words
        places.add(next(k for k, w in enumerate([*made, ""]) if k == len(words) or w != words[k]))
    assert max(places) > 200
    docs = docs_of([(i, f"{'word ' * (i % 40)}word", None, None) for i in range(1_100)])
    assert sum(r["n"] for r in pii._examples(docs).where("label = 1").collect()) >= 1_100


def test_texts_of_both_halves_fit_and_calibrate(spark, docs_of):
    """Addresses of one half only: neither half is left out of the trees or of the thresholds."""
    made = [(i, f"a host {1 + i % 200}.{i % 250}.{i % 99}.{1 + i % 90} of {i} answers", None, None) for i in range(300)]
    halves = {r["doc_id"]: r["half"] for r in docs_of(made).select("doc_id", F.expr("pmod(xxhash64(doc_id, text), 2)").alias("half")).collect()}
    for half in (0, 1):
        model = pii.train(docs_of([r for r in made if halves[r[0]] == half] + [(1_000 + i, f"word {i} word", None, None) for i in range(300)]))
        assert model.least["ip"] < float("inf")
        assert model.trees.margin(np.array([pii.features("a host 10.20.30.40 answers", pii.Span("ip", 7, 18))], float))[0] > 0


# ---- language and toxicity: held-out accuracy

def invented(language, n, seed):
    rng = random.Random(seed)
    parts = {"xx": ["the", "ing", "sh", "wh", "ed"], "yy": ["ich", "keit", "sch", "und", "ver"], "zz": ["eau", "oux", "ment", "que", "elle"]}[language]
    return " ".join("".join(rng.choices(parts, k=rng.randint(1, 3))) for _ in range(n))


def test_language_on_held_out_texts(spark, docs_of):
    rows = [(i, invented(lang, 30, i), lang, None) for i, lang in enumerate(["xx", "yy", "zz"] * 40)]
    rows += [(1000, None, None, None), (1001, "", None, None), (1002, "12 :-)", "xx", None), (1003, invented("zz", 1, 7), None, None), (None, invented("yy", 900, 8), None, None)]
    docs = docs_of(rows)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    model = langid.train(docs.where(~held), per_language=20)
    assert model.languages == ["xx", "yy", "zz"]
    got = docs.select("doc_id", "lang", langid.predicted(F.col("text"), model, spark).alias("p")).select("doc_id", "lang", "p.*").collect()
    for r in got:
        if r["doc_id"] in (1000, 1001, 1002):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        else:
            assert 0 <= r["score"] <= 1 and r["lang_pred"] == (r["lang"] or {1003: "zz", None: "yy"}[r["doc_id"]])
    empty = langid.train(docs.limit(0))
    assert {tuple(r[0]) for r in docs.select(langid.predicted(F.col("text"), empty, spark)).collect()} == {("und", 0.0, 0.0)}


def test_forward_sums_all_segmentations():
    vocabulary = langid.vocabulary_of(public_tokenizers.path("piece_bpe_32k.model"))
    p = np.random.default_rng(1).random((vocabulary.size, 2))
    number = {w: i for i, w in enumerate(vocabulary.pieces)}
    words = ["▁the", "▁inger", "qqx", "▁日本"]

    def every(word):
        if not word:
            return np.ones(2)
        total = np.zeros(2)
        for k in range(1, min(len(word), langid.LONGEST_PIECE) + 1):
            piece = number.get(word[:k], vocabulary.size - 1 if k == 1 else None)
            if piece is not None:
                total = total + p[piece] * every(word[k:])
        return total
    for at, codes in langid.by_length(words):
        for i, got in zip(at, langid.forward(vocabulary, codes, p)):
            assert np.allclose(np.exp(got), every(words[i]))


def test_long_words_are_scored_whole():
    vocabulary = langid.vocabulary_of(public_tokenizers.path("piece_bpe_32k.model"))
    p = np.random.default_rng(1).random((vocabulary.size, 2)) * 1e-4
    rng = random.Random(4)
    words = ["▁" + "".join(rng.choice(["the", "ing", "日", "é", "x"]) for _ in range(k)) for k in (1, 5, 9, 20, 60, 300)]
    for at, codes in langid.by_length(words):
        for i, got in zip(at, langid.forward(vocabulary, codes, p)):
            assert np.isfinite(got).all() and np.allclose(got, langid.forward_one(vocabulary, words[i], p))
    one = langid.forward_one(vocabulary, "▁" + "the" * 100_000, p)
    assert np.isfinite(one).all() and (one < -1_000).all()


def test_labels_beyond_the_bound_are_not_learned(spark, docs_of):
    docs = docs_of([(i, invented("xx", 5, i), f"l{i % 7}", None) for i in range(70)] + [(100 + i, invented("yy", 5, i), "yy", None) for i in range(20)])
    assert langid.train(docs, most_languages=3).languages == ["l0", "l1", "yy"]


def test_samples_take_rows_not_ids(spark):
    df = spark.range(0, 40_000, 1, 4).selectExpr("cast(null as long) as doc_id", "'one text' as text", "id % 2 as g")
    drawn = dict(sample_about(df, "g", 1_000, "salt").groupBy("g").count().collect())
    assert all(800 < drawn[g] < 1_200 for g in (0, 1))
    many = sample_about(df, "g", 1_000, "salt", groups=1)
    assert 1_600 < many.count() < 2_400 and many.columns == df.columns


def test_toxicity_on_held_out_texts(spark, docs_of):
    rng = random.Random(6)
    rows, labels = [], {}
    for i, t in enumerate(some_texts(900, seed=9, length=40)):
        bad = i % 4 == 0
        words = t.split()
        if bad:
            words[rng.randint(0, len(words)):0] = rng.sample(["vileword", "nastyword", "rudeword"], 2)
        rows.append((i, " ".join(words), None, None))
        labels[i] = int(bad)
    docs = docs_of([*rows, (None, None, None, None), (5000, "", None, None)])
    table = spark.createDataFrame([*labels.items(), (5000, None)], "doc_id long, toxic int")
    fit = table.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    model = toxicity.train(docs, fit)
    assert len(model[0]) < 2_000
    got = dict(docs.select("doc_id", toxicity.scored(F.col("text"), model, spark)).collect())
    held = [i for i in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([(got[i] >= 0.7) == bool(labels[i]) for i in held]) > 0.97
    assert 0 <= got[None] < 0.5 and got[None] == got[5000]
    assert toxicity.train(docs, fit.where("toxic = 0")) is None and toxicity.train(docs.limit(0), fit) is None


# ---- licenses

def test_licenses_edges(docs_of):
    notice = dict(licenses.NOTICES)["GPL-3.0"]
    rows = [(1, "filler words " * 50 + notice + " more words" * 30, None, None), (1, notice.upper(), None, None), (None, "Released, under the\tMIT license!!", None, None),
            (2, None, None, None), (3, "", None, None), (4, "under the", None, None), (5, "This work is licensed under nothing at all", None, None)]
    assert rows_of(licenses.matches(docs_of(rows)).select("doc_id", "license", "containment")) == [(1, "GPL-3.0", 1.0), (1, "GPL-3.0", 1.0), (None, "MIT", 1.0)]
    assert licenses.matches(docs_of(rows).limit(0)).collect() == []


# ---- top-k

def test_top_k_equals_all_scores(spark):
    rng = np.random.default_rng(3)
    vectors = [(i, [float(x) for x in rng.normal(0, 0.3, 12)]) for i in range(700)]
    vectors += [(i, vectors[i - 700][1]) for i in range(700, 760)]  # ties
    odd = [(900, None), (901, [1.0, None]), (902, [float("nan")] * 12), (903, [float("inf")] * 12), (None, [1.0] * 12), (904, [0.5]), (920, [])]
    df = spark.createDataFrame(vectors + odd, "vec_id long, embedding array<float>")
    got = maxscore.top_k(df.selectExpr("*", "0 as shard", "0 as block", "0 as score"), k=20, shard=100, query_block=8).collect()
    whole = {i: np.pad(np.floor(64 * np.array(v, np.float32).astype(float)).astype(int), (0, 12 - len(v))) for i, v in [*vectors, (904, [0.5]), (920, [])]}
    want = []
    for q in (i for i in whole if i % 20 == 0):
        scores = sorted((-int(whole[q] @ v), i) for i, v in whole.items() if i != q)[:20]
        want += [(q, r, i, -s) for r, (s, i) in enumerate(scores, 1)]
    assert sorted(map(tuple, got)) == sorted(want)
    assert maxscore.top_k(df.limit(0)).collect() == []
    assert len(maxscore.top_k(df.where("vec_id in (0, 3, 4)")).collect()) == 2


# ---- mixing

def test_permutation_is_a_bijection(spark):
    for n in (1, 2, 7, 64, 1000):
        got = [r[0] for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(3), F.lit(5))).collect()]
        assert sorted(got) == list(range(n)) and (n < 64 or got != list(range(n)))


def levels(sizes, share=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    left, target, free = share * sum(sizes.values()), dict.fromkeys(names, 0.0), set(names)
    while free and left > 1e-9:
        per = left / sum(weight[s] for s in free)
        over = {s for s in free if target[s] + per * weight[s] > most * sizes[s]}
        for s in over or free:
            given = most * sizes[s] - target[s] if s in over else per * weight[s]
            target[s] += given
            left -= given
        free -= over or free
    return target


@pytest.mark.parametrize("counts", [{"a": 60, "b": 200, "c": 40, None: 25}, {"only": 9}, {"x": 0, "y": 30}, {str(k): 5 * k for k in range(1, 12)}])
def test_mix_meets_its_targets(docs_of, counts):
    rng = random.Random(1)
    rows = [(next(numbers), " ".join(["w"] * rng.randint(0, 120)) if n else None, None, s) for numbers in [itertools.count()] for s, n in counts.items() for _ in range(max(n, 1))]
    docs = docs_of([*rows, *rows[:1]])
    sizes = collections.Counter()
    for r in [*rows, *rows[:1]]:
        sizes[r[3]] += len((r[1] or "").split())
    got = mixing.word_counts(mixing.mix(docs, block=8)[0]).collect()
    again = mixing.word_counts(mixing.mix(docs, block=8)[0]).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, again), key=repr)
    of = {r[0]: r[3] for r in rows}
    want, taken = levels(sizes), collections.Counter()
    for r in got:
        assert r["source_size"] == sizes[of[r["doc_id"]]] and abs(r["target"] - want[of[r["doc_id"]]]) < 1e-6 and 0 <= r["taken"] <= 2 * r["size"]
        taken[of[r["doc_id"]]] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(12, 0.03 * want[s])


def test_mix_draws_each_block_once_before_twice(docs_of):
    docs = docs_of([(i, "w " * 100, None, "ab"[i % 2]) for i in range(60)])
    slots = mixing.mix(docs, block=16, slots_per_shard=64)[1].collect()
    for sid in {r["sid"] for r in slots}:
        own = [r for r in slots if r["sid"] == sid]
        assert len({r["ordinal"] for r in own}) == len(own)
        times = collections.Counter(r["block"] for r in own)
        assert max(times.values()) - min([*times.values(), 0] if len(times) < -(-3000 // 16) else times.values()) <= 1
    assert len({r["shard"] for r in slots}) > 1


def test_taken_texts(docs_of):
    assert mixing.rebuilt("a b\nc  d", [(0, 2, 1), (2, 4, 1)]) == "a b\nc  d"
    assert mixing.rebuilt("a b c d", [(0, 2, 2), (3, 4, 1)]) == "a b a b d"
    rows = [(i, " ".join(f"d{i}w{j}" for j in range(40)), "xx", "ab"[i % 2]) for i in range(40)] + [(None, "p q r", None, None), (3, "", "xx", "a"), (4, None, "xx", "a")]
    docs = docs_of(rows, extra=False)
    words = mixing.word_counts(mixing.mix(docs)[0]).where("taken > 0").groupBy().sum("taken").first()[0]
    got = mixing.taken_texts(docs)
    assert got.columns == docs.columns and sum(len(r["text"].split()) for r in got.collect()) == words
    assert all(r["n_chars"] == len(r["text"]) for r in got.collect())
    assert mixing.taken_texts(docs.limit(0)).collect() == []
