"""Alignment, prefix trie and id files, each held against a plain version."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece
from pyspark import cloudpickle
from tokenizers import Tokenizer

from cuegrid.llm import alignment, id_files, prefix_trie
from cuegrid.llm.queries import CHECKS, QUERIES

SF = "/root/testdata/sf0.001"
ODD = ["a", "B", "É", "é", "é", "́", " ", " ", "  ", "\n", "\n\n", "\x1c", "\x85", "\xa0", "　", ".", ",", "...", "'s", " 'S", "12", "½", "Σ", "İ", "İ.", "ß", "ﬁ", "<|endoftext|>", "<|ENDOFTEXT|>",
       "<s>", "</s>", "<unk>", "<0x41>", "_", "日本", "🙂", "​", "-", "don't", "\t", "\x00", "Å", "²", "ก็", "the ", "of", "été", "Èou.,", "▁"]


def odd_texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(ODD[:-1] if rng.random() < 0.98 else ODD) for _ in range(rng.randint(0, 30))) for _ in range(n)] + [None, "", " ", "  ", "\n", "x" * 3_000, " " * 500]


# alignment

def plain_alignment(rows):
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    own = alignment.aligner(None, None)
    per, count = [], Counter()
    for i, t in rows:
        made = None
        if t:
            ids_a, ids_b = a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)
            bytes_a, bytes_b = [own.bytes_a[x] for x in ids_a], [own.bytes_b[x] for x in ids_b]
            whole = (" " + t).encode()
            if b"".join(bytes_a) == whole == b"".join(bytes_b):
                cover_a, cover_b = ([k for k, x in enumerate(parts) for _ in x] for parts in (bytes_a, bytes_b))
                links = sorted(set(zip(cover_a, cover_b)))
                groups, start = [], 0
                for at in range(1, len(whole) + 1):
                    if at == len(whole) or cover_a[at] != cover_a[at - 1] and cover_b[at] != cover_b[at - 1]:
                        sides = [",".join(str(ids[k]) for k in sorted(set(cover[start:at]))) for ids, cover in ((ids_a, cover_a), (ids_b, cover_b))]
                        groups.append("|".join(sides))
                        start = at
                pairs = [(ids_a[x], ids_b[y]) for x, y in links]
                count.update(pairs)
                made = len(ids_a), len(ids_b), len(groups), pairs, hashlib.sha256(";".join(groups).encode()).hexdigest()
        per.append((i, made))
    best = defaultdict(int)
    for (_, y), n in count.items():
        best[y] = max(best[y], n)
    return Counter((i, 0, 0, 0, 0, 0, 0, "") if m is None else (i, *m[:3], len(m[3]), sum(count[p] == best[p[1]] for p in m[3]), sum(count[p] for p in m[3]), m[4]) for i, m in per)


def test_alignment_equals_the_plain_one(spark):
    rows = list(enumerate(odd_texts(800, 1))) + [(None, "the of"), (3, "the of"), (3, "the of")]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, part string, block string")
    got = Counter(tuple(r)[:8] for r in alignment.aligned(docs).collect())
    assert got == plain_alignment(rows)
    assert alignment.aligned(docs.limit(0)).collect() == []


def test_alignment_query_over_all_documents(spark):
    df = QUERIES["op11_alignment"](spark, SF)
    assert df.columns[:8] == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert {t for c, t in df.dtypes if c != "groups_sha256"} == {"bigint"}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert Counter(tuple(r)[:8] for r in df.collect()) == plain_alignment([tuple(r) for r in docs])


def test_small_blocks_change_nothing(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = Counter(map(tuple, alignment.aligned(docs).collect()))
    monkeypatch.setattr(alignment, "BLOCK_CHARS", 20_000)
    monkeypatch.setattr(alignment, "BLOCK_CHUNKS", 500)
    assert Counter(map(tuple, alignment.aligned(docs).collect())) == want


def test_small_rows_of_blocks_change_nothing(spark, monkeypatch):
    rows = list(enumerate(odd_texts(800, 2)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    monkeypatch.setattr(alignment, "SEGMENT", 100)
    assert Counter(tuple(r)[:8] for r in alignment.aligned(docs).collect()) == plain_alignment(rows)
    # the tokens of one chunk spell it, but not those of the text
    rows = [(1, "the \u2581"), (2, ""), (3, None)]
    assert Counter(tuple(r)[:8] for r in alignment.aligned(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == plain_alignment(rows)


def test_blocks_are_rows_of_bounded_size(spark, monkeypatch):
    """Whatever a block holds, its rows, and the row groups of the table, which writers and readers hold whole, do not grow with it."""
    docs = spark.createDataFrame([(i, " ".join(f"w{k % 5_003}" for k in range(i, i + 20_000))) for i in range(60)], "doc_id long, text string").coalesce(1)
    tables, written = [], alignment.as_table
    monkeypatch.setattr(alignment, "as_table", lambda *a, **b: tables.append(written(*a, **b)) or tables[-1])
    assert alignment.aligned(docs).count() == 60
    sizes = {"binary": lambda v: len(v) // 4, "array": len}
    kinds = {c: k.split("<")[0] for c, k in tables[0].dtypes}
    assert max(sizes[kinds[c]](r[c]) for r in tables[0].collect() for c in kinds if kinds[c] in sizes and r[c] is not None) <= 100_000
    files = [pq.ParquetFile(f.removeprefix("file:").replace("///", "/")).metadata for f in tables[0].inputFiles()]
    assert max(m.row_group(g).total_byte_size for m in files for g in range(m.num_row_groups)) < 20 << 20


def test_gustavson_product_and_links(spark):
    rng = np.random.default_rng(3)
    for _ in range(20):
        x, y = rng.random((6, 9)) < 0.3, rng.random((9, 5)) < 0.3
        csr = lambda m: alignment.Csr(alignment.offsets(m.sum(axis=1)), np.nonzero(m)[1], m.shape[1])
        pattern, values = alignment.product(csr(x), csr(y))
        dense = np.zeros((6, 5), int)
        dense[pattern.rows, pattern.indices] = values
        assert (dense == x.astype(int) @ y.astype(int)).all()
    text = "Schiffahrt, naïve étude"
    row = spark.createDataFrame([(text,)], "text string").select(alignment.links("text").alias("l")).first()["l"]
    assert sum(x["n_bytes"] for x in row) == len((" " + text).encode()) and row[0]["start"] == 0 and row[-1]["end"] == len((" " + text).encode())


# prefix trie

def plain_trie(turns):
    own = defaultdict(list)
    for c, turn, role, text in turns:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(rows)] for c, rows in own.items()}
    built = {}
    for c, rows in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(own.get(c - c % 20, [])[:h] + rows[h:])
    members = defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[built[c][:d]].append(c)
    children = Counter(p[:-1] for p in members if p)
    out = Counter()
    for p, own_ in members.items():
        below = [q for q in members if q[:len(p)] == p]
        saved = sum((len(members[q]) - 1) * len(q[-1][1].split()) for q in below if q)
        ends = ",".join(str(c) for c in own_ if len(built[c]) == len(p))
        out[(own_[0], len(p), members[p[:-1]][0] if p else None, len(own_), children[p], sum(not children[q] for q in below), saved, hashlib.sha256(ends.encode()).hexdigest())] += 1
    return out


def some_conversations(seed):
    rng = random.Random(seed)
    rows = []
    for c in [*rng.sample(range(60), 40), 1_000, 1_003]:
        for turn in range(rng.randint(0, 7)):
            rows.append((c, turn if turn else None, rng.choice(["user", None]), rng.choice(["a b", "c", "", None])))
    rows += [(2_001 + 20 * k, t, "user", "the same") for k in range(30) for t in range(6)]
    return rows + [(None, 0, "user", "nobody's")]


@pytest.mark.parametrize("container", [1, 5, 40, 1_000])
def test_trie_equals_the_plain_one(spark, container):
    rows = some_conversations(container)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, depth string, n int")
    got = prefix_trie.shared_starts_trie(df, container)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert Counter(map(tuple, got.collect())) == plain_trie(rows)


def test_trie_of_nothing_and_long_conversations(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert prefix_trie.shared_starts_trie(spark.createDataFrame([], schema)).collect() == []
    rows = [(c, t, "user", f"turn {t}" if t < 300 else f"{c}") for c in (1, 2, 3) for t in range(301)] + [(7, 0, "user", "x"), (7, 0, "user", "x")]
    got = prefix_trie.shared_starts_trie(spark.createDataFrame(rows, schema), 50)
    assert Counter(map(tuple, got.collect())) == plain_trie(rows)


def test_trie_query_has_sql():
    assert "op12_prefix_trie" in CHECKS


# id files

def plain_ids(texts):
    model = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [[*model.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]


def expected_rows(rows):
    out, at = Counter(), 0
    for (i, _), ids in zip(rows, plain_ids([t for _, t in rows])):
        out[(i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))] += 1
        at += len(ids)
    return out


def test_id_files_query_over_all_documents(spark):
    df = QUERIES["op13_id_files"](spark, SF)
    assert dict(df.dtypes) == {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"}
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
    assert Counter(map(tuple, df.collect())) == expected_rows(docs)


def test_words_are_encoded_as_whole_texts_are():
    texts = odd_texts(3_000, 2)
    words = id_files.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    assert [[*np.frombuffer(b, words.kind).tolist(), 2] for b in words.encode(texts)] == plain_ids(texts)


def test_letters_are_encoded_once_whatever_follows_them(monkeypatch):
    path, asked = public_tokenizers.path("word_bpe_49k.json"), []
    words = id_files.WordIds(path)
    letters = words._letters
    monkeypatch.setattr(words, "_letters", lambda some: (asked.extend(some), letters(some))[1])
    texts = ["Été été. été, été!!! été###", "été.,' thhewhor thhewhor", f"{'y' * 70}?! {'y' * 70}"]
    for kept in (300_000, 2):
        monkeypatch.setattr(id_files, "KEPT", kept)
        assert [[*np.frombuffer(b, words.kind).tolist(), 2] for b in words.encode(texts)] == plain_ids(texts)
    assert Counter(asked) == {"été": 1, "thhewhor": 1, "y" * 70: 2}


def test_table_of_words_outlives_functions_that_travel_by_value():
    cloudpickle.register_pickle_by_value(id_files)
    try:
        travelled = cloudpickle.dumps(id_files.words_for)
    finally:
        cloudpickle.unregister_pickle_by_value(id_files)
    path = public_tokenizers.path("word_bpe_49k.json")
    first, second = cloudpickle.loads(travelled), cloudpickle.loads(travelled)
    assert first is not second and first(path) is second(path)


def test_documents_that_span_blocks_and_odd_rows(spark, tmp_path):
    rows = [(k, t) for k, t in enumerate(["the of " * 100_000, "", None, "a " * 140_000, "été, " * 3])] + [(None, "no id")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in reversed(rows)], "doc_id long, text string, part string").coalesce(1)
    id_files.write_ids(docs, f"{tmp_path}/ids")
    assert Counter(map(tuple, id_files.read_ids(spark, f"{tmp_path}/ids").collect())) == expected_rows(rows)
    assert spark.read.parquet(f"{tmp_path}/ids/blocks").count() > 2
    id_files.write_ids(docs.limit(0), f"{tmp_path}/none")
    assert id_files.read_ids(spark, f"{tmp_path}/none").collect() == []
    same = spark.createDataFrame([(5, "the same")] * 50 + [(5, "another")] * 3, "doc_id long, text string")
    id_files.write_ids(same, f"{tmp_path}/same")
    got = id_files.read_ids(spark, f"{tmp_path}/same").collect()
    assert len({r["start"] for r in got}) == 53 and Counter(r["n_tokens"] for r in got) == {3: 50, 2: 3}


def test_coding_round_trip_segments_and_damage():
    rng = np.random.default_rng(1)
    ids = (rng.zipf(1.2, 3 * id_files.BLOCK + 999) % 49_000).astype("<u2")
    f = id_files.frequencies(dict(enumerate(np.bincount(ids).tolist())) | {49_001: 1})
    assert f.sum() == 1 << id_files.SCALE and (f[np.unique(ids)] > 0).all()
    coder = id_files.Coder(f)
    blocks = [ids[:1], ids[:128], ids[:129], ids[:40_000], ids[:id_files.BLOCK], ids[id_files.BLOCK:2 * id_files.BLOCK], ids[-999:]]
    data = coder.encode(blocks)
    names = [f"block {k}" for k in range(len(data))]
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(blocks, coder.decode(data, names)))
    share = id_files.LANES * id_files.STEPS
    assert (coder.decode(data[4:5], names, range(2, 3))[0] == blocks[4][2 * share:3 * share]).all()
    p = f[f > 0] / f.sum()
    n = np.bincount(blocks[4], minlength=len(f))[f > 0]
    assert len(data[4]) < 1.1 * (n * -np.log2(p)).sum() / 8
    for at, what in ((len(data[3]) - 5, "damaged"), (2, "format"), (16, "table")):
        bad = bytearray(data[3])
        bad[at] ^= 1
        with pytest.raises(ValueError, match=what):
            coder.decode([bytes(bad)], ["b"])
    with pytest.raises(ValueError, match="cut short|damaged"):
        coder.decode([data[3][:500]], ["b"])
    only = id_files.Coder(id_files.frequencies({7: 3}))
    assert only.decode(only.encode([np.array([7, 7, 7], "<u2")]), ["b"])[0].tolist() == [7, 7, 7]
    with pytest.raises(ValueError, match="do not fit"):
        id_files.frequencies(dict.fromkeys(range(600_000), 1))


def test_checksums_join():
    a, b = b"some bytes", b"and very many more" * 1_000
    assert id_files.joined_crc(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)
