"""The corpus pipeline, stage by stage, on a small table."""

import random
import re

import corpus_pipeline
import pyarrow as pa
import sentencepiece
import public_tokenizers

from cuegrid.llm import langid, near_dup

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_do_their_work(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(10_001, "12345 ---", "en", "src0", 9), (10_002, None, None, None, None), (None, "the and of that was with", None, None, 24)], docs.schema)
    docs = docs.unionByName(extra).unionByName(docs.where("doc_id = 5"))
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        seen[name] = docs.collect()
        if name != "token ids":
            assert docs.columns == corpus_pipeline.COLUMNS
    ids = {name: [r["doc_id"] for r in rows] for name, rows in seen.items()}
    assert 10_001 not in ids["language"] and 10_002 not in ids["language"] and None in ids["language"]
    assert len(ids["language"]) == 202
    assert len(set(ids["near duplicates"])) == len(ids["near duplicates"]) and None in ids["near duplicates"]
    assert sorted(ids["personal data"], key=repr) == sorted(ids["near duplicates"], key=repr)
    assert not any("example.com" in r["text"] for r in seen["personal data"]) and any("<EMAIL>" in r["text"] for r in seen["personal data"])
    words = sum(len(r["text"].split()) for r in seen["personal data"])
    assert abs(sum(len(r["text"].split()) for r in seen["source mix"]) - 1.5 * words) < 0.02 * words
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = {r["doc_id"]: r["text"] for r in seen["source mix"]}
    for r in random.Random(1).sample(seen["token ids"], 40):
        assert list(r["ids"]) == model.encode(texts[r["doc_id"]]) and r["decoded"] == texts[r["doc_id"]] and r["n_tokens"] == len(r["ids"])


def test_an_empty_table_stays_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).collect() == []


def test_duplicates_are_judged_row_by_row(spark):
    words = [f"w{i}" for i in range(300)]
    a, b, c, d, e = (" ".join(words[60 * k:60 * k + 60]) for k in range(5))
    rows = [(1, a), (2, b), (2, a + " end"), (2, c), (2, c), (None, d), (None, d), (None, d + " end"), (None, b), (3, e), (None, e), (4, " "), (4, " "), (5, " "), (4, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.one_of_each_group(spark, docs, SF).collect()
    kept = sorted(((r["doc_id"], r["text"]) for r in got if r["doc_id"] is not None), key=repr)
    assert kept == sorted([(1, a), (2, b), (2, c), (3, e), (4, " "), (5, " "), (4, None)], key=repr)
    nameless = [r["text"] for r in got if r["doc_id"] is None]
    assert len(nameless) == 1 and nameless[0] in (d, d + " end")


def test_workers_give_memory_back_between_operators(spark, docs_of):
    """Workers serve all stages one after the other; what one stage has freed must not stay theirs beside the next one's."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(4, 9)))
    docs = docs_of([(i, " ".join(word() for _ in range(250)), ("en", "de")[i % 2], "s") for i in range(6_000)], extra=False).coalesce(1).persist()
    docs.count()

    def held(batches):
        for _ in batches:
            pass
        with open("/proc/self/smaps_rollup") as f:
            yield pa.record_batch([pa.array([int(re.search(r"\nAnonymous:\s+(\d+)", f.read())[1]) // 1024])], ["mb"])

    model = langid.train(docs.limit(200))
    found = {}
    for name, df in (("language", docs.select(langid.predicted(docs["text"], model, spark))), ("near duplicates", near_dup.signed(docs, near_dup.Bands()))):
        df.write.format("noop").mode("overwrite").save()
        found[name] = spark.range(8, numPartitions=8).mapInArrow(held, "mb long").agg({"mb": "max"}).first()[0]
    docs.unpersist()
    assert max(found.values()) < 100, found
