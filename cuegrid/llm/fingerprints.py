"""Document fingerprints by consistent weighted sampling, in DataFrame operations only.

A text's terms are its words, weighted by their counts. For each of `SAMPLES` samples a term draws r, c ~ Gamma(2, 1) and
b ~ U(0, 1) from hashes of the term alone; with t = floor(ln w / r + b) the term's value is c / exp(r (t - b + 1)), and the
sample is the pair (term, t) of the least value (Ioffe 2010). Two texts agree on a sample with a probability equal to their
generalised Jaccard similarity, sum of min weights over sum of max weights.

A sample is kept as one long: the value's order-preserving bits above, 24 bits of a hash of (term, t) below, so that each sample is
a min() of a long, which aggregates without Python, in generated code, and map-side. A term is only worked out for a sample if it can
come below 32 / (sum of weights), which a product of hash bits decides without a logarithm: some term does with
probability 1 - exp(-32), and a sample without any is marked as such.

Texts move once, hashed on doc_id and a digest of the text; words are counted and samples taken inside that partitioning, without
a further exchange. Equal rows move as one.

Defined results: a null text counts as empty. A text without words has all samples 0; two such are alike by 1. The order of
documents is by descending doc_id, rows without doc_id last, and among equal ids by text; a document alone is its own next.
Repeated rows are documents of their own. Further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuegrid.llm.common import uniform
from cuegrid.plans.store import as_table

SAMPLES = 64
CODE_BITS = 24
REACH = 32.0
BLANKS = r"[\x20\x09-\x0D]+"


def sample(term: Column, log_weight: Column, reach: Column, k: int) -> Column:
    """The packed value of a term for sample k, or null if it cannot be the least one."""
    low32, unit = F.lit(0xFFFFFFFF), 1.0 / (1 << 32)
    h1, h2 = F.xxhash64(term, F.lit(2 * k)), F.xxhash64(term, F.lit(2 * k + 1))
    # the product of two uniforms in (0, 1] has -ln distributed as Gamma(2, 1)
    upper = lambda h: (F.shiftrightunsigned(h, 32) + 1).cast("double") * unit
    lower = lambda h: (h.bitwiseAND(low32) + 1).cast("double") * unit
    in_r, in_c = upper(h1) * lower(h1), upper(h2) * lower(h2)
    b = uniform(term, F.lit(-1 - k))  # a hash of its own: the least values have c near 0, which fixes the bits of h2
    r, c = F.log(in_r) * -1.0, F.log(in_c) * -1.0
    t = F.floor(log_weight / r + b)
    # ln value, moved to positive numbers below 2^9 and kept with 30 bits after the point
    level = F.least(F.greatest(F.log(c) - r * (t - b + 1.0), F.lit(-255.0)), F.lit(255.0)) + 256.0
    code = F.xxhash64(term, t, F.lit(k)).bitwiseAND(F.lit((1 << CODE_BITS) - 1))
    packed = F.shiftleft(F.floor(level * float(1 << 30)).cast("long"), CODE_BITS).bitwiseOR(code)
    # c >= 1 - in_c, and exp(r (t - b + 1)) <= weight * exp(r) = weight / in_r
    return F.when((1.0 - in_c) * in_r <= reach, packed)


def fingerprints(texts: DataFrame, key: list[str], text: str = "text", samples: int = SAMPLES) -> DataFrame:
    """key, samples array<int>: one row for each key. Rows that are partitioned by some of the key columns do not move."""
    code = (1 << CODE_BITS) - 1
    words = (texts.withColumn("_words", F.split(F.coalesce(text, F.lit("")), BLANKS))
             .select(*key, F.size("_words").cast("double").alias("_all"), F.explode("_words").alias("_w")))
    counted = (words.groupBy(*key, F.when(F.col("_w") != "", F.xxhash64("_w")).alias("_term"))
               .agg(F.count(F.lit(1)).cast("double").alias("_n"), F.max("_all").alias("_all"))
               .select(*key, "_term", F.log("_n").alias("_log"), (F.lit(REACH) * F.col("_n") / F.col("_all")).alias("_reach")))
    taken = [F.min(F.when(F.col("_term").isNotNull(), sample(F.col("_term"), F.col("_log"), F.col("_reach"), k))).alias(f"_{k}") for k in range(samples)]
    least = counted.groupBy(*key).agg(*taken)
    return least.select(*key, F.array(*[F.coalesce(F.col(f"_{k}").bitwiseAND(F.lit(code)).cast("int"), F.lit(0)) for k in range(samples)]).alias("samples"))


def likeness(a: Column, b: Column) -> Column:
    """The share of equal samples."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1.0).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x) / F.size(a)


def as_text(samples: Column) -> Column:
    """Six hexadecimal digits a sample."""
    return F.array_join(F.transform(samples, lambda x: F.lower(F.lpad(F.hex(x), 6, "0"))), "")


#: A content: 128 bits over the doc_id and the text. Short, as every counted word carries it.
CONTENT = ["d1", "d2"]


def contents(docs: DataFrame) -> DataFrame:
    """d1, d2, k, nul, text: one for each row of docs. k and nul stand for doc_id where equality must hold for nulls too."""
    id_, text = F.col("doc_id").cast("long"), F.coalesce("text", F.lit(""))
    k, nul = F.coalesce(id_, F.lit(0)), id_.isNull()
    return docs.select(F.xxhash64(k, nul, text).alias("d1"), F.xxhash64(F.lit("second"), text, nul, k).alias("d2"), k.alias("k"), nul.alias("nul"), text.alias("text"))


def chain(rows: DataFrame) -> DataFrame:
    """d1, d2, doc_id, copies, next_d1, next_d2: each distinct content and the next one, cyclically.

    The order is by descending doc_id, then text. A range sort without the texts, except those of ids with several contents,
    numbered inside each partition; the offsets of the partitions come from one row each.
    """
    counted = as_table(rows.groupBy(*CONTENT, "k", "nul").agg(F.count(F.lit(1)).alias("copies")), "fingerprint-contents")
    several = as_table(counted.groupBy("k", "nul").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("k", "nul"), "fingerprint-several")
    if several.isEmpty():
        known = counted.withColumn("text", F.lit(None).cast("string"))
    else:
        known = counted.join(rows.join(several, ["k", "nul"], "left_semi").dropDuplicates(CONTENT).select(*CONTENT, "text"), CONTENT, "left")
    id_ = F.when(~F.col("nul"), F.col("k"))
    placed = as_table(known.withColumn("doc_id", id_).orderBy(F.col("doc_id").desc_nulls_last(), "text", *CONTENT).drop("text", "k", "nul").withColumn("m", F.monotonically_increasing_id()), "fingerprint-order")
    part, inside = F.shiftrightunsigned("m", 33), F.col("m").bitwiseAND(F.lit((1 << 33) - 1))
    offsets = (placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("rows"))
               .select("part", (F.sum("rows").over(Window.orderBy("part")) - F.col("rows")).alias("offset")))
    ranked = as_table(placed.withColumn("part", part).join(offsets, "part").select(*CONTENT, "doc_id", "copies", (F.col("offset") + inside).alias("place")), "fingerprint-rank")
    before = F.pmod(F.col("place") - 1, F.lit(max(ranked.count(), 1)))
    return ranked.join(ranked.select(before.alias("place"), *[F.col(c).alias(f"next_{c}") for c in CONTENT]), "place").drop("place")


def edited(docs: DataFrame) -> DataFrame:
    """CONTENT, doc_id, copies, n_chars, text, edited, edited_self, next_d1, next_d2, partitioned by CONTENT.

    edited: the last floor(n_chars / 3) code points replaced by the first as many of the next content. Only the pieces that
    are inserted travel, each from its content to the one before. edited_self: the same with the text itself as the next
    one, which it is for all but the last of several copies. Copies become one row before texts move, so neither an id
    that many rows share nor many equal rows meet in one task.
    """
    rows = contents(docs)
    placed = rows.select(*CONTENT, "text").dropDuplicates(CONTENT)
    cut = F.floor(F.length("text") / 3).cast("int")
    head = F.expr("left(text, cast(n_chars - cut as int))")
    chained = placed.join(chain(rows), CONTENT).withColumn("n_chars", F.length("text").cast("long")).withColumn("cut", cut)
    wanted = chained.select(*[F.col(f"next_{c}").alias(c) for c in CONTENT], *[F.col(c).alias(f"to_{c}") for c in CONTENT], "cut")
    pieces = placed.join(wanted, CONTENT).select(*[F.col(f"to_{c}").alias(c) for c in CONTENT], F.expr("left(text, cut)").alias("piece"))
    return (chained.join(pieces, CONTENT)
            .select(*CONTENT, "doc_id", "copies", "n_chars", "text", F.concat(head, "piece").alias("edited"),
                    F.when(F.col("copies") > 1, F.concat(head, F.expr("left(text, cut)"))).alias("edited_self"), *[f"next_{c}" for c in CONTENT]))


def edits_and_neighbours(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """doc_id, n_chars, edited_sha256, samples, edited_samples, near_edited, near_next."""
    texts = edited(docs)
    kinds = ("text", "edited", "edited_self")
    all_ = texts.select(*CONTENT, F.explode(F.array(*[F.struct(F.lit(i).alias("kind"), F.col(c).alias("text")) for i, c in enumerate(kinds)])).alias("v"))
    prints = fingerprints(all_.where("v.text is not null").select(*CONTENT, "v.kind", "v.text"), [*CONTENT, "kind"], samples=samples)
    sides = prints.groupBy(*CONTENT).agg(*[F.first(F.when(F.col("kind") == i, F.col("samples")), ignorenulls=True).alias(name)
                                           for i, name in enumerate(("samples", "edited_samples", "self_samples"))])
    facts = texts.select(*CONTENT, "doc_id", "copies", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.sha2("edited_self", 256).alias("self_sha256"), *[f"next_{c}" for c in CONTENT])
    done = as_table(facts.join(sides, CONTENT), "fingerprint-samples")
    following = done.select(*[F.col(c).alias(f"next_{c}") for c in CONTENT], F.col("samples").alias("next_samples"))
    last = (done.join(following, [f"next_{c}" for c in CONTENT])
            .select("doc_id", "n_chars", "edited_sha256", "samples", "edited_samples", likeness(F.col("samples"), F.col("edited_samples")).alias("near_edited"),
                    likeness(F.col("samples"), F.col("next_samples")).alias("near_next")))
    others = (done.where("copies > 1")
              .select("doc_id", "n_chars", F.col("self_sha256").alias("edited_sha256"), "samples", F.col("self_samples").alias("edited_samples"),
                      likeness(F.col("samples"), F.col("self_samples")).alias("near_edited"), F.lit(1.0).alias("near_next"), F.explode(F.sequence(F.lit(2).cast("long"), F.col("copies"))).alias("copy")).drop("copy"))
    return last.unionByName(others)
