"""Reading model replies and asking a provider, over whole tables of requests."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuegrid.functions import text as X
from cuegrid.plans.store import cut

# Field names providers use instead of id and text.
ID_NAMES = ("id", "cue_id", "cueId", "index")
TEXT_NAMES = (
    "text", "translation", "translated_text", "translatedText", "translated",
    "vietnamese", "shortened_text", "shortenedText", "content", "output",
)
SINGLE_TEXT_NAMES = TEXT_NAMES[:4]
FENCE = r"(?is)^```(?:json)?\s*(.*?)\s*```$"


def unfenced(reply: Column) -> Column:
    clean = X.strip(reply)
    return F.when(clean.rlike(FENCE), F.regexp_replace(clean, FENCE, "$1")).otherwise(clean)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value worked out once, also where lambdas of the body use it: nothing else is shared inside a lambda."""
    return F.transform(F.array(value), body)[0]


def as_sequence(text: Column) -> Column:
    """JSON values written one after the other, as one array; a text that is one value is its only element.

    Commas are put in between objects at the outermost level alone, so an array that lacks one inside stays unreadable.
    The text is cut into strings, brackets and other pieces (by possessive runs, which need no stack however long a
    string is); one fold counts the open brackets and keeps the places between objects, between which the pieces are joined again.
    """
    def put(state: Column, piece: Column) -> Column:
        opens, closes = piece.isin("{", "["), piece.isin("}", "]")
        between = (state["depth"] == 0) & (piece == "{") & (state["last"] == "}")
        return F.struct(
            (state["depth"] + F.when(opens, 1).when(closes, -1).otherwise(0)).alias("depth"), piece.alias("last"),
            F.when(between, F.concat(state["cuts"], F.array(state["at"]))).otherwise(state["cuts"]).alias("cuts"), (state["at"] + 1).alias("at"))

    def joined(found: Column) -> Column:
        pieces, cuts = found["pieces"], found["cuts"]
        runs = F.transform(F.sequence(F.lit(0), F.size(cuts) - 2), lambda k: F.array_join(F.slice(pieces, F.get(cuts, k) + 1, F.get(cuts, k + 1) - F.get(cuts, k)), " "))
        return F.array_join(runs, ",")

    pieces = F.regexp_extract_all(text, F.lit(r'("[^"\\]*+(?:\\.[^"\\]*+)*+"|[\[\]{}]|[^"\[\]{}\s]++|")'), F.lit(1))
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("last"), F.array(F.lit(0)).alias("cuts"), F.lit(0).alias("at"))
    with_cuts = bound(pieces, lambda p: F.struct(p.alias("pieces"), F.aggregate(p, start, put, lambda s: F.concat(s["cuts"], F.array(s["at"]))).alias("cuts")))
    one = F.concat(F.lit("["), text, F.lit("]"))
    return F.when(F.try_parse_json(one).isNotNull(), one).otherwise(F.concat(F.lit("["), bound(with_cuts, joined), F.lit("]")))


def _at(item: Column, name: str, kind: str) -> Column:
    return F.try_variant_get(item, f"$.{name}", kind)


def _is(v: Column, kind: str) -> Column:
    return F.schema_of_variant(v).startswith(kind)


def translation_items(replies: DataFrame) -> DataFrame:
    """(media_id, batch_no, pos, item_id, text, problem) for every item of every reply.

    replies: (media_id, batch_no, reply). A reply that cannot be read gives one
    row with its problem. The reply is read as a list of values: a lone value
    is the payload, several are the items themselves.
    """
    r = replies.select("media_id", "batch_no", F.try_parse_json(as_sequence(unfenced(F.col("reply")))).alias("listed"))
    r = r.withColumn("several", F.try_variant_get("listed", "$[1]", "variant").isNotNull())
    r = r.withColumn("v", F.when(F.col("several"), F.col("listed")).otherwise(F.try_variant_get("listed", "$[0]", "variant")))
    inner = _at(F.col("v"), "translations", "variant")
    r = r.withColumn("v", F.when(~F.col("several") & _is(F.col("v"), "OBJECT") & inner.isNotNull(), inner).otherwise(F.col("v")))
    v = F.col("v")
    single = _at(v, "id", "variant").isNotNull() & F.coalesce(*[_at(v, n, "variant") for n in SINGLE_TEXT_NAMES]).isNotNull()
    r = r.withColumn("kind", (
        F.when(v.isNull(), "unreadable").when(_is(v, "ARRAY"), "list")
        .when(_is(v, "OBJECT"), F.when(single, "one").otherwise("map")).otherwise("not_a_list")))
    # A single object is the one element of the list it was read as, or of a wrapper.
    r = r.withColumn("target", F.when(F.col("kind") == "one", F.try_parse_json(F.concat(F.lit("["), F.to_json(v), F.lit("]"))))
                     .when(F.col("kind").isin("list", "map"), v))
    items = r.select("media_id", "batch_no", "kind", "target").lateralJoin(
        replies.sparkSession.tvf.variant_explode_outer(F.col("target").outer()))
    broken = F.col("kind").isin("unreadable", "not_a_list")
    items = items.where(broken | F.col("pos").isNotNull())
    value = F.col("value")
    raw_id = F.when(F.col("kind") == "map", F.col("key")).otherwise(F.coalesce(*[_at(value, n, "string") for n in ID_NAMES]))

    def text_at(path: str) -> Column:
        return F.when(_is(_at(value, path, "variant"), "STRING"), _at(value, path, "string"))

    own = F.when(_is(value, "STRING"), F.try_variant_get("value", "$", "string"))
    aliased = F.coalesce(*[F.coalesce(text_at(n), text_at(f"{n}.text")) for n in TEXT_NAMES[1:]])
    # A text field of another type is an error; the other names count only without one.
    text = F.when(F.col("kind") == "map", own).when(_at(value, "text", "variant").isNotNull(), text_at("text")).otherwise(aliased)
    items = items.select("media_id", "batch_no", F.coalesce("pos", F.lit(0)).alias("pos"), F.when(broken, F.col("kind")).alias("broken"),
                         X.strip(raw_id).alias("raw"), X.strip(text).alias("text"))
    items = items.withColumn("item_id", F.when(F.col("raw").rlike(r"^[+-]?\d+$"), F.col("raw").try_cast("long")))
    problem = F.coalesce("broken", F.when(F.col("raw").isNull() | F.col("text").isNull(), "no_id_or_text").when(F.col("item_id").isNull(), "bad_id"))
    return items.select("media_id", "batch_no", "pos", "item_id", "text", problem.alias("problem"))


def reply_status(items: DataFrame, expected: DataFrame, allow_missing: bool = False) -> DataFrame:
    """ok or the first problem of each reply; expected: (media_id, batch_no, item_id)."""
    keys = ["media_id", "batch_no"]
    n = items.groupBy(*keys, "item_id").agg(F.count("*").alias("times"), F.min("problem").alias("problem"))
    both = expected.withColumn("wanted", F.lit(True)).join(n, [*keys, "item_id"], "full")
    known = F.col("item_id").isNotNull()
    per = both.groupBy(*keys).agg(
        F.min("problem").alias("problem"), F.bool_or(F.coalesce(known & (F.col("times") > 1), F.lit(False))).alias("twice"),
        F.bool_or(known & F.col("wanted").isNull()).alias("extra"), F.bool_or(F.col("times").isNull()).alias("missing"))
    status = (
        F.when(F.col("problem").isNotNull(), F.col("problem")).when(F.col("twice"), "duplicate_id")
        .when(F.col("extra"), "extra_ids").when(F.col("missing") & F.lit(not allow_missing), "missing_ids").otherwise("ok")
    )
    return per.select(*keys, status.alias("status"))


UTTERANCES = "array<struct<cue_ids:array<bigint>,full_text:string,display_lines:array<struct<id:bigint,text:string>>>>"


def _master_list(reply: Column) -> Column:
    text = F.regexp_replace(reply, r"(?i)^\s*```(?:json)?\s*|\s*```\s*$", "")
    return F.coalesce(F.from_json(text, f"utterances {UTTERANCES}").getField("utterances"), F.from_json(text, UTTERANCES))


def _list_status(replies: DataFrame, listed: Column) -> DataFrame:
    status = F.when(listed.isNull(), "unreadable").when(F.size(listed) == 0, "empty").otherwise("ok")
    return replies.select("media_id", "batch_no", status.alias("status"))


def master_status(replies: DataFrame) -> DataFrame:
    """One row a reply: ok, empty or unreadable, for those that give master_groups no row."""
    return _list_status(replies, _master_list(F.col("reply")))


def master_groups(replies: DataFrame) -> DataFrame:
    """Utterance rows of dialogue replies; blank display lines are refilled from the full text.

    Adds same_words: the display lines speak exactly the words of full_text.
    Replies that do not parse give no row; master_status tells them.
    """
    r = replies.select("media_id", "batch_no", F.posexplode(_master_list(F.col("reply"))).alias("pos", "u"))
    r = r.select("media_id", "batch_no", "pos", "u.cue_ids", X.strip(F.col("u.full_text")).alias("full_text"),
                 F.transform("u.display_lines", lambda d: d["id"]).alias("line_ids"),
                 F.transform("u.display_lines", lambda d: X.strip(F.coalesce(d["text"], F.lit("")))).alias("lines"))
    blank = F.exists("lines", lambda t: t == "")
    r = r.withColumn("lines", F.when(blank, X.balanced_lines(F.col("full_text"), F.size("cue_ids"))).otherwise(F.col("lines")))
    r = r.withColumn("_a", X.lexical_key(F.array_join("lines", " "))).withColumn("_b", X.lexical_key(F.col("full_text")))
    one_to_one = (F.col("line_ids") == F.col("cue_ids")) & (F.size("cue_ids") > 0) & (F.col("full_text") != "")
    same = F.coalesce(one_to_one & (F.col("_a") == F.col("_b")), F.lit(False))
    return r.select("media_id", "batch_no", "pos", "cue_ids", "full_text", "lines", same.alias("same_words"))


DIRECTION = "struct<id:bigint,spoken_text:string,emotion:string,intensity:double,style:string,pause_before_ms:int,pause_after_ms:int>"


def _direction_list(reply: Column) -> Column:
    v = F.try_parse_json(F.regexp_replace(reply, r"(?i)^\s*```(?:json)?\s*|\s*```\s*$", ""))
    wrapped = F.coalesce(*[F.try_variant_get(v, f"$.{n}", f"array<{DIRECTION}>") for n in ("prosody", "items", "translations")])
    return F.coalesce(wrapped, F.try_variant_get(v, "$", f"array<{DIRECTION}>"))


def direction_status(replies: DataFrame) -> DataFrame:
    """One row a reply: ok, empty or unreadable, for those that give direction_items no row."""
    return _list_status(replies, _direction_list(F.col("reply")))


def direction_items(replies: DataFrame) -> DataFrame:
    """Delivery directions of replies, bare or under one of three wrapper names."""
    r = replies.select("media_id", "batch_no", F.posexplode(_direction_list(F.col("reply"))).alias("pos", "d")).where("d.id is not null")
    return r.select("media_id", "batch_no", "pos", F.col("d.id").alias("id"), *[
        F.col(f"d.{c}").alias(f"new_{c}") for c in ("spoken_text", "emotion", "intensity", "style", "pause_before_ms", "pause_after_ms")])


def ask(requests: DataFrame, request: Callable[[str], str]) -> DataFrame:
    """Call a provider for every request row inside the executors; errors become a column.

    requests: (media_id, batch_no, request).
    """
    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            replies, errors = [], []
            for text in b["request"]:
                try:
                    replies.append(request(text))
                    errors.append(None)
                except Exception as exc:  # a failing provider must not fail the job
                    replies.append(None)
                    errors.append(str(exc))
            yield b[["media_id", "batch_no"]].assign(reply=pd.Series(replies, dtype=object, index=b.index), error=pd.Series(errors, dtype=object, index=b.index))

    schema = f"media_id {requests.schema['media_id'].dataType.simpleString()}, batch_no bigint, reply string, error string"
    return requests.select("media_id", F.col("batch_no").cast("long").alias("batch_no"), "request").mapInPandas(call, schema)


def ask_until_valid(requests: DataFrame, request: Callable[[str], str], status: Callable[[DataFrame], DataFrame], attempts: int = 3) -> DataFrame:
    """Ask, validate, and ask again with the error added, at most `attempts` times.

    status(replies) gives (media_id, batch_no, status). The result has reply,
    attempt and status of the last round of every request; each round is
    materialised, since a provider does not answer twice the same way.
    """
    keys = ["media_id", "batch_no"]
    open_ = requests
    done = None
    for attempt in range(1, attempts + 1):
        replies = cut(ask(open_, request))
        judged = cut(replies.join(status(replies.where("reply is not null")), keys, "left").select(
            *keys, "reply", F.lit(attempt).alias("attempt"), F.coalesce("status", "error", F.lit("no_reply")).alias("status")))
        final = judged if attempt == attempts else judged.where("status = 'ok'")
        done = final if done is None else done.unionByName(final)
        if attempt == attempts or judged.where("status <> 'ok'").isEmpty():
            return done
        failed = judged.where("status <> 'ok'").select(*keys, "status")
        open_ = cut(open_.join(failed, keys).select(*keys, F.concat("request", F.lit("\nRETRY: "), "status").alias("request")))
    return done


def with_fallback(drafts: DataFrame, accepted: DataFrame, warning: str) -> DataFrame:
    """Accepted texts where there are any, the draft and a warning elsewhere."""
    d = drafts.join(accepted.select("media_id", "cue_id", F.col("text").alias("_new")), ["media_id", "cue_id"], "left")
    return d.withColumn("warning", F.when(F.col("_new").isNull(), warning)).withColumn("text", F.coalesce("_new", "text")).drop("_new")
