"""Id reconciliation, edits, directions, requests and replies."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuegrid.operators import reconcile as R
from cuegrid.operators import replies as P
from cuegrid.operators import sequence as S
from cuegrid.operators import tracks as T
from cuegrid.plans.scan import numbered
from cuegrid.plans.store import cut
from cuegrid.workload import views
from cuegrid.workload.registry import query
from cuegrid.workload.scalars import ignorable_sql


def ranked(spark, sf_dir):
    return numbered(views.marked(spark, sf_dir), views.CUES, "rank")


def returned_ids(spark, sf_dir):
    """Answers with ids left out, invented, repeated and swapped."""
    r = ranked(spark, sf_dir)
    i, m = F.col("cue_id"), F.col("media_id")
    kept = r.where((m % 3 != 0) | (i % 23 != 5))
    twice = F.when((m % 4 == 1) & (i % 31 == 7), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    pos = F.when(m % 5 == 2, F.col("rank") * 4 + F.when(F.col("rank") % 17 == 3, 6).otherwise(0)).otherwise(F.col("rank") * 4)
    item = F.when((m % 6 == 4) & (i % 29 == 2), i + 100_000).otherwise(i)
    return kept.select("media_id", item.alias("item_id"), pos.alias("pos"), F.explode(twice).alias("again")).select(
        "media_id", "item_id", (F.col("pos") + F.col("again")).alias("pos"))


RETURNED_SQL = """r as (select *, row_number() over (partition by media_id order by cue_id) rank from marked),
  returned as (select media_id, case when media_id % 6 = 4 and cue_id % 29 = 2 then cue_id + 100000 else cue_id end item_id,
    case when media_id % 5 = 2 then rank * 4 + case when rank % 17 = 3 then 6 else 0 end else rank * 4 end + again pos
    from (select *, unnest(case when media_id % 4 = 1 and cue_id % 31 = 7 then [0, 1] else [0] end) again from r
      where media_id % 3 <> 0 or cue_id % 23 <> 5))"""


@query("id_reconcile", "marked", RETURNED_SQL + """,
  c as (select media_id, item_id, count(*) times, min(pos) pos from returned group by all),
  b as (select coalesce(r.media_id, c.media_id) media_id, r.rank, c.times, c.pos from r full join c on c.media_id = r.media_id and c.item_id = r.cue_id),
  o as (select media_id, max(case when rank < p then 1 else 0 end) reordered from (select media_id, rank,
    lag(rank) over (partition by media_id order by pos) p from b where pos is not null and rank is not null) group by media_id),
  s as (select media_id, count(*) filter (times is null) missing, count(*) filter (rank is null) extra, count(*) filter (times > 1) duplicated from b group by media_id)
  select s.*, coalesce(o.reordered, 0) reordered, case when missing + extra + duplicated + coalesce(o.reordered, 0) = 0 then 1 else 0 end exact_match,
    case when extra + duplicated = 0 then 1 else 0 end usable from s left join o using (media_id)""")
def id_reconcile(spark, sf_dir):
    expected = ranked(spark, sf_dir).select("media_id", F.col("cue_id").alias("item_id"), "rank")
    r = R.reconcile_ids(expected, returned_ids(spark, sf_dir), ["media_id"])
    return r.select("media_id", "missing", "extra", "duplicated", F.col("reordered").cast("int").alias("reordered"),
                    F.col("exact").cast("int").alias("exact_match"), F.col("usable_if_partial").cast("int").alias("usable"))


@query("review_view", "", """select d.doc_id cue_id, d.source, coalesce('q' || l.quality, '') translation from documents d left join labels l using (doc_id)""")
def review_view(spark, sf_dir):
    d = views.table(spark, sf_dir, "documents").select((F.col("doc_id") % 10).alias("media_id"), F.col("doc_id").alias("cue_id"), "source")
    t = views.table(spark, sf_dir, "labels").select((F.col("doc_id") % 10).alias("media_id"), F.col("doc_id").alias("cue_id"), F.concat(F.lit("q"), F.col("quality").cast("string")).alias("text"))
    return R.review_view(d, t).select("cue_id", "source", "translation")


def _edits(spark, sf_dir):
    shift = F.when(F.col("doc_id") % 9 == 0, 10_000_000).otherwise(0)
    return views.table(spark, sf_dir, "labels").select((F.col("doc_id") + shift).alias("doc_id"), F.concat(F.lit(" edit "), F.col("toxic").cast("string"), F.lit(" ")).alias("edited"))


@query("apply_edits", "", """e as (select doc_id, 'edit ' || toxic t from labels where doc_id % 9 <> 0)
  select d.doc_id, md5(coalesce(t, text)) text_hash, case when t is null then 0 else 1 end was_edited from documents d left join e using (doc_id)""")
def apply_edits(spark, sf_dir):
    d = views.table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"))
    c = R.apply_edits(d, _edits(spark, sf_dir), ["doc_id"])
    return c.select("doc_id", F.md5("content").alias("text_hash"), F.col("was_edited").cast("int").alias("was_edited"))


@query("rejected_edits", "", "select doc_id + 10000000 doc_id from labels where doc_id % 9 = 0")
def rejected_edits(spark, sf_dir):
    return R.rejected_edits(views.table(spark, sf_dir, "documents"), _edits(spark, sf_dir), ["doc_id"]).select("doc_id")


def _plans(spark, sf_dir):
    c = S.translation_batches(views.cues(spark, sf_dir))
    return c.select("media_id", "batch_no", F.col("cue_id").alias("id"), F.col("content").alias("spoken_text"), F.lit("neutral").alias("emotion"),
                    F.lit(0.45).alias("intensity"), F.lit("tu_nhien").alias("style"), F.lit(0).alias("pause_before_ms"), F.lit(100).alias("pause_after_ms"))


def _directions(spark, sf_dir):
    p, i = _plans(spark, sf_dir), F.col("id")
    spoken = F.when(i % 7 == 3, F.concat("spoken_text", F.lit(" thêm"))).when(i % 11 == 5, "").otherwise(F.concat(F.upper("spoken_text"), F.lit("!")))
    spoken = F.when(F.col("spoken_text").contains("ß"), F.concat("spoken_text", F.lit("!"))).otherwise(spoken)
    mood = F.element_at(F.array(*[F.lit(x) for x in ("Warm", "sad", "bored", "tense")]), (i % 4 + 1).cast("int"))
    return p.where((F.col("media_id") + F.col("batch_no")) % 5 != 2).select(
        "media_id", "batch_no", F.when((F.col("batch_no") % 7 == 3) & (i % 30 == 4), -i).otherwise(i).alias("id"), i.alias("pos"),
        spoken.alias("new_spoken_text"), mood.alias("new_emotion"), ((i % 10) / 10).alias("new_intensity"), F.lit("doc_truyen").alias("new_style"),
        (i % 200 - 20).cast("int").alias("new_pause_before_ms"), (i % 400).cast("int").alias("new_pause_after_ms"))


@query("apply_prosody", "cues", """p as (select media_id, cue_id id, content, (row_number() over (partition by media_id order by cue_id) - 1) // 30 batch_no from cues),
  d as (select *, case when contains(content, 'ß') then content || '!' when id % 7 = 3 then content || ' thêm' when id % 11 = 5 then '' else upper(content) || '!' end spoken,
    contains(content, 'ß') or not (id % 7 = 3 or id % 11 = 5) same, ['warm', 'sad', 'bored', 'tense'][id % 4 + 1] mood from p),
  w as (select media_id, batch_no, (media_id + batch_no) % 5 <> 2 and not bool_or(batch_no % 7 = 3 and id % 30 = 4) whole from p group by media_id, batch_no),
  k as (select d.*, whole and same and mood <> 'bored' ok from d join w using (media_id, batch_no))
  select media_id, id, case when ok then spoken else content end spoken_text, case when ok then mood else 'neutral' end emotion,
    case when ok then cast(least(75, greatest(30, id % 10 * 10)) as int) else 45 end intensity_pct, case when ok then 'doc_truyen' else 'tu_nhien' end style,
    case when ok then cast(least(120, greatest(0, id % 200 - 20)) as int) else 0 end pause_before_ms, case when ok then cast(least(280, greatest(60, id % 400)) as int) else 100 end pause_after_ms,
    case when ok then 'ai' else 'fallback' end prosody_source from k""")
def apply_prosody(spark, sf_dir):
    p = R.apply_directions(_plans(spark, sf_dir), _directions(spark, sf_dir))
    return p.select("media_id", "id", "spoken_text", "emotion", F.round(F.col("intensity") * 100).cast("int").alias("intensity_pct"), "style",
                    "pause_before_ms", "pause_after_ms", "prosody_source")


def _answers(spark, sf_dir):
    i = F.col("cue_id")
    return views.marked(spark, sf_dir).where((F.col("media_id") % 2 == 0) | (i % 13 != 1)).select(
        "media_id", "cue_id", F.when(i % 19 == 2, "  ").otherwise(F.concat(F.lit("bản dịch "), "content")).alias("text"))


ANSWERS_SQL = """answers as (select media_id, cue_id, case when cue_id % 19 = 2 then '  ' else 'bản dịch ' || content end as text from marked
    where media_id % 2 = 0 or cue_id % 13 <> 1)"""


@query("resume_translation", "marked", ANSWERS_SQL + f""",
  r as (select *, (row_number() over (partition by media_id order by cue_id) - 1) // 30 batch_no from marked)
  select r.media_id, r.batch_no, min(case when a.text is not null and ({ignorable_sql('r.content', '(r.end_ms - r.start_ms)')} or trim(a.text) <> '') then 1 else 0 end) resumable
  from r left join answers a using (media_id, cue_id) group by all""")
def resume_translation(spark, sf_dir):
    c = S.translation_batches(views.marked(spark, sf_dir))
    return R.resumable_batches(c, _answers(spark, sf_dir)).withColumn("resumable", F.col("resumable").cast("int"))


@query("missing_translations", "marked", ANSWERS_SQL + f""" select media_id, cue_id from marked m where not {ignorable_sql('content', '(end_ms - start_ms)')}
  and not exists (select 1 from answers a where a.media_id = m.media_id and a.cue_id = m.cue_id and trim(a.text) <> '')""")
def missing_translations(spark, sf_dir):
    return R.missing_translations(views.marked(spark, sf_dir), _answers(spark, sf_dir)).select("media_id", "cue_id")


@query("merge_repairs", "marked", ANSWERS_SQL + f""", missing as (select media_id, cue_id from marked m where not {ignorable_sql('content', '(end_ms - start_ms)')}
    and not exists (select 1 from answers a where a.media_id = m.media_id and a.cue_id = m.cue_id and trim(a.text) <> ''))
  select media_id, cue_id, case when r.media_id is not null then 'sửa' else a.text end as text from answers a
    full join missing r using (media_id, cue_id)""")
def merge_repairs(spark, sf_dir):
    answers = _answers(spark, sf_dir)
    repairs = R.missing_translations(views.marked(spark, sf_dir), answers).select("media_id", "cue_id", F.lit("sửa").alias("text"))
    return R.merge_repairs(answers, repairs).select("media_id", "cue_id", "text")


@query("master_coverage", "cues", """r as (select media_id, cue_id, row_number() over (partition by media_id order by cue_id) rank from cues),
  f as (select media_id, count(*) wanted, sum(case when media_id % 4 = 1 and cue_id = 9 then 0 when media_id % 4 = 2 and cue_id = 5 then 2 else 1 end)::bigint used,
    max(case when media_id % 4 = 1 and cue_id = 9 or media_id % 4 = 2 and cue_id = 5 then 1 else 0 end) broken, max(cue_id) last_id from cues group by media_id)
  select media_id, wanted, used, case when broken = 0 and (media_id % 4 <> 3 or last_id <= 7) then 1 else 0 end covered from f""")
def master_coverage(spark, sf_dir):
    # Groups of seven lines; by medium one id is lost, doubled, or the first two groups trade places.
    c, m, i = numbered(views.cues(spark, sf_dir), views.CUES, "rank"), F.col("media_id"), F.col("cue_id")
    pos = F.floor((i - 1) / 7)
    pos = F.when((m % 4 == 3) & (pos <= 1), 1 - pos).otherwise(pos)
    times = F.when((m % 4 == 1) & (i == 9), F.array().cast("array<int>")).when((m % 4 == 2) & (i == 5), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    flat = c.select("media_id", pos.alias("pos"), "cue_id", F.explode(times).alias("again"))
    u = flat.groupBy("media_id", "pos").agg(F.transform(F.array_sort(F.collect_list(F.struct("cue_id", "again"))), lambda r: r["cue_id"]).alias("cue_ids"))
    return R.master_coverage(c.select("media_id", "cue_id", "rank"), u).withColumn("covered", F.col("covered").cast("int"))


@query("overlong_translations", "marked", r"""w as (select media_id, cue_id, repeat(content || ' ', 1 + cue_id % 4) as text,
    cast(greatest(2, least(24, round_even((end_ms - start_ms) / 1000 * 3.2::double, 0))) as int) max_words from marked)
  select media_id, cue_id, max_words from w where len(regexp_extract_all(text, '\S+')) > max_words + 2""")
def overlong_translations(spark, sf_dir):
    return R.overlong(_long_lines(spark, sf_dir)).select("media_id", "cue_id", "max_words")


def _long_lines(spark, sf_dir):
    c = views.marked(spark, sf_dir)
    return c.withColumn("text", F.repeat(F.concat("content", F.lit(" ")), (1 + F.col("cue_id") % 4).cast("int")))


@query("accept_shortened", "marked", r"""w as (select media_id, cue_id, repeat(content || ' ', 1 + cue_id % 4) as text, content,
    cast(greatest(2, least(24, round_even((end_ms - start_ms) / 1000 * 3.2::double, 0))) as int) max_words from marked),
  s as (select media_id, cue_id, case when media_id % 10 = 3 then ' ' else 'ngắn' end short from w where len(regexp_extract_all(text, '\S+')) > max_words + 2)
  select w.media_id, w.cue_id, md5(case when short = 'ngắn' then short else w.text end) text_hash from w left join s using (media_id, cue_id)""")
def accept_shortened(spark, sf_dir):
    lines = _long_lines(spark, sf_dir)
    short = R.overlong(lines).select("media_id", "cue_id", F.when(F.col("media_id") % 10 == 3, " ").otherwise("ngắn").alias("short"))
    return R.accept_shortened(lines, short).select("media_id", "cue_id", F.md5("text").alias("text_hash"))


@query("chunk_positions", "jobs batches", """e as (select batch_id, position from jobs where position <= 6),
  c as (select batch_id * 10 + position // 4 chunk_id, batch_id, case when job_id % 40 = 0 then position + 90 else position end as position from jobs
    union all select batch_id * 10 + position // 4, batch_id, position from jobs where job_id % 50 = 7 and job_id % 40 <> 0),
  p as (select c.chunk_id, c.batch_id, c.position, count(*) times, max(expected_episodes) n, max(case when e.position is null then 0 else 1 end) known
    from c join batches b using (batch_id) left join e on e.batch_id = c.batch_id and e.position = c.position group by all)
  select chunk_id, batch_id, case when bool_or(times > 1 or position not between 1 and n) then 'duplicated_or_outside' when sum(known) = 0 then 'accepted'
    when sum(known) = count(*) then 'already_uploaded' else 'overlap' end verdict from p group by all""")
def chunk_positions(spark, sf_dir):
    j, k = views.jobs(spark, sf_dir), F.col("job_id")
    chunk_id = (F.col("batch_id") * 10 + F.floor(F.col("position") / 4)).alias("chunk_id")
    c = j.select(chunk_id, "batch_id", F.when(k % 40 == 0, F.col("position") + 90).otherwise(F.col("position")).alias("position"))
    again = j.where((k % 50 == 7) & (k % 40 != 0)).select(chunk_id, "batch_id", "position")
    return R.check_chunk(c.unionByName(again), j.where("position <= 6").select("batch_id", "position"), views.batches(spark, sf_dir))


@query("replace_position", "jobs", """select batch_id, position, case when job_id % 6 = 0 then job_id + 50000000 else job_id end job_id from jobs""")
def replace_position(spark, sf_dir):
    j = views.jobs(spark, sf_dir).select("batch_id", "position", "job_id")
    new = j.where("job_id % 6 = 0").withColumn("job_id", F.col("job_id") + 50_000_000)
    return R.replace_positions(j, new)


def payloads(c):
    """Requests for cues of (media_id, cue_id, speaker, content, start_ms, end_ms)."""
    c = c.join(S.speaker_aliases(c).select("media_id", "speaker", F.col("alias").alias("speaker_alias")), ["media_id", "speaker"], "left")
    c = cut(S.translation_batches(c).select("media_id", "batch_no", "rank", "cue_id", "content", "speaker_alias", "start_ms", "end_ms"))
    return R.request_payloads(c, T.translation_context(c.drop("batch_no", "rank")))


@query("request_payload", "marked", """r as (select media_id, cue_id, content, speaker, row_number() over (partition by media_id order by cue_id) rank from marked),
  b as (select media_id, (rank - 1) // 30 batch_no, min(rank) lo, max(rank) hi, string_agg(cue_id, ',' order by cue_id) expected_ids, count(*) n_items,
    sum(length(content))::bigint item_chars, count(speaker) n_aliased from r group by all)
  select b.media_id, b.batch_no, expected_ids, n_items, item_chars, n_aliased, count(*) n_context, count(*) filter (r.rank between lo and hi) n_translate
  from b join r on r.media_id = b.media_id and r.rank between lo - 6 and hi + 4 group by all""")
def request_payload(spark, sf_dir):
    shape = "items array<struct<id:bigint,text:string,speaker:string>>, context array<struct<id:bigint,translate:boolean>>"
    p = payloads(views.marked(spark, sf_dir)).withColumn("r", F.from_json("request", shape))
    chars = F.aggregate("r.items", F.lit(0).cast("long"), lambda n, i: n + F.length(i["text"]))
    return p.select("media_id", "batch_no", F.array_join(F.transform("expected_ids", lambda i: i.cast("string")), ",").alias("expected_ids"),
                    F.size("r.items").cast("long").alias("n_items"), chars.alias("item_chars"), F.size(F.filter("r.items", lambda i: i["speaker"].isNotNull())).cast("long").alias("n_aliased"),
                    F.size("r.context").cast("long").alias("n_context"), F.size(F.filter("r.context", lambda i: i["translate"])).cast("long").alias("n_translate"))


def _replies(spark, sf_dir):
    """Replies in every accepted spelling, and broken ones, one per batch of cues."""
    c = S.translation_batches(views.cues(spark, sf_dir)).where("batch_no is not null")
    e = F.array_sort(F.collect_list(F.struct(F.col("cue_id").alias("id"), F.concat(F.lit(" dịch {"), "content", F.lit("} ")).alias("text"))))
    b = c.groupBy("media_id", "batch_no").agg(e.alias("e"))
    kind = (F.col("media_id") + F.col("batch_no")) % 8
    pairs = F.map_from_arrays(F.transform("e", lambda x: x["id"].cast("string")), F.transform("e", lambda x: x["text"]))
    renamed = F.transform("e", lambda x: F.struct(x["id"].alias("cueId"), F.struct(x["text"].alias("text")).alias("output")))
    wrapped = F.to_json(F.struct(F.col("e").alias("translations")))
    reply = (
        F.when(kind == 0, F.concat(F.lit("```json\n"), wrapped, F.lit("\n```"))).when(kind == 1, F.to_json(pairs)).when(kind == 2, F.to_json("e"))
        .when(kind == 3, F.array_join(F.transform("e", lambda x: F.to_json(x)), "\n")).when(kind == 4, F.to_json(renamed))
        .when(kind == 5, F.concat(wrapped, F.lit(" trailing"))).when(kind == 6, F.to_json(F.concat("e", F.slice("e", 1, 1)))).otherwise(F.to_json(F.slice("e", 2, 100)))
    )
    expected = c.select("media_id", "batch_no", F.col("cue_id").alias("item_id"))
    return b.select("media_id", "batch_no", reply.alias("reply")), expected


REPLIES_SQL = """r as (select media_id, cue_id, content, row_number() over (partition by media_id order by cue_id) rank from cues),
  b as (select *, (rank - 1) // 30 batch_no, (rank - 1) % 30 i, (media_id + (rank - 1) // 30) % 8 kind from r)"""


@query("parse_translations", "cues", REPLIES_SQL + """ select media_id, batch_no, cue_id item_id, trim('dịch {' || content || '}') as text, null problem from b where kind < 5 or kind = 6 or kind = 7 and i > 0
  union all select media_id, batch_no, cue_id, trim('dịch {' || content || '}'), null from b where kind = 6 and i = 0
  union all select distinct media_id, batch_no, null, null, 'unreadable' from b where kind = 5""")
def parse_translations(spark, sf_dir):
    return P.translation_items(_replies(spark, sf_dir)[0]).select("media_id", "batch_no", "item_id", "text", "problem")


@query("reply_status", "cues", REPLIES_SQL + """ select distinct media_id, batch_no, case when kind < 5 then 'ok' when kind = 5 then 'unreadable'
    when kind = 6 then 'duplicate_id' else 'missing_ids' end status from b""")
def reply_status(spark, sf_dir):
    replies, expected = _replies(spark, sf_dir)
    return P.reply_status(P.translation_items(replies), expected)


@query("parse_master", "cues", """r as (select *, row_number() over (partition by media_id order by cue_id) rank from cues),
  g as (select media_id, (rank - 1) // 3 pos, string_agg(cue_id, ',' order by cue_id) cue_ids, string_agg(content, ' ' order by cue_id) full_text,
    count(*) n, (media_id + (rank - 1) // 3) % 5 kind from r group by all),
  w as (select *, string_split(full_text, ' ') w from g)
  select media_id, pos, cue_ids, full_text, case when kind = 1 then array_to_string(list_transform(range(n), lambda l:
      array_to_string(w[l * (len(w) // n) + least(l, len(w) % n) + 1: (l + 1) * (len(w) // n) + least(l + 1, len(w) % n)], ' ')), ' / ')
    else null end refilled, case when kind = 2 then 0 else 1 end same_words from w""")
def parse_master(spark, sf_dir):
    c = numbered(views.cues(spark, sf_dir), views.CUES, "rank").withColumn("pos", F.floor((F.col("rank") - 1) / 3))
    e = F.array_sort(F.collect_list(F.struct("cue_id", "content")))
    g = c.groupBy("media_id", "pos").agg(e.alias("e")).withColumn("kind", (F.col("media_id") + F.col("pos")) % 5)
    kind = F.col("kind")
    shown = F.transform("e", lambda x: F.struct(x["cue_id"].alias("id"), F.when(kind == 1, "").when(kind == 2, F.concat(F.lit("lạ "), x["content"])).otherwise(F.concat(x["content"], F.lit("!"))).alias("text")))
    u = F.array(F.struct(F.transform("e", lambda x: x["cue_id"]).alias("cue_ids"), F.array_join(F.transform("e", lambda x: x["content"]), " ").alias("full_text"), shown.alias("display_lines")))
    body = F.when(kind == 3, F.to_json(u)).otherwise(F.concat(F.lit("```json\n"), F.to_json(F.struct(u.alias("utterances"))), F.lit("\n```")))
    m = P.master_groups(g.select("media_id", F.col("pos").alias("batch_no"), body.alias("reply")))
    refilled = (F.col("media_id") + F.col("batch_no")) % 5 == 1
    return m.select("media_id", F.col("batch_no").alias("pos"), F.array_join(F.transform("cue_ids", lambda i: i.cast("string")), ",").alias("cue_ids"), "full_text",
                    F.when(refilled, F.array_join("lines", " / ")).alias("refilled"), F.col("same_words").cast("int").alias("same_words"))


@query("parse_prosody", "cues", """r as (select *, row_number() over (partition by media_id order by cue_id) rank from cues)
  select media_id, (rank - 1) // 30 batch_no, cue_id id, content || '!' spoken, cast(cue_id % 300 as int) pause from r where (media_id + (rank - 1) // 30) % 5 <> 4""")
def parse_prosody(spark, sf_dir):
    c = S.translation_batches(views.cues(spark, sf_dir))
    item = F.struct(F.col("cue_id").alias("id"), F.concat("content", F.lit("!")).alias("spoken_text"), F.lit("warm").alias("emotion"), F.lit(0.6).alias("intensity"),
                    F.lit("doc_truyen").alias("style"), F.lit(5).alias("pause_before_ms"), (F.col("cue_id") % 300).cast("int").alias("pause_after_ms"))
    b = c.groupBy("media_id", "batch_no").agg(F.array_sort(F.collect_list(item)).alias("e"))
    kind = (F.col("media_id") + F.col("batch_no")) % 5
    body = (
        F.when(kind == 0, F.concat(F.lit("```\n"), F.to_json(F.struct(F.col("e").alias("prosody"))), F.lit("\n```"))).when(kind == 1, F.to_json(F.struct(F.col("e").alias("items"))))
        .when(kind == 2, F.to_json(F.struct(F.col("e").alias("translations")))).when(kind == 3, F.to_json("e")).otherwise("not json")
    )
    d = P.direction_items(b.select("media_id", "batch_no", body.alias("reply")))
    return d.select("media_id", "batch_no", "id", F.col("new_spoken_text").alias("spoken"), F.col("new_pause_after_ms").alias("pause"))


# The replies of parse_master and parse_prosody, and two broken ones for each medium.
def _with_broken(replies):
    broken = F.array(*[F.struct(F.lit(1_000 + i).alias("batch_no"), F.lit(b).alias("reply")) for i, b in enumerate(("not json", "[]"))])
    return replies.unionByName(replies.select("media_id").distinct().select("media_id", F.explode(broken).alias("b")).select("media_id", F.col("b.batch_no").cast("long").alias("batch_no"), "b.reply"))


@query("reply_list_status", "cues", """r as (select media_id, (row_number() over (partition by media_id order by cue_id) - 1) // 30 batch_no from cues),
  k as (select unnest(['master', 'direction']) kind), m as (select distinct media_id from cues)
  select distinct kind, media_id, batch_no, 'ok' as status from r, k
  union all select kind, media_id, 1000, 'unreadable' from m, k union all select kind, media_id, 1001, 'empty' from m, k""")
def reply_list_status(spark, sf_dir):
    """Which replies of either kind give no row, and why."""
    c = S.translation_batches(views.cues(spark, sf_dir)).withColumn("batch_no", F.col("batch_no").cast("long"))
    u = F.collect_list(F.struct(F.array("cue_id").alias("cue_ids"), F.col("content").alias("full_text")))
    d = F.collect_list(F.struct(F.col("cue_id").alias("id"), F.col("content").alias("spoken_text")))
    b = c.groupBy("media_id", "batch_no").agg(u.alias("u"), d.alias("d"))
    masters = b.select("media_id", "batch_no", F.concat(F.lit("```json\n"), F.to_json(F.struct(F.col("u").alias("utterances"))), F.lit("\n```")).alias("reply"))
    directions = b.select("media_id", "batch_no", F.to_json(F.struct(F.col("d").alias("items"))).alias("reply"))
    return (P.master_status(_with_broken(masters)).select(F.lit("master").alias("kind"), "media_id", "batch_no", "status")
            .unionByName(P.direction_status(_with_broken(directions)).select(F.lit("direction").alias("kind"), "media_id", "batch_no", "status")))


def echo_provider(request: str) -> str:
    """Deterministic stand-in: answers every item, but only once told to retry for odd batches."""
    import json
    body = json.loads(request.split("\nRETRY: ")[0])
    items = body["items"]
    if len(items) % 2 and "RETRY" not in request:
        items = items[1:]
    return json.dumps({"translations": [{"id": i["id"], "text": "ok " + i["text"]} for i in items]}, ensure_ascii=False)


@query("provider_rounds", "cues", """r as (select media_id, (row_number() over (partition by media_id order by cue_id) - 1) // 30 batch_no from cues),
  n as (select media_id, batch_no, count(*) n from r group by all)
  select media_id, batch_no, cast(case when n % 2 = 1 then 2 else 1 end as int) attempt, 'ok' status from n""")
def provider_rounds(spark, sf_dir):
    p = cut(payloads(views.cues(spark, sf_dir)))
    expected = p.select("media_id", "batch_no", F.explode("expected_ids").alias("item_id"))
    done = P.ask_until_valid(p.select("media_id", "batch_no", "request"), echo_provider, lambda r: P.reply_status(P.translation_items(r), expected))
    return done.select("media_id", "batch_no", "attempt", "status")


@query("provider_fallback", "marked", ANSWERS_SQL + """ select m.media_id, m.cue_id, coalesce(a.text, m.content) as text, case when a.text is null then 'provider unavailable' end warning
  from marked m left join answers a using (media_id, cue_id)""")
def provider_fallback(spark, sf_dir):
    d = views.marked(spark, sf_dir).select("media_id", "cue_id", F.col("content").alias("text"))
    return P.with_fallback(d, _answers(spark, sf_dir), "provider unavailable")
