"""Column functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuegrid.functions import text as X
from cuegrid.functions import timing as M
from cuegrid.functions import vietnamese as V
from cuegrid.functions.geometry import background_box, centredness
from cuegrid.operators import catalog as C
from cuegrid.operators.folds import clean_words as drop_untimed
from cuegrid.plans.scan import neighbours
from cuegrid.workload import views
from cuegrid.workload.registry import query

C3 = ("media_id", "cue_id")
# Blanks as the library knows them: ASCII white space, the separators U+001C to U+001F, and those of Unicode.
BLANK_SQL = r"[\s\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
WORDS_SQL = r"len(regexp_extract_all({}, '[\p{{L}}\p{{N}}_\x{{C0}}-\x{{1EF9}}]+'))"


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{BLANK_SQL}+|{BLANK_SQL}+$', '', 'g')"


def one_spaced_sql(x: str) -> str:
    return strip_sql(f"regexp_replace({x}, '{BLANK_SQL}+', ' ', 'g')")


def predict_sql(x: str) -> str:
    return (f"greatest(350, cast(round_even({WORDS_SQL.format(x)} / 3.45 * 1000 + 180 * len(regexp_extract_all({x}, '[,;:]'))"
            f" + 320 * len(regexp_extract_all({x}, '[.!?]')), 0) as bigint))")


def pause_sql(x: str) -> str:
    t = rf"regexp_replace({x}, '\s+$', '')"
    close = '["”’)]?$'
    return (f"case when regexp_matches({t}, '(\\.{{2,}}|…+)$') then 360 when regexp_matches({t}, '\\.{close}') then 360"
            f" when regexp_matches({t}, '[!?]{close}') then 320 when regexp_matches({t}, '[;:]{close}') then 240"
            f" when regexp_matches({t}, ',{close}') then 180 else 100 end")


def ignorable_sql(x: str, ms: str) -> str:
    core = rf"regexp_replace({x}, '[^\p{{L}}\p{{N}}_\x{{3400}}-\x{{9FFF}}]', '', 'g')"
    return f"(length({core}) <= 1 or ({ms} <= 500 and regexp_full_match({core}, '[A-Za-z]{{1,3}}')))"


TERMINAL_SQL = r"""'[.!?…,:;]\s*["”'')\]}]*$'"""


def tail_sql(x: str) -> str:
    last = f"right({strip_sql(x)}, 1)"
    return (f"case when {last} in ('?', '？') then '?' when {last} in ('!', '！') then '!' when {last} in ('。', '.') then '.'"
            f" when {last} in ('，', '、', ',') then ',' when {last} = '…' then '...'"
            f" when {last} in ('吗', '呢', '吧', '嘛', '么') then '?' else '' end")


def digit_sql(n: str) -> str:
    return f"['không','một','hai','ba','bốn','năm','sáu','bảy','tám','chín'][cast({n} as int) + 1]"


def below_hundred_sql(n: str) -> str:
    return (f"case when {n} < 10 then {digit_sql(n)} when {n} < 20 then 'mười' || case {n} % 10 when 0 then '' when 5 then ' lăm'"
            f" else ' ' || {digit_sql(f'({n} % 10)')} end else {digit_sql(f'({n} // 10)')} || ' mươi' || case {n} % 10 when 0 then ''"
            f" when 1 then ' mốt' when 5 then ' lăm' else ' ' || {digit_sql(f'({n} % 10)')} end end")


def below_thousand_sql(n: str) -> str:
    return (f"case when {n} < 100 then {below_hundred_sql(n)} else {digit_sql(f'({n} // 100)')} || ' trăm' ||"
            f" case when {n} % 100 = 0 then '' else case when {n} % 100 < 10 then ' lẻ ' else ' ' end || {below_hundred_sql(f'({n} % 100)')} end end")


def words_sql(n: str) -> str:
    """SQL for a number below a million, written with plain arithmetic."""
    return (f"case when {n} < 1000 then {below_thousand_sql(n)} else {below_thousand_sql(f'({n} // 1000)')} || ' nghìn' ||"
            f" case when {n} % 1000 = 0 then '' else ' ' || {below_thousand_sql(f'({n} % 1000)')} end end")


def digits_sql(n: str) -> str:
    return f"array_to_string(list_transform(string_split(cast({n} as varchar), ''), lambda d: {digit_sql('d')}), ' ')"


@query("ignorable_fragments", "marked", f"""select media_id, cue_id, content from marked
  where {ignorable_sql('content', 'least(end_ms - start_ms, 350 + 45 * length(content))')}""")
def ignorable_fragments(spark, sf_dir):
    c = views.marked(spark, sf_dir)
    length = F.least(F.col("end_ms") - F.col("start_ms"), 350 + 45 * F.length("content"))
    return c.where(X.ignorable(F.col("content"), length)).select(*C3, "content")


@query("untranslated_rows", "marked", r"""select media_id, cue_id, text from (select media_id, cue_id,
  case when cue_id % 6 = 0 then content || source else content end as text from marked)
  where regexp_matches(text, '[\x{3400}-\x{9FFF}]')""")
def untranslated_rows(spark, sf_dir):
    c = views.marked(spark, sf_dir)
    text = F.when(F.col("cue_id") % 6 == 0, F.concat("content", "source")).otherwise(F.col("content"))
    return c.select(*C3, text.alias("text")).where(X.has_cjk(F.col("text")))


@query("terminal_punctuation", "marked", f"""select media_id, cue_id from marked
  where regexp_matches({strip_sql('content')}, {TERMINAL_SQL})""")
def terminal_punctuation(spark, sf_dir):
    return views.marked(spark, sf_dir).where(X.has_terminal(F.col("content"))).select(*C3)


def _number(spark, sf_dir):
    # Keys of orders spread over all branches of the number rule.
    return views.table(spark, sf_dir, "orders").select("o_orderkey", ((F.col("o_orderkey") * 7919) % 2_000_003 - 500).alias("n"))


@query("vn_integer", "", f"""nums as (select o_orderkey, (o_orderkey * 7919) % 2000003 - 500 n from orders),
  parts as (select o_orderkey, n, abs(n) a from nums)
  select o_orderkey, n, case when n < 0 then 'âm ' else '' end ||
    case when a < 1000000 then {words_sql('a')} else {digits_sql('a')} end words from parts""")
def vn_integer(spark, sf_dir):
    return _number(spark, sf_dir).withColumn("words", V.integer_words(F.col("n")))


@query("spoken_text", "cues", f"""big as (select media_id, cue_id, content, 10000000 + cue_id * 1234 big from cues)
  select media_id, cue_id, {words_sql('cue_id')} || ' mét vuông, giảm ' || {words_sql('media_id')} || ' phần trăm ' ||
    content || ' ' || {digits_sql('big')} || ' ki lô gam. x' || cue_id || 'm2' spoken from big""")
def spoken_text(spark, sf_dir):
    c = views.cues(spark, sf_dir)
    line = F.concat(
        F.col("cue_id").cast("string"), F.lit("M²,  giảm "), F.col("media_id").cast("string"), F.lit("% "), F.col("content"), F.lit(" "),
        (10_000_000 + F.col("cue_id") * 1234).cast("string"), F.lit(" kg. x"), F.col("cue_id").cast("string"), F.lit("m2 "))
    return c.select(*C3, V.spoken_text(line).alias("spoken"))


@query("predict_duration", "marked", f"select media_id, cue_id, {predict_sql('content')} predicted_ms from marked")
def predict_duration(spark, sf_dir):
    return views.marked(spark, sf_dir).select(*C3, M.predict_ms(F.col("content")).alias("predicted_ms"))


@query("emotion", "marked", """select media_id, cue_id, case when contains(content, '!') then 'intense'
  when contains(content, '?') then 'questioning' when contains(content, '…') or contains(content, '...') then 'hesitant'
  else 'neutral' end emotion from marked""")
def emotion(spark, sf_dir):
    return views.marked(spark, sf_dir).select(*C3, M.emotion(F.col("content")).alias("emotion"))


@query("pause_after", "marked", f"select media_id, cue_id, {pause_sql('content')} pause_ms from marked")
def pause_after(spark, sf_dir):
    return views.marked(spark, sf_dir).select(*C3, M.pause_after_ms(F.col("content")).alias("pause_ms"))


@query("speech_window", "cues", """t as (select media_id, cue_id, end_ms - start_ms target from cues)
  select media_id, cue_id, greatest(target, least(target + cue_id % 900 - 40 - 180,
    cast(round_even(target * 1.12::double, 0) as bigint) + 220)) window_ms from t""")
def speech_window(spark, sf_dir):
    target = F.col("end_ms") - F.col("start_ms")
    window = M.speech_window_ms(target, target + F.col("cue_id") % 900, F.lit(40), F.lit(180))
    return views.cues(spark, sf_dir).select(*C3, window.alias("window_ms"))


@query("tempo_fit", "cues", """t as (select media_id, cue_id, end_ms - start_ms win, (end_ms - start_ms) * (90 + cue_id % 40) // 100 orig from cues)
  select media_id, cue_id, case when win <= 0 or orig <= 0 or orig / win <= 1.03::double then orig
    else cast(round_even(orig / least(1.12::double, orig / win), 0) as bigint) end fitted_ms from t""")
def tempo_fit(spark, sf_dir):
    window = F.col("end_ms") - F.col("start_ms")
    original = F.floor(window * (90 + F.col("cue_id") % 40) / 100)
    return views.cues(spark, sf_dir).select(*C3, M.fitted_ms(original, window).alias("fitted_ms"))


@query("source_tail_punct", "marked", f"select media_id, cue_id, {tail_sql('source')} mark from marked")
def source_tail_punct(spark, sf_dir):
    return views.marked(spark, sf_dir).select(*C3, X.source_tail(F.col("source")).alias("mark"))


@query("append_punctuation", "marked", f"""t as (select media_id, cue_id, {strip_sql('content')} clean, {tail_sql('source')} mark from marked)
  select media_id, cue_id, case when clean = '' or regexp_matches(clean, {TERMINAL_SQL}) then clean
    else clean || case when mark = '' then '.' else mark end end as text from t""")
def append_punctuation(spark, sf_dir):
    return views.marked(spark, sf_dir).select(*C3, X.append_mark(F.col("content"), F.col("source")).alias("text"))


@query("lexical_key", "", r"""select doc_id, n_words, md5(key) key_hash from (select doc_id,
    len(regexp_extract_all(lower(nfc_normalize(text)), '[\p{L}\p{N}_\x{C0}-\x{1EF9}]+')) n_words,
    array_to_string(regexp_extract_all(replace(lower(nfc_normalize(text)), 'ß', 'ss'), '[\p{L}\p{N}_\x{C0}-\x{1EF9}]+'), ' ') as key
  from documents)""")
def lexical_key(spark, sf_dir):
    d = views.table(spark, sf_dir, "documents").select("doc_id", X.lexical_key(F.col("text")).alias("key"))
    return d.select("doc_id", X.count_of(F.col("key"), r"[^ ]+").cast("long").alias("n_words"), F.md5("key").alias("key_hash"))


@query("balanced_lines", "cues", r"""w as (select media_id, cue_id, string_split(content, ' ') w, 1 + cue_id % 5 n from cues),
  i as (select *, unnest(range(n)) line_no, len(w) // n as base, len(w) % n extra from w where len(w) >= n)
  select media_id, cue_id, line_no, array_to_string(w[line_no * base + least(line_no, extra) + 1:
    (line_no + 1) * base + least(line_no + 1, extra)], ' ') line from i""")
def balanced_lines(spark, sf_dir):
    c = views.cues(spark, sf_dir).select(*C3, X.balanced_lines(F.col("content"), 1 + F.col("cue_id") % 5).alias("lines"))
    return c.select(*C3, F.posexplode("lines").alias("line_no", "line"))


@query("join_spoken", "marked", rf"""p as (select media_id, cue_id, content l, lead(content) over w r, {strip_sql('source')} s
    from marked window w as (partition by media_id order by cue_id)),
  q as (select *, regexp_replace(l, '{BLANK_SQL}+$', '') b,
    regexp_replace(regexp_replace(regexp_replace(l, '{BLANK_SQL}+$', ''), '[.!?。！？]+\s*$', ''), '{BLANK_SQL}+$', '') bare from p where r is not null)
  select media_id, cue_id, {strip_sql(rf"case when regexp_matches(s, '[。！？!?]\s*$') then b when regexp_matches(s, '[,，、]\s*$') and not ends_with(bare, ',') then bare || ',' else bare end || ' ' || regexp_replace(r, '^{BLANK_SQL}+', '')")} spoken from q""")
def join_spoken(spark, sf_dir):
    c = neighbours(views.marked(spark, sf_dir), views.CUES, next={"right": F.col("content")}).where("right is not null")
    return c.select(*C3, X.join_spoken(F.col("content"), F.col("right"), F.col("source")).alias("spoken"))


P = ",;:!?。.，、！？…"


@query("pause_clauses", "marked", rf"""flat as (select media_id, cue_id,
    regexp_replace({one_spaced_sql("content || ' a,b; ' || content")}, '\.{{3,}}', '…', 'g') t from marked),
  raw as (select media_id, cue_id, list_filter(list_transform(regexp_extract_all(t, '[^{P}]+([{P}]\s*)*'),
    lambda c: regexp_replace(trim(c), '([{P}])\s+', '\1', 'g')), lambda c: regexp_matches(c, '[^{P}]')) cs from flat),
  one as (select media_id, cue_id, unnest(cs) clause, generate_subscripts(cs, 1) - 1 clause_no from raw)
  select media_id, cue_id, clause_no, clause, case when regexp_matches(clause, '(\.{{2,}}|…+)$') then 380
    when regexp_matches(clause, '[!?！？]+$') then 340 when regexp_matches(clause, '\.+$') then 380
    when regexp_matches(clause, '[:;]+$') then 260 when ends_with(clause, ',') then 210 else 0 end pause_ms from one""")
def pause_clauses(spark, sf_dir):
    c = views.marked(spark, sf_dir)
    text = F.concat("content", F.lit(" a,b; "), "content")
    c = c.select(*C3, F.posexplode(X.pause_clauses(text)).alias("clause_no", "clause"))
    return c.withColumn("pause_ms", X.clause_pause_ms(F.col("clause")))


@query("ocr_normalize", "marked", f"select media_id, cue_id, regexp_replace(content || source, '{BLANK_SQL}|[，。！？,.!?]', '', 'g') plain from marked")
def ocr_normalize(spark, sf_dir):
    return views.marked(spark, sf_dir).select(*C3, X.ocr_plain(F.concat("content", "source")).alias("plain"))


@query("overlap_ratio", "cues asr_track", """o as (select c.media_id, c.cue_id, start_ms, end_ms, asr_start, asr_end,
    least(end_ms, asr_end) - greatest(start_ms, asr_start) shared
    from cues c join asr_track a on a.media_id = c.media_id and a.asr_id = c.cue_id)
  select media_id, cue_id, case when shared <= 0 then 0 else cast(floor(1000000 * (shared /
    greatest(1, end_ms - start_ms, asr_end - asr_start))) as bigint) end ratio_ppm from o""")
def overlap_ratio(spark, sf_dir):
    c, a = views.cues(spark, sf_dir), views.asr_track(spark, sf_dir).withColumnRenamed("asr_id", "cue_id")
    ratio = M.overlap_ratio(F.col("start_ms"), F.col("end_ms"), F.col("asr_start"), F.col("asr_end"))
    return c.join(a, ["media_id", "cue_id"]).select(*C3, F.floor(1_000_000 * ratio).cast("long").alias("ratio_ppm"))


@query("max_words", "cues", """select media_id, cue_id, cast(greatest(2, least(24,
  round_even((end_ms - start_ms) / 1000 * 3.2::double, 0))) as int) max_words from cues""")
def max_words(spark, sf_dir):
    return views.cues(spark, sf_dir).select(*C3, M.max_words(F.col("end_ms") - F.col("start_ms")).alias("max_words"))


@query("output_filename", "jobs batches", r"""n as (select batch_id, count(*) n, min_by(filename, position) first_name, min(created_at) created
    from jobs group by batch_id),
  l as (select n.batch_id, created, case when n = 1 then regexp_replace(first_name || ': "x"', '\.[^.]*$', '')
    when dub then 'combined-vi-dubbed' when burn_subtitles then 'combined-vi-burned' else 'combined-source' end || ' / <part>. ' label
    from n join batches using (batch_id))
  select batch_id, strftime(created, '%Y%m%d-%H%M%S') || '_' || case when c = '' then 'video' else c end || '.mp4' output_name
  from (select *, regexp_replace(regexp_replace(label, '[<>:"/\\|?*\x00-\x1f]+', '-', 'g'), '^[ .\-]+|[ .\-]+$', '', 'g') c from l)""")
def output_filename(spark, sf_dir):
    j, b = views.jobs(spark, sf_dir), views.batches(spark, sf_dir)
    n = j.groupBy("batch_id").agg(
        F.count("*").alias("n"), F.min_by("filename", "position").alias("first_name"), F.min("created_at").alias("created"))
    single = F.regexp_replace(F.concat("first_name", F.lit(': "x"')), r"\.[^.]*$", "")
    mode = C.output_label(F.col("n"), single, F.col("dub"), F.col("burn_subtitles"))
    return n.join(b, "batch_id").select(
        "batch_id", C.output_name(F.col("created"), F.concat(mode, F.lit(" / <part>. "))).alias("output_name"))


@query("encode_budget", "jobs", """t as (select batch_id, sum(size_bytes) as bytes, sum(60000 + job_id % 977 * 100) ms from jobs group by batch_id),
  k as (select batch_id, cast(round_even(greatest(650, least(12000, greatest(bytes * 8 / greatest(ms / 1000, 0.001) / 1000 * 2.4::double - 128,
    4200 * ((1280 * 720) / (1920 * 1080))))), 0) as bigint) target from t)
  select batch_id, target target_kbps, cast(round_even(least(18000, target * 1.5), 0) as bigint) max_kbps from k""")
def encode_budget(spark, sf_dir):
    t = views.jobs(spark, sf_dir).groupBy("batch_id").agg(
        F.sum("size_bytes").alias("bytes"), F.sum(60_000 + F.col("job_id") % 977 * 100).alias("ms"))
    return t.select("batch_id", *C.encode_budget(F.col("bytes"), F.col("ms"), F.lit(1280), F.lit(720)))


@query("background_box", "regions", """t as (select media_id, region_id, x, y, width, height, 300 + region_id * 53 % 900 tw, 1 + region_id % 2 n,
    20 + region_id % 14 fs from regions),
  s as (select *, least(1280, greatest(width, tw + 2 * 18)) w,
    least(720, greatest(height, cast(round_even(fs * 1.22::double * n + 2 * 8, 0) as bigint))) h from t)
  select media_id, region_id, greatest(0, least(1280 - w, x + width // 2 - w // 2)) bx,
    greatest(0, least(720 - h, y + height // 2 - h // 2)) as "by", w bw, h bh,
    greatest(8, cast(round_even(h * 0.18::double, 0) as bigint)) radius from s""")
def background(spark, sf_dir):
    r, i = views.regions(spark, sf_dir), F.col("region_id")
    box = background_box(F.col("x"), F.col("y"), F.col("width"), F.col("height"),
                         300 + i * 53 % 900, 1 + i % 2, 20 + i % 14, F.lit(1280), F.lit(720))
    r = r.select("media_id", "region_id", box.alias("b"))
    return r.select("media_id", "region_id", F.col("b.x").alias("bx"), F.col("b.y").alias("by"),
                    F.col("b.width").alias("bw"), F.col("b.height").alias("bh"), F.col("b.radius").alias("radius"))


@query("centredness", "boxes", """select media_id, seq, cast(floor(1000000 * greatest(0, 1 - abs(x + w / 2 - 640) / 640)) as bigint) centre_ppm from boxes""")
def centred(spark, sf_dir):
    c = centredness(F.col("x"), F.col("w"), F.lit(1280))
    return views.boxes(spark, sf_dir).select("media_id", "seq", F.floor(1_000_000 * c).cast("long").alias("centre_ppm"))


@query("nfc_text", "", "select doc_id, md5(nfc_normalize(trim(text))) text_hash from documents")
def nfc_text(spark, sf_dir):
    return views.table(spark, sf_dir, "documents").select("doc_id", F.md5(X.nfc(F.trim("text"))).alias("text_hash"))


@query("clean_words", "words", """select media_id, pos, word, start_ms, least(end_ms, start_ms + 320) end_ms from words where trim(word) <> ''""")
def clean_words(spark, sf_dir):
    w = drop_untimed(views.words(spark, sf_dir), 320)
    return w.select("media_id", "pos", "word", "start_ms", "end_ms")
