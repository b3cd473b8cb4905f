"""Literal cases: inputs and the results the rules must give."""

import pytest
from pyspark.sql import functions as F

from cuegrid.functions import text as X
from cuegrid.functions import timing as M
from cuegrid.functions import vietnamese as V
from cuegrid.operators import catalog as C
from cuegrid.operators import folds as G
from cuegrid.operators import quality as Q
from cuegrid.operators import reconcile as R
from cuegrid.operators import replies as P
from cuegrid.operators import sequence as S
from cuegrid.operators import tracks as T
from cuegrid.plans.scan import Sequence
from cuegrid.sources import reports, srt


def cues(spark, rows):
    """rows: (cue_id, start s, end s, content, speaker)."""
    data = [(1, i, round(a * 1000), round(b * 1000), c, s) for i, a, b, c, s in rows]
    return spark.createDataFrame(data, "media_id long, cue_id long, start_ms long, end_ms long, content string, speaker string")


def value(spark, column_of, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(column_of(F.col("t"))).collect()]


def test_text_functions(spark):
    assert value(spark, M.pause_after_ms, "Mưa rồi.", "Rẽ trái,", "Qua cầu;", "Mấy giờ?", "Đi bộ") == [360, 180, 240, 320, 100]
    assert value(spark, V.spoken_text, "Vườn 12m², lãi 5%.") == ["Vườn mười hai mét vuông, lãi năm phần trăm."]
    assert value(spark, lambda t: V.integer_words(t.cast("long")), "0", "15", "-40", "3002") == ["không", "mười lăm", "âm bốn mươi", "ba nghìn hai"]
    clauses = value(spark, X.pause_clauses, "Tàu đến muộn, ta uống trà. Mấy giờ rồi? Sắp đến!", "!! , x:y;", "")
    assert clauses == [["Tàu đến muộn,", "ta uống trà.", "Mấy giờ rồi?", "Sắp đến!"], ["x:", "y;"], []]
    assert value(spark, X.clause_pause_ms, "gạo,", "muối.", "chưa?", "thìa:", "bếp。", "nồi…") == [210, 380, 340, 260, 0, 380]
    assert value(spark, X.source_tail, "下雨了吗", "火车来了。", "等一下...", "", "喝茶") == ["?", ".", ".", "", ""]
    assert value(spark, lambda t: X.append_mark(t, F.lit("几点了呢")), "Mấy giờ", "Mấy giờ!", "\t") == ["Mấy giờ?", "Mấy giờ!", ""]
    assert value(spark, X.nfc, "tra\u0300") == ["tr\u00e0"]


def test_all_kinds_of_blanks_count(spark):
    assert value(spark, X.strip, "\u3000茶好。\u00a0", "\u2003a b\x1f", "\u0085") == ["茶好。", "a b", ""]
    assert value(spark, X.ocr_plain, "\u3000茶\u2002好。\u3000") == ["茶好"]
    assert value(spark, X.ends_sentence, "Trà ngon.\u3000", "Trà\u3000") == [True, False]
    assert value(spark, X.source_tail, "喝茶吗\u3000") == ["?"]
    assert value(spark, lambda t: X.join_spoken(t, F.lit("\u3000ở quán."), F.lit("喝茶，\u3000")), "Uống trà.\u00a0") == ["Uống trà, ở quán."]
    assert value(spark, lambda t: F.array_join(X.balanced_lines(t, F.lit(2)), "|"), "\u3000một\u2003hai ba ") == ["một hai|ba"]


def words(spark, rows):
    return spark.createDataFrame([(1, i, w, round(a * 1000), round(b * 1000), s) for i, (w, a, b, s) in enumerate(rows)],
                                 "media_id long, pos long, word string, start_ms long, end_ms long, speaker string")


def grouped(spark, rows):
    w = S.smooth_speaker_flips(G.clean_words(words(spark, rows)))
    return [(r.content, r.speaker, r.end_ms) for r in G.group_words(w, speaker="speaker_fixed").orderBy("cue_id").collect()]


def test_word_grouping(spark):
    # one short word of another voice inside a run belongs to the run
    assert grouped(spark, [("火", 1.0, 1.3, "P"), ("车", 1.3, 1.5, "Q"), ("到", 1.5, 1.7, "P"), ("站", 1.7, 2.0, "P")]) == [("火车到站", "P", 2000)]
    # a word without pause of over a second is cut to 1.2 s, which leaves a gap before the next voice
    assert grouped(spark, [("茶", 2.0, 6.0, "P"), ("喝", 6.0, 6.6, "Q"), ("水", 6.6, 7.0, "Q")]) == [("茶", "P", 3200), ("喝水", "Q", 7000)]


def test_fragment_speakers(spark):
    c = cues(spark, [(4, 0, 1.2, "开往北方的火", "P"), (5, 1.2, 1.5, "车", "Q")])
    assert {r.cue_id: r.speaker_fixed for r in S.repair_fragment_speakers(c).collect()} == {4: "P", 5: "P"}


def test_metrics(spark):
    w = spark.createDataFrame([(7, "茶", 500, 1500), (7, "水", 1200, 1900), (8, "哦", 9000, 9030)], "media_id long, word string, start_ms long, end_ms long")
    m = T.transcript_metrics(w, spark.createDataFrame([(7, 9000), (8, 130_000)], "media_id long, duration_ms long"))
    assert {r.media_id: (r.speech_ms, r.units, r.words) for r in m.collect()} == {7: (1400, 2, 2), 8: (30, 1, 1)}
    assert [r.media_id for r in T.sparse_transcripts(m).collect()] == [8]


def test_units_and_sentences(spark):
    c = cues(spark, [(1, 0, 1, "Chuyến tàu", "P"), (2, 1.2, 2, "có trễ không?", "P"), (3, 2.2, 3, "Không trễ.", "Q"), (4, 7, 8, "Hôm sau trời mưa", "Q")])
    assert [(r.cue_ids, r.scene_id) for r in G.dialogue_units(c).orderBy("unit_id").collect()] == [([1, 2], 1), ([3], 1), ([4], 2)]
    c = cues(spark, [(1, 2, 3, "Khi nước sôi", "P"), (2, 3.3, 4, "thì cho muối,", "P"), (3, 4, 5.5, "rồi cho mì.", "P"), (4, 5.5, 6, "Xong!", "Q")])
    got = [(r.utterance_id, r.start_ms, r.end_ms, r.content, r.cue_ids) for r in S.sentence_utterances(c).orderBy("utterance_id").collect()]
    assert got == [(1, 2000, 5500, "Khi nước sôi thì cho muối, rồi cho mì.", [1, 2, 3]), (4, 5500, 6000, "Xong!", [4])]


def test_build_utterances(spark):
    def run(rows):
        return [(r.content, r.speaker) for r in G.build_utterances(cues(spark, rows)).orderBy("utterance_id").collect()]
    assert run([(1, 0, 1, "Rửa rau", "P"), (2, 1.3, 2, "cho sạch", "P"), (3, 2.2, 3, "Vâng", "Q")]) == [("Rửa rau cho sạch", "P"), ("Vâng", "Q")]
    assert run([(1, 0, 4, "Nếu trời…", "P"), (2, 4.2, 8, "không mưa nữa.", "P")]) == [("Nếu trời không mưa nữa.", "P")]
    assert run([(1, 0, 2, "Cửa đã khóa.", "P"), (2, 2.2, 4, "Chìa ở đâu?", "P")]) == [("Cửa đã khóa.", "P"), ("Chìa ở đâu?", "P")]


def speech(spark, rows, hard=()):
    data = [(1, i, [i], t, round(a * 1000), round(b * 1000), s, s, src, i in hard) for i, a, b, t, s, src in rows]
    g = spark.createDataFrame(data, "media_id long, group_id long, cue_ids array<long>, full_text string, start_ms long, end_ms long, first_speaker string, last_speaker string, source_last string, hard_break boolean")
    return [(r.cue_ids, r.full_text) for r in G.coalesce_speech(g).orderBy("utterance_id").collect()]


def test_coalesced_speech(spark):
    got = speech(spark, [(1, 0, 1, "Chiều nay chuyến tàu.", "P", "今天下午的火车"), (2, 1.2, 2, "sẽ chạy chậm", "P", "会慢，"), (3, 2.2, 3, "vì trời mưa.", "P", "因为下雨。"), (4, 3.1, 4, "Tôi biết.", "P", "我知道。")])
    assert got == [([1, 2, 3], "Chiều nay chuyến tàu sẽ chạy chậm, vì trời mưa."), ([4], "Tôi biết.")]
    got = speech(spark, [(5, 0, 1, "một", "P", "一"), (6, 1.1, 2, "hai", "Q", "二"), (7, 2.1, 3, "ba", "Q", "三"), (8, 6, 7, "bốn", "Q", "四")], hard=(7,))
    assert [ids for ids, _ in got] == [[5], [6], [7], [8]]
    # a first part of 112 characters, blanks included, and a further one of 108 are the most
    for size, groups in ((108, 1), (109, 2)):
        assert len(speech(spark, [(1, 0, 1, "a" * 110 + "  ", "P", "一"), (2, 1.1, 2, "b" * size, "P", "二")])) == groups


def test_speech_window(spark):
    df = spark.range(1).select(M.fitted_ms(F.lit(900), F.lit(1500)).alias("slow"))
    assert df.first().slow == 900
    w = spark.range(1).select(M.speech_window_ms(F.lit(1000), F.lit(9000), F.lit(0), F.lit(300)).alias("w")).first().w
    assert 1000 <= w <= 8700


def test_retime(spark):
    rows = [(1, 1, i, t, 4000, 3000) for i, t in enumerate(["Khi nước sôi", "thì cho muối,", "rồi cho mì."], 1)]
    got = [(r.aligned_start_ms, r.aligned_end_ms) for r in S.retime(spark.createDataFrame(rows, "media_id long, phrase long, cue_id long, content string, scheduled_start_ms long, fitted_ms long")).orderBy("cue_id").collect()]
    assert got[0][0] == 4000 and got[-1][1] == 7000 and all(a[1] == b[0] for a, b in zip(got, got[1:]))


def test_natural_order_and_names(spark):
    names = ["part-12.mkv", "part-3.mkv", "7 z.mkv", "part-03b.mkv", "21 a.mkv"]
    f = spark.createDataFrame([(1, i, n) for i, n in enumerate(names)], "b int, i int, filename string")
    assert [r.filename for r in C.natural_order(f, "b", "i").orderBy("natural_position").collect()] == ["7 z.mkv", "21 a.mkv", "part-3.mkv", "part-03b.mkv", "part-12.mkv"]
    at = F.lit("2025-02-03 04:05:06").cast("timestamp_ntz")
    assert spark.range(1).select(C.output_name(at, F.lit("Mưa: phần <2>"))).first()[0] == "20250203-040506_Mưa- phần -2.mp4"


def test_recent_refuses_other_lengths(spark):
    jobs = spark.createDataFrame([(i, i) for i in range(5)], "job_id int, created_at int")
    assert [r.job_id for r in C.recent(jobs, 2).collect()] == [4, 3]
    for n in (0, 201):
        with pytest.raises(ValueError):
            C.recent(jobs, n)


def test_batch_progress(spark):
    e = spark.createDataFrame([("k", 1, "a.mkv", "failed", "no audio"), ("k", 2, "b.mkv", "running", None)], "batch_id string, position int, filename string, status string, error string")
    r = C.batch_progress(e, spark.createDataFrame([("k", "running")], "batch_id string, batch_status string")).first()
    assert r.new_status == "running" and "a.mkv" in r.error


def test_usage_ledger(spark):
    e = spark.createDataFrame([(3, "own", "m1", 40, 10, 30, 5, 45), (3, "own", "m2", 7, None, None, 2, None)],
                              "media_id int, provider string, model string, prompt_tokens long, prompt_cache_hit_tokens long, prompt_cache_miss_tokens long, completion_tokens long, total_tokens long")
    r = C.usage_ledger(C.usage_tokens(e)).first()
    assert (r.requests, r.total, r.hit, r.miss, r.models) == (2, 54, 10, 37, {"m1": 1, "m2": 1})


REPLIES = [
    ('```json\n[{"id":4,"text":"Trà nóng"}]\n```', [4], {4: "Trà nóng"}),
    ('{"translations":{"4":"Trà nóng"}}', [4], {4: "Trà nóng"}),
    ('{"4":"Trà","5":"nóng"}', [4, 5], {4: "Trà", 5: "nóng"}),
    ('{"id":4,"text":"Trà"}\n\n{"id":5,"text":"nóng"}', [4, 5], {4: "Trà", 5: "nóng"}),
    ('[{"cueId":4,"translated":"Trà"},{"index":5,"output":{"text":"nóng"}}]', [4, 5], {4: "Trà", 5: "nóng"}),
    ('{"id":4,"text":"]}{ trong chuỗi"} {"id":5,"text":"\\"}{\\""}', [4, 5], {4: "]}{ trong chuỗi", 5: '"}{"'}),
    ('{"id":9223372036854775807,"text":"lớn"}', [9223372036854775807], {9223372036854775807: "lớn"}),
    ('{"id":4,"text":"' + "dài " * 250_000 + '"}', [4], {4: ("dài " * 250_000).strip()}),
    ('{"id":4,"text":"' + '\\"' * 300_000 + '"} {"id":5,"text":"x"}', [4, 5], {4: '"' * 300_000, 5: "x"}),
    ("[]", [4], "missing_ids"),
    ('[{"id":4,"text":"a"},{"id":6,"text":"b"}]', [4], "extra_ids"),
    ('[{"id":4,"text":"a"},{"id":4,"text":"b"}]', [4], "duplicate_id"),
    ('[{"id":4,"text":7}]', [4], "no_id_or_text"),
    ('[{"id":"bốn","text":"a"}]', [4], "bad_id"),
    ("không phải JSON", [4], "unreadable"),
    ('[{"id":4,"text":"a"} {"id":5,"text":"b"}]', [4, 5], "unreadable"),  # a comma is put in between whole replies only
]


def test_translation_replies(spark):
    rows = spark.createDataFrame([(i, 0, r) for i, (r, _, _) in enumerate(REPLIES)], "media_id long, batch_no long, reply string")
    want = spark.createDataFrame([(i, 0, x) for i, (_, ids, _) in enumerate(REPLIES) for x in ids], "media_id long, batch_no long, item_id long")
    items = P.translation_items(rows)
    got = {}
    for r in items.where("problem is null").collect():
        got.setdefault(r.media_id, {})[r.item_id] = r.text
    status = {r.media_id: r.status for r in P.reply_status(items, want).collect()}
    for i, (_, _, expected) in enumerate(REPLIES):
        if isinstance(expected, dict):
            assert status[i] == "ok" and got[i] == expected, i
        else:
            assert status[i] == expected, i


def test_master_replies(spark):
    line = '{"utterances":[{"cue_ids":[3,4],"full_text":"%s","display_lines":[{"id":3,"text":"%s"},{"id":4,"text":""}]}]}'
    rows = [(1, 0, line % ("Trời mưa cả ngày.", "Trời mưa cả ngày.")), (2, 0, line.replace('"text":""', '"text":"gió"') % ("Trời mưa to", "Trời mưa")), (3, 0, "không đọc được"), (4, 0, '{"utterances":[]}'), (5, 0, None)]
    replies = spark.createDataFrame(rows, "media_id long, batch_no long, reply string")
    r = {x.media_id: x for x in P.master_groups(replies).collect()}
    assert set(r) == {1, 2} and r[1].same_words and " ".join(r[1].lines) == r[1].full_text and all(r[1].lines) and not r[2].same_words
    assert {x.media_id: x.status for x in P.master_status(replies).collect()} == {1: "ok", 2: "ok", 3: "unreadable", 4: "empty", 5: "unreadable"}


def test_directions(spark):
    plans = spark.createDataFrame([(m, 0, 8, "Trà nóng quá", "neutral", 0.5, "tu_nhien", 0, 90) for m in (1, 2)],
                                  "media_id long, batch_no long, id long, spoken_text string, emotion string, intensity double, style string, pause_before_ms int, pause_after_ms int")
    raw = '{"prosody":[{"id":8,"spoken_text":"%s","emotion":"warm","intensity":0.7,"style":"doc_truyen","pause_before_ms":30,"pause_after_ms":200}]}'
    replies = spark.createDataFrame([(1, 0, raw % "Trà nóng... quá!"), (2, 0, raw % "Trà rất nóng"), (3, 0, "?")], "media_id long, batch_no long, reply string")
    r = {x.media_id: x for x in R.apply_directions(plans, P.direction_items(replies)).collect()}
    assert (r[1].spoken_text, r[1].prosody_source, r[1].pause_after_ms) == ("Trà nóng... quá!", "ai", 200)
    assert (r[2].spoken_text, r[2].prosody_source) == ("Trà nóng quá", "fallback")
    assert {x.media_id: x.status for x in P.direction_status(replies).collect()} == {1: "ok", 2: "ok", 3: "unreadable"}


def test_failing_provider_is_not_fatal(spark):
    def offline(_):
        raise RuntimeError("no route")
    r = P.ask(spark.createDataFrame([(1, 0, "x")], "media_id long, batch_no long, request string"), offline).first()
    assert r.reply is None and r.error == "no route"


def test_first_ids_are_limited_per_rule(spark):
    found = spark.createDataFrame([(1, n, i, i) for n in ("empty_lines", "tts_speed") for i in range(30)], "media_id long, name string, item_id long, pos long")
    got = {r["name"]: list(r["ids"]) for r in Q.first_findings(found).collect()}
    assert got == {"empty_lines": list(range(30)), "tts_speed": list(range(20))}


def test_srt_parsing_keeps_ids_blanks_and_line_breaks(spark):
    body = "\ufeff5\r\n00:00:02,000 --> 00:00:03,250\r\nmưa\r\nto\r\n\r\n8\n00:00:04,000 --> 00:00:04,200\n\n\n11\n02:00:00.125 --> 02:00:01,000 X1:0\n40\n\ngió\n\n"
    got = [(r.cue_id, r.start_ms, r.end_ms, r.content) for r in srt.parse_srt(spark.createDataFrame([(1, body)], "media_id int, body string")).orderBy("cue_id").collect()]
    assert got == [(5, 2000, 3250, "mưa\nto"), (8, 4000, 4200, ""), (11, 7200125, 7201000, "40\n\ngió")]


def test_long_and_malformed_srt_blocks(spark):
    head = "1\n00:00:01,000 --> 00:00:02,000\n"
    texts = spark.createDataFrame([(1, head + "dòng\n" * 200_000), (2, "ghi chú\n\n" + head + "a\n\n00:00:05,000 --> 00:00:06,000\nmất số\n"), (3, head + "b\n")], "media_id int, body string")
    assert {r.media_id: r.content.count("dòng") for r in srt.parse_srt(texts).where("media_id = 1").collect()} == {1: 200_000}
    assert sorted((r.media_id, r.block_no, r.problem) for r in srt.malformed_blocks(texts).collect()) == [(2, 0, "no_head"), (2, 1, "no_number")]


def test_artifacts_of_other_versions_are_ignored(spark):
    df = spark.createDataFrame([(1, '{"pipeline_version":"2.0","artifacts":{"cut":{"fingerprint":"z","files":["b"]}}}'), (2, '{"pipeline_version":"0.9","artifacts":{"cut":{"fingerprint":"z"}}}'), (3, "{")], "media_id int, body string")
    assert [(r.media_id, r.name, r.files) for r in reports.artifact_rows(df).collect()] == [(1, "cut", ["b"])]


def test_blank_speakers_are_unknown(spark):
    body = '{"word_segments":[{"word":"trà","start":0.5,"end":0.75,"speaker":" "},{"word":"nóng","start":0.75,"end":1.0,"speaker":"P"}]}'
    assert [r.speaker for r in reports.aligned_words(spark.createDataFrame([(1, body)], "media_id int, body string")).orderBy("pos").collect()] == [None, "P"]


def test_ocr_session_timing(spark):
    s = spark.createDataFrame([(1, i, i * 400, t, 80) for i, t in enumerate(["p", "q", "q", "p"])], "media_id long, seq long, ts_ms long, text string, score_pct long")
    got = [(r.text, r.samples) for r in S.ocr_sessions(s, Sequence(("media_id",), ("seq",))).orderBy("session").collect()]
    assert got == [("p", 1), ("q", 2), ("p", 1)]


def test_regions_end_with_the_video(spark):
    boxes = spark.createDataFrame([(1, t, i, 300, 600, 400, 40, 90) for i, t in enumerate(range(0, 3000, 250))], "media_id long, ts_ms long, seq long, x int, y int, w int, h int, score_pct int")
    cues_ = spark.createDataFrame([(1, 1, 0, 2900), (2, 1, 100, 5000), (2, 2, 7000, 8000)], "media_id long, cue_id long, start_ms long, end_ms long")
    video = spark.createDataFrame([(1, 2800), (2, 4000)], "media_id long, duration_ms long")
    from cuegrid.operators import regions as B
    got = B.source_regions(boxes, cues_, 250, 1280, 720, video).collect()
    assert {(r.media_id, r.end_ms) for r in got} == {(1, 2800), (2, 4000)}


def test_streams_leave_the_session_as_it_was(spark):
    from cuegrid.streaming import state
    before = spark.conf.get(state.STORE, None)
    with state.spilled_state(spark):
        assert spark.conf.get(state.STORE) == state.ROCKSDB
    assert spark.conf.get(state.STORE, None) == before
