"""Worked cases of loaders, spoken numbers, transcripts, captions, frames, generations and packing."""

import pytest
from pyspark.sql import functions as F

from leafmark.functions import spoken
from leafmark.operators import hierarchy, lecture, packing, prompts, speech, tree
from leafmark.sources import files

NUMBERS = {
    "với bảy mươi bài báo mất ba mươi hai giây": "với 70 bài báo mất 32 giây", "khoảng hai trăm hai mươi token": "khoảng 220 token", "chênh lệch không phẩy không một một": "chênh lệch 0.011", "chiếm bốn mươi phần trăm": "chiếm 40%",
    "năm hai nghìn không trăm hai mươi lăm": "năm 2025", "một nghìn hai trăm linh năm": "1205", "hai mươi mốt sinh viên": "21 sinh viên", "mười lăm phút": "15 phút", "khoảng hai trăm rưỡi token": "khoảng 250 token", "một nghìn rưỡi sinh viên": "1500 sinh viên", "hai triệu rưỡi đồng": "2500000 đồng",
    **{same: same for same in ("Hôm nay học một phương pháp mới", "trong năm học này", "hai bên đồng ý", "học lúc hai giờ rưỡi", "mất một tiếng rưỡi")},
}


@pytest.mark.parametrize("text", sorted(NUMBERS))
def test_spoken_numbers(text):
    assert spoken.spoken_to_digits(text) == NUMBERS[text]


def test_error_rates(spark):
    rows = spark.createDataFrame([("Hằng số k = 60, chạy 32 giây.", "hằng số k bằng sáu mươi chạy 32 giây"), ("RAPTOR mất 3097 giây", "Raptor mất 3.097 giây"), ("rộng 377 km²", "rộng ba trăm bảy mươi bảy km vuông")], "reference string, hypothesis string")
    got = [(r.words, r.word_errors, r.numbers, r.numbers_hit) for r in speech.error_rates(rows).collect()]
    assert got[0] == (7, 3, 2, 1) and got[1] == (4, 0, 1, 1) and got[2][2] == 1


def test_screened_segments(spark):
    cases = [
        (49680, 79660, "Hẹn gặp lại các bạn trong những video tiếp theo.", False, 53400, []), (50000, 52000, "Cảm ơn các bạn đã theo dõi.", False, 52000, []), (10000, 15000, "Hãy subscribe cho kênh Ghiền Mì Gõ để không bỏ lỡ những video hấp dẫn", False, 15000, []), (54000, 56000, "Nội dung bất kỳ", False, 56000, []),
        (45000, 70000, "Với bài giảng tiếng Việt cần đánh giá lại", True, 53400, ["beyond_media_end"]), (40000, 48000, "Tóm lại k bằng 60. Cảm ơn các bạn đã theo dõi.", True, 48000, ["stock_phrase"]), (1000, 5000, "Các bạn theo dõi công thức trên bảng", True, 5000, []),
    ]
    rows = spark.createDataFrame([(i, a, b, t, 53400) for i, (a, b, t, *_) in enumerate(cases)], "i int, start_ms long, end_ms long, text string, duration_ms long")
    got = {r.i: (r.keep, r.end, r["flags"]) for r in speech.screen_segments(rows).collect()}
    assert got == {i: tuple(c[3:]) for i, c in enumerate(cases)}


def test_captions(spark):
    srt = "1\n00:00:01,000 --> 00:00:04,500\nHello <i>there</i>.\n\n2\n00:00:05,000 --> 00:00:09,000\nk = 60 &amp; more.\n"
    vtt = "WEBVTT\n\nNOTE a note\n\n00:01.000 --> 00:03.250\nFirst.\n\n00:01:10.000 --> 00:01:12.000\nLate.\n"
    cues = files.read_captions(spark.createDataFrame([("a", srt), ("b", vtt), ("c", "no cues")], "path string, value string"))
    got = sorted((r.path, r.ordinal, r.start_ms, r.end_ms, r.text) for r in cues.collect())
    assert got == [("a", 0, 1000, 4500, "Hello there."), ("a", 1, 5000, 9000, "k = 60 & more."), ("b", 0, 1000, 3250, "First."), ("b", 1, 70000, 72000, "Late.")]
    assert [r.path for r in files.refused_captions(spark.createDataFrame([("a",), ("c",)], "path string"), cues).collect()] == ["c"]


def test_changed_frames(spark):
    def frames(sigs):
        return spark.createDataFrame([("v", t, s, 30_000) for t, s in sigs], "video_id string, ts_ms long, signature array<double>, duration_ms long")

    steps = frames([(0, [0.0] * 4), (5000, [0.05] * 4), (10_000, [0.0, 0.0, 1.0, 1.0]), (15_000, [0.0, 0.0, 1.0, 1.0]), (20_000, [1.0] * 4)])
    got = [(r.ts_ms, r.visible_to_ms) for r in lecture.select_changed_frames(steps, 0.4, 10)[0].orderBy("ts_ms").collect()]
    assert got == [(0, 10_000), (10_000, 20_000), (20_000, 30_000)]
    some, stopped = lecture.select_changed_frames(steps, 0.4, 1)
    assert [(r.ts_ms, r.visible_to_ms) for r in some.collect()] == [(0, 10_000)] and stopped.collect()[0].unread_from_ms == 10_000


def test_glossary(spark):
    rows = [("w", i, t) for i, t in enumerate(["  Agreement   Ranking ", "agreement ranking", "SBERT\0", ""])] + [("many", i, f"t{i}") for i in range(41)] + [("long", 0, "x" * 61)] + [("wide", i, "a long term here and there " + str(i)) for i in range(20)]
    got = {r.workspace_id: (r.terms, r.reason) for r in speech.clean_glossary(spark.createDataFrame(rows, "workspace_id string, ordinal int, term string")).collect()}
    assert got["w"] == (["Agreement Ranking", "SBERT"], None)
    assert {k: v[1] for k, v in got.items() if k != "w"} == {"many": "too many terms", "long": "term too long", "wide": "glossary too long"} and got["many"][0] is None


def test_generation_contract(spark):
    raw = spark.createDataFrame([(1, '```json\n{"answerable": true, "claims": [{"text": "a", "citations": ["C1", "C7"], "confidence": 0.9}]}\n```', ["C1"]), (2, "no json", ["C1"])], "query_id long, response string, context_ids array<string>")
    got = {r.query_id: (r.answerable, [c.text for c in r.claims], r.errors) for r in prompts.parse_generations(raw).collect()}
    assert got == {1: (True, ["a"], ["claim_0_invalid_citation:C7"]), 2: (False, [], ["provider_invalid_json"])}


def test_best_block_is_cut_where_none_fits(spark):
    text = "One two three four. Five six seven eight. Nine ten eleven twelve."
    blocks = spark.createDataFrame([(1, "n", 0.9, "s", text, 900)], "query_id long, node_id string, utility double, source string, text string, tokens int")
    got = packing.assemble(blocks, spark.createDataFrame([(1, "factoid")], "query_id long, query_type string"), budget=10).collect()
    assert len(got) == 1 and got[0].truncated and got[0].tokens <= 10 and text.startswith(got[0].text)


def test_tree_of_pages_and_paragraphs(spark):
    words = " ".join(f"Word{i} is here now and then." for i in range(120))
    rows = spark.createDataFrame([("d", "src", 0, "1. Methods", words, [(0, 1000, 1), (1000, 10_000, 2)], [("p1", "x", 0, 50)])], "document_id string, source string, section_pos int, title string, text string, page_spans array<struct<s: int, e: int, page: int>>, paragraphs array<struct<paragraph_id: string, text: string, char_start: int, char_end: int>>")
    nodes = tree.build_hierarchy(rows).collect()
    leaves = sorted((n for n in nodes if n.level == "child"), key=lambda n: n.position)
    assert len(leaves) > 3 and all(words[n.char_start:n.char_end] == n.text for n in leaves)
    assert leaves[0].page_start == 1 and leaves[-1].page_end == 2 and leaves[0].paragraph_ids == ["p1"] and not leaves[1].paragraph_ids
    assert {n.parent_id for n in leaves} <= {n.node_id for n in nodes if n.level == "parent"}
    assert tree.validate_hierarchy(tree.build_hierarchy(rows)).where("violation not like 'pages%'").count() == 0


def test_section_types(spark):
    rows = spark.createDataFrame([("2.1. Related Work",), ("Notes",), ("METHODS",)], "t string")
    assert [r[0] for r in rows.select(hierarchy.section_type(F.col("t"))).collect()] == ["related_work", "document", "method"]
