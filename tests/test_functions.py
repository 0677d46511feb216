"""Golden cases for text, number and guard rules."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sourceline.functions import highlight as hl
from sourceline.functions import numbers as nb
from sourceline.functions import text as tx
from sourceline.functions.profiles import KOREAN
from sourceline.functions.spoken import clean_question
from sourceline.operators import classify as cl
from sourceline.operators import guards as gd
from sourceline.operators import knowledge as kb


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "v string").select(fn(F.col("v")).alias("r")).first()["r"]


def test_korean_tokens_have_character_pairs(spark):
    assert one(spark, "정확도 88.9% CCTV", tx.lexical_tokens) == ["정확도", "정확", "확도", "88.9", "cctv"]


def test_content_words_keep_units_and_names(spark):
    assert one(spark, "총 3회, 41% 와 YOLOv8 때 팀 a", lambda c: tx.content_words(c, KOREAN.one_char_skip)) == [
        "총", "3회", "41%", "와", "YOLOv8", "팀"]


def test_label_and_value_lines_are_merged(spark):
    lines = [c["line"] for c in one(spark, "월 고정비\n30만원\n본문이 여기 길게 있다", tx.candidate_lines)]
    assert lines == ["월 고정비 30만원", "본문이 여기 길게 있다"]


@pytest.mark.parametrize("text, expected", [
    ("누적 응시자 1,000명,\n오픈", "누적 응시자 1,000명,\n오픈"),                       # two characters are too few
    ("누적 응시자 1,000명,\n오픈 베타", "누적 응시자 1,000명, 오픈 베타"),
    ("가장 큰 우려는\n- 비용 문제입니다 정말", "가장 큰 우려는\n- 비용 문제입니다 정말"),     # bullets start anew
    ("가장 큰 우려는\n비용 문제가 가장 크다", "가장 큰 우려는 비용 문제가 가장 크다"),
    ("끝난 문장이다.\n다음 문장이 이어진다", "끝난 문장이다.\n다음 문장이 이어진다"),
])
def test_wrapped_lines(spark, text, expected):
    assert one(spark, text, lambda c: tx.join_wrapped(c, KOREAN.open_end)) == expected


def test_passages_overlap_and_keep_lines_whole(spark):
    lines = ["a" * 110, "b" * 110, "c" * 109, "d" * 111]
    got = one(spark, "\n".join(lines), tx.passages)
    assert got == ["\n".join(lines[:2]), "\n".join(lines[1:4]), lines[3]]
    assert one(spark, "x" * 219, tx.passages) == ["x" * 219]


def test_budget_parts(spark):
    para = "p" * 2000
    parts = one(spark, "\n\n".join([para, para, "end"]), tx.budget_parts)
    assert [len(p) for p in parts] == [2002, 2007]


def test_stutter_filler_and_courtesy_go(spark):
    said = "안녕하세요. 발표 잘 들었습니다. 어.. 음 그 그 모델은 왜 썼나요"
    assert one(spark, said, clean_question) == "그 모델은 왜 썼나요"
    assert one(spark, "가격 가격은 얼마죠", clean_question) == "가격 가격은 얼마죠"


def test_page_references(spark):
    assert one(spark, "12번 슬라이드와 p.3 참고 42", tx.drop_page_refs).strip() == "와  참고 42"
    assert one(spark, "10번 슬라이드와 0번 슬라이드", tx.name_page_zero) == "10번 슬라이드와 보강 자료"


def test_content_id_of_missing_page(spark):
    import hashlib
    want = hashlib.sha1("doc|None|글".encode()).hexdigest()[:10]
    got = spark.range(1).select(tx.content_id(F.lit("doc"), F.lit(None).cast("int"), F.lit("글")).alias("i")).first()["i"]
    assert got == want


SOURCE = "Search uses BM25 with vectors.\nrecall 77.5%, 123ms\nmodel is abc-4.2-mini"
BARE = "recall 77.5%, 123ms\n1,234 pages"


@pytest.mark.parametrize("text, source, question, expected", [
    ("BM25 and q5-tiny go together.", BARE, "why BM25 and q5-tiny?", True),        # names from the question
    ("q5-tiny was used.", BARE, "why Q5 tiny?", True),                             # other spelling
    ("BM25 counts words.", BARE, "what is bm25?", True),                           # other case
    ("It runs on BM25.", SOURCE, "what runs?", True),                              # name in the source
    ("The model is abc-4.2-mini.", SOURCE, "which model?", True),
    ("BM25 with q5-tiny reach 77.5%.", BARE, "BM25 with q5-tiny?", True),
    ("Recall is 91.2%.", SOURCE, "recall?", False),
    ("Yes, 91%.", BARE, "is it 91%?", False),                                      # questions do not vouch for numbers
    ("BM25 takes 0.3ms.", BARE, "how fast is BM25?", False),
    ("z9-large was used.", BARE, "which one?", False),
    ("We used 300 pages.", BARE, "how many?", False),
    ("It takes 123ms.", BARE, "how long?", True),
    ("Both were joined.", BARE, "why?", True),
    ("It has 1234 pages", BARE, "?", True),
])
def test_number_support(spark, text, source, question, expected):
    row = spark.range(1).select(nb.numbers_supported_by_name(F.lit(text), F.lit(source), F.lit(question)).alias("ok")).first()
    assert row["ok"] is expected


@pytest.mark.parametrize("text, noise", [
    ("", True), ("   ", True), ("음 저기 ", True), ("그니까", True), ("어 음 그 저기", True),
    ("어떻게!?", True), ("어떻게 하나요", False), ("손익분기점은 언제인가요", False)])
def test_noise(spark, text, noise):
    assert one(spark, text, lambda c: gd.is_noise(c, KOREAN)) is noise


@pytest.mark.parametrize("text, kind", [
    ("이 방법의 한계는 무엇인가요", "한계반론"), ("왜 그렇게 했나요", "근거"), ("어떻게 나누셨나요", "절차"), ("몇 개인가요", "사실확인")])
def test_question_types(spark, text, kind):
    assert one(spark, text, lambda c: cl.question_type(c, KOREAN)) == kind


def test_core_kinds(spark):
    assert one(spark, "의의는 뭔가요", lambda c: cl.core_kind(c, KOREAN)) == "significance"
    assert one(spark, "한계와 장점은", lambda c: cl.core_kind(c, KOREAN)) is None
    assert one(spark, "AI 탐지의 한계", lambda c: cl.core_kind_of_bare_question(c, KOREAN)) is None


def test_highlight_spans(spark):
    row = spark.createDataFrame([("재발표 발표자에게 3회 B2B", ["발표"])], "t string, w array<string>").select(
        hl.word_and_number_spans(F.col("t"), F.col("w")).alias("s"), hl.literal_spans(F.col("t"), F.col("w")).alias("l")).first()
    assert [(s["start"], s["end"]) for s in row["s"]] == [(4, 9), (10, 12)]
    assert [(s["start"], s["end"]) for s in row["l"]] == [(1, 3), (4, 6)]


def test_highlight_spans_read_the_text_once(spark):
    """A written word may run on through further occurrences; no span looks into the text again by its place."""
    texts = {"abab ab-ab xab": ["ab"], "xa-a-a a-a": ["a-a"], "ababx abab": ["ab", "abab"], "-- --- a--": ["--"], "12% of 3 ab3": ["ab"], "": ["ab"]}
    df = spark.createDataFrame([(t, w) for t, w in texts.items()], "t string, w array<string>")
    spans = hl.word_and_number_spans(F.col("t"), F.col("w"))
    got = {r["t"]: [(s["start"], s["end"]) for s in r["s"]] for r in df.select("t", spans.alias("s")).collect()}
    assert got == {"abab ab-ab xab": [(0, 4), (5, 7), (8, 10)], "xa-a-a a-a": [(7, 10)], "ababx abab": [(0, 5), (6, 10)],
                   "-- --- a--": [(0, 2), (3, 5)], "12% of 3 ab3": [(0, 3), (7, 8), (9, 12)], "": []}
    assert "substring(t," not in str(spans)


def test_section_chunks(spark):
    text = "# 제목\n소개 줄\n## 하나\n- 가\n- 나\n## 둘"
    got = one(spark, text, kb.section_pieces)
    assert got == ["제목 / 소개 줄", "제목 / 하나 / 가 / 나", "제목 / 둘"]


def test_messages(spark):
    parse = lambda raw: one(spark, raw, tx.parse_message)
    assert parse('{"text": "hi"}')["type"] == "stt.final"
    assert parse('{"type": "x"')["text"] == '{"type": "x"'
    assert parse(" plain ")["text"] == "plain"
