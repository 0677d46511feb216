"""Check and take apart text that a model has already produced.

Every operator takes a ``response`` column; calling the model is not part of this library.
A response is one row and is taken apart inside the row; only its lines become rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import (NUMBER, all_supported_by_name, known_source, new_numbers, numbers_supported,
                                 numbers_supported_by_name, supported_by)
from ..functions.profiles import LATIN, Profile
from ..functions.text import (BLANK, bigrams, drop_page_refs, find_all, first_readable_line, let, name_page_zero, strip)
from ..plans.ranking import first_per_group, number_ordered, number_rows, top_n
from .guards import HIGHLIGHT_MAX, NUMBER_AND_UNIT

# ---- fixed values -------------------------------------------------------------------
QUESTION_LINE = r"^[^0-9]{0,3}([0-9]+)\s*(?:\t|\||:|\.|\)|\s{2,})\s*(.+)$"
LOOSE_QUESTION_LINE = r"^[^0-9]{0,6}([0-9]+)\s*(?:\t|\||:|\.|\)|\s{2,})\s*(.+)$"
NUMBERED_LINE = r"^[^0-9]{0,6}([0-9]+)\s*(?:\t|\||:|\.|\))\s*(.+)$"
STEP_LINE = r"^[^0-9]{0,6}?([0-9]+)\s*[|\t:]\s*(.+)$"
WARNING_LINE = r"^[^0-9]{0,6}?([0-9]+)\s*(?:번)?\s*(?:슬라이드)?\s*[|\t:]\s*(.+)$"
FLOW_LINE = r"^[^0-9]{0,8}?([0-9]+)\s*(?:\t|\||:|\)|번|\.)\s*(.+)$"
TRAILING_REF = r"\s*[\[(]\s*(?:p\.?\s*)?[0-9]+\s*[\])]\s*$"
MIN_QUESTION, STEP_CHARS, MAX_STEPS = 8, 30, 3
FLOW_STEPS, FLOW_TEXT, DETAIL_CHARS, WHY_CHARS, GUIDE_CHARS = 3, 30, 80, 24, 100
NODE_TITLE, EDGE_WHY, STORY_CHARS, MAX_EDGES = 24, 30, 60, 20
NAME_CHARS, TOPIC_CHARS = 24, 20
NOTE_KINDS = ("repeat", "explain", "fact", "filler", "known")
BATCH_PAGES, BATCH_CHUNKS, ITEM_FACTS = 8, 80, 4
CHUNK_MARK, RELATION_MARK = "조각", "관계"
SECTION_PAGES, SECTION_LINKS, SECTION_STORY = "슬라이드", "연결", "줄거리"
# -------------------------------------------------------------------------------------


def response_lines(responses: DataFrame, keep: Sequence[str] = ("deck_id",), response: str = "response") -> DataFrame:
    """``keep..., pos, line``: stripped non-blank lines."""
    return responses.select(*keep, F.posexplode(F.split(response, "\n")).alias("pos", "_raw")).withColumn(
        "line", strip(F.col("_raw"))).drop("_raw").where(F.col("line") != "")


def target_pages(chunks: DataFrame, min_chars: int) -> DataFrame:
    """Pages long enough to ask about."""
    return chunks.where(F.col("n_chars") >= min_chars)


def _numbered(lines: DataFrame, pattern: str, number: str = "page", text: str = "text") -> DataFrame:
    return (lines.where(F.col("line").rlike(pattern))
            .withColumn(number, F.regexp_extract("line", pattern, 1).try_cast("int"))
            .withColumn(text, strip(F.regexp_extract("line", pattern, 2))))


def parse_questions(responses: DataFrame, targets: DataFrame, loose: bool = False) -> DataFrame:
    """``deck_id, pos, page, question``: "page, separator, question" lines for known pages."""
    rows = _numbered(response_lines(responses), LOOSE_QUESTION_LINE if loose else QUESTION_LINE, text="question")
    return rows.where(F.length("question") >= MIN_QUESTION).join(
        targets.select("deck_id", "page").distinct(), ["deck_id", "page"], "left_semi").select(
        "deck_id", "pos", "page", "question")


def _bare(text: Column) -> Column:
    return F.regexp_replace(text, r"""^["' ]+|["' ]+$""", "")


def attach_answers(questions: DataFrame, responses: DataFrame, pages: DataFrame, profile: Profile = LATIN) -> DataFrame:
    """Adds ``answer`` and ``dropped`` to numbered questions (``deck_id, number, page``): the last
    line of that number; "none" is no answer; one with unsupported numbers is dropped."""
    rows = _numbered(response_lines(responses), NUMBERED_LINE, number="number")
    last = rows.groupBy("deck_id", "number").agg(F.max_by("text", "pos").alias("_raw"))
    joined = (questions.join(last, ["deck_id", "number"], "left")
              .join(pages.select("deck_id", "page", F.col("text").alias("_page")), ["deck_id", "page"], "left"))
    said = _bare(F.coalesce("_raw", F.lit("")))
    said = F.when(said == profile.none_word, "").otherwise(said)
    fine = numbers_supported(said, F.coalesce("_page", F.lit("")))
    return joined.withColumn("answer", F.when(fine, said).otherwise("")).withColumn(
        "dropped", (said != "") & ~fine).drop("_raw", "_page")


def _fill_header(lines: Column, header: str) -> Column:
    """``array<struct<section, pos, line>>``: every line with the last header above it; header
    lines themselves go."""
    start = F.struct(F.lit("").alias("section"), F.lit(0).alias("pos"),
                     F.array().cast("array<struct<section:string,pos:int,line:string>>").alias("out"))

    def step(acc: Column, line: Column) -> Column:
        head = F.regexp_extract(line, header, 1)
        is_head = line.rlike(header)
        return F.struct(
            F.when(is_head, head).otherwise(acc["section"]).alias("section"), (acc["pos"] + 1).alias("pos"),
            F.when(is_head, acc["out"]).otherwise(F.concat(acc["out"], F.array(F.struct(
                acc["section"].alias("section"), acc["pos"].alias("pos"), line.alias("line"))))).alias("out"))

    return F.aggregate(lines, start, step)["out"]


def sectioned_lines(responses: DataFrame, header: str, keep: Sequence[str] = ("deck_id",)) -> DataFrame:
    tidy = F.transform(F.split("response", "\n"), lambda line: F.regexp_replace(strip(line), r"^\*+|\*+$", ""))
    return responses.select(*keep, F.explode(_fill_header(tidy, header)).alias("_l")).select(*keep, "_l.*")


def core_suggestions(responses: DataFrame, pages: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """``deck_id, kind, status, place, slide, text``: up to three supported steps per kind; a kind
    without any has one row with status ``no_answer``."""
    rows = sectioned_lines(responses, r"^#+\s*([a-z]+)").where(F.col("section").isin(*kinds))
    steps = (_numbered(rows, STEP_LINE, number="slide")
             .withColumn("text", strip(F.regexp_replace(_bare(F.col("text")), TRAILING_REF, "")))
             .join(pages.select("deck_id", F.col("page").alias("slide"), F.col("text").alias("_page")), ["deck_id", "slide"])
             .where(numbers_supported(F.col("text"), F.col("_page"))))
    first = top_n(steps, ["deck_id", "section"], ["pos"], MAX_STEPS, "place").select(
        "deck_id", F.col("section").alias("kind"), "place", "slide", F.substring("text", 1, STEP_CHARS).alias("text"))
    wanted = responses.select("deck_id", F.explode(F.array(*[F.lit(k) for k in kinds])).alias("kind")).distinct()
    return wanted.join(first, ["deck_id", "kind"], "left").withColumn(
        "status", F.when(F.col("place").isNull(), "no_answer").otherwise("ok"))


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+|\n+"), strip), lambda s: s != "")


def steps_from_answer(response: Column, answer: Column) -> Column:
    """Up to three steps: response lines without bullets whose numbers the answer has, or else
    the answer's own sentences."""
    lines = F.transform(F.split(F.coalesce(response, F.lit("")), "\n"),
                        lambda line: strip(F.regexp_replace(line, r"^\s*(?:[0-9]+[.)]|[-•*])\s*", "")))
    good = F.filter(lines, lambda line: (line != "") & numbers_supported(line, answer))
    picked = let(good, lambda g: F.when(F.size(g) > 0, g).otherwise(sentences(answer)))
    return F.when(strip(answer) == "", F.array().cast("array<string>")).otherwise(
        F.transform(F.slice(picked, 1, MAX_STEPS), lambda s: F.substring(s, 1, STEP_CHARS)))


def answer_warnings(answers: DataFrame, pages: DataFrame, runs: DataFrame) -> DataFrame:
    """``qid, slide, kind, message``: numbers of two characters or more that the deck does not
    have (no slide), and the contradictions a model reported for known slides.

    ``answers(qid, deck_id, answer, response)``; ``runs`` are the deck's :func:`number_runs`.
    """
    said = answers.select("qid", "deck_id", F.explode(F.array_distinct(F.filter(
        find_all(F.coalesce("answer", F.lit("")), NUMBER), lambda n: F.length(n) >= 2))).alias("message"))
    keyed = said.withColumn("number", F.replace("message", F.lit(","), F.lit("")))
    unknown = without_backing(keyed, runs).select(
        "qid", F.lit(None).cast("int").alias("slide"), F.lit("number").alias("kind"), "message")
    reported = _numbered(response_lines(answers, ("qid", "deck_id")), WARNING_LINE, number="slide", text="message").join(
        pages.select("deck_id", F.col("page").alias("slide")), ["deck_id", "slide"], "left_semi").select(
        "qid", "slide", F.lit("contradiction").alias("kind"), "message")
    return unknown.unionByName(reported)


def number_runs(texts: DataFrame) -> DataFrame:
    """``deck_id, run``: distinct digit stretches of a deck once blanks and commas are gone."""
    stretch = find_all(F.regexp_replace("text", r"[\s\p{Z}]|,", ""), r"[0-9][0-9.]*")
    return texts.select("deck_id", F.explode(F.array_distinct(stretch)).alias("run")).distinct()


def without_backing(said: DataFrame, runs: DataFrame) -> DataFrame:
    """Rows of ``said`` whose ``number`` is part of no digit stretch of its deck.

    A stretch is listed under each of its one-, two- and three-character pieces, a number
    under its first three characters; only stretches filed under the number's piece are
    searched for it.
    """
    size = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length("run") - n + 1, F.lit(1))),
                                 lambda i: F.substring(F.col("run"), i, F.lit(n)))
    filed = runs.select("deck_id", "run", F.explode(F.array_distinct(F.concat(size(1), size(2), size(3)))).alias("piece"))
    asked = said.select("deck_id", "number", F.substring("number", 1, 3).alias("piece")).distinct()
    backed = asked.join(filed, ["deck_id", "piece"]).where(F.contains("run", "number")).select(
        "deck_id", "number").distinct()
    return said.join(backed, ["deck_id", "number"], "left_anti")


def cut_at_unsupported(answers: DataFrame, profile: Profile = LATIN) -> DataFrame:
    """Adds ``shown`` and ``status`` to ``response, source, question``: sentences before the first
    one with unsupported numbers; ok, blocked, or no_answer ("none" or nothing at all)."""
    clean = lambda s: strip(F.regexp_replace(s, r"\*\*|__|`", ""))
    said = F.filter(F.transform(F.split("response", r"(?<=[.!?])\s+"), clean), lambda s: s != "")

    bad = F.array_position(all_supported_by_name(F.col("_said"), F.col("source"), F.col("question")), F.lit(False))
    is_none = F.regexp_replace(F.coalesce(F.get("_said", F.lit(0)), F.lit("")), r"""^["' .]+|["' .]+$""", "") == profile.none_word
    nothing = (F.size("_said") == 0) | ((F.size("_said") == 1) & is_none)
    return (answers.withColumn("_said", said).withColumn("_bad", bad.cast("int"))
            .withColumn("shown", F.when(nothing, "").when(F.col("_bad") > 0, F.array_join(F.slice("_said", 1, F.col("_bad") - 1), " "))
                        .otherwise(F.array_join("_said", " ")))
            .withColumn("status", F.when(nothing, "no_answer").when(F.col("_bad") > 0, "blocked").otherwise("ok"))
            .drop("_said", "_bad"))


def refined_blocks(responses: DataFrame, pages: DataFrame) -> DataFrame:
    """``deck_id, page, text`` from ``=== page`` blocks whose numbers are all on the raw page; the
    last block of a page counts."""
    rows = responses.select("deck_id", F.explode(_fill_header(F.split("response", "\n"), r"^===\s*([0-9]+)\s*$")).alias("_l")).select(
        "deck_id", "_l.*").where(F.col("section") != "")
    blocks = rows.groupBy("deck_id", F.col("section").cast("int").alias("page")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("_b"))
    body = strip(F.array_join(F.col("_b.line"), "\n"))
    raw = pages.select("deck_id", "page", F.col("text").alias("_page"))
    return (blocks.select("deck_id", "page", body.alias("text")).join(raw, ["deck_id", "page"])
            .where((F.col("text") != "") & numbers_supported(F.col("text"), F.col("_page"))).drop("_page"))


def _fields(line: Column) -> Column:
    return F.transform(F.split(line, r"\|"), lambda x: F.regexp_replace(strip(x), r"""^["']+|["']+$""", ""))


def _number_in(text: Column) -> Column:
    return F.try_to_number(F.regexp_extract(text, "([0-9]{1,9})", 1), F.lit("999999999")).cast("int")


def page_graph_lines(responses: DataFrame) -> DataFrame:
    return sectioned_lines(responses, r"^#+\s*(\S+)").withColumn("f", _fields(F.col("line"))).drop("line")


def page_graph(responses: DataFrame, pages: DataFrame, runs: DataFrame, roles: Sequence[str],
               relations: Sequence[str], default_role: str, default_relation: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and story of a page graph written as three sections of ``|`` lines.

    ``runs`` are the :func:`number_runs` of the deck and its notes. Unknown pages, self links and story lines with unsupported numbers go; such a reason is emptied; unknown
    roles and relations become the defaults; pages without a node get a readable first line.
    """
    rows = page_graph_lines(responses)
    f = lambda i: F.coalesce(F.get("f", F.lit(i)), F.lit(""))
    known = pages.select("deck_id", "page").distinct()
    n_fields = F.size("f")

    named = (rows.where(F.col("section").startswith(SECTION_PAGES) & (n_fields >= 3))
             .select("deck_id", "pos", _number_in(f(0)).alias("page"), f(1).alias("role"), f(2).alias("title"))
             .join(known, ["deck_id", "page"], "left_semi"))
    first = first_per_group(named, ["deck_id", "page"], ["pos"]).select(
        "deck_id", "page", F.when(F.col("role").isin(*roles), F.col("role")).otherwise(default_role).alias("role"),
        F.substring("title", 1, NODE_TITLE).alias("title"))
    unnamed = pages.join(first, ["deck_id", "page"], "left_anti").select(
        "deck_id", "page", F.lit(default_role).alias("role"),
        first_readable_line(F.col("text"), max_chars=NODE_TITLE).alias("title"))

    links = (rows.where(F.col("section").startswith(SECTION_LINKS) & (n_fields >= 3))
             .select("deck_id", "pos", _number_in(f(0)).alias("src"), _number_in(f(1)).alias("dst"),
                     F.when(f(2).isin(*relations), f(2)).otherwise(default_relation).alias("relation"),
                     F.substring(f(3), 1, EDGE_WHY).alias("why")).where(F.col("src") != F.col("dst")))
    for end in ("src", "dst"):
        links = links.join(known.withColumnRenamed("page", end), ["deck_id", end], "left_semi")
    bad = _unbacked(links.select("deck_id", "pos", F.col("why").alias("_t")), runs)
    links = links.join(bad.withColumn("_bad", F.lit(True)), ["deck_id", "pos"], "left").withColumn(
        "why", F.when(F.coalesce("_bad", F.lit(False)), "").otherwise(F.col("why")))
    edges = top_n(links.drop("_bad"), ["deck_id"], ["pos"], MAX_EDGES, "ord").drop("pos")

    told = rows.where(F.col("section").startswith(SECTION_STORY) & (f(0) != "")).select(
        "deck_id", "pos", F.regexp_replace(f(0), r"^[0-9]+[.)]\s*", "").alias("text"), find_all(f(1), "[0-9]{1,9}").alias("_p"))
    told = told.join(_unbacked(told.select("deck_id", "pos", F.col("text").alias("_t")), runs), ["deck_id", "pos"], "left_anti")
    valid = (told.select("deck_id", "pos", F.posexplode(F.transform("_p", lambda p: p.cast("int"))).alias("_i", "page"))
             .join(known, ["deck_id", "page"], "left_semi").groupBy("deck_id", "pos")
             .agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "page"))), lambda s: s["page"]).alias("pages")))
    story = told.join(valid, ["deck_id", "pos"], "left").select(
        "deck_id", F.col("pos").alias("ord"), F.substring("text", 1, STORY_CHARS).alias("text"),
        F.coalesce("pages", F.array().cast("array<int>")).alias("pages"))
    return first.unionByName(unnamed), edges, story


def _unbacked(texts: DataFrame, runs: DataFrame) -> DataFrame:
    """``deck_id, pos`` of texts (``_t``) with a number the deck does not have."""
    said = texts.select("deck_id", "pos", F.explode(find_all(F.coalesce("_t", F.lit("")), NUMBER)).alias("n")).select(
        "deck_id", "pos", F.replace("n", F.lit(","), F.lit("")).alias("number"))
    return without_backing(said, runs).select("deck_id", "pos").distinct()


def knowledge_graph(responses: DataFrame, chunks: DataFrame, relations: Sequence[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges (``ord`` in text order) and topics (in order of first use) of a knowledge graph.

    ``responses(deck_id, batch, response)`` refer to the chunks of a batch by number,
    ``chunks(deck_id, batch, number, id)``.
    """
    rows = response_lines(responses, ("deck_id", "batch")).withColumn(
        "f", F.transform(F.split(F.regexp_replace("line", r"^\|+|\|+$", ""), r"\|"), strip)).where(F.size("f") >= 4)
    f = lambda i: F.coalesce(F.get("f", F.lit(i)), F.lit(""))
    ids = chunks.select("deck_id", "batch", "number", "id")
    order = F.struct("batch", "pos").alias("ord")
    named = (rows.where(f(0) == CHUNK_MARK).select("deck_id", "batch", order, _number_in(f(1)).alias("number"),
                                                    F.substring(f(2), 1, NAME_CHARS).alias("name"),
                                                    F.substring(f(3), 1, TOPIC_CHARS).alias("topic"))
             .join(ids, ["deck_id", "batch", "number"]))
    nodes = named.groupBy("deck_id", "id").agg(F.max_by(F.struct("name", "topic"), "ord").alias("_n")).select(
        "deck_id", "id", "_n.name", "_n.topic")
    topics = named.where(F.col("topic") != "").groupBy("deck_id", "topic").agg(F.min("ord").alias("ord"))
    edges = rows.where((f(0) == RELATION_MARK) & f(3).isin(*relations)).select(
        "deck_id", "batch", order, _number_in(f(1)).alias("_a"), _number_in(f(2)).alias("_b"),
        f(3).alias("relation"), F.substring(f(4), 1, EDGE_WHY).alias("why")).where(F.col("_a") != F.col("_b"))
    for end, number in (("src", "_a"), ("dst", "_b")):
        edges = edges.join(ids.select("deck_id", "batch", F.col("number").alias(number), F.col("id").alias(end)),
                           ["deck_id", "batch", number])
    return nodes, edges.select("deck_id", "src", "dst", "relation", "why", "ord"), topics


def topic_order(topics: DataFrame) -> DataFrame:
    """``deck_id, topic, place``: topics in the order in which chunks first name them."""
    return number_ordered(topics, ["deck_id"], ["ord", "topic"], "place").select("deck_id", "topic", "place")


def _unquote(text: Column) -> Column:
    """Outer quotes off when they wrap the whole field; quotes inside stay."""
    t = strip(text)
    return F.when(t.rlike('^"[^"]*"$') | t.rlike("^'[^']*'$"), strip(F.regexp_replace(t, r"""^["']|["']$""", ""))).otherwise(t)


def parse_note_lines(responses: DataFrame) -> DataFrame:
    """``deck_id, pos, said_page, kind, text`` of "page | kind | sentence" lines."""
    rows = response_lines(responses).withColumn("f", F.transform(F.split("line", r"\|"), _unquote)).where(
        (F.size("f") >= 3) & (F.get("f", F.lit(2)) != ""))
    kind = F.get("f", F.lit(1))
    return rows.select("deck_id", "pos", F.coalesce(_number_in(F.get("f", F.lit(0))), F.lit(0)).alias("said_page"),
                       F.when(kind.isin(*NOTE_KINDS), kind).otherwise("explain").alias("kind"),
                       F.get("f", F.lit(2)).alias("text"))


def upgrade_new_facts(kind: Column, text: Column, deck_text: Column) -> Column:
    """An explanation or repetition with a number the deck lacks is a new fact."""
    return F.when(kind.isin("explain", "repeat") & (F.size(new_numbers(text, deck_text)) > 0), "fact").otherwise(kind)


def classify_notes(parsed: DataFrame, pages: DataFrame, runs: DataFrame, default_page: int | None = None) -> DataFrame:
    """Adds ``page`` (a known one, else the default, else null), ``new_numbers`` and the final
    ``kind``; ``known`` stays visible as ``said_known``. ``runs`` are the deck's
    :func:`number_runs`."""
    known = pages.select("deck_id", F.col("page").alias("said_page"), F.lit(True).alias("_ok")).distinct()
    found = new_numbers(F.col("text"), F.lit(""))
    said = parsed.select("deck_id", "pos", F.explode(F.array_distinct(found)).alias("number"))
    fresh = without_backing(said, runs).groupBy("deck_id", "pos").agg(
        F.array_sort(F.collect_list("number")).alias("new_numbers"))
    joined = parsed.join(known, ["deck_id", "said_page"], "left").join(fresh, ["deck_id", "pos"], "left").withColumn(
        "new_numbers", F.coalesce("new_numbers", F.array().cast("array<string>")))
    kind = F.when(F.col("kind").isin("explain", "repeat") & (F.size("new_numbers") > 0), "fact").otherwise(F.col("kind"))
    return (joined.withColumn("page", F.when(F.col("_ok"), F.col("said_page")).otherwise(F.lit(default_page).cast("int")))
            .withColumn("said_known", F.col("kind") == "known")
            .withColumn("kind", F.when(F.col("kind") == "known", "explain").otherwise(kind)).drop("_ok", "said_page"))


def approve_cards(requests: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """Cards ready to store, from ``deck_id, core_id, steps(text, slide)[], edited, source, at``:
    unknown kinds and cards without text are rejected."""
    tidy = F.slice(F.filter(F.transform("steps", lambda s: F.struct(
        F.substring(strip(F.coalesce(s["text"], F.lit(""))), 1, STEP_CHARS).alias("text"), s["slide"].alias("slide"))),
        lambda s: s["text"] != ""), 1, MAX_STEPS)
    source = F.when(F.coalesce("source", F.lit("")) != "", F.col("source")).otherwise(
        F.when(F.col("edited"), "edited").otherwise("suggested"))
    return (requests.where(F.col("core_id").isin(*kinds)).withColumn("steps", tidy).where(F.size("steps") > 0)
            .withColumn("source", source))


def flow_lines(response: Column, none_word: str = LATIN.none_word) -> Column:
    clean = F.transform(F.split(response, "\n"), lambda s: strip(F.regexp_replace(s, r"\*\*|__|`", "")))
    return F.filter(clean, lambda s: s != "")


def _has_words(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^\p{L}]", "")) >= 2


def flow_steps(answers: DataFrame, profile: Profile = LATIN) -> DataFrame:
    """Adds ``steps``, ``guide`` and ``status`` to ``response, question, qtype, slides``, where
    ``slides`` is the short array ``struct<slide, text>`` the model was given.

    Lines are "slide | title | detail | key phrases | link | reason". A step on a slide that was
    not given goes to the slide it shares most character pairs with. A title with unsupported
    numbers ends the flow; such a detail, reason or guide is just left out. Link words come
    from a fixed list or from the type's defaults; the last step has neither link nor reason.
    """
    slides, question = F.col("slides"), F.col("question")
    all_text = F.array_join(F.transform(slides, lambda s: s["text"]), "\n")
    step_type = ("struct<text:string,detail:string,slide:int,keys:array<string>,link:string,why:string>")
    start = F.struct(
        F.array().cast(f"array<{step_type}>").alias("steps"), F.lit("").alias("guide"), F.lit("").alias("status"))
    defaults = F.lit(None).cast("array<string>")
    for kind, links in {**profile.default_links}.items():
        defaults = F.when(F.col("qtype") == kind, F.array(*[F.lit(x) for x in links])).otherwise(defaults)
    defaults = F.coalesce(defaults, F.array(*[F.lit(x) for x in profile.default_links[profile.qtype_default]]))

    def field(parts: Column, i: int) -> Column:
        return F.coalesce(F.get(parts, F.lit(i)), F.lit(""))

    def slide_of(given: Column, number: Column) -> Column:
        return F.get(F.filter(given, lambda s: s["slide"] == number), F.lit(0))

    def closest(text: Column) -> Column:
        return let(bigrams(text), lambda mine: F.aggregate(
            # a pair is one of the slide's if it stands in its text without blanks
            F.transform(slides, lambda s: let(F.regexp_replace(s["text"], f"{BLANK}+", ""), lambda tight: F.struct(F.when(
                tight.isNotNull(), F.size(F.filter(mine, lambda pair: F.contains(tight, pair)))).alias("n"), s["slide"].alias("slide")))),
            F.struct(F.lit(-1).alias("n"), F.lit(None).cast("int").alias("slide")),
            lambda acc, s: F.when(s["n"] > acc["n"], s).otherwise(acc))["slide"])

    def take(acc: Column, line: Column, whole: Column, given: Column) -> Column:
        number = F.regexp_extract(line, FLOW_LINE, 1).cast("int")
        parts = _fields(F.regexp_extract(line, FLOW_LINE, 2))

        def build(p: Column) -> Column:
            return let(strip(F.regexp_replace(field(p, 0), r"^(?:슬라이드|<?TAB?>?|\||\s)+", "")), lambda text: placed(p, text))

        def placed(p: Column, text: Column) -> Column:
            movable = (F.size(slides) > 0) & supported_by(F.concat_ws(" ", text, field(p, 1)), whole)
            slide = F.when(slide_of(given, number)["text"].isNotNull(), number).when(movable, closest(F.concat(text, field(p, 1))))

            def finish(page: Column) -> Column:
                own = slide_of(given, page)
                detail = F.when((field(p, 1) == "-") | ~supported_by(drop_page_refs(field(p, 1)), own), "").otherwise(
                    F.substring(name_page_zero(field(p, 1)), 1, DETAIL_CHARS))
                title = F.substring(text, 1, FLOW_TEXT)
                keys = F.filter(F.transform(F.split(field(p, 2), "[,/、]"), lambda k: F.regexp_replace(strip(k), r"""^["']+|["']+$""", "")),
                                lambda k: (F.length(k) >= 2) & ~k.rlike(NUMBER_AND_UNIT) & (F.contains(title, k) | F.contains(detail, k)))
                place = F.size(acc["steps"])
                link = F.when(field(p, 3).isin(*profile.links), field(p, 3)).otherwise(F.coalesce(F.get(defaults, place), F.lit("")))
                why = F.when((field(p, 4) == "-") | ~supported_by(drop_page_refs(field(p, 4)), whole), "").otherwise(
                    F.substring(field(p, 4), 1, WHY_CHARS))
                added = F.concat(acc["steps"], F.array(F.struct(
                    title.alias("text"), detail.alias("detail"), page.alias("slide"),
                    F.slice(F.array_distinct(keys), 1, HIGHLIGHT_MAX).alias("keys"), link.alias("link"), why.alias("why")).cast(step_type)))
                skip = page.isNull() | ~_has_words(text)
                return (F.when(skip, acc).when(~supported_by(text, own), _state(acc, status="blocked"))
                        .when(place < FLOW_STEPS, _state(acc, steps=added)).otherwise(acc))

            return let(slide, finish)

        guide_line = r"^\W*(?:가이드|guide)\s*[|:]\s*(.+)$"
        guide = F.regexp_replace(strip(F.regexp_extract(line, guide_line, 1)), r"""^["']+|["']+$""", "")
        good_guide = supported_by(drop_page_refs(guide), whole)
        none = (F.regexp_replace(line, r"""^["' .]+|["' .]+$""", "") == profile.none_word) & (F.size(acc["steps"]) == 0)
        return (F.when(acc["status"] != "", acc).when(none, _state(acc, status="no_answer"))
                .when(line.rlike(guide_line), F.when(good_guide, _state(acc, guide=F.substring(name_page_zero(guide), 1, GUIDE_CHARS))).otherwise(acc))
                .when(line.rlike(FLOW_LINE), let(parts, build)).otherwise(acc))

    def _state(acc: Column, **changed) -> Column:
        value = lambda name: F.lit(changed[name]) if isinstance(changed.get(name), str) else changed.get(name, acc[name])
        return F.struct(value("steps").alias("steps"), value("guide").alias("guide"), value("status").alias("status"))

    # what numbers are looked up in is made ready once, not for every line
    ready = F.transform(slides, lambda s: F.struct(s["slide"].alias("slide"), s["text"].alias("text"), *[
        known_source(s["text"], question)[c].alias(c) for c in ("tight", "names")]))
    folded = let(known_source(all_text, question), lambda whole: let(ready, lambda given: F.aggregate(
        flow_lines(F.col("response")), start, lambda acc, line: take(acc, line, whole, given))))
    last = lambda steps: F.transform(steps, lambda s, i: F.when(i == F.size(steps) - 1, s.withField("link", F.lit("")).withField(
        "why", F.lit(""))).otherwise(s))
    return (answers.withColumn("_flow", folded).withColumn("steps", let(F.col("_flow.steps"), last))
            .withColumn("guide", F.col("_flow.guide"))
            .withColumn("status", F.when(F.col("_flow.status") != "", F.col("_flow.status")).when(
                F.size("steps") > 0, "ok").otherwise("no_answer")).drop("_flow"))


def prompt_blocks(pages: DataFrame, per_batch: int = BATCH_PAGES) -> DataFrame:
    """``deck_id, batch, block``: pages of a deck in order, eight per batch, as numbered blocks."""
    placed = number_rows(pages, ["deck_id"], "page", "_n")
    block = F.concat(F.lit("=== "), F.col("page").cast("string"), F.lit("\n"), F.col("text"))
    return (placed.withColumn("batch", F.floor((F.col("_n") - 1) / per_batch).cast("int"))
            .groupBy("deck_id", "batch").agg(F.array_sort(F.collect_list(F.struct("page", block.alias("b")))).alias("_b"))
            .select("deck_id", "batch", F.array_join(F.col("_b.b"), "\n\n").alias("block")))


def item_lines(made: DataFrame) -> DataFrame:
    """``deck_id, number, item``: "[n] question / facts" lines of questions with facts."""
    facts = F.array_join(F.slice("facts", 1, ITEM_FACTS), ", ")
    return made.where(F.size("facts") > 0).select("deck_id", "number", F.concat(
        F.lit("["), F.col("number").cast("string"), F.lit("] "), F.col("question"), F.lit(" / "), facts).alias("item"))


def knowledge_batches(chunks: DataFrame, per_batch: int = BATCH_CHUNKS) -> DataFrame:
    """Adds ``batch`` and ``number`` (1..80) to a deck's knowledge chunks in order."""
    placed = number_ordered(chunks, ["deck_id"], ["ord"], "_n")
    return placed.withColumn("batch", F.floor((F.col("_n") - 1) / per_batch).cast("int")).withColumn(
        "number", ((F.col("_n") - 1) % per_batch + 1).cast("int")).drop("_n")
