"""Plans and operators whose rows must not grow faster than their input."""

from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from sourceline.operators import evidence as ev
from sourceline.operators import generated as gen
from sourceline.operators import index as ix
from sourceline.operators import notes as nt
from sourceline.operators import search as se


def test_words_of_texts_are_not_broadcast(spark, capsys):
    texts = spark.createDataFrame([("d", "a", "steam engine"), ("d", "b", "engines of old")], "deck_id string, id string, text string")
    vocab = spark.createDataFrame([("d", w, 1.0) for w in ("steam", "engine", "engines", "old")], "deck_id string, word string, idf double")
    asked = ev.question_context(spark.createDataFrame([(1, "d", "engine")], "qid int, deck_id string, question string"), vocab)
    matched = ev.match_texts(texts, asked, vocab)
    matched.explain()
    assert "BroadcastHashJoin" not in capsys.readouterr().out
    assert {(r["id"], r["score"], r["n"]) for r in matched.collect()} == {("a", 1.0, 1), ("b", 0.7, 1)}


def _plain_bm25(docs, asked, k):
    words = {i: text.split() for i, text in docs}
    mean = sum(map(len, words.values())) / len(words)
    score = lambda q, d: sum(math.log(1 + (len(words) - n + 0.5) / (n + 0.5)) * d.count(w) * 2.5 / (d.count(w) + 1.5 * (0.25 + 0.75 * len(d) / mean))
                             for w in q.split() for n in [sum(w in x for x in words.values())] if w in d)
    for qid, q in asked:
        scored = sorted((-round(score(q, d), 9), i) for i, d in words.items() if set(q.split()) & set(d))
        yield from ((qid, i, rank, -s) for rank, (s, i) in enumerate(scored[:k], 1))


def test_lexical_search_makes_no_rows_of_pairs(spark, capsys):
    rnd = random.Random(5)
    text = lambda n: " ".join(rnd.choice("abcdefghij") * 3 for _ in range(n))
    docs, asked = [(i, text(rnd.randint(1, 12))) for i in range(60)], [(q, text(3)) for q in range(20)]
    docs += [(100 + i, docs[i][1]) for i in range(10)]
    index = ix.build_index(spark.createDataFrame(docs, "id long, text string"))
    queries = spark.createDataFrame(asked, "qid long, question string")
    want = sorted(_plain_bm25(docs, asked, 4))
    for options in ({}, {"posting_rows": 40, "asked_rows": 15}):
        hits = se.bm25_search(index, queries, 4, **options)
        assert sorted((r["qid"], r["id"], r["rank"], round(r["score"], 6)) for r in hits.collect()) == [(*w[:3], round(w[3], 6)) for w in want]
    hits.explain()
    plan = capsys.readouterr().out
    assert "keys=[id" not in plan.split("CoGroup")[0] and "CoGroup" in plan


def test_a_text_is_one_row_of_a_tile(spark, capsys):
    rnd = random.Random(7)
    text = lambda n: " ".join(rnd.choice("abcdefghij") * 3 for _ in range(n))
    docs = [(i % 3, i // 3, text(rnd.randint(0, 12))) for i in range(90)]
    docs += docs[:9] + [(0, 1, text(20)), (1, None, text(5)), (1, None, text(5)), (None, 7, "aaa"), (2, 800, None)]
    docs = spark.createDataFrame(docs, "deck_id int, id long, text string")
    asked = [(q % 4, q, text(3)) for q in range(20)] + [(1, 1, text(2)), (2, None, "aaa bbb"), (None, 90, "aaa"), (0, 91, "")]
    asked = spark.createDataFrame(asked, "deck_id int, qid long, question string")
    for scope in ([], ["deck_id"]):
        index = ix.build_index(docs, scope=scope)
        rows = lambda hits: sorted(tuple(map(str, r)) for r in hits.select("qid", "id", "rank", F.round("score", 6)).collect())
        want = rows(se.bm25_search(ix.Index(index.postings, index.scope), asked, 4))
        for options in ({}, {"posting_rows": 60, "asked_rows": 15}):
            assert rows(hits := se.bm25_search(index, asked, 4, **options)) == want and len(want) > 40
        hits.explain()
        assert "tf#" not in capsys.readouterr().out
        terms = se.query_terms(asked, scope)
        for few in (0, 9, 1000):
            counted = ix.counts_of_terms(index, terms, few).where(F.col("term") != ix.DOC).orderBy(*scope, "term")
            assert counted.select(*scope, "term", "df").collect() == index.counts().join(
                terms.select(*scope, "term").distinct(), [*scope, "term"], "left_semi").orderBy(*scope, "term").select(*scope, "term", "df").collect()


def _fusion_tables(spark):
    rnd = random.Random(6)
    text = lambda n: " ".join(rnd.choice("abcdefghij") * 3 for _ in range(n))
    docs = [(3 * i, text(rnd.randint(0, 9)), rnd.randint(1, 6)) for i in range(150)]
    docs += [(1000 + i, *docs[i][1:]) for i in range(20)] + docs[:10]     # equal texts, and ids that come twice
    asked = [(q, text(2)) for q in range(8)] + [(8, "zzz"), (9, "jjj aaa"), (9, "jjj aaa")]
    return spark.createDataFrame(docs, "id long, text string, size int"), spark.createDataFrame(asked, "qid long, question string")


def _rows_of(hits):
    return sorted((r["qid"], r["rank"], r["id"], round(r["score"], 9)) for r in hits.collect())


def test_full_fusion_counts_ranks_in_tiles(spark):
    docs, asked = _fusion_tables(spark)
    index = ix.build_index(docs)
    pairs = se.bm25_scores(index, asked)
    sized = pairs.select("qid", "id").join(docs, "id").join(asked, "qid").select(
        "qid", "id", F.round(1.0 / (1 + F.abs(F.length("question") - F.col("size"))), 9).alias("score"))
    by_size = lambda score, size, chars: np.round(1.0 / (1 + np.abs(chars - size)), 9)
    lists = [se.Lexical(index), se.Lexical(index, by_size, F.col("size"), F.length("question"))]
    got = _rows_of(se.fuse_full(*lists, docs, asked, 5))
    assert got == _rows_of(se.fuse_full(pairs, sized, docs, asked, 5)) and {q for q, *_ in got} == set(range(10))
    # every rank of every list, over tiles of a few rows
    ranked = se._all_ranks(se.LexicalLists(index, asked, lists, docs, posting_rows=150, asked_rows=8), docs, asked, 500).collect()
    for n, side in enumerate((pairs, sized)):
        want = se.total_ranks(side, docs.select("id").distinct().crossJoin(asked.select("qid").distinct()), docs, lambda s: F.floor(s * 4))
        assert sorted((r["qid"], r["id"], r["rank"]) for r in ranked if r["list"] == n) == sorted(
            {(r["qid"], r["id"], r["rank"]) for r in want.collect()})


def test_two_lexical_retrievers_make_no_rows_of_pairs(spark, monkeypatch):
    docs, asked = _fusion_tables(spark)
    index = ix.build_index(docs)
    per_size = se.Lexical(by=lambda score, size, _: score / size, doc_value=F.col("size"))
    whole = 1000
    want = _rows_of(se.fuse_retrievers(lambda d, q, k: se._ranked(se.bm25_scores(index, q), k), lambda d, q, k: se._ranked(se.bm25_scores(index, q).join(d, "id").select(
        "qid", "id", (F.col("score") / F.col("size")).alias("score")), k), docs, asked, 3, whole))
    assert _rows_of(se.fuse_retrievers(se.named_retriever("fast"), per_size, docs, asked, 3, whole)) == want
    sizes, first = [], se.LexicalLists.first
    monkeypatch.setattr(se.LexicalLists, "first", lambda self, depth, also=None: (sizes.append(depth), first(self, depth, also))[1])
    assert _rows_of(se.fuse_retrievers(se.named_retriever("fast"), per_size, docs, asked, 3)) == want
    assert sizes == [2 * se.K_RRF + 3 * 3]      # an id that comes twice has three entries


def test_fusion_with_vectors_makes_no_rows_of_pairs(spark, monkeypatch):
    docs, asked = _fusion_tables(spark)
    rng = np.random.default_rng(4)
    vector = lambda n: [[float(x) for x in v] for v in rng.integers(-2, 3, (n, 3))]
    ids, qids = list(range(0, 450, 6)) + [1000, 1001, 2000], list(range(7))
    both = spark.createDataFrame(list(zip(ids, vector(len(ids)), strict=True)), "id long, vector array<double>")
    queries = asked.join(spark.createDataFrame(list(zip(qids, vector(7), strict=True)), "qid long, vector array<double>"), "qid")
    index = ix.build_index(docs)
    want = _rows_of(se.fuse_with_dense(se.bm25_scores(index, asked).join(both.select("id"), "id", "left_semi"), both, queries, 4))
    monkeypatch.setattr(se, "bm25_scores", None)
    assert _rows_of(se.fuse_with_dense(se.LexicalLists(index, asked, only=both, posting_rows=60), both, queries, 4)) == want
    assert se.hybrid_retriever(docs.select("id", "text").distinct().join(both, "id"), queries, 2).count() == 14


def test_index_tasks_are_bounded_by_text(spark, capsys, monkeypatch):
    monkeypatch.setattr(ix, "TASK_CHARS", 100)
    index = ix.build_index(spark.createDataFrame([(i, "word " * 20) for i in range(10)], "id long, text string"))
    index.postings.explain()
    assert ", 10), REPARTITION_BY_NUM" in capsys.readouterr().out
    assert index.postings.where("term = 'word' and tf = 20").count() == 10


def test_dense_search_sorts_only_the_best(monkeypatch):
    rng = np.random.default_rng(2)
    docs, asked, sizes, sort = rng.integers(-2, 3, (500, 4)).astype(float), rng.normal(size=(6, 4)), [], np.argsort
    docs[300:] = docs[:200]
    monkeypatch.setattr(se.np, "argsort", lambda x, *more, **options: (sizes.append(x.shape), sort(x, *more, **options))[1])
    ids = rng.permutation(500)
    got = pd.concat(se._best_of_block(np.arange(6), asked, ids, docs, 7, True))
    for q in range(6):
        want = sorted((-round(float(s), 9), i) for i, s in zip(ids, docs @ asked[q], strict=True) if i != q)[:7]
        mine = got[got["qid"] == q]
        assert list(mine["id"]) == [i for _, i in want] and np.allclose(mine["score"], [-s for s, _ in want])
    assert all(len(s) == 1 for s in sizes)


def test_similar_sets_meet_whole_and_by_slices(spark, capsys):
    rnd = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "omega"]
    texts = sorted({"".join(rnd.choice(words) for _ in range(rnd.randint(1, 4))) for _ in range(60)})
    grams = {t: {t[i:i + 2] for i in range(len(t) - 1)} for t in texts}
    rows = [(d, "".join(sorted(grams[t])), (t,)) for d in "xy" for t in texts[ord(d) % 2::1 + (d == "y")]]
    sets = lambda name: spark.createDataFrame(rows, f"deck_id string, grams string, {name} struct<t:string>")
    want = {(d, a, b) for d, _, (a,) in rows for e, _, (b,) in rows
            if d == e and a < b and len(grams[a] & grams[b]) / min(len(grams[a]), len(grams[b])) >= 0.6}
    for held in (7, 4096):
        found = nt.similar_sets(sets("l"), sets("r"), F.col("l.t") < F.col("r.t"), held=held)
        got = [(r["deck_id"], r["l"]["t"], r["r"]["t"]) for r in found.collect()]
        assert len(got) == len(set(got)) and set(got) == want and len(want) > 50
    notes = spark.createDataFrame([("x", str(i), t, i) for i, t in enumerate(texts)], "deck_id string, id string, text string, ord long")
    nt.first_similar(notes, notes).explain()
    assert "explode(grams" not in capsys.readouterr().out


def test_forest_of_links_connects_what_links_connect():
    pairs = [(i, j) for i in range(12) for j in range(i + 1, 12) if i % 3 == j % 3]
    batch = pa.RecordBatch.from_pydict({"a": [a for a, _ in pairs], "b": [b for _, b in pairs]}, pa.schema([("a", pa.int64()), ("b", pa.int64())]))
    kept = [(r["a"], r["b"]) for out in nt._forest(iter([batch.slice(0, 5), batch.slice(5)])) for r in out.to_pylist()]
    assert len(kept) == 9 and set(kept) <= set(pairs) and all(any(n in x for x in kept) for n in range(12))


def test_flow_makes_its_sources_ready_once(spark):
    slides = [(1, "steam engine ran 1,200 km"), (2, "boat of iron"), (3, None)]
    lines = "1 | engine of 1200 | went 9999 km | steam | so | x\n7 | iron boat | - | - | so | -\n2 | boat 4711 | - | - | so | -"
    df = spark.createDataFrame([("q", "fact", slides, lines)], "question string, qtype string, slides array<struct<slide:int,text:string>>, response string")
    flow = gen.flow_steps(df)
    row = flow.first()
    assert [(s["text"], s["slide"]) for s in row["steps"]] == [("engine of 1200", 1), ("iron boat", 2)] and row["status"] == "blocked"
    plan = flow._jdf.queryExecution().analyzed().toString()
    assert "array_intersect" not in plan and plan.count("concat(regexp_replace(lower(") <= 3


def test_a_page_meets_its_questions_at_once(spark):
    rnd = random.Random(9)
    word = lambda: rnd.choice(["steam", "team", "engine", "engines", "gin", "oil", "oils", "1890", "189", "x", "rust", "rusty"])
    text = lambda n: " ".join(word() for _ in range(n))
    chunks = [("d", p, p, "\n".join(text(rnd.randint(3, 9)) for _ in range(p))) for p in range(5)]
    asked = [(q, "d", text(rnd.randint(1, 5))) for q in range(600)]
    vocab = spark.createDataFrame([("d", w, 1.0 + i / 7) for i, w in enumerate(("steam", "team", "engine", "engines", "gin", "oils", "1890", "x", "rust"))], "deck_id string, word string, idf double")
    idf = {r["word"]: r["idf"] for r in vocab.collect()}
    pages = ev.page_context(spark.createDataFrame(chunks, "deck_id string, id int, page int, text string"), vocab).drop("deck_id")
    context = ev.question_context(spark.createDataFrame(asked, "qid int, deck_id string, question string"), vocab)
    hits = spark.createDataFrame([(q, q % 2 * 4 if q < 590 else q % 5, 1) for q, *_ in asked], "qid int, id int, rank int")
    rows = ev.question_pages(hits, context, pages)
    assert rows.count() < 20
    lines = {r["id"]: [(x["line"], set(x["keys"])) for x in r["lines"]] for r in pages.collect()}
    want = {}
    for r in hits.join(context, "qid").collect():
        for i, (_, keys) in enumerate(lines[r["id"]]):
            gains = []
            for w, x in ((a["word"], a["idf"]) for a in r["asked"]):
                near = [idf[k] for k in keys & set(idf) if len(k) > 1 and not k[0].isdigit() and (k in w or w in k)]
                if w in keys and w in idf:
                    gains.append(x or 0.0)
                elif len(w) > 1 and near:
                    gains.append(0.7 * max(near))
            if gains:
                want[r["qid"], r["id"], i] = (round(sum(gains), 9), len(gains))
    got = {(r["qid"], r["id"], o["idx"]): (round(o["score"], 9), o["n"]) for r in ev.line_overlaps(rows).collect() for o in r["overlaps"]}
    assert len(want) > 500 and got == want
    scored = {(r["qid"], r["id"]): r["scored"] for r in ev.score_lines(rows).collect()}
    best = {(r["qid"], r["id"]): r["best"] for r in ev.best_lines(rows).collect()}
    assert len(best) == 600
    for at, one in best.items():
        first = max(scored[at], key=lambda s: (s["score"], -s["idx"]), default=None)
        assert (one is None and not lines[at[1]]) or (one["score"], one["n"], one["idx"], one["line"]) == (first["score"], first["n"], first["idx"], lines[at[1]][one["idx"]][0])
