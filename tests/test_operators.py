"""Small tables against brute force, and invariants."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from sourceline.operators import graph as gr
from sourceline.operators import index as ix
from sourceline.operators import knowledge as kb
from sourceline.operators import notes as nt
from sourceline.operators import search as se
from sourceline.plans import ranking as rk
from sourceline.sources import tables as t
from sourceline.streaming import sinks


def test_number_rows_equals_row_number(spark):
    rows = [(random.Random(i).choice("aab"), i * 7 % 1009) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, o int")
    got = {(r["g"], r["o"]): r["n"] for r in rk.number_rows(df, ["g"], "o", "n", width=50).collect()}
    for g in "ab":
        order = sorted(o for h, o in rows if h == g)
        assert [got[g, o] for o in order] == list(range(1, len(order) + 1))


@pytest.mark.parametrize("values", [[5.0], [1.0, 2.0], [3.0, 3.0, 3.0, 9.5], [float(i % 17) + i / 7 for i in range(101)]])
def test_exact_index(spark, values):
    row = rk.exact_index(spark.createDataFrame([(v,) for v in values], "v double"), [], "v",
                         {"p50": rk.median_high, "p95": rk.at_share(0.95)}, width=2.0).first()
    order, n = sorted(values), len(values)
    assert (row["p50"], row["p95"]) == (order[n // 2], order[min(n - 1, int(n * 0.95))])


def test_degree_cap_equals_sequential_rule(spark):
    rnd = random.Random(3)
    rows = [(a, b, i) for i in range(400) for a, b in [rnd.sample(range(40), 2)]] + [(99, 200 + i, 1000 + i) for i in range(30)]
    count, want = {}, []
    for a, b, o in rows:
        if count.get(a, 0) < 4 and count.get(b, 0) < 8:
            count[a], count[b] = count.get(a, 0) + 1, count.get(b, 0) + 1
            want.append(o)
    got = gr.cap_degrees(spark.createDataFrame(rows, "src int, dst int, ord int")).collect()
    assert sorted(r["ord"] for r in got) == want


def test_degree_cap_reads_only_what_is_open(spark, monkeypatch):
    """A chain of waiting edges beside many edges that the first round settles; odd rows are defined."""
    written = {}

    def counted(df, name):
        out = stored(df, name)
        written.setdefault(name, []).append(out.count())
        return out

    from sourceline.plans.materialize import stored
    monkeypatch.setattr(gr, "stored", counted)
    rnd = random.Random(5)
    rows = [(10_000 + i, 50_000 + i, i) for i in range(1_000)]
    rows += [(a, b, 5_000 + i) for i in range(300) for a, b in [rnd.sample(range(30), 2)]]
    count, want = {}, []
    for a, b, o in rows:
        if count.get(a, 0) < 4 and count.get(b, 0) < 8:
            count[a], count[b] = count.get(a, 0) + 1, count.get(b, 0) + 1
            want.append(o)
    got = gr.cap_degrees(spark.createDataFrame(rows, "src int, dst int, ord int"))
    assert sorted(r["ord"] for r in got.collect()) == want
    assert len(written["capped-edges"]) > 2
    assert written["capped-edges"][0] == len(rows) and sum(written["capped-edges"][1:] + written["capped-open"]) < 1_000
    assert max(written["capped-ends"]) <= 8 * 30
    odd = [(1, 100 + i, i) for i in range(5)] + [(1, 200, None), (None, 300, 0), (2, None, 0)]
    kept = gr.cap_degrees(spark.createDataFrame(odd, "src int, dst int, ord int")).collect()
    assert sorted((r["dst"] for r in kept)) == [100, 101, 102, 103]


def _similar(a, b):
    x, y = ({s.replace(" ", "")[i:i + 2] for i in range(len(s.replace(" ", "")) - 1)} for s in (a, b))
    return len(x & y) / min(len(x), len(y)) if x and y else 0.0


def _texts(n, seed):
    rnd = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma"]
    return [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 5))) for _ in range(n)]


def test_first_similar_equals_brute_force(spark):
    rows = [("d", str(i), text, i) for i, text in enumerate(_texts(60, 1))]
    df = spark.createDataFrame(rows, "deck_id string, id string, text string, ord long")
    got = {r["id"]: r["similar_to"] for r in nt.first_similar(df, df, earlier_only=True).collect()}
    for i, (_, ident, text, _) in enumerate(rows):
        want = next((rows[j][1] for j in range(i) if _similar(text, rows[j][2]) >= 0.6), None)
        assert got[ident] == want


def test_note_insert_equals_sequential_rule(spark):
    texts = _texts(50, 2)
    stored, items = texts[:10], texts[10:]
    notes = [[str(i), t] for i, t in enumerate(stored)]
    for i, text in enumerate(items):
        twin = next((n for n in notes if _similar(text, n[1]) >= 0.6), None)
        if twin is None:
            notes.append([str(10 + i), text])
        elif len(text) > len(twin[1]):
            twin[1] = text
    frame = lambda part, base: spark.createDataFrame(
        [("d", str(base + i), "explain", t, base + i) for i, t in enumerate(part)], "deck_id string, id string, kind string, text string, ord long")
    got = nt.insert_notes(frame(stored, 0), frame(items, 10)).collect()
    assert sorted((r["id"], r["text"]) for r in got) == sorted((i, t) for i, t in notes)


@pytest.mark.parametrize("n, spans", [(1, 1), (2, 1), (5, 1), (6, 3), (7, 3)])
def test_note_spans_of_paragraphs(spark, n, spans):
    rows = [("d", "doc", 1, "explain", f"s{i}.", 2, "Part", i) for i in range(n)]
    df = spark.createDataFrame(rows, "deck_id string, source string, para int, kind string, text string, page int, section string, ord long")
    got = kb.note_chunks(df).orderBy("ord").collect()
    assert len(got) == spans and got[0]["text"].startswith("Part / s0.")
    assert got[-1]["text"].endswith(f"s{n - 1}.") or n == 7


def test_dense_search_does_not_depend_on_tiles(spark):
    rnd = random.Random(5)
    df = spark.createDataFrame([(i, [rnd.gauss(0, 1) for _ in range(8)]) for i in range(60)], "id int, vector array<float>")
    asked = df.select(F.col("id").alias("qid"), "vector")
    rows = lambda d: sorted((r["qid"], r["rank"], r["id"]) for r in d.collect())
    assert rows(se.dense_search(df, asked, 3, skip_self=True)) == rows(
        se.dense_search(df, asked, 3, skip_self=True, doc_rows=20, query_rows=10))


def test_fusion_is_symmetric_without_ties(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3)], "qid int, id int, rank int")
    b = spark.createDataFrame([(1, 12, 1), (1, 13, 2)], "qid int, id int, rank int")
    ids = lambda d: [r["id"] for r in d.orderBy("rank").collect()]
    assert ids(se.fuse_hits(a, b, 2))[0] == ids(se.fuse_hits(b, a, 2))[0] == 12


def test_unknown_retriever_is_an_error(spark):
    with pytest.raises(ValueError):
        se.retrieve("nothing", None, None, 3)


def test_hub_with_nine_seeds_keeps_its_neighbours(spark):
    edges = [(0, i, "x", i) for i in range(1, 9)] + [(0, 99, "x", 50)]
    seeds = spark.createDataFrame([(1, n, n + 1) for n in range(9)], "qid int, node int, rank int")
    got = gr.page_neighbours(spark.createDataFrame(edges, "src int, dst int, relation string, ord int"), seeds, 1).collect()
    assert [(r["qid"], r["other"]) for r in got] == [(1, 99)]


def test_degree_cap_keeps_graphs_apart(spark):
    rows = [(d, 1, 10 + i, i) for d in "ab" for i in range(6)]
    got = gr.cap_degrees(spark.createDataFrame(rows, "deck string, src int, dst int, ord int"), key=["deck"]).collect()
    assert sorted((r["deck"], r["ord"]) for r in got) == [(d, i) for d in "ab" for i in range(4)]


def test_pages_above_999(spark):
    from sourceline.operators import generated as gen
    said = spark.createDataFrame([("d", "1000 | why is this page so long\n999 | and what about this one\n99999999999 | no such page at all")], "deck_id string, response string")
    pages = spark.createDataFrame([("d", 999), ("d", 1000)], "deck_id string, page int")
    assert sorted(r["page"] for r in gen.parse_questions(said, pages).collect()) == [999, 1000]


def test_fusion_ranks_documents_without_a_hit(spark):
    """Question ``alpha``: document 1 has no hit but the smallest id, and leads the vectors."""
    from sourceline.operators.index import build_index
    docs = spark.createDataFrame([(1, "beta", [1.0, 0.0]), (2, "alpha", [0.0, 1.0]), (3, "gamma", [0.8, 0.6])], "id long, text string, vector array<double>")
    asked = spark.createDataFrame([(7, "alpha", [1.0, 0.0])], "qid long, question string, vector array<double>")
    hits = se.fuse_with_dense(se.bm25_scores(build_index(docs), asked), docs, asked, 3).orderBy("rank").collect()
    assert [r["id"] for r in hits] == [1, 2, 3]
    assert abs(hits[0]["score"] - (1 / 62 + 1 / 61)) < 1e-9
    nothing = asked.limit(0)
    assert se.fuse_with_dense(se.bm25_scores(build_index(docs), nothing), docs, nothing, 3).count() == 0
    filled = se.bm25_search(build_index(docs), asked, 3, fill=docs).orderBy("rank").collect()
    assert [(r["id"], r["score"] > 0) for r in filled] == [(2, True), (1, False), (3, False)]


def test_unreadable_file_costs_its_rows_only(spark, tmp_path):
    from sourceline.sources import stores
    path = str(tmp_path / "keyed")
    spark.createDataFrame([("a", 1)], "deck_id string, n int").coalesce(1).write.parquet(path)
    (tmp_path / "keyed" / "part-broken.parquet").write_bytes(b"PAR1 this is no table PAR1")
    schema = "deck_id string, n int"
    from pyspark.sql.types import StructType
    assert [tuple(r) for r in stores.read_keyed(spark, path, StructType.fromDDL(schema)).collect()] == [("a", 1)]
    assert stores.read_keyed(spark, path + "-gone", StructType.fromDDL(schema)).count() == 0


def test_cluster_needs_a_shared_folder(spark):
    from types import SimpleNamespace

    from sourceline.session import work_dir
    fake = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: default), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError):
        work_dir(fake)


def test_fallback_evidence_only_where_it_adds(spark):
    from sourceline.operators.evidence import fallback_evidence
    base = spark.createDataFrame([(1, 1, "one"), (2, 1, "one"), (2, 0, "[n] general"), (4, 0, "kept aside"), (5, 2, "two")], "qid long, page int, text string")
    picked = spark.createDataFrame([(1, 1, "a", 1), (1, 2, "b", 2), (2, 1, "c", 1), (2, None, "general", 2), (3, 0, "second", 2), (3, None, "first", 1), (4, 9, "no such page", 1), (5, 2, "d", 1)],
                                   "qid long, page int, text string, rank int")
    questions = spark.createDataFrame([(i, "d") for i in range(1, 7)], "qid long, deck_id string")
    pages = spark.createDataFrame([("d", 1, "one"), ("d", 2, "two")], "deck_id string, page int, text string")
    found = sorted(map(tuple, fallback_evidence(base, picked, questions, pages, "[n] ").collect()))
    assert found == [(1, 1, "one"), (1, 2, "two"), (3, 0, "[n] first\n[n] second")]
    assert fallback_evidence(base, picked.limit(0), questions, pages).count() == 0
    assert fallback_evidence(base.limit(0), picked, questions, pages).select("qid").distinct().count() == 4


def test_ordered_values_of_a_log(spark):
    from sourceline.operators.logs import ordered_values
    log = spark.createDataFrame([(5, "ok", 2.0), (3, "ok", 1.0), (3, "ignored", 0.5), (None, "ok", None)], "q_chars int, status string, latency_ms double")
    rows = sorted(map(tuple, ordered_values(log).collect()))
    assert rows == [("latency_ms", 1, 1.0), ("latency_ms", 2, 2.0), ("q_chars", 1, 3.0), ("q_chars", 2, 3.0), ("q_chars", 3, 5.0)]
    assert ordered_values(log.limit(0)).count() == 0


def test_retrievers_by_name(spark):
    import pytest

    from sourceline.operators.search import retrieve
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["red fox\nblue hen", "red hen", "green cow", "blue cow"])], "id long, text string")
    asked = spark.createDataFrame([(7, "red hen"), (8, "cow")], "qid long, question string")
    plain = [(r.qid, r.id) for r in retrieve("fast", docs, asked, 2).orderBy("qid", "rank").collect()]
    assert [(r.qid, r.id) for r in retrieve("bm25+bm25", docs, asked, 2).orderBy("qid", "rank").collect()] == plain
    assert [(r.qid, r.id) for r in retrieve("passages:bm25", docs, asked, 1).orderBy("qid", "rank").collect()] == [(q, i) for q, i in plain if (q, i) in {(7, 1), (8, 2)}]
    with pytest.raises(ValueError):
        retrieve("bm25+nothing", docs, asked, 2)


def test_passages_of_a_scope(spark):
    from sourceline.operators.search import passage_search
    docs = spark.createDataFrame([("a", 1, "red fox"), ("b", 2, "red fox"), ("b", 3, "red")], "deck_id string, id long, text string")
    asked = spark.createDataFrame([("b", 7, "red fox"), ("c", 8, "red")], "deck_id string, qid long, question string")
    assert [(r.qid, r.id) for r in passage_search(docs, asked, 3, scope=["deck_id"]).orderBy("rank").collect()] == [(7, 2), (7, 3)]


@pytest.mark.parametrize("scope", [[], ["deck_id"]])
def test_index_at_rest_equals_the_one_just_built(spark, tmp_path, scope):
    rnd = random.Random(5)
    words = [f"word{i}" for i in range(60)]
    rows = [(i, i % 3, " ".join(["common", *rnd.choices(words, k=rnd.randrange(1, 30))])) for i in range(300)] + [(900, 0, ""), (901, 1, None)]
    docs = spark.createDataFrame(rows, "id long, deck_id int, text string")
    asked = spark.createDataFrame([(i, i % 4, " ".join(rnd.choices([*words, "common", "absent"], k=5))) for i in range(20)] + [(99, 0, "")],
                                  "qid long, deck_id int, question string")
    built, path = ix.build_index(docs, scope=scope), str(tmp_path / "index")
    ix.write_index(built, path)
    kept = ix.read_index(spark, path, scope)
    hits = lambda index: sorted(tuple(r) for r in se.bm25_search(index, asked, 4).select("qid", "id", "rank", "score").collect())
    assert hits(kept) == hits(built) and len(hits(kept)) > 40
    terms = lambda index: sorted(tuple(r) for r in index.term_stats().select(*scope, "term", "df", F.round("idf", 9)).collect())
    assert terms(kept) == terms(built)
    summary = lambda index: sorted(tuple(r) for r in ix.index_summary(index).collect())
    assert summary(kept) == summary(built)
    # only folders of asked terms are read
    plan = kept.about(se.query_terms(asked, scope)).postings._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan


def test_running_summary_adds_changed_sessions_and_hides_unfinished_versions(spark, tmp_path):
    schema = "session string, at long, status string, latency_ms double"
    log, sink, mark = (str(tmp_path / n) for n in ("log", "sink", "cp"))
    first = [("a", 1, "ok", 10.0), ("a", 2, "ignored", None), ("b", 3, "no_evidence", None), (None, 4, "ok", 1.0), ("", 5, "ok", 1.0)]
    run = lambda: sinks.summarise_stream(spark.readStream.schema(schema).parquet(log), sink, mark)
    spark.createDataFrame([], schema).write.parquet(log)
    run()
    assert sinks.read_summary(spark, sink).count() == 0
    spark.createDataFrame(first, schema).write.mode("append").parquet(log)
    run()
    whole = {r.session: tuple(r)[1:] for r in sinks.read_summary(spark, sink).collect()}
    assert whole == {"a": (2, 1, 0, 1, 10.0, 2), "b": (1, 0, 1, 0, None, 3)}
    spark.createDataFrame([("b", 9, "ok", 30.0)], schema).write.mode("append").parquet(log)
    run()
    rows = spark.read.parquet(f"{sink}/rows")
    last = rows.agg(F.max("version")).first()[0]
    assert [r.session for r in rows.where(F.col("version") == last).collect()] == ["b"]
    # a version without a mark, as a lost driver leaves it
    rows.where("session = 'a'").drop("version", "attempt").withColumn("total", F.lit(77).cast("long")).write.parquet(f"{sink}/rows/version={last + 1}/attempt=ax")
    whole = {r.session: tuple(r)[1:] for r in sinks.read_summary(spark, sink).collect()}
    assert whole == {"a": (2, 1, 0, 1, 10.0, 2), "b": (2, 1, 1, 0, 30.0, 9)}


def test_gold_holds_questions_of_any_length(spark):
    docs = [(1, "old steam engines rust in the yard"), (2, "steamy"), (3, ""), (None, "the steam engines rust"), (5, None)]
    asked = [(1, "steam engines rust"), (2, "steam"), (3, "team eng"), (4, ""), (5, "..."), (6, None), (7, "engines rust in the")]
    found = t.gold_pairs(spark.createDataFrame(docs, "id long, text string"), spark.createDataFrame(asked, "qid long, question string"))
    want = [(q, i) for q, needle in asked for i, text in docs if needle is not None and text is not None and needle in text]
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, want))
