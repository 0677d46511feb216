"""The operators on odd rows, against plain versions of what each must return."""

from __future__ import annotations

import hashlib
import math
import random
import re
import string
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from sourceline.llm import decontamination, embedding_dedup, lm, mixing, near_copies, packing, quality, secret_scan, sharding, simhash, warc
from sourceline.llm.common import crc_of_id

from .conftest import odd_rows

ROWS = [r[:4] for r in odd_rows()]
key = lambda rows: sorted(rows, key=repr)


def size_of(text):
    return len((text or "").encode().split())


def test_mix(odd, none):
    got = mixing.mixed_words(odd, block=64).collect()
    sizes = defaultdict(int)
    for _, text, _, source in ROWS:
        sizes[source] += size_of(text)
    names = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, target, free = sum(sizes.values()), {}, set(names)
    while True:
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        above = {s for s in free if share[s] > 3 * sizes[s]}
        if not above:
            target |= share
            break
        target |= {s: 3.0 * sizes[s] for s in above}
        free -= above
    source_of = defaultdict(set)
    for i, text, _, source in ROWS:
        source_of[i, size_of(text)].add(source)
    assert key((r.doc_id, r["size"]) for r in got) == key((i, size_of(t)) for i, t, _, _ in ROWS)
    taken = Counter()
    for r in got:
        assert r.taken <= 3 * r["size"]
        source = next(s for s in source_of[r.doc_id, r["size"]] if sizes[s] == r.source_size)
        assert abs(r.target - target[source]) < 1e-6 * max(1, target[source])
        taken[source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in names)
    assert key(map(tuple, mixing.mixed_words(odd, block=64).collect())) == key(map(tuple, got))
    assert mixing.mixed_words(none).count() == 0


def test_mix_interleaves_sources(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("a b c d").alias("text"), F.when(F.col("id") % 4 > 0, "big").otherwise("small").alias("source"))
    rows = mixing.sized(docs)
    mix = mixing.mixture(rows, mixing.targets(rows), block=8)
    slots = {r.slot: r.src for r in mix.select("slot", "src").distinct().collect()}
    share = sum(s == 1 for s in slots.values()) / len(slots)
    for at in range(0, 190, 20):
        window = [slots[i] for i in range(at, at + 20)]
        assert abs(window.count(1) - 20 * share) <= 2
    assert mixing.mixed_words(docs.withColumn("text", F.lit(" "))).agg(F.sum("taken"), F.max("target")).first() == (0, 0.0)


def plain_components(fps):
    ids = sorted({f for _, f in fps})
    values, parent = np.array(ids, np.uint64), list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, j in zip(*np.nonzero(np.bitwise_count(values[:, None] ^ values[None, :]) <= 3), strict=True):
        a, b = find(i), find(j)
        parent[max(a, b)] = min(a, b)
    root = {f: find(i) for i, f in enumerate(ids)}
    least = {}
    for i, f in fps:
        least[root[f]] = min((x for x in (least.get(root[f]), i) if x is not None), default=None)
    return [(i, f"{f:016x}", least[root[f]]) for i, f in fps]


@pytest.mark.parametrize("node", [simhash.NODE, 2])
def test_simhash(odd, none, node):
    def plain(text):
        words = (text or "").encode().lower().split()
        grams = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    near = simhash.near_duplicates(odd.select("doc_id", "text"), node=node).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "first.doc_id").collect()
    expected = plain_components([(i, plain(t)) for i, t, _, _ in ROWS])
    assert key(map(tuple, near)) == key(expected)
    if node > 2:
        assert key(map(tuple, simhash.components(odd).collect())) == key(expected)
        assert simhash.components(none).count() == 0


def test_quality(odd, none, labels):
    trees = quality.train(odd, labels)
    got = quality.quality_scores(odd, labels).collect()
    text_of = defaultdict(set)
    for i, t, _, _ in ROWS:
        text_of[i].add(t)
    assert key(r.doc_id for r in got) == key(i for i, *_ in ROWS)
    for r in got:
        assert r.held_out == (crc_of_id(r.doc_id) % 5 == 0) and r.predicted == (r.score >= 0.3)
        assert any(abs(trees.score(quality.statistics([None if t is None else t.encode()]))[0] - r.score) < 1e-12 for t in text_of[r.doc_id])
    assert quality.quality_scores(none, labels).count() == 0
    assert {r.score for r in quality.quality_scores(odd, labels.limit(0)).collect()} == {0.5}


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = quality.quality_scores(spark.read.parquet(f"{sf}/documents.parquet"), labels).where("held_out").join(labels, "doc_id").collect()
    assert sum(r.predicted == r.quality for r in got) / len(got) > 0.94


@pytest.mark.parametrize("dense", [embedding_dedup.DENSE, 5])
def test_vectors(spark, dense, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 4)
    rng = np.random.default_rng(4)
    base = rng.normal(size=(6, 16))
    vectors = [(b + rng.normal(size=16) * s).tolist() for b in base for s in [0.02] * 12 + [0.25] * 12 + [0.5] * 4]
    rows = [(i, v, i // 90) for i, v in enumerate(vectors)]
    rows += [(500 + i, v, 0) for i, v in enumerate(vectors[:5])] + [rows[0], rows[0]]
    rows += [(600, None, 0), (601, [0.0] * 16, 0), (602, [float("nan")] + [1.0] * 15, 0), (603, [None] + [1.0] * 15, 0), (604, vectors[0], None),
             (605, [float("inf")] * 16, 0), (606, [], 0), (607, vectors[0][:8], 0), (608, [1e-40] * 16, 1), (609, [3.0] * 16, 1), (None, vectors[0], 0)]
    df = spark.createDataFrame([(*r, "odd") for r in rows], "vec_id long, embedding array<double>, label int, rep string").repartition(3)
    got = embedding_dedup.near_duplicates(df, dense=dense).collect()

    def fine(v, label):
        return label is not None and v and None not in v and all(map(math.isfinite, v)) and any(v)
    unit = [embedding_dedup.unit([v])[0] if fine(v, label) else None for _, v, label in rows]
    linked = [[j for j in range(len(rows)) if j != i and unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2]
               and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.93] for i in range(len(rows))]
    expected = []
    for i, row in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in linked[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        least = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        expected.append((row[0], len(linked[i]), least, True if row[0] is None else row[0] == least))
    assert key(map(tuple, got)) == key(expected)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_shards(odd, none):
    got = sharding.shard_bytes(odd).collect()
    expected = [(i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, _, _ in ROWS]
    assert key((r.doc_id, r["size"], r.text_crc32) for r in got) == key(expected)
    slots, place = defaultdict(list), defaultdict(set)
    for r in got:
        slots[r.shard].append(r.slot)
        place[r.text_crc32, r["size"]].add(r.shard)
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 24
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for (crc, size), s in place.items() if size > 8)
    assert sharding.shard_bytes(none).count() == 0


def test_language_model(odd, none):
    got = lm.scores(odd).collect()
    counts = Counter()
    for i, t, _, _ in ROWS:
        if crc_of_id(i) % 7 != 2:
            counts.update((t or "").encode().lower().split())
            counts[None] += 1
    total, types = sum(counts.values()), len(counts)
    expected = defaultdict(list)
    for i, t, _, _ in ROWS:
        tokens = [*(t or "").encode().lower().split(), None]
        expected[i, len(tokens)].append((sum(counts[w] > 0 for w in tokens), sum(math.log10((counts[w] + 1) / (total + types + 1)) for w in tokens)))
    assert len(got) == len(ROWS)
    for r in got:
        assert any(r.n_known == k and abs(r.base_score - b) < 1e-6 * max(1, abs(b)) for k, b in expected[r.doc_id, r.n_tokens])
        assert r.held_out == (crc_of_id(r.doc_id) % 7 == 2) and r.train_tokens == total and r.score < 0
    assert lm.scores(none).count() == 0


def test_language_model_without_the_head_knows_the_same(odd, monkeypatch):
    expected = {(r.doc_id, r.n_tokens): (r.n_known, r.base_score) for r in lm.scores(odd).collect()}
    monkeypatch.setattr(lm.Vocabulary, "of", classmethod(lambda cls, counts, of=lm.Vocabulary.of.__func__: _short(of(cls, counts))))
    for r in lm.scores(odd).collect():
        known, base = expected[r.doc_id, r.n_tokens]
        assert r.n_known == known and abs(r.base_score - base) < 1e-6 * abs(base)


def _short(v):
    # the class words stay as they are; only words of rare classes move behind the join
    cut = max(0, min(len(v.head), 120))
    words = v.head[cut:]
    rare = v.rare_total.copy()
    for w, n in zip(words, v.n[cut:], strict=True):
        rare[lm.rare_class(w) - 1 - lm.WORDS] += n + 1
    return lm.Vocabulary(v.head[:cut], v.n[:cut], v.end, v.tokens, v.types, rare, v.class_n)


def record(i, url, ts, status, headers, body):
    return (i, url, ts, status, headers, body, "odd")


def test_revisits(spark):
    kind = "record_id long, url string, ts long, status int, headers map<string,string>, body string, task string"
    rows = [record(1, "http://WWW.Host.com:80/a/?utm_x=1&b=2&a=1#f", 10, 200, {"ETag": '"x"', "Content-Type": "text/html", "Date": "1"}, "one"),
            record(2, "https://host.com/a?a=1&b=2", 20, 304, {"etag": 'W/"x"', "content-type": "no", "date": "2"}, None),
            record(3, "https://host.com/a?a=1&b=2", 30, 304, {"etag": '"y"'}, None), record(4, "https://host.com/a?a=1&b=2", 5, 304, {"etag": '"x"'}, None),
            record(5, "https://host.com/a?a=1&b=2", 10, 304, {"etag": '"x"'}, None), record(6, "https://host.com/a?a=1&b=2", 40, 206, {}, "part"),
            record(7, "https://host.com/a?a=1&b=2", 50, 304, None, None), record(8, None, 60, 304, {"etag": '"x"'}, None), record(9, "http://host.com/a?a=1&b=2", None, 304, {"etag": '"x"'}, None),
            record(10, "q", 1, 200, {"Last-Modified": "m"}, ""), record(11, "q/", 2, 304, {"last-modified": "m", "etag": '"z"'}, None), record(11, "q/", 2, 304, {"last-modified": "m", "etag": '"z"'}, None),
            record(12, "q", 3, 200, {}, None), record(13, "q", 4, None, None, "x")]
    rows += [record(100 + i, "hot", i, 304 if i % 3 else 200, {"etag": f'"{i // 3}"'}, None if i % 3 else str(i)) for i in range(300)]
    got = warc.resolve_revisits(spark.createDataFrame(rows, kind).repartition(5)).collect()
    by = {r.record_id: r for r in got}
    assert len(got) == len(rows)
    assert (by[2].status, by[2].body, by[2].source_id, by[2].headers) == (200, "one", 1, {"etag": 'W/"x"', "content-type": "text/html", "date": "2"})
    assert [by[i].outcome for i in (1, 3, 4, 5, 6, 7, 8, 9, 11, 12, 13)] == ["kept", "changed", "no response", "no response", "kept", "changed", "no response", "no response", "resolved", "kept", "kept"]
    assert by[11].body == "" and by[11].headers["last-modified"] == "m" and by[3].status == 304 and by[3].body is None
    assert all(by[100 + i].body == str(i // 3 * 3) and by[100 + i].source_id == 100 + i // 3 * 3 for i in range(300) if i % 3)
    assert warc.resolve_revisits(spark.createDataFrame([], kind)).count() == 0


def test_revisits_of_repeated_ids(spark):
    """Records that share ids and differ in URL, body or time, against a plain loop."""
    rng = np.random.default_rng(12)
    kind = "record_id long, url string, ts long, status int, headers map<string,string>, body string, row string"
    rows = []
    for _ in range(160):
        full, tag = bool(rng.random() < 0.5), f'"{rng.integers(3)}"'
        rows.append(record(None if rng.random() < 0.1 else int(rng.integers(6)), f"http://h{rng.integers(4)}/", int(rng.integers(12)), 200 if full else 304, {"etag": tag}, "b" * int(rng.integers(40)) if full else None))
    rows += rows[:20]
    latest = lambda r: (r[2], r[0] is not None, r[0] or 0, len(r[5]), r[4]["etag"])
    expected = []
    for i, url, ts, status, headers, body, _ in rows:
        before = [r for r in rows if r[1] == url and r[2] < ts and r[3] == 200]
        source = max(before, key=latest, default=None)
        if status == 200:
            expected.append((i, url[7:-1], ts, 200, None, "kept", body))
        elif source is None:
            expected.append((i, url[7:-1], ts, 304, None, "no response", None))
        else:
            # of equal latest responses the headers may differ, so the outcome is read off those that tie
            tied = {r[4]["etag"] for r in before if latest(r) == latest(source)}
            expected.append((i, url[7:-1], ts, source[0], tied, headers["etag"], source[5]))
    got = warc.resolve_revisits(spark.createDataFrame(rows, kind).repartition(7)).collect()
    assert len(got) == len(rows)
    left = Counter()
    for e in expected:
        if e[5] in ("kept", "no response"):
            left[e] += 1
    for r in got:
        row = (r.record_id, r.url_key, r.ts, r.status, r.source_id, r.outcome, r.body)
        if r.outcome in ("kept", "no response"):
            left[row] -= 1
        else:
            fits = [e for e in expected if e[:3] == row[:3] and e[5] not in ("kept", "no response") and e[3] == r.source_id]
            assert any((r.outcome == "resolved" and e[5] in e[4] and r.body == e[6]) or (r.outcome == "changed" and (len(e[4]) > 1 or e[5] not in e[4])) for e in fits), r
    assert not any(left.values()) and Counter(r.outcome for r in got)["resolved"] > 10


def test_one_id_of_two_urls(spark):
    for pages, resolved in (([(1, "http://a/", "y"), (1, "http://b/", None)], {("a", "y")}), ([(3, "http://a/", "y"), (3, "http://b/", "z")], {("a", "y"), ("b", "z")})):
        got = warc.resolve_revisits(warc.captures(spark.createDataFrame(pages, "page_id long, url string, html string"))).collect()
        assert len(got) == 3 * len(pages) and {(r.url_key, r.body) for r in got if r.outcome == "resolved"} == resolved


def test_odd_pages(spark):
    pages = spark.createDataFrame([(1, None, None), (2, "http://a/", None), (None, "http://a/", "x"), (3, "http://a/", "y"), (3, "http://a/", "y")], "page_id long, url string, html string")
    assert warc.resolved_pages(pages).count() == 15 and warc.resolved_pages(pages.limit(0)).count() == 0


def test_decontamination(odd, none, items):
    split = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    ascii_lower = lambda t: "".join(c.lower() if c < "\x80" else c for c in t or "")
    windows = defaultdict(set)
    for i, text in ((r.item_id, r.text) for r in items.collect()):
        w = split.findall(ascii_lower(text))
        for at in range(max(1, len(w) - 12) if w else 0):
            windows[tuple(w[at:at + 13])].add(i)
    expected = []
    for i, text, _, _ in ROWS:
        w, hit, found = split.findall(ascii_lower(text)), set(), set()
        for gram, ids in windows.items():
            for at in range(len(w) - len(gram) + 1):
                if tuple(w[at:at + len(gram)]) == gram:
                    hit |= set(range(at, at + len(gram)))
                    found |= ids - {None}
        ids = ",".join(sorted(map(str, found)))
        expected.append((i, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    assert sum(e[2] > 0 for e in expected) >= 5
    assert key(map(tuple, decontamination.contamination(odd, items).collect())) == key(expected)
    assert decontamination.contamination(none, items).count() == 0
    assert decontamination.contamination(odd, items.limit(0)).where("contaminated or n_hit > 0 or n_items > 0").count() == 0


def plain_secrets(text):
    """``start, kind, end`` of the three kinds, one loop over the text for each."""
    value, found = set(string.ascii_letters + string.digits + "+/_.=-"), []

    def stretch(at, letters):
        return next((i for i in range(at, len(text)) if text[i] not in letters), len(text))

    at = 0
    while at < len(text):
        end = None
        for name in ("password", "passwd", "secret", "token", "api_key", "apikey"):
            if text[at:at + len(name)].translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)) != name:
                continue
            i = at + len(name)
            i += text[i:i + 1] in ("'", '"')
            i = stretch(i, " ")
            if text[i:i + 1] not in (":", "="):
                continue
            i = stretch(i + 1, " ")
            i += text[i:i + 1] in ("'", '"')
            if (last := stretch(i, value)) > i:
                end, length = last, last - i
                break
        if end is None:
            at += 1
            continue
        if length >= 8:
            found.append((at, 0, end))
        at = end
    at = text.find("AKIA")
    while at >= 0:
        end = stretch(at + 4, string.ascii_uppercase + string.digits)
        if end - at >= 16:
            found.append((at, 1, end))
        at = text.find("AKIA", end if end > at + 4 else at + 1)
    at = 0
    while at < len(text):
        end = stretch(at, "0123456789abcdef")
        if end - at >= 32:
            found.append((at, 2, end))
        at = max(end, at + 1)
    return sorted(found)


def test_base_spans_equal_plain_loops():
    rng, pieces = random.Random(11), ["password", "PassWd", "secret", "token", "apikey", "API_KEY", "api_keyapi_key", '"', "'", " ", "  ", ":", "=", "\t", "\n", "AKIA", "AKIAAKIA",
                                      "ABCDEFGHIJKL0123", "abcdefgh", "a1b2c3", "deadbeef" * 4, "0" * 31, "É", "\u017f", "\u212a", "x", "."]
    found = 0
    for _ in range(20_000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 14)))
        assert sorted(secret_scan.base_spans(text)) == plain_secrets(text), repr(text)
        found += len(plain_secrets(text))
    assert found > 2_000


def test_secrets(odd, none):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    got = secret_scan.secret_counts(odd, path).collect()
    coder, expected = secret_scan.encoding(path), []
    for i, text, _, _ in ROWS:
        base = plain_secrets(text or "")
        kinds = [k for _, k, _ in base]
        expected.append((i, kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(secret_scan.listed(base).encode()).hexdigest(), secret_scan.listed(secret_scan.spans(text or "", coder))))
    assert key(map(tuple, got)) == key(expected) and sum(e[1] for e in expected) > 0
    assert secret_scan.secret_counts(none, path).count() == 0


def test_packed_ids(odd, none):
    from tokenizers import Tokenizer
    path = public_tokenizers.path("word_bpe_49k.json")
    plain, expected, at = Tokenizer.from_file(path), [], 0
    got = sorted(packing.packed_documents(odd, path, 2).collect(), key=lambda r: r.start)
    encoded = defaultdict(list)
    for i, text, _, _ in ROWS:
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 2]
        encoded[i].append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    for r in got:
        assert r.start == at and (r.n_tokens, r.ids_crc32) in encoded[r.doc_id]
        encoded[r.doc_id].remove((r.n_tokens, r.ids_crc32))
        at += r.n_tokens
    assert not any(encoded.values()) and [r.doc_id for r in got] == sorted((r.doc_id for r in got), key=lambda i: (i is not None, i))
    assert packing.packed_documents(none, path, 2).count() == 0


def test_small_files_read_the_same(odd):
    path = public_tokenizers.path("word_bpe_49k.json")
    from sourceline.llm.common import shared_path
    files = packing.write_ids(odd, shared_path(odd.sparkSession, "small-files"), path, 2, file_ids=500)
    assert files.count() > 10
    assert key(map(tuple, packing.read_documents(files).collect())) == key(map(tuple, packing.packed_documents(odd, path, 2).collect()))


@pytest.fixture(scope="module")
def tables(spark, odd, items, labels, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    for name, df in (("documents", odd), ("benchmark", items), ("labels", labels)):
        df.write.parquet(f"{path}/{name}.parquet")
    return path


def plain_copies(rows):
    """First row of every component of a Jaccard similarity of 0.8 on 5-word shingles, all pairs compared."""
    rows = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, str(r[1])))
    sets = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        sets.append({tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    parent = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if 5 * len(a & sets[j]) >= 4 * len(a | sets[j]) and parent[i] != parent[j]:
                low, high = sorted((parent[i], parent[j]))
                parent = [low if x == high else x for x in parent]
    return Counter(rows[i] for i in set(parent))


def test_pipeline_equals_its_operators(spark, tables, odd, items, labels):
    docs, columns = spark.read.parquet(f"{tables}/documents.parquet"), odd.columns
    text = lambda df: Counter((r.doc_id, r.text) for r in df.collect())
    for at, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before, after = text(docs), stage(spark, docs, tables)
        path = f"{tables}/stage{at}"
        after.write.parquet(path)
        after = spark.read.parquet(path)
        now = text(after)
        if at < 4:
            assert after.columns == columns
        if at == 0:
            trees = quality.train(docs, labels)
            good = [t for t, s in zip(before.elements(), trees.score(quality.statistics([None if t is None else t.encode() for _, t in before.elements()])), strict=True) if s >= 0.3]
            assert now == Counter(good)
        elif at == 1:
            firsts = plain_copies(list(before.elements()))
            assert now == firsts and sum(now.values()) < sum(before.values())
        elif at == 2:
            bad = Counter(r.doc_id for r in decontamination.contamination(docs, items).where("contaminated").collect())
            assert Counter(i for i, _ in now.elements()) == Counter(i for i, _ in before.elements()) - bad and bad
        elif at == 3:
            assert max(now.values()) <= 3 and set(now) <= set(before)
        else:
            assert now == before and after.columns == [*[c for c in columns if c not in ("shard", "slot")], "shard", "slot"]
        docs = after


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_of_nothing(spark, none, tables, name):
    assert dict(corpus_pipeline.STAGES)[name](spark, none, tables).count() == 0


def test_near_copies_equal_brute_force(spark):
    """Copies at every distance around 0.8, chains of them, and a group larger than its leaders reach."""
    rng = np.random.default_rng(8)
    vocabulary = [f"w{i}" for i in range(2000)]
    texts = []
    for n in (40, 150, 600):
        for changes in (0, 1, 2, 3, 4, 6):
            base = rng.choice(vocabulary, n).tolist()
            texts.append(" ".join(base))
            for _ in range(4):
                at = rng.choice(n, min(n, changes * n // 100 + (changes > 0)), replace=False)
                texts.append(" ".join(x if i not in at else "z" + x for i, x in enumerate(base)))
    base = rng.choice(vocabulary, 300).tolist()
    for i in range(25):
        base[i * 12] = f"c{i}"
        texts += [" ".join(base), " ".join(base)]
    texts += [None, "", " ", "One two", "one  TWO", "three"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = Counter((r.doc_id, r.text) for r in corpus_pipeline.distinct_documents(spark, docs, "").collect())
    assert got == plain_copies(list(enumerate(texts))) and 20 < len(got) < 100


def test_tries_of_fingerprints_link_before_leaders(spark, monkeypatch):
    """Without leaders and prefixes the stage still unites what the tries of SimHash link, and only what is similar."""
    rng = np.random.default_rng(11)
    vocabulary = [f"w{i}" for i in range(5000)]
    base = rng.choice(vocabulary, 800).tolist()
    near = [*base[:400], "other", *base[401:]]
    often = rng.choice(vocabulary, 21).tolist() * 60  # its repeats fill the fingerprint, its few shingles not the set
    tails = [" ".join([*often, *rng.choice(vocabulary, 40).tolist()]) for _ in range(2)]
    texts = [" ".join(base), " ".join(near), *tails, " ".join(rng.choice(vocabulary, 300))]
    prints = [simhash.fingerprint(t.encode().split()) for t in texts]
    assert (prints[0] ^ prints[1]).bit_count() <= 3 and (prints[2] ^ prints[3]).bit_count() <= 3
    assert len(plain_copies(list(enumerate(texts)))) == 4
    no_pairs = lambda *_: spark.createDataFrame([], "a string, b string, ca string, cb string")
    monkeypatch.setattr(near_copies, "_with_leaders", no_pairs)
    monkeypatch.setattr(near_copies, "prefix_pairs", no_pairs)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert [dict(corpus_pipeline.STAGES)["simhash_trie"]] == [corpus_pipeline.distinct_documents]
    assert sorted(r.doc_id for r in corpus_pipeline.distinct_documents(spark, docs, "").collect()) == [0, 2, 3, 4]


def test_prefix_pairs_hold_every_link(spark):
    """Candidates of the join against all pairs, with hot shingles, many sizes and split slices; no leaders help."""
    rng = np.random.default_rng(5)
    passage, sets = rng.integers(1, 1 << 60, 60), []
    for size in (1, 2, 3, 5, 9, 40, 45, 50, 120):
        base = rng.integers(1, 1 << 60, size)
        for _ in range(14):
            own = rng.integers(1, 1 << 60, rng.integers(0, max(2, size // 3)))
            kept = base[rng.random(size) > 0.08]
            sets.append(np.unique(np.concatenate([kept, own, passage[:rng.integers(0, 61)] if rng.random() < 0.3 else passage[:0]]) if len(kept) else base))
    rows = [(f"s{i:03}", len(x), f"s{i:03}" if i % 5 else "one", x.tolist()) for i, x in enumerate(sets)]
    df = spark.createDataFrame(rows, "node string, n int, component string, hashes array<long>")
    want = {(a[0], b[0]) for a in rows for b in rows if (b[1], b[0]) < (a[1], a[0]) and a[2] != b[2] and 5 * len({*a[3]} & {*b[3]}) >= 4 * len({*a[3]} | {*b[3]})}
    for held in (near_copies.SLICE, 2):
        found = {(r.a, r.b) for r in near_copies.prefix_pairs(df, held).collect()}
        assert want <= found and len(want) > 50 and len(found) < 4 * len(want) + 200, (len(found), len(want))


def test_near_copies_of_odd_rows(odd, none):
    got = near_copies.one_of_each(odd)
    assert got.columns == odd.columns and near_copies.one_of_each(none).count() == 0
    assert Counter((r.doc_id, r.text) for r in got.collect()) == plain_copies([r[:2] for r in ROWS])


def test_copies_that_differ_in_their_own_words_name_nothing_shared(spark):
    """Hundreds of texts that share 85 % of one base, each changed in more than a ninth of its shingles: no candidates.

    With smaller changes of their own they are candidates of each other, similar or not.
    """
    rng = np.random.default_rng(9)
    base = [f"b{i}" for i in range(200)]

    def candidates(changes):
        texts = [" ".join(base)]
        for i in range(60):
            at = rng.choice(38, changes, replace=False) * 5 + 5
            texts.append(" ".join(f"x{i}y{j}" if j in at else w for j, w in enumerate(base)))
        sets = [near_copies.shingles(t.encode()).view(np.int64).tolist() for t in texts]
        rows = [(f"{i:04}", len(x), f"{i:04}", x) for i, x in enumerate(sets)]
        return {(r.a, r.b) for r in near_copies.prefix_pairs(spark.createDataFrame(rows, "node string, n int, component string, hashes array<long>")).collect()}

    assert not candidates(6)
    assert {x for pair in candidates(3) for x in pair} == {f"{i:04}" for i in range(61)}


def test_vectors_with_a_common_direction(spark):
    rng = np.random.default_rng(6)
    n, pairs, common = 3000, 300, np.eye(64)[0]

    def unit(x):
        return x / np.linalg.norm(x, axis=-1, keepdims=True)
    side = rng.normal(size=(n, 64)) * np.array([0.0] + [1.0] * 63)
    x = 0.8 ** 0.5 * common + 0.2 ** 0.5 * unit(side)
    step = rng.normal(size=(pairs, 64))
    step = unit(step - (step * x[:pairs]).sum(1, keepdims=True) * x[:pairs])
    x = np.concatenate([x, 0.935 * x[:pairs] + (1 - 0.935 ** 2) ** 0.5 * step])
    df = spark.createDataFrame([(i, v, 0) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>, label int")
    part = {r.vec_id: r.component_id for r in embedding_dedup.near_duplicates(df).collect()}
    assert sum(part[i] == part[n + i] for i in range(pairs)) >= 298
