"""The methods without Spark, against plain versions."""

from __future__ import annotations

import random
import string

import numpy as np
import pytest

from sourceline.llm import lm, packing, quality, secret_scan, sharding, simhash


def test_trie_links_equal_all_pairs():
    rng = np.random.default_rng(3)
    near = rng.integers(0, 1 << 63, 20, dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (20, 30, 2)).astype(np.uint64)
    values = np.unique(np.concatenate([(near[:, None] ^ flips[:, :, 0] ^ flips[:, :, 1]).ravel(), rng.integers(0, 1 << 63, 500, dtype=np.uint64)]))
    found = simhash.trie_links(values, np.array([[0, len(values), 0, len(values), 0]]), 0, np.arange(len(values)))
    parent = np.arange(len(values))
    i, j = np.nonzero(np.bitwise_count(values[:, None] ^ values[None, :]) <= 3)
    assert (found == simhash.united(parent, i, j)).all()
    assert len(set(found.tolist())) < len(values) - 300


def test_rotation_comes_back():
    values = np.random.default_rng(1).integers(0, 1 << 63, 8, dtype=np.uint64)
    for block in range(4):
        turned = values if not block else (values << np.uint64(16 * block)) | (values >> np.uint64(64 - 16 * block))
        assert (simhash._unrotate(turned, np.full(8, block)) == values).all()


def test_fingerprint_of_long_text_does_not_depend_on_chunks(monkeypatch):
    words = [str(i).encode() for i in range(1000)]
    whole = simhash.fingerprint(words)
    monkeypatch.setattr(simhash, "HASHES", 7)
    assert simhash.fingerprint(words) == whole and simhash.fingerprint([]) == 0


@pytest.mark.parametrize("bits", [1, 3, 8, 13, 15, 16, 17, 31, 32])
def test_packing_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1001, dtype=np.uint64).astype(np.uint32)
    data = packing.pack(ids, bits)
    assert len(data) == -(-1001 * bits // 8) and (packing.unpack(data, 1001, bits) == ids).all()


@pytest.mark.parametrize("bits", [15, 16])
def test_packed_file_reads_any_range(tmp_path, bits):
    rng = np.random.default_rng(0)
    ids, ends = rng.integers(0, 1 << bits, 10_000).astype(np.uint32), np.array([0, 10, 5000, 5000, 10_000])
    path = str(tmp_path / "a.bits")
    packing.write_file(path, ids, np.arange(5), np.zeros(5), ends, bits, block=100)
    packed = packing.PackedFile(path)
    for start, end in ((0, 0), (0, 1), (99, 101), (350, 7777), (9999, 10_000)):
        assert (packed.ids(start, end) == ids[start:end]).all()
    import zlib
    starts = [0, *ends[:-1]]
    assert packed.crcs() == [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(starts, ends, strict=True)]


def test_words_encode_as_the_whole_text():
    import public_tokenizers
    from tokenizers import Tokenizer
    path = public_tokenizers.path("word_bpe_49k.json")
    plain, coder = Tokenizer.from_file(path), packing.WordEncoder(path)
    rng = random.Random(5)
    texts = ["", " ", "it's THE end...", "a<|endoftext|>b <|ENDOFTEXT|>", "Été ÉTÉ,  x y", "ΣΣ Σ.", "don't'll 'S", "x" * 5000,
             "́́ á. b,", "12.5, 7.", "İstanbul \U0001f600 \x00\x1f\x85 z"]
    texts += ["".join(rng.choice(string.printable + "éßÄ中́ ") for _ in range(rng.randrange(60))) for _ in range(400)]
    for _ in range(2):
        for text, ids in zip(texts, coder.encode(texts), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, text


def plain_capacity(sizes, shards):
    def need(capacity):
        count, left = 0, -1
        for s in sizes:
            if s > capacity or s > left:
                count, left = count + 1, (capacity - s if s <= capacity else -1)
            else:
                left -= s
        return count
    return next(c for c in range(1, sum(sizes) + 1) if need(c) <= shards)


def test_cuts_have_the_smallest_capacity():
    rng = random.Random(2)
    for _ in range(60):
        sizes = [rng.randrange(1, 20) for _ in range(rng.randrange(1, 40))]
        shards = rng.randrange(1, 8)
        capacity, starts = sharding.smallest_cuts(np.array(sizes), shards)
        assert capacity == max(plain_capacity(sizes, shards), -(-sum(sizes) // (shards * 1024)))
        bounds = [0, *starts, len(sizes)]
        assert len(bounds) - 1 <= shards and bounds == sorted(set(bounds))
        assert all(sum(sizes[a:b]) <= capacity or b == a + 1 for a, b in zip(bounds, bounds[1:], strict=False))


def test_a_dominant_group_stands_alone():
    sizes = np.array([1] * 100 + [1000] + [1] * 100)
    _, starts = sharding.smallest_cuts(sizes, 24)
    assert 100 in starts and 101 in starts and len(starts) >= 20


def test_flat_trees_equal_a_walk():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 6))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] > 0)).astype(float)
    trees = quality.fit(x[:1500], y[:1500])
    score = trees.score(x[1500:])
    assert ((score > 0.5) == y[1500:]).mean() > 0.95
    for row, value in zip(x[1500:1520], score, strict=False):
        total = trees.base
        for t in range(len(trees.feature)):
            node = 0
            while node < trees.feature.shape[1]:
                node = 2 * node + 1 + (row[trees.feature[t, node]] > trees.threshold[t, node])
            total += trees.leaf[t, node - trees.feature.shape[1]]
        assert abs(1 / (1 + np.exp(-total)) - value) < 1e-12


def test_trees_of_odd_samples():
    none = quality.fit(np.zeros((0, 4)), np.zeros(0))
    assert none.score(np.zeros((2, 4))).tolist() == [0.5, 0.5]
    assert quality.fit(np.zeros((9, 4)), np.ones(9)).score(np.zeros((1, 4)))[0] > 0.9
    same = quality.fit(np.zeros((10, 4)), np.array([0, 1] * 5))
    assert abs(same.score(np.zeros((1, 4)))[0] - 0.5) < 0.01
    assert np.isfinite(quality.statistics([None, b"", b"\n\n", "é".encode(), b"a" * 100_000])).all()


def test_log_bilinear_is_normalised_and_learns():
    class_n = np.zeros(lm.CLASSES, np.int64)
    class_n[[0, 5, 6, 7]] = 1000
    texts = [np.array([5, 6, 7] * 20 + [0], np.int16)] * 300
    start = lm.Model.start(class_n)
    flat, seen = lm.train_on(start, texts, class_n, 0)
    model = lm.Model(flat, "trained")
    every = np.arange(lm.CLASSES)
    probabilities = sum(np.exp(lm.token_log_probabilities(model, np.array([5, 6, w]), np.array([0]))[2]) for w in every)
    assert abs(probabilities - 1) < 1e-3 and seen == 300 * 61
    before = lm.token_log_probabilities(start, texts[0].astype(int), np.array([0])).mean()
    assert lm.token_log_probabilities(model, texts[0].astype(int), np.array([0])).mean() > before + 0.5


@pytest.fixture(scope="module")
def coder():
    import public_tokenizers
    return secret_scan.encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def test_secret_rules(coder):
    key = "AKIA" + "Z7" * 8
    text = f"é PassWord: 'abcdefgh' {key} token=short secret=" + "0123456789abcdef" * 3
    found = secret_scan.spans(text, coder)
    named = [(secret_scan.KINDS[k], text[a:b]) for a, k, b in found]
    assert named == [("assign", "PassWord: 'abcdefgh"), ("access", key), ("assign", "secret=" + "0123456789abcdef" * 3), ("hex", "0123456789abcdef" * 3)]
    assert secret_scan.spans("", coder) == [] and secret_scan.spans("AKIAABCDEFGHIJK passwd=1234567 deadbeef", coder) == []
    assert secret_scan.base_spans("paſſword=abcdefghij") == []


def test_random_strings_and_what_is_known(coder):
    assert "random" in secret_scan.listed(secret_scan.spans("key q7Zk2Xv9Lm4Rt8Wp3Ns6Yd1Hb5Jc0Gf end", coder))
    for fine in ("sha256-q7Zk2Xv9Lm4Rt8Wp3Ns6Yd1Hb5Jc0Gf", "123e4567-e89b-12d3-a456-426614174000", "getUserAccountById2Factory9",
                 "thisisalonginventedwordwithoutmeaning", "2024-01-01-10-20-30-40-50", "my_variable_name_2024_final"):
        assert secret_scan.spans(f"see {fine} there", coder) == [], fine


def test_random_letters_and_keys_joined_to_words(coder):
    rng = random.Random(5)

    def found(before, alphabet, n, after=""):
        value = "".join(rng.choice(alphabet) for _ in range(n))
        text = f"see {before}{value}{after} end"
        return any(k == 3 and a <= 4 + len(before) and b >= 4 + len(before) + n for a, k, b in secret_scan.spans(text, coder))
    letters, base62 = string.ascii_letters, string.ascii_letters + string.digits
    path = "configuration/production/database/connection="
    for case in (("", letters, 24), ("", base62, 20), (path, base62, 24), ("service-account-", base62, 32, "-production-eu-west")):
        assert sum(found(*case) for _ in range(200)) >= 190, case
    for fine in ("service/configuration/production/database/connection", "DELETE_CUSTOMER_RESPONSE_HANDLER", "logs/2024-01-01-10-20-30/part-00017",
                 "users/123e4567-e89b-12d3-a456-426614174000/profile", "=" * 40, "a" + "-=" * 20):
        assert secret_scan.spans(f"see {fine} there", coder) == [], fine
