"""Secrets in texts: three fixed rules, and strings that a tokenizer finds incompressible.

A byte-pair vocabulary spends few tokens on words and many on random strings. A long run of key
characters with fewer than ``MAX_RATIO`` characters per token is therefore reported as ``random``. What
a rule has found, known digests and identifiers are taken out of a run first. The rest is judged as a
whole, by its parts between ``/ = _ -`` and by windows of ``MIN_RUN`` characters, so a key joined to
readable text is found. Nothing but the ratio decides: a string of letters is judged like any other.

Measured recall of 2,000 random strings each, of 20 / 24 / 40 characters: base62 99.9 / 99.95 / 100 %,
base64 99.8 / 99.95 / 100 %, letters of both cases 98.7 / 99.4 / 100 %, capitals 90.2 / 95.6 / 99.6 %, small
letters 69.2 / 78.2 / 94.1 % (their ratio is often above the limit). Base62 behind a readable path of 43
characters: 20 characters 99.7 %, 24 characters 100 %.

Spans are in code points, the end exclusive. Defined cases: a null or empty text has no spans; a text
of any length is scanned whole; rows that repeat an id are scanned each by itself; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_left, bisect_right
from collections import deque
from collections.abc import Iterable, Iterator
from itertools import takewhile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The rules of the base kinds, in the order in which kinds are listed.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 8, 16, 32
# End of fixed values.

RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
MIN_RUN, MAX_RATIO = 20, 1.8
#: What looks random and is public: digests by name or by length, UUIDs, numbers with separators. Each stands
#: alone, with no letter or digit before or after it; a named digest is at most as long as in hex.
KNOWN = re.compile(r"(?i)(?<![a-z0-9])(?:" + "|".join(rf"{name}[-_=][a-z0-9+/_-]{{1,{n}}}={{0,2}}" for name, n in (
    ("md5", 32), ("sha1", 40), ("sha224", 56), ("sha256", 64), ("sha384", 96), ("sha512", 128))) + "|(?:" + "|".join(
    [rf"[0-9a-f]{{{n}}}" for n in (32, 40, 56, 64, 96, 128)] + [r"[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}", r"[0-9+/_=-]{8,}"]) + ")(?![a-z0-9]))")
#: Words in capitals are judged in small letters, of which the vocabulary knows more.
CONSTANT = re.compile(r"[A-Z]+(?:[_-][A-Z]+)+")
PART = re.compile(r"[^/=_-]+")
#: Characters encoded at once: a longer stretch of letters costs the vocabulary the square of its length.
STRETCH = 1024
_ENCODINGS: dict[str, object] = {}


def encoding(path: str):
    """The tiktoken encoding of a file of ranks, once for each Python worker."""
    if path not in _ENCODINGS:
        import public_tokenizers
        import tiktoken
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
        _ENCODINGS[path] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[path]


def base_spans(text: str, long_runs: bool = True) -> list[tuple[int, int, int]]:
    """``start, kind, end`` by the three rules. ``long_runs`` False: the text has no run of ``MIN_RUN`` characters."""
    found = []
    lowered = text.lower()
    if any(word in lowered for word in ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    if long_runs:
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= MIN_HEX]
    return found


def token_ends(run: str, coder) -> np.ndarray:
    """Zero and the end of every token of ``run``, which is ASCII."""
    sizes = [len(x) for at in range(0, len(run), STRETCH) for x in coder.decode_tokens_bytes(coder.encode_ordinary(run[at:at + STRETCH]))]
    return np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])


def _dense(run: str, coder) -> list[tuple[int, int]]:
    """The stretches of ``run`` in windows of whole tokens, ``MIN_RUN`` characters or just over, with too many tokens."""
    ends = token_ends(run, coder)
    if len(run) < MAX_RATIO * (len(ends) - 1):
        return [(0, len(run))]
    last = np.searchsorted(ends, ends[:-1] + MIN_RUN)
    first = np.flatnonzero(last < len(ends))
    last = last[first]
    hot = ends[last] - ends[first] < MAX_RATIO * (last - first)
    return list(zip(ends[first[hot]].tolist(), ends[last[hot]].tolist(), strict=True))


def random_spans(run: str, coder) -> list[tuple[int, int]]:
    """Incompressible stretches of ``run``: the run itself, a part between ``/ = _ -``, or windows in it.

    A stretch found by windows is widened to the parts that it lies in.
    """
    if CONSTANT.fullmatch(run):
        run = run.lower()
    found = _dense(run, coder)
    if found == [(0, len(run))]:
        return found
    parts = [m.span() for m in PART.finditer(run)]
    for start, end in parts:
        if MIN_RUN <= end - start < len(run):
            found += [(start + a, start + b) for a, b in _dense(run[start:end], coder)]
    lows, highs = [low for low, _ in parts], [high for _, high in parts]
    merged: list[tuple[int, int]] = []
    for start, end in sorted(found):
        i, j = bisect_right(highs, start), bisect_left(lows, end) - 1
        if i > j:
            continue
        start, end = lows[i], highs[j]
        if merged and start <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(merged[-1][1], end))
        else:
            merged.append((start, end))
    return [(start, end) for start, end in merged if end - start >= MIN_RUN]


def spans(text: str, coder) -> list[tuple[int, int, int]]:
    """``start, kind, end`` of everything found, in order."""
    long_runs = any(len(word) >= MIN_RUN for word in text.split())
    base = base_spans(text, long_runs)
    found = list(base)
    if long_runs:
        taken = deque(sorted((start, end) for start, _, end in base))
        for m in RUN.finditer(text):
            while taken and taken[0][1] <= m.start():
                taken.popleft()
            at, closed = m.start(), [k.span() for k in KNOWN.finditer(text, m.start(), m.end())]
            closed += takewhile(lambda x: x[0] < m.end(), taken)
            for start, end in [*sorted(closed), (m.end(), m.end())]:
                if start - at >= MIN_RUN:
                    found += [(at + a, 3, at + b) for a, b in random_spans(text[at:start], coder)]
                at = max(at, end)
    return sorted(found)


def listed(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in found)


def secret_spans(docs: DataFrame, ranks: str) -> DataFrame:
    """``doc_id, spans array<struct<kind, start, end, value>>`` of every row of ``docs(doc_id, text)``."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoding(ranks)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())]))
        for batch in batches:
            rows = [[{"kind": KINDS[k], "start": a, "end": b, "value": text[a:b]} for a, k, b in spans(text, coder)] if text else []
                    for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, kind)], ["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, spans array<struct<kind string, start long, end long, value string>>")


def secret_counts(docs: DataFrame, ranks: str) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` from :func:`secret_spans`."""
    found = secret_spans(docs, ranks)

    def text(array):
        return F.concat_ws(",", F.transform(array, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, KINDS[:3]), F.sha2(text(F.filter("spans", lambda s: s["kind"] != KINDS[3])), 256).alias("base_sha256"),
                        text(F.col("spans")).alias("spans"))
