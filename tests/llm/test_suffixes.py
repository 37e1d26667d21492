"""Repeated strings against counting every string, and the parts of the sort on their own."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from conftest import SMALL
from odd_tables import nothing, odd, odd_rows, prose  # noqa: F401

from lakeloom.llm import queries, suffixes


def plain(texts, length):
    """For each text its spans and what is kept, by a count of all strings."""
    bodies = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in bodies for i in range(len(b) - length + 1))
    out = []
    for body in bodies:
        gone = bytearray(len(body))
        for i in range(len(body) - length + 1):
            if seen[body[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        edges = [0, *(i for i in range(1, len(gone)) if gone[i] != gone[i - 1]), len(gone)]
        spans = [(a, b) for a, b in zip(edges, edges[1:], strict=False) if b > a and gone[a]]
        out.append((len(body), spans, bytes(x for x, g in zip(body, gone, strict=True) if not g)))
    return out


def found(docs, **options):
    rows = suffixes.remove_repeats(docs, **options).collect()
    return sorted(((r.doc_id, r.n_bytes, [tuple(s) for s in r.spans], bytes(r.kept)) for r in rows), key=str)


def wanted(rows, length=200):
    return sorted(((i, *x) for (i, _), x in zip(rows, plain([t for _, t in rows], length), strict=True)), key=str)


def test_differences_of_the_cover():
    assert {(a - b) % suffixes.PERIOD for a in suffixes.COVER for b in suffixes.COVER} == set(range(suffixes.PERIOD))
    for one in range(suffixes.PERIOD):
        for apart in range(suffixes.PERIOD):
            shift = int(suffixes.SHIFTS[one, apart])
            assert {(one + shift) % suffixes.PERIOD, (one + apart + shift) % suffixes.PERIOD} <= set(suffixes.COVER)


def mixture(draw, texts=60):
    shared = ["".join(draw.choices("abcdefgh", k=draw.randint(1, 300))) for _ in range(8)] + ["x" * 300, "ab" * 150]
    return ["".join(draw.choice([draw.choice(shared), "".join(draw.choices("abcdefgh", k=draw.randint(0, 40)))]) for _ in range(5)) for _ in range(texts)]


@pytest.mark.parametrize("length", [73, 100, 200])
def test_sorted_suffixes(length):
    texts = [t.encode() for t in mixture(random.Random(length)) if len(t) >= length]
    first = np.cumsum([0, *map(len, texts[:-1])])
    at = np.concatenate([np.arange(f, f + len(t) - length + 1) for f, t in zip(first, texts, strict=True)])
    raw = b"".join(texts)
    seen = Counter(raw[a : a + length] for a in at.tolist())
    got = suffixes.repeated_suffixes(np.frombuffer(raw, np.uint8), at, np.zeros(len(at), np.int64), length)
    assert got.tolist() == [a for a in at.tolist() if seen[raw[a : a + length]] > 1]


def test_ties_are_decided_by_the_cover():
    """Suffixes that share more bytes than are compared come out ordered by what follows."""
    body = b"q" * 90 + b"b" + b"q" * 90 + b"a" + b"q" * 90 + b"c" + b"z" * 100
    words = suffixes.words_at(np.frombuffer(body + bytes(600), np.uint8))
    at, start = suffixes.by_words(np.array([0, 91, 182]), np.zeros(3, np.int64), words, 72)
    assert start.tolist() == [0, 0, 0]
    assert suffixes.resolve_ties(at, start, words, 200).tolist() == [91, 0, 182]


@pytest.mark.parametrize("level", range(4))
def test_equal_strings_share_a_bucket(level):
    """Pieces hold each string once, and equal strings have equal buckets; equal names mean equal bytes."""
    parts = [t.encode() for t in mixture(random.Random(level)) if len(t) >= 200]
    buckets, names = {}, {}
    for part, columns in zip(parts, suffixes.Pieces(200, level).find(parts), strict=True):
        starts, windows, bucket, digest = (c.tolist() for c in columns)
        assert sum(windows) == len(part) - 199 and starts == np.r_[0, np.cumsum(windows)[:-1]].tolist()
        for s, w, b, d in zip(starts, windows, bucket, digest, strict=True):
            assert names.setdefault((b, d), part[s : s + w + 199]) == part[s : s + w + 199]
            for i in range(s, s + w):
                assert buckets.setdefault(part[i : i + 200], b) == b


def test_odd_rows(spark, odd, odd_rows, nothing):
    rows = [r[:2] for r in odd_rows]
    assert found(odd) == wanted(rows)
    assert found(odd, hashed_bytes=500) == wanted(rows)
    assert suffixes.remove_repeats(nothing).count() == 0
    assert suffixes.remove_repeats(nothing).columns == ["doc_id", "n_bytes", "spans", "kept"]
    with pytest.raises(ValueError):
        suffixes.remove_repeats(odd, length=40)


@pytest.mark.parametrize("seed", range(2))
def test_crowded_buckets_are_parted(spark, seed):
    """A line that all texts share, in ever other surroundings, and spans that part letters."""
    draw = random.Random(seed)
    line = prose(seed, 12)
    rows = [(i, f"{prose(100 + i, 30)} {line} {draw.choice(['é', 'è', 'e'])}{prose(500 + i % 7, 40)}") for i in range(60)]
    rows += [(100 + i, t) for i, t in enumerate(mixture(draw, 30))] + [(5, rows[3][1]), (None, rows[9][1][40:])]
    # Letters of several bytes, so that pieces begin and end inside them.
    rows += [(200 + i, "".join(draw.choices("日本語éжñ😀", k=90)) + "語é日" * 8 + "жñ" * draw.randint(60, 90)) for i in range(20)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert found(frame, crowd=2, sorted_bytes=5000) == wanted(rows)
    assert found(frame, length=90, crowd=3) == wanted(rows, 90)


def test_strings_inside_one_text(spark):
    rows = [(1, "0" * 1000), (2, prose(1, 60) + "!" + prose(1, 60)), (3, "1" * 200), (4, "2" * 201), (5, "3" * 199)]
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == wanted(rows)
    assert [len(x[3]) for x in wanted(rows)] == [0, 1, 200, 0, 199]


def test_settings_are_given_back(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    assert queries.QUERIES["op13_suffix_array_dedup"](spark, SMALL).count() == spark.read.parquet(f"{SMALL}/documents.parquet").count()
    assert spark.conf.get(key) == before
