"""Periodic runs against a scan of every period, and the query against the contract written out plainly."""

from __future__ import annotations

import random
import re
import zlib
from fractions import Fraction
from hashlib import sha256

import pytest
from conftest import SMALL
from odd_tables import nothing, odd, odd_rows  # noqa: F401

from lakeloom.llm import periodicity, queries


def plain(words, min_length=24, min_exponent=3):
    """Every period, every stretch of words that equal those one period on."""
    n, found = len(words), {}
    for p in range(1, n // min_exponent + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j > i and j - i + p >= max(min_length, min_exponent * p):
                found.setdefault((i, j - i + p), p)
            i = j + 1
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda r: (r[0], r[2]))


def patchwork(draw):
    words = []
    letters = "abcde"[: draw.choice([1, 2, 3, 5])]
    while len(words) < draw.randint(0, 200):
        if draw.random() < 0.5:
            part = [draw.choice(letters).encode() for _ in range(draw.randint(1, 9))]
            words += (part * draw.randint(1, 14))[: draw.randint(1, 80)]
        else:
            words += [draw.choice("abcdefgh").encode() for _ in range(draw.randint(0, 9))]
    return words


@pytest.mark.parametrize(("min_length", "min_exponent"), [(24, 3), (6, 2), (1, 2), (10, 4)])
def test_runs_of_many_texts(min_length, min_exponent):
    draw = random.Random(min_length)
    docs = [patchwork(draw) for _ in range(300)] + [[], [b"a"], [b"a"] * 24, [b"a"] * 23, [b"a", b"b"] * 12]
    got = periodicity.find_runs(docs, min_length, min_exponent)
    assert [[tuple(r) for r in g.tolist()] for g in got] == [plain(d, min_length, min_exponent) for d in docs]
    assert sum(map(len, got)) > 50


def test_equal_texts_beside_each_other_make_no_run():
    part = [b"w%d" % i for i in range(30)]
    assert [len(r) for r in periodicity.find_runs([part] * 5)] == [0] * 5
    assert [r.tolist() for r in periodicity.find_runs([part * 3] * 2)] == [[[0, 90, 30]]] * 2


def test_long_texts_of_one_word_and_of_one_passage():
    assert periodicity.find_runs([[b"a"] * 100_000])[0].tolist() == [[0, 100_000, 1]]
    passage = [b"x%d" % i for i in range(16)]
    apart = [w for i in range(5000) for w in (b"w%d" % i, *passage)]
    assert len(periodicity.find_runs([apart])[0]) == 0


def test_odd_rows(spark, odd, odd_rows, nothing):
    got = periodicity.runs(odd, chunk_words=50)
    assert got.columns == ["doc_id", "n_words", "runs", "text"]
    want = [(i, len((t or "").split()), plain((t or "").encode().split()), " ".join(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t, *_ in odd_rows]
    assert sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.text) for r in got.collect()), key=str) == sorted(want, key=str)
    assert periodicity.runs(nothing).count() == 0
    with pytest.raises(ValueError):
        periodicity.runs(odd, min_exponent=1)


def test_words_behind_the_first_period_are_dropped(spark):
    text = "one " + "a b c " * 10 + "two " + "d " * 30 + "three"
    [row] = periodicity.runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert [tuple(r) for r in row.runs] == [(1, 30, 3), (32, 30, 1)]
    assert row.text == "one a b c two d three"


def contract(name, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(name).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = plain(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (name, len(runs), *best, 1000 * best[1] // best[2] if runs else None, *(sha256(x.encode()).hexdigest() for x in (lines, kept)))


def test_query_against_the_contract(spark):
    columns = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = queries.QUERIES["op12_periodic_runs"](spark, SMALL)
    assert got.columns == columns
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(tuple(r) for r in got.collect()) == sorted(contract(*r) for r in docs)
    assert got.where("n_runs > 0").count() > 10
