"""SimHash, BPE, contamination, licenses and sharding against plain versions of themselves, on odd inputs."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from conftest import SMALL
from odd_tables import nothing, odd, odd_rows  # noqa: F401
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lakeloom.llm import bpe, contamination, licenses, queries, sharding, simhash

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def lowered(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))


def grouped(nodes, linked):
    parent = {n: n for n in nodes}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = sorted((top(a), top(b)))
        parent[b] = a
    return {n: top(n) for n in nodes}


# SimHash


def plain_simhash(text, size=3):
    found = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
    shingles = [" ".join(found[i : i + size]) for i in range(len(found) - size + 1)] or ([" ".join(found)] if found else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_and_groups(spark, odd, odd_rows):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == len(odd_rows)
    prints = [(r[0], plain_simhash(r[1])) for r in odd_rows]
    assert Counter((r.doc_id, r.fingerprint) for r in got) == Counter((i, f"{p:016x}") for i, p in prints)
    values = sorted({p for _, p in prints})
    near = [(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= 3]
    group = grouped(values, near)
    least = defaultdict(list)
    for i, p in prints:
        least[group[p]].append(i)
    expected = Counter((i, min((x for x in least[group[p]] if x is not None), default=None)) for i, p in prints)
    assert Counter((r.doc_id, r.component_id) for r in got) == expected


def test_no_documents(spark, nothing):
    assert simhash.near_duplicates(nothing).collect() == []


@pytest.mark.parametrize("shard_rows", [2, 256])
def test_links_join_what_is_within_the_radius(spark, shard_rows):
    """Random fingerprints, chains of near ones, and a crowded ball, with shards that are cut again and that are not."""
    rng = np.random.default_rng(5)
    values = list(rng.integers(0, 1 << 64, 400, dtype=np.uint64))
    for start in values[:40]:
        for _ in range(4):
            flips = rng.choice(64, rng.integers(1, 5), replace=False)
            values.append(np.uint64(int(start) ^ sum(1 << int(b) for b in flips)))
    values += [np.uint64((1 << int(a)) | (1 << int(b))) for a in range(20) for b in range(20)]
    values = sorted({int(v) for v in values})
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    nodes = spark.createDataFrame([(v,) for v in signed], "fp long")
    got = simhash.links(nodes, shard_rows=shard_rows).collect()
    near = [(signed[i], signed[j]) for i in range(len(values)) for j in range(i) if (values[i] ^ values[j]).bit_count() <= 3]
    assert grouped(signed, [(r.a, r.b) for r in got]) == grouped(signed, near)


@given(st.lists(st.integers(0, 2**16), max_size=60), st.integers(0, 6), st.integers(0, 2**16))
@settings(max_examples=60, deadline=None)
def test_bk_tree_finds_all(values, radius, wanted):
    tree = simhash.BKTree()
    for value in values:
        tree.add(value)
    assert sorted(tree.within(wanted, radius)) == sorted({v for v in values if (v ^ wanted).bit_count() <= radius})


# BPE


def test_ids_and_text_are_the_librarys(spark, odd, odd_rows):
    library = Tokenizer.from_file(VOCABULARY)
    got = queries.tokenized(odd, VOCABULARY).collect()
    expected = []
    for doc_id, text, *_ in odd_rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        digest = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        expected.append((doc_id, len(ids), digest, hashlib.sha256(back.encode()).hexdigest()))
    assert Counter(map(tuple, got)) == Counter(expected)


def test_small_table_is_encoded_as_the_library_does(spark):
    library = Tokenizer.from_file(VOCABULARY)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    ids = {r.doc_id: r.ids for r in bpe.encode(docs, VOCABULARY, chunk_chars=20_000).collect()}
    assert ids == {r.doc_id: library.encode(r.text, add_special_tokens=False).ids for r in docs.collect()}


def test_encoding_no_documents(spark, nothing):
    assert queries.tokenized(nothing, VOCABULARY).collect() == []


VOCABULARY_ARRAYS = bpe.Vocabulary(VOCABULARY)
LIBRARY = Tokenizer.from_file(VOCABULARY)
ENCODER = bpe.Encoder(VOCABULARY_ARRAYS, kept_ids=2000)


@given(st.lists(st.text(st.sampled_from("aab'strevmldé \n\t 　x1²😀!<|endoftext|>"), max_size=40), max_size=6))
@settings(max_examples=150, deadline=None)
def test_any_text(batch):
    batch = [*batch, "a" * 37, "x<|endoftext|>y", "".join(batch)]
    ids, offsets = ENCODER.encode(batch)
    for i, text in enumerate(batch):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == LIBRARY.encode(text, add_special_tokens=False).ids
        assert bpe.decode_ids(ids[offsets[i] : offsets[i + 1]].tolist(), VOCABULARY_ARRAYS) == text


# Contamination


def plain_contamination(docs, items, size=13):
    windows = defaultdict(set)
    for name, text in items:
        found = words(text)
        width = min(size, len(found))
        for i in range(len(found) - width + 1 if width else 0):
            windows[tuple(found[i : i + width])].add("" if name is None else str(name))
    for doc_id, text in docs:
        found, hit, names = words(text), set(), set()
        for width in {len(w) for w in windows}:
            for i in range(len(found) - width + 1):
                if own := windows.get(tuple(found[i : i + width])):
                    names |= own
                    hit.update(range(i, i + width))
        yield doc_id, len(found), len(hit), tuple(sorted(names))


@pytest.mark.parametrize("block_words", [1_000_000, 40])
def test_hits_and_items(spark, odd, odd_rows, block_words):
    one, two, long = odd_rows[0][1], odd_rows[2][1], odd_rows[10][1]
    items = [
        (10, " ".join(one.split()[5:40])),
        (9, " ".join(one.split()[30:44]).upper()),
        (None, "ONE-Two"),
        (7, " ".join(two.split()[:13])),
        (8, " ".join(two.split()[:12] + ["other"])),
        (6, " ".join(long.split()[20_000:20_100])),
        (6, " ".join(long.split()[10:30])),
        (5, None),
        (4, "..."),
        (3, "the"),
    ]
    benchmark = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, doc_id string")
    got = contamination.contamination(odd, benchmark, block_words=block_words).collect()
    expected = Counter(plain_contamination([(r[0], r[1]) for r in odd_rows], items))
    assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in got) == expected
    for r in got:
        assert len({w for a, b in zip(r.starts, r.ends, strict=True) for w in range(a, b)}) == r.n_hit


def test_no_benchmark_and_no_documents(spark, odd, nothing):
    benchmark = spark.createDataFrame([], "item_id long, text string")
    assert {r.n_hit for r in contamination.contamination(odd, benchmark).collect()} == {0}
    some = spark.createDataFrame([(1, "the")], "item_id long, text string")
    assert contamination.contamination(nothing, some).collect() == []


def test_proximity(spark):
    item = "a b c d e f g h i j k l m".split()
    texts = {
        1: item,
        2: [*item[:4], "x", "y", *item[4:]],
        3: [*item[:4], "x", "y", "z", "w", *item[4:]],
        4: item[::-1],
        5: [*item[:6], "x", *item[6:], "m"],
    }
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string")
    benchmark = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    near = {r.doc_id: r.n_hit for r in contamination.contamination(docs, benchmark, slop=2).collect()}
    assert near == {1: 13, 2: 15, 3: 0, 4: 0, 5: 14}


# Licenses


def test_every_place_of_the_base_phrases(spark, odd_rows):
    texts = [
        "Under the MIT-License! under the mit license",
        "cc by nc cc by-nc/sa. Apache License, Version 2.0",
        "see the mit (license) under",
        None,
        "",
        "All rights reserved. " * 3000 + "Licensed under CC BY-NC 4.0.",
        "mit " * 20_000,
    ]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_words string")
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        found = words(text)
        base = sorted(
            (at, label)
            for phrase, label in licenses.BASE.items()
            for at in range(len(found))
            if found[at : at + len(phrase.split())] == phrase.split()
        )
        assert [(b.word, b.label) for b in got[i].base] == base
        assert got[i].n_words == len(found)
    assert {f.label for f in got[0].found} == {"mit"}
    assert {f.label for f in got[1].found} == {"cc-by-nc", "cc-by-nc-sa", "apache-2"}
    assert {f.label for f in got[5].found} == {"all-rights-reserved", "cc-by-nc"}


def test_a_contained_detection_is_suppressed():
    rule = lambda label, priority: licenses.Rule(label, label, b"", priority, 1.0, re.compile(b""))
    high, low = rule("high", 9), rule("low", 1)
    found = [(0, 10, low), (2, 5, high), (3, 4, high), (3, 4, low), (4, 6, high), (4, 5, low), (20, 22, low), (20, 21, low)]
    assert [(a, b, r.label) for a, b, r in licenses.resolve(found)] == [(0, 10, "low"), (2, 5, "high"), (4, 6, "high"), (20, 22, "low")]


@given(st.lists(st.tuples(st.integers(0, 30), st.integers(1, 8), st.integers(1, 3)), max_size=25))
@settings(max_examples=100, deadline=None)
def test_resolve_keeps_what_nothing_better_contains(spans):
    by_priority = {p: licenses.Rule(str(p), str(p), b"", p, 1.0, re.compile(b"")) for p in (1, 2, 3)}
    found = [(a, a + n, by_priority[p]) for a, n, p in spans]
    best = sorted(set(found), key=lambda d: (-d[2].priority, -(d[1] - d[0]), d[0]))
    kept = []
    for d in best:
        if not any(k[0] <= d[0] and d[1] <= k[1] for k in kept):
            kept.append(d)
    assert sorted(licenses.resolve(found), key=lambda d: d[:2]) == sorted(kept, key=lambda d: d[:2])


def alternatives(pattern):
    """Every text that a pattern of words matches; of a class of characters the first and the last."""
    texts, at = [""], 0
    while at < len(pattern):
        if pattern.startswith("(?:", at):
            depth, end, parts = 1, at + 3, [""]
            while depth:
                depth += {"(": 1, ")": -1}.get(pattern[end], 0)
                if depth == 1 and pattern[end] == "|":
                    parts.append("")
                elif depth:
                    parts[-1] += pattern[end]
                end += 1
            unit = [t for part in parts for t in alternatives(part)]
        elif pattern[at] == "[":
            end = pattern.index("]", at) + 1
            unit = [pattern[at + 1], pattern[end - 2]]
        else:
            unit, end = [pattern[at]], at + 1
        if pattern[end : end + 1] == "?":
            unit, end = ["", *unit], end + 1
        texts, at = [a + b for a in texts for b in unit], end
    return texts


def test_gates_lose_no_match():
    """Detections are those of all rules run on the text, for every form of every name in every way, and of every notice."""
    scanner = licenses.Scanner(licenses.BASE)
    ways = [pattern for *_, pattern in [*licenses.WAYS, licenses.ALONE]]
    texts = [alternatives(way)[-1].replace("{name}", form) for *_, name in licenses.NAMES for form in alternatives(name) for way in ways]
    texts += [form for *_, notice in licenses.NOTICES for form in alternatives(notice)]
    assert len(texts) > 5000
    for rule in scanner.rules:
        assert rule.words
    for text in set(texts):
        line = f" {text} ".encode()
        spans = [(line.count(b" ", 0, m.start()) - 1, line.count(b" ", 0, m.end()), r) for r in scanner.rules for m in r.pattern.finditer(line)]
        assert scanner.scan(text.encode())[2] == licenses.resolve(spans), text


@pytest.mark.parametrize(
    ("text", "label"),
    [
        ("Licensed under GPL3.", "gpl-3"),
        ("licensed under gpl2", "gpl-2"),
        ("licensed under LGPL3", "lgpl"),
        ("licensed under LGPLv2.1", "lgpl"),
        ("LGPLv3", "lgpl"),
        ("AGPL3", "agpl-3"),
        ("released under the AGPLv3 license", "agpl-3"),
        ("MPL2", "mpl-2"),
        ("under the MPLv2", "mpl-2"),
        ("Apache2 license", "apache-2"),
        ("ApacheV2", "apache-2"),
    ],
)
def test_names_written_together_with_a_version(text, label):
    assert [rule.label for *_, rule in licenses.Scanner(licenses.BASE).scan(text.encode())[2]] == [label]


def test_scanning_no_documents(spark, nothing):
    assert licenses.scan(nothing).collect() == []


# Sharding


@pytest.mark.parametrize("buckets", [2, 4096])
def test_shards(spark, odd, odd_rows, buckets):
    rows = odd
    for _ in range(4):
        rows = rows.union(odd)
    got = sharding.interleave(rows, shards=7, buckets=buckets).collect()
    total = 5 * len(odd_rows)
    assert len(got) == total
    counts = Counter(r.shard for r in got)
    assert set(counts) == set(range(7)) and max(counts.values()) - min(counts.values()) <= 1
    for shard in counts:
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(counts[shard]))
    for stratum in {r.stratum for r in got}:
        held = Counter(r.shard for r in got if r.stratum == stratum)
        even = sum(held.values()) / 7
        assert all(abs(held[s] - even) < 2 for s in range(7))
    facts = lambda t: (len((t or "").encode()) + 16, zlib.crc32((t or "").encode()))
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((r[0], *facts(r[1])) for r in odd_rows * 5)


def test_shards_do_not_depend_on_partitions(spark, odd):
    place = lambda df: Counter((r.doc_id, r.text_crc32, r.shard, r.slot) for r in sharding.interleave(df, 3).collect())
    assert place(odd) == place(odd.repartition(5, F.col("part")).coalesce(1))


def test_small_sources_are_spread_over_all_shards(spark):
    """A third of the rows in sources of one and two rows: every shard has its share of them and of the large source."""
    rows = [(i, "t", "large") for i in range(2000)] + [(5000 + i, "t", f"one-{i}") for i in range(600)] + [(9000 + i, "t", f"two-{i // 2}") for i in range(600)]
    got = sharding.interleave(spark.createDataFrame(rows, "doc_id long, text string, source string"), shards=8).collect()
    for group, total in (("large", 2000), ("one", 600), ("two", 600)):
        held = Counter(r.shard for r in got if r.stratum.startswith("=" + group))
        assert set(held) == set(range(8)) and all(abs(n - total / 8) < total / 16 for n in held.values())


def test_rows_without_an_id_are_spread_over_the_buckets(spark):
    rows = spark.range(500).selectExpr("cast(null as bigint) AS doc_id", "cast(id as string) AS text", "'a' AS source")
    got = [r.slot * 4 + r.shard for r in sorted(sharding.interleave(rows, shards=4, buckets=64).collect(), key=lambda r: int(r.text_crc32))]
    assert len(set(got)) == 500 and got != sorted(got)


def test_fewer_rows_than_shards(spark, odd, nothing):
    got = sharding.interleave(odd.where("doc_id in (1, 2)"), shards=40).collect()
    assert len(got) == 2 and {r.slot for r in got} == {0}
    assert sharding.interleave(nothing).collect() == []
