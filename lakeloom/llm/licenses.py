"""License scan by ordered signature rules.

Rules are regular expressions over a text's words (A-Z lowered, one space between), made from a list of license
names and the ways in which texts mention a license. Each rule names words of which its matches must hold one, forms
that are written together with a version included; only rules of which a text has a word are run. Detections are resolved in order of priority: one that lies within the words of a
detection of higher priority, or of a longer one of the same, is suppressed.

Besides the rules there are base phrases: fixed sequences of words whose every place is reported, resolved by nothing.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import short_batches, utf8, words_of

# Base phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Label, gating words, and the name as a pattern over words.
NAMES = [
    ("mit", "mit", "(?:the )?mit(?: expat)?"),
    ("apache-2", "apache apachev apache2 apachev2", "apache(?: software)?(?: license)?(?: version| ?v)? ?2(?: 0)?"),
    ("apache-1.1", "apache apachev apache1 apachev1", "apache(?: software)?(?: license)?(?: version| ?v)? ?1 1"),
    ("apache-1.0", "apache apachev apache1 apachev1", "apache(?: software)?(?: license)?(?: version| ?v)? ?1 0"),
    ("gpl-3", "gnu", "gnu general public license(?: as published by the free software foundation)?(?: either)? (?:version|v) ?3(?: 0)?"),
    ("gpl-2", "gnu", "gnu general public license(?: as published by the free software foundation)?(?: either)? (?:version|v) ?2(?: 0)?"),
    ("gpl-3", "gplv3", "gplv3"),
    ("gpl-2", "gplv2", "gplv2"),
    ("gpl-3", "gpl gpl3", "gpl(?: version| v)? ?3(?: 0)?"),
    ("gpl-2", "gpl gpl2", "gpl(?: version| v)? ?2(?: 0)?"),
    ("gpl", "gnu", "gnu general public license"),
    ("gpl", "gnu", "gnu gpl"),
    ("lgpl-3", "lesser", "gnu lesser general public license (?:version|v) ?3(?: 0)?"),
    ("lgpl-2.1", "lesser", "gnu lesser general public license (?:version|v) ?2(?: 1)?"),
    ("lgpl", "lesser", "gnu lesser general public license"),
    ("lgpl", "lgpl lgplv lgpl2 lgpl3 lgplv2 lgplv3", "lgpl(?: version| ?v)?(?: ?[23](?: [01])?)?"),
    ("agpl-3", "affero", "gnu affero general public license(?: version| v)?(?: ?3(?: 0)?)?"),
    ("agpl-3", "agpl agplv agpl3 agplv3", "agpl(?: version| ?v)?(?: ?3(?: 0)?)?"),
    ("fdl", "documentation", "gnu free documentation license(?: version)?(?: 1 [123])?"),
    ("bsd-2", "bsd", "(?:2 clause|simplified|freebsd) bsd"),
    ("bsd-2", "bsd", "bsd 2 clause"),
    ("bsd-3", "bsd", "(?:3 clause|new|modified|revised) bsd"),
    ("bsd-3", "bsd", "bsd 3 clause"),
    ("bsd-4", "bsd", "(?:4 clause|original) bsd"),
    ("bsd-0", "0bsd", "0bsd"),
    ("bsd", "bsd", "bsd style"),
    ("mpl-2", "mozilla", "mozilla public license(?: version| v)? ?2(?: 0)?"),
    ("mpl-1.1", "mozilla", "mozilla public license(?: version| v)? ?1 1"),
    ("mpl", "mozilla", "mozilla public license"),
    ("mpl-2", "mpl mplv mpl2 mplv2", "mpl(?: version| ?v)? ?2(?: 0)?"),
    ("epl-2", "eclipse", "eclipse public license(?: version| v)? ?2(?: 0)?"),
    ("epl-1", "eclipse", "eclipse public license(?: version| v)? ?1(?: 0)?"),
    ("eupl-1.2", "eupl", "eupl(?: version| v)?(?: 1 2)?"),
    ("eupl-1.2", "european", "european union public licen[cs]e(?: version| v)?(?: 1 2)?"),
    ("cddl-1", "cddl", "cddl(?: version| v)?(?: 1 [01])?"),
    ("cddl-1", "distribution", "common development and distribution license(?: version| v)?(?: 1 [01])?"),
    ("cpl-1", "common", "common public license(?: version| v)?(?: 1 0)?"),
    ("isc", "isc", "isc"),
    ("zlib", "zlib", "zlib(?: libpng)?"),
    ("bsl-1", "boost", "boost software license(?: version| v)?(?: 1 0)?"),
    ("artistic-2", "artistic", "artistic license(?: version| v)? ?2(?: 0)?"),
    ("artistic-1", "artistic", "artistic license(?: version| v)? ?1(?: 0)?"),
    ("unlicense", "unlicense", "(?:the )?unlicense"),
    ("wtfpl", "wtfpl", "wtfpl(?: version| v)?(?: 2)?"),
    ("psf-2", "python", "python software foundation license(?: version| v)?(?: 2)?"),
    ("php-3", "php", "php license(?: version| v)?(?: 3(?: 01?)?)?"),
    ("ruby", "ruby", "ruby license"),
    ("openssl", "openssl", "openssl license"),
    ("postgresql", "postgresql", "postgresql licen[cs]e"),
    ("ofl-1.1", "sil", "sil open font license(?: version| v)?(?: 1 1)?"),
    ("odbl-1", "database", "open database license(?: version| v)?(?: 1 0)?"),
    ("odbl-1", "odbl", "odbl(?: version| v)?(?: 1 0)?"),
    ("cc0", "cc0", "(?:cc )?cc0(?: 1 0)?(?: universal)?"),
    ("cc-by", "cc", "cc by(?: [1-4] [05])?"),
    ("cc-by-sa", "cc", "cc by sa(?: [1-4] [05])?"),
    ("cc-by-nd", "cc", "cc by nd(?: [1-4] [05])?"),
    ("cc-by-nc", "cc", "cc by nc(?: [1-4] [05])?"),
    ("cc-by-nc-sa", "cc", "cc by nc sa(?: [1-4] [05])?"),
    ("cc-by-nc-nd", "cc", "cc by nc nd(?: [1-4] [05])?"),
    ("cc-by", "creative", "creative commons attribution(?: [1-4] [05])?(?: international| unported)?"),
    ("cc-by-sa", "creative", "creative commons attribution share ?alike(?: [1-4] [05])?(?: international| unported)?"),
    ("cc-by-nd", "creative", "creative commons attribution no ?deriv(?:ative)?s(?: [1-4] [05])?(?: international| unported)?"),
    ("cc-by-nc", "creative", "creative commons attribution non ?commercial(?: [1-4] [05])?(?: international| unported)?"),
    ("cc-by-nc-sa", "creative", "creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?(?: international| unported)?"),
    ("cc-by-nc-nd", "creative", "creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: [1-4] [05])?(?: international| unported)?"),
]

# Ways to mention a license, with priority and score. Higher priorities are resolved first.
WAYS = [
    ("identifier", 90, 1.0, "spdx license identifier {name}(?: only| or later)?"),
    ("terms", 80, 0.99, "(?:licensed|released|distributed|published|available|provided|redistributed|modified|used) under (?:the )?(?:terms (?:and conditions )?of )?(?:the )?{name}(?: licen[cs]e)?(?: only| or later| or any later version)?"),
    ("governed", 70, 0.95, "(?:governed by|subject to|covered by|in accordance with|under) (?:the )?(?:terms (?:and conditions )?of )?(?:the )?{name}(?: licen[cs]e)?"),
    ("field", 60, 0.9, "licen[cs]e (?:is )?(?:the )?{name}(?: licen[cs]e)?"),
    ("name", 50, 0.8, "{name} licen[cs]e"),
]
# Names that say enough by themselves; the others are words of many meanings.
ALONE = ("full-name", 40, 0.6, "{name}")
AMBIGUOUS = {"mit", "isc", "zlib", "bsd", "ruby", "unlicense"}

# Rules without a license's name. Label, gating words, priority, score, pattern.
NOTICES = [
    ("all-rights-reserved", "reserved", 30, 0.7, "all rights reserved"),
    ("all-rights-reserved", "reservados", 30, 0.7, "todos los derechos reservados"),
    ("all-rights-reserved", "réservés", 30, 0.7, "tous droits réservés"),
    ("all-rights-reserved", "vorbehalten", 30, 0.7, "alle rechte vorbehalten"),
    ("public-domain", "domain", 30, 0.7, "(?:released |dedicated )?(?:in|into|to) the public domain"),
    ("proprietary", "proprietary", 30, 0.6, "proprietary and confidential"),
    ("mit", "granted", 85, 1.0, "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("isc", "granted", 85, 1.0, "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "redistribution", 85, 0.95, "redistribution and use in source and binary forms with or without modification are permitted"),
    ("unlicense", "unencumbered", 85, 1.0, "this is free and unencumbered software released into the public domain"),
    ("copyright-notice", "copyright", 20, 0.4, "copyright (?:c )?(?:19|20)[0-9][0-9]"),
]


@dataclass(frozen=True)
class Rule:
    name: str
    label: str
    words: frozenset[bytes]
    priority: int
    score: float
    pattern: re.Pattern


def rules() -> list[Rule]:
    """All rules, highest priority first; of one priority in the order of the lists."""
    found = []

    def add(name: str, label: str, words: str, priority: int, score: float, pattern: str) -> None:
        found.append(Rule(name, label, frozenset(words.encode().split()), priority, score, re.compile(f"(?<= ){pattern}(?= )".encode())))

    for i, (label, gates, name) in enumerate(NAMES):
        ways = WAYS if label in AMBIGUOUS else [*WAYS, ALONE]
        for way, priority, score, pattern in ways:
            add(f"{way}:{label}:{i}", label, gates, priority, score, pattern.replace("{name}", f"(?:{name})"))
    for i, (label, gates, priority, score, pattern) in enumerate(NOTICES):
        add(f"notice:{label}:{i}", label, gates, priority, score, pattern)
    return sorted(found, key=lambda r: -r.priority)


def resolve(detections: list[tuple[int, int, Rule]]) -> list[tuple[int, int, Rule]]:
    """Detections (first word, word past the last, rule) that lie within no better one, in order of place.

    Better is a higher priority, then a longer span, then an earlier place, then the earlier rule. What is kept never
    nests, so starts and ends of the kept ones grow together and one search tells whether one of them contains a span.
    """
    starts: list[int] = []
    ends: list[int] = []
    kept: list[tuple[int, int, Rule]] = []
    furthest: list[int] = []
    for priority in sorted({r.priority for _, _, r in detections}, reverse=True):
        level = [d for d in detections if d[2].priority == priority]
        level.sort(key=lambda d: (d[0], -d[1]))
        best_end, new = -1, []
        for start, end, rule in level:
            if end <= best_end:
                continue
            best_end = end
            at = bisect_left(starts, start + 1)
            if at and furthest[at - 1] >= end:
                continue
            new.append((start, end, rule))
        kept = sorted([*kept, *new], key=lambda d: (d[0], -d[1]))
        starts = [d[0] for d in kept]
        ends = [d[1] for d in kept]
        furthest = np.maximum.accumulate(ends).tolist() if ends else []
    return kept


class Scanner:
    def __init__(self, base: dict[str, str]):
        self.rules = rules()
        self.words = frozenset().union(*(r.words for r in self.rules))
        self.base = [(f" {phrase} ".encode(), label, [w.encode() for w in phrase.split()]) for phrase, label in sorted(base.items())]
        self.known = self.words.union(*(words for _, _, words in self.base)) if base else self.words

    def scan(self, text: bytes) -> tuple[int, list[tuple[str, int]], list[tuple[int, int, Rule]]]:
        """Number of words, base places (label, first word), and the detections that stay."""
        words = words_of(text)
        present = self.known.intersection(words)
        if not present:
            return len(words), [], []
        line = b" " + b" ".join(words) + b" "
        base, spans = [], []
        for phrase, label, needed in self.base:
            if present.issuperset(needed):
                at = line.find(phrase)
                while at >= 0:
                    base.append((label, at))
                    at = line.find(phrase, at + 1)
        for rule in self.rules:
            if not present.isdisjoint(rule.words):
                spans.extend((m.start(), m.end(), rule) for m in rule.pattern.finditer(line))
        if not base and not spans:
            return len(words), [], []
        gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
        number = lambda at: int(np.searchsorted(gaps, at, side="left"))
        base = sorted((number(at), label) for label, at in base)
        spans = [(number(a) - 1, number(b), rule) for a, b, rule in spans]
        return len(words), [(label, at) for at, label in base], resolve(spans)


SCANNED = (
    "doc_id long, n_words long, base array<struct<label:string,word:long>>, "
    "found array<struct<label:string,rule:string,first:long,past:long,score:double>>"
)


def _scan(base: dict[str, str]):
    base_kind = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))
    found_kind = pa.list_(
        pa.struct([("label", pa.string()), ("rule", pa.string()), ("first", pa.int64()), ("past", pa.int64()), ("score", pa.float64())])
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(base)
        for batch in batches:
            data, offsets = utf8(batch[1])
            raw, offsets = data.tobytes(), offsets.tolist()
            rows = [scanner.scan(raw[a:b]) for a, b in zip(offsets, offsets[1:], strict=False)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch[0],
                    pa.array([n for n, _, _ in rows], pa.int64()),
                    pa.array([[{"label": x, "word": at} for x, at in base] for _, base, _ in rows], base_kind),
                    pa.array(
                        [[{"label": r.label, "rule": r.name, "first": a, "past": b, "score": r.score} for a, b, r in found] for _, _, found in rows],
                        found_kind,
                    ),
                ],
                ["doc_id", "n_words", "base", "found"],
            )

    return run


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: dict[str, str] | None = None) -> DataFrame:
    """One row per document: doc_id, n_words, base places and the detections that stay, each with its span in words.

    Null and empty texts have no words and no detections; repeated rows are scanned alike; an empty table gives no rows.
    Other columns are not read.
    """
    short_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_scan(BASE if base is None else base), SCANNED)
