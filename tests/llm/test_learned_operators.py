"""Toxicity and language: held-out accuracy, exact code lengths, and odd inputs."""

from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from conftest import SMALL
from odd_tables import nothing, odd, odd_rows, prose  # noqa: F401
from pyspark.sql import functions as F

from lakeloom.llm import langid, toxicity

MEDIUM = SMALL.replace("sf0.001", "sf0.01")


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{MEDIUM}/documents.parquet")


@pytest.fixture(scope="module")
def language_model(documents):
    return langid.learn(langid.kept_for_learning(documents).select("lang", "text"))


def plain_bits(model, data, language):
    """The code length byte by byte: the longest context known, an escape for each context without the byte."""
    which, total = model.languages.index(language), 0.0
    numbers = [{int(g): i for i, g in enumerate(grams)} for grams in model.grams]
    for i in range(len(data)):
        for size in range(min(model.order, i), -1, -1):
            gram = int.from_bytes(data[i - size : i + 1], "big")
            at = numbers[size].get(gram)
            if at is not None and not math.isnan(model.cost[size][at][which]):
                total += model.cost[size][at][which]
                break
            if size == 0:
                total += model.escape[0][0][which] + 8
            elif (context := numbers[size - 1].get(gram >> 8)) is not None:
                total += model.escape[size][context][which]
    return total


def test_code_lengths_are_exact(language_model, documents):
    trees = langid.Trees(language_model)
    samples = [r.text[:400] for r in documents.limit(6).collect()] + ["", "a", "zzqx €€ ☃ é\x00\x7f", "the"]
    raw = [s.encode().lower() for s in samples]
    offsets = np.r_[0, np.cumsum([len(r) for r in raw])]
    data = np.frombuffer(b"".join(raw), np.uint8)
    for chunk in (1_000_000, 64):
        langid.CHUNK, before = chunk, langid.CHUNK
        got = trees.lengths(data, offsets)
        langid.CHUNK = before
        for i, text in enumerate(raw):
            for j, language in enumerate(language_model.languages):
                assert got[i, j] == pytest.approx(plain_bits(language_model, text, language), rel=1e-4, abs=1e-3)


def test_probabilities_of_a_context_sum_to_one(language_model):
    """What is seen and what is escaped share the whole, in every context of every language."""
    for level in range(1, language_model.order + 1):
        grams, above = language_model.grams[level], language_model.grams[level - 1]
        share = np.zeros((len(above), len(language_model.languages)))
        np.add.at(share, np.searchsorted(above, grams >> 8), np.nan_to_num(np.exp2(-language_model.cost[level].astype(float))))
        known = language_model.escape[level] > 0
        left = np.exp2(-language_model.escape[level].astype(float))
        assert np.allclose((share + left)[known], 1, atol=1e-4)


def test_held_out_languages(language_model, documents):
    found = langid.identify(documents, language_model).join(documents.select("doc_id", "lang"), "doc_id")
    found = found.where(langid.held_out(F.col("doc_id"))).collect()
    assert len(found) > 100
    assert sum(r.lang == r.lang_pred for r in found) >= 0.98 * len(found)
    assert all(0 <= r.score <= 1 for r in found)


def test_odd_texts_have_languages(spark, language_model, odd, odd_rows, nothing):
    got = langid.identify(odd, language_model).collect()
    assert len(got) == len(odd_rows)
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    assert {by_id[i].lang_pred for i in (4, 5, 6, 7)} == {"und"} and by_id[4].score == 0
    assert by_id[1].lang_pred in language_model.languages
    assert langid.identify(nothing, language_model).collect() == []


def test_nothing_to_learn_languages_from(spark, odd, nothing):
    model = langid.learn(nothing.select("lang", "text"))
    assert {r.lang_pred for r in langid.identify(odd, model).collect()} == {"und"}
    one = langid.learn(odd.where("lang = 'de'").select("lang", "text"))
    assert {r.lang_pred for r in langid.identify(odd, one).collect()} == {"und", "de"}


def test_copies_are_sampled_once(spark):
    rows = [("en", f"copy {i % 10}") for i in range(3000)] + [("en", f"text {i}") for i in range(3000)] + [("de", "kurz"), ("de", None), (None, "x")]
    labelled = spark.createDataFrame(rows, "lang string, text string")
    got = [(r.lang, r.text) for r in langid.sample(labelled, 1000).collect()]
    assert len(got) == len(set(got)) and 850 < sum(x == "en" for x, _ in got) < 1150
    assert sorted(t for x, t in got if x == "de") == ["", "kurz"]


def test_draws_of_very_many_rows():
    from lakeloom.llm.common import draw_bound

    for held in (1, 1000, 10**9, 10**12, 10**15):
        share = (draw_bound(1000, held) + 2**63 + 1) / 2**64
        assert share == pytest.approx(min(1.0, 1000 / held), rel=1e-3)


def toxic_rows(n=600):
    """Clean prose, insults, invented insults with one beginning, and disguised ones."""
    draw, rows = random.Random(3), []
    plain = ["barito", "lunges", "marki", "tobari", "gesmar", "the", "of", "you", "and", "killun", "rimar", "bato"]
    for i in range(n):
        words = [draw.choice(plain) + draw.choice(["", "ri", "ka", "lo"]) for _ in range(draw.randint(20, 60))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(4):
                words.insert(draw.randrange(len(words)), draw.choice(["idiot", "st*pid1", "1d1ot", "zorg" + draw.choice(["ka", "lo", "mi"])]))
        rows.append((i, " ".join(words), int(toxic)))
    return rows


@pytest.fixture(scope="module")
def toxic_model(spark):
    return toxicity.learn(spark.createDataFrame(toxic_rows(), "doc_id long, text string, toxic int"))


def test_toxic_texts_are_found(spark, toxic_model):
    assert any("zorg".startswith(s) or s.startswith("zorg") for stems in toxic_model.lexicon.stems.values() for s in stems)
    rows = [(i, t + " new ending here", y) for i, t, y in toxic_rows(900)[600:]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = toxicity.with_score(docs, toxic_model).collect()
    right = sum((r.score >= toxicity.THRESHOLD) == bool(r.toxic) for r in got)
    assert right >= 0.97 * len(got)


def test_scores_keep_rows_and_columns(spark, toxic_model, odd, odd_rows, nothing):
    got = toxicity.with_score(odd, toxic_model, name="score_features")
    assert got.columns == [*odd.columns, "score_features"]
    rows = got.collect()
    assert len(rows) == len(odd_rows) and all(0 <= r.score_features <= 1 for r in rows)
    by_id = {r.doc_id: r.score_features for r in rows}
    assert by_id[4] == by_id[5] and by_id[1] == by_id[2]
    assert toxicity.with_score(nothing, toxic_model, name="s").collect() == []


def plain_features(text, lexicon):
    """The features of one text, one after another."""
    tokens = toxicity.TOKEN.findall((text or "").lower())
    n = max(len(tokens), 1)
    shown = [toxicity.PLAIN.fullmatch(t) is not None for t in tokens]
    words = [t if s else toxicity.plain_form(t) for t, s in zip(tokens, shown, strict=True)]
    insult = [w in toxicity.INSULTS for w in words]
    weight = [lexicon.weight(w) for w in words]
    persons = [i for i, t in enumerate(tokens) if t in toxicity.SECOND_PERSON]
    hits = [i for i in range(len(tokens)) if insult[i] or weight[i]]
    gaps = [min(abs(p - h) for p in persons) for h in hits] if persons else []
    hidden = sum(not shown[i] for i in hits)
    raw = (text or "").encode()
    kind = ["".join(k for k, letters in (("A", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("!", b"!"), ("?", b"?"), ("*", b"*@$#%&|"), ("0", b"0123456789"), ("a", b"abcdefghijklmnopqrstuvwxyz"))
                    if b in letters) or ("a" if b >= 128 else ".") for b in raw]
    count = lambda k: sum(x == k for x in kind)
    runs = sum(a == b and a in "!?" for a, b in zip(kind, kind[1:], strict=False))
    mixed = sum(b in "*0!" and a in "Aa" and c in "Aa" for a, b, c in zip(kind, kind[1:], kind[2:], strict=False))
    size = max(len(text or ""), 1)
    return [
        math.log1p(len(tokens)), min(sum(insult), 20), sum(insult) / n, min(sum(w > 0 for w in weight), 20), sum(w > 0 for w in weight) / n, sum(weight) / n,
        min(sum(g <= toxicity.NEAR for g in gaps), 20), len(persons) / n, 1 / (1 + min(gaps)) if gaps else 0.0, min(hidden, 20), hidden / n,
        count("A") / max(count("A") + count("a"), 1), count("!") / size, count("?") / size, count("*") / size, runs / size, count("0") / size, mixed / n,
    ]


def test_features_are_those_of_each_text_alone(odd_rows):
    """Against a plain version; a text's neighbours in a batch change nothing."""
    lexicon = toxicity.Lexicon({"glurk": 2.5}, {4: {"blor": 1.25}, 5: {}, 6: {}})
    texts = [r[1] for r in odd_rows] + [
        "You 1d-i0t!! stuuupid f.o.o.l", "!!", "!ends!", "a", "$tart", "*", "x!", "!", "??", "?what", "GLURK blorping you", "é!é 4you", "no one here", "u r @ssh0le?!", "",
    ]
    got = toxicity.features(pa.array(texts), lexicon, {})
    assert np.allclose(got, [plain_features(t, lexicon) for t in texts], rtol=0, atol=1e-12)
    for i, text in enumerate(texts):
        assert np.array_equal(toxicity.features(pa.array([text], pa.string()), lexicon, {})[0], got[i])


def test_scores_do_not_depend_on_partitions(spark):
    """The same labels in other partitions and another order, near copies with other texts among them: the same scores to the last bit."""
    rows = [(f"{'you idiot ' if i % 3 == 0 else ''}{prose(i % 40, 60)} {'end' if i % 2 else 'fin'}{i}", int(i % 3 == 0)) for i in range(300)]
    frame = spark.createDataFrame(rows, "text string, toxic int")
    asked = spark.createDataFrame([(i, prose(900 + i, 50) + (" you are an idiot" if i % 2 else "")) for i in range(40)], "doc_id long, text string")
    found = []
    for labelled in (frame.coalesce(1), frame.orderBy(F.rand(3)).repartition(7)):
        found.append(sorted((r.doc_id, r.score) for r in toxicity.with_score(asked, toxicity.learn(labelled)).collect()))
    assert found[0] == found[1]


def test_labels_of_one_class_or_none(spark, odd, nothing):
    clean = toxicity.learn(odd.select("text", F.lit(0).alias("toxic")))
    assert {r.s for r in toxicity.with_score(odd, clean, name="s").collect()} == {0.0}
    none = toxicity.learn(nothing.select("text", F.lit(0).alias("toxic")))
    assert {r.s for r in toxicity.with_score(odd, none, name="s").collect()} == {0.0}


def test_labelled_sample_ignores_what_is_no_label(spark, odd):
    labels = spark.createDataFrame([(1, 0, 1), (1, 1, 0), (2, 0, None), (None, 0, 1), (3, 1, 0), (99, 0, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.labelled_sample(odd, labels).collect()
    assert sorted(r.toxic for r in got) == [0, 0, 1]


def test_disguises():
    assert toxicity.plain_form("1d1ot") == "idiot" and toxicity.plain_form("st-u-p-i-d") == "stupid"
    texts = ["you are an idiot", "idiot " + "word " * 30 + "you", "IDIOT!!!", "an 1d1ot", ""]
    rows = toxicity.features(pa.array(texts), toxicity.Lexicon(), {})
    at = {name: i for i, name in enumerate(toxicity.FEATURES)}
    assert rows[0][at["near_person"]] == 1 and rows[1][at["near_person"]] == 0
    assert rows[2][at["capitals"]] == 1 and rows[3][at["hidden"]] == 1 and not rows[4].any()
