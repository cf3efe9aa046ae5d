"""Every operator and stage on nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from assayer.llm import language_id, quality_classifier
from assayer.llm.components import components
from assayer.llm.decontaminate import contaminated
from assayer.llm.license_scan import scan_licenses
from assayer.llm.line_dedup import LineSpread, remove_boilerplate
from assayer.llm.near_dedup import NearDedup, near_duplicates
from assayer.llm.quality_rules import quality_rules
from assayer.llm.repeats import repeated_passages
from assayer.llm.sentence_pieces import decode, encode
from assayer.llm.token_counts import count_tokens

#: Names that the operators use inside or return.
CLASHING = (
    "kept score component_id line lines row row_id vertex text_key at key own_id own_key own_text band label host site"
    " document line_words first end left right lost rest ids exact predicted item_id n_tokens tokenizer nth turn shingles"
).split()
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 70001}" for i in range(120_000)) + "x" * 5000
COPY = " ".join(f"copy{i}" for i in range(80))
ROWS = [
    (1, None, "en", "a", 0),
    (2, "", None, "a", 0),
    (3, " \n\t \x0b", "en", None, 4),
    (4, LONG, "en", "a", len(LONG)),
    (5, COPY, "de", "b", 1),
    (6, COPY, "de", "c", 1),
    (6, COPY, "de", "c", 1),
    (7, COPY.upper() + "\n" + COPY.upper(), "de", "a", None),
    (None, COPY, "de", "a", 1),
    (None, None, None, None, None),
    (8, "Short text. Released under the MIT License.", "en", "a", 1),
    (9, "Ünïcödé 世界 ▁ 😀\x00 |#|", "en", "a", 1),
]


@pytest.fixture(scope="module")
def messy(spark):
    return spark.createDataFrame(ROWS, DOCS).select("*", *(F.lit("x").alias(c) for c in CLASHING)).cache()


@pytest.fixture(scope="module")
def empty(messy):
    return messy.filter("false")


@pytest.fixture(scope="module")
def items(spark):
    rows = [(1, COPY), (2, None), (3, ""), (4, "tiny"), (None, COPY), (5, COPY)]
    return spark.createDataFrame(rows, "item_id long, text string").withColumn("doc_id", F.lit(7))


def by_id(df, *columns):
    return sorted(((r.doc_id, *(r[c] for c in columns)) for r in df.collect()), key=repr)


def test_quality_rules(messy, empty):
    got = by_id(quality_rules(messy), "n_words", "n_dup_lines", "n_symbols", "base_failed", "kept")
    assert len(got) == len(ROWS)
    assert (1, 0, 0, 0, True, False) in got and (3, 0, 0, 0, True, False) in got
    assert got.count((6, 80, 0, 0, False, True)) == 2 and (None, 0, 0, 0, True, False) in got
    assert (7, 160, 1, 0, True, False) in got  # every word lies in a repeated window
    assert (4, 120_000, 0, 0, True, False) in got and (9, 5, 0, 3, True, False) in got
    assert quality_rules(empty).collect() == []


def test_near_duplicates(messy, empty):
    got = by_id(near_duplicates(messy), "n_shingles", "component_id", "kept")
    assert len(got) == len(ROWS)
    assert (1, 0, 1, True) in got and (2, 0, 2, True) in got and (None, 0, None, False) not in got
    assert (5, 76, 5, True) in got and got.count((6, 76, 5, False)) == 2 and (None, 76, 5, False) in got
    assert near_duplicates(empty).collect() == []


def test_near_duplicates_without_ids(spark):
    rows = [(None, COPY), (None, COPY), (None, COPY + " end")]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [r.component_id for r in got] == [None] * 3 and sum(r.kept for r in got) == 1


def test_line_dedup(messy, empty):
    assert remove_boilerplate(messy, removed="gone").columns == [*messy.columns, "gone"]
    same = by_id(remove_boilerplate(messy), "text", "lang", "source", "kept")
    assert same == by_id(messy, "text", "lang", "source", "kept")
    assert remove_boilerplate(empty).collect() == []
    found = remove_boilerplate(messy, LineSpread(min_sites=3), removed="gone")
    assert {(r.doc_id, r.gone, r.text) for r in found.filter("gone > 0").collect()} == {
        (6, 1, ""), (None, 1, ""), (7, 2, "")
    }


def test_decontamination(messy, empty, items):
    got = by_id(contaminated(messy, items), "item_id", "edits", "start", "end")
    n = len(COPY)
    expected = [(d, i, 0, 0, n) for d in (5, 6, 6, 7, None) for i in (1, 5, None)]
    assert got == sorted(expected, key=repr)
    assert contaminated(empty, items).collect() == [] and contaminated(messy, items.filter("false")).collect() == []


def test_sentence_pieces(messy, empty):
    coded = encode(messy)
    got = {(r.doc_id, r.text_key): r for r in coded.collect()}
    assert coded.count() == len(ROWS)
    assert all(r.exact is not False for r in got.values())
    assert [r.ids for r in got.values() if r.doc_id == 1] == [None] and [r.ids for r in got.values() if r.doc_id == 2] == [[]]
    back = by_id(decode(coded), "text")
    assert back == by_id(messy, "text")
    assert encode(empty).collect() == [] and decode(encode(empty)).collect() == []


def test_license_scan(messy, empty):
    assert by_id(scan_licenses(messy), "licence", "first_sentence") == [(8, "MIT", 1)]
    assert scan_licenses(empty).collect() == []


def test_repeats(messy, empty):
    got = by_id(repeated_passages(messy), "first_word", "end_word")
    assert got == sorted([(5, 0, 80), (6, 0, 80), (7, 0, 160), (None, 0, 80), (4, 0, 49_998), (4, 70_001, 119_999)], key=repr)
    assert repeated_passages(empty).collect() == []


def test_token_counts(messy, empty):
    got = by_id(count_tokens(messy), "source", "lang", "n_chars", "n_tokens")
    assert len(got) == len(ROWS) and (None, None, None, 0, 0) in got and (2, "a", None, 0, 0) in got
    assert next(r for r in got if r[0] == 4)[3] == len(LONG)
    assert count_tokens(empty).collect() == []


def test_language_id(messy, empty):
    model = language_id.train(messy)
    assert model.languages == ["de", "en"]
    got = by_id(language_id.predict(messy, model), "lang_pred")
    assert len(got) == len(ROWS)
    assert {(1, "und"), (2, "und"), (3, "und"), (5, "de"), (4, "en"), (None, "und")} <= set(got)
    assert language_id.predict(empty, model).collect() == []
    nothing = language_id.train(empty)
    assert {r.lang_pred for r in language_id.predict(messy, nothing).collect()} == {"und"}


def test_quality_classifier(spark, messy, empty):
    labels = [(5, 1), (6, 1), (6, 1), (4, 0), (8, 0), (9, None), (None, 1), (1, 0), (7, 2)]
    labels = spark.createDataFrame(labels, "doc_id long, label int").withColumn("text", F.lit("x"))
    weights = quality_classifier.train(messy, labels)
    got = by_id(quality_classifier.score(messy, weights), "predicted")
    assert len(got) == len(ROWS) and {(5, 1), (6, 1), (7, 1)} <= set(got)
    scores = {r.doc_id: r.score for r in quality_classifier.score(messy, weights).collect() if r.doc_id in (1, 2, 3)}
    assert len(set(scores.values())) == 1  # no words: the intercept alone
    assert quality_classifier.score(empty, weights).collect() == []
    assert not quality_classifier.train(empty, labels).any()


def test_components(spark):
    path = [(i, i + 1) for i in range(40)]
    links = spark.createDataFrame([*path, (3, 3), (None, 4), (41, 90), (90, 41), (50, 41), (60, 61)], "a long, b long")
    got = {r.vertex: r.label for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 90: 41, 50: 41, 61: 60}
    assert components(links.filter("false")).collect() == []


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stage(spark, tmp_path, messy, empty, items, name, stage):
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    kept, none = stage(spark, messy, str(tmp_path)), stage(spark, empty, str(tmp_path))
    last = name == corpus_pipeline.STAGES[-1][0]
    assert none.collect() == [] and none.columns == kept.columns
    assert last or kept.columns == messy.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=repr)
    everything = sorted((r[0] for r in ROWS), key=repr)
    expected = {
        "quality rules": [5, 6, 6, None],
        "line dedup": sorted((r[0] for r in ROWS if (r[1] or "").strip()), key=repr),
        "minhash near-dedup": [1, 2, 3, 4, 5, 8, 9, None],
        "benchmark decontamination": [1, 2, 3, 4, 8, 9, None],
        "sentencepiece": everything,
    }
    assert name not in expected or ids == sorted(expected[name], key=repr)


def test_staged_tables_are_dropped(spark):
    import os

    from assayer.llm import frames

    before = frames.staged_so_far()
    kept = frames.staged(spark.range(3), "kept")
    since = frames.staged_so_far()
    for _ in range(3):
        last = frames.staged(spark.range(2), "passing")
    paths = frames._staged[since:]
    frames.drop_staged(spark, since, keep=1)
    assert [os.path.exists(p) for p in paths] == [False, False, True] and frames.staged_so_far() == since + 1
    assert kept.count() == 3 and last.count() == 2
    frames.drop_staged(spark, before)
    assert frames.staged_so_far() == before and not os.path.exists(paths[-1])
    frames.drop_staged(spark, before, keep=1)  # nothing to drop
    assert frames.staged_so_far() == before
