"""Operators against plain Python on small tables, and the pipeline against all of it in a row."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from assayer.llm import language_id as li
from assayer.llm import quality_classifier as qc
from assayer.llm import queries
from assayer.llm.decontaminate import EditMatch, Item, Searcher, contaminated, normalise
from assayer.llm.hashing import buffers, windows, words
from assayer.llm.license_scan import recognise
from assayer.llm.line_dedup import LineSpread, remove_boilerplate
from assayer.llm.near_dedup import NearDedup, near_duplicates
from assayer.llm.quality_rules import QualityRules, quality_rules
from assayer.llm.repeats import Repeats, repeated_passages
from assayer.llm.sentence_pieces import PIECE_MODEL, Encoder, read_vocabulary, viterbi
from assayer.llm.token_counts import TokenRollup, deletes, inserts, revisions
from tests.llm import brute

import pyarrow as pa  # isort: skip


def text_of(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def edited(rng, text, edits):
    w = text.split(" ")
    for _ in range(edits):
        i = rng.randrange(len(w))
        w[i : i + 1] = rng.choice([[], [f"new{rng.randrange(99)}"], [w[i], f"w{rng.randrange(400)}"]])
    return " ".join(w)


def test_words_and_windows():
    texts = ["", None, "a  b", " x\ty\x0bz\r\n", "é ü A", "word " * 7, "b" * 3000]
    data, offsets = buffers(pa.array([*texts, "skipped"], pa.string()).slice(0, len(texts)))
    found = words(data, offsets, lower=False)
    got = [data[a:b].tobytes().decode() for a, b in zip(found.starts, found.ends)]
    assert got == [w for t in texts for w in brute.words(t)]
    assert np.diff(found.offsets).tolist() == [len(brute.words(t)) for t in texts]
    assert len(set(found.hashes.tolist())) == len(set(got))
    keys, first = windows(found, 3)
    spans = [tuple(got[i : i + 3]) for i in first]
    assert len(first) == 1 + 5 and len(set(keys.tolist())) == len(set(spans)) == 2


def test_long_text_is_cut_at_white_space(monkeypatch):
    rng = random.Random(1)
    data = np.frombuffer(text_of(rng, 3000).encode(), np.uint8)
    whole = words(data, np.array([0, len(data)]), lower=False)
    monkeypatch.setattr("assayer.llm.hashing.BLOCK", 500)
    cut = words(data, np.array([0, len(data)]), lower=False)
    assert (whole.hashes == cut.hashes).all() and (whole.starts == cut.starts).all()


def test_quality_rules(spark):
    rng = random.Random(2)
    lines = [text_of(rng, rng.randrange(1, 25)) for _ in range(30)]
    docs = []
    for i in range(120):
        body = [rng.choice(lines) if rng.random() < 0.5 else text_of(rng, 20) for _ in range(rng.randrange(1, 6))]
        docs.append((i, "\n".join(body).replace("w1 ", "W1  "), rng.choice(["a", "b", None])))
    got = quality_rules(spark.createDataFrame(docs, "doc_id long, text string, source string"), QualityRules(max_documents=3))
    got = {r.doc_id: r for r in got.collect()}
    for d, lost, failed, kept in brute.quality(docs, max_documents=3):
        assert (got[d].lost_words, got[d].base_failed, got[d].kept) == (lost, failed, kept)
        n, chars, symbols, dup, repeat, _ = brute.base_counts(docs[d][1])
        assert (n, chars, symbols, dup, repeat) == tuple(
            got[d][c] for c in "n_words word_chars n_symbols n_dup_lines n_repeat_words".split()
        )
    assert 0 < sum(r.kept for r in got.values()) < len(docs)


def test_near_duplicates_of_many_copies(spark):
    """One original with very many edited copies, hardly any of which are similar to each other."""
    rng = random.Random(3)
    base = [text_of(rng, 120, 10**6) for _ in range(4)]
    docs = [(1000 + i, edited(rng, base[i % 4], rng.randrange(0, 9))) for i in range(240)] + [(2000 + i, t) for i, t in enumerate(base)]
    docs += [(i, text_of(rng, rng.randrange(0, 9), 12)) for i in range(60)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    for size, pct in ((3, 85), (5, 80), (3, 70)):
        got = {r.doc_id: r.component_id for r in near_duplicates(frame, NearDedup(size, pct)).collect()}
        assert got == brute.near(docs, size, pct)
        assert 1 < len(set(got.values())) < len(docs)


def test_line_dedup_near_the_limit(spark):
    rows = [(i, f"own {i} text here\nSeven  Sites\nown line {i}", f"s{i % 7}") for i in range(50)]
    rows += [(100 + i, f"other {i} text here\neight sites\nown line {i}", f"s{i % 8}") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for lg_k in (4, 10):  # a coarse sketch sends more lines to the exact count, with the same result
        options = LineSpread(min_sites=8, lg_k=lg_k)
        got = {r.doc_id: r.text for r in remove_boilerplate(docs, options).collect()}
        assert [got[d] for d, *_ in rows] == brute.without_boilerplate(rows, min_sites=8)
        assert "eight" in got[100] and "eight" not in got[101] and "Seven" in got[49]


def test_edit_matching():
    rng = random.Random(4)
    items = [Item(i, normalise(text_of(rng, 40)), 0) for i in range(6)]
    for item in items:
        item.budget = len(item.text) * 8 // 100
    searcher = Searcher(items)
    hits = 0
    for _ in range(150):
        item = rng.choice(items)
        changed = list(item.text)
        for _ in range(rng.randrange(0, item.budget + 4)):
            i = rng.randrange(len(changed))
            changed[i] = rng.choice(["", "x", changed[i] + "y"])
        text = text_of(rng, 30) + " " + "".join(changed) + " " + text_of(rng, 30)
        got = {items[i].item_id: (edits, a, b) for i, edits, a, b in searcher.search(text)}
        expected = {x.item_id: e for x in items if (e := brute.best_edits(x.text, text)) <= x.budget}
        assert {i: e for i, (e, _, _) in got.items()} == expected
        for i, (edits, a, b) in got.items():
            assert brute.best_edits(items[i].text, text[a:b]) == edits
        hits += bool(got)
    assert 20 < hits < 150


def test_item_blocks_give_the_same_pairs(spark):
    rng = random.Random(5)
    items = [(i, text_of(rng, 20)) for i in range(8)]
    docs = [(i, text_of(rng, 30) + " " + items[i % 8][1].upper() + " " + text_of(rng, 9)) for i in range(20)]
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for block in (10**6, 200):
        got = {(r.doc_id, r.item_id) for r in contaminated(*frames, EditMatch(block_chars=block)).collect()}
        assert got == brute.contaminated(docs, items)


def test_viterbi():
    vocabulary, rng = read_vocabulary(), random.Random(6)
    encoder = Encoder(vocabulary)
    letters = list("abcdefgh tion then ing éüñ  世界😀\n\t▁.,%")
    for n in [*range(1, 60), 200, 700]:
        text = "".join(rng.choice(letters) for _ in range(n))
        score, ids = brute.segment(" " + text, vocabulary)
        for chunks in (" " + text, [" " + text], [" " + text[:9], "", text[9:]]):
            assert [i for part in viterbi(chunks, vocabulary) for i in part] == ids
        coded = np.frombuffer(encoder.encode(text), np.int32)
        assert coded.tolist() == ids and encoder.decode(coded) == text


def test_memory_of_segments(monkeypatch):
    """Segments that leave the memory and come back, at every edge of its generations, have the same ids."""
    vocabulary, rng = read_vocabulary(), random.Random(16)
    texts = [" ".join(rng.choice(["the", "a", "long", f"w{rng.randrange(40)}", "y" * 70]) for _ in range(30)) for _ in range(40)]
    expected = [Encoder(vocabulary).encode(t) for t in texts]
    for size in (1, 2, 7):
        monkeypatch.setattr(Encoder, "MEMORY", size)
        encoder = Encoder(vocabulary)
        assert [encoder.encode(t) for t in texts] == expected
        assert len(encoder.young) <= size and len(encoder.old) <= size
    monkeypatch.setattr(Encoder, "CHUNK", 3)
    assert [Encoder(vocabulary).encode(t) for t in texts] == expected


def test_viterbi_commits_early():
    """The stream is committed while it is read, and only a window is held."""
    vocabulary, text = read_vocabulary(), "xyz" * 3000
    read = 0

    def chars():
        nonlocal read
        for c in text:
            read += 1
            yield c

    parts, behind = [], []
    for part in viterbi(chars(), vocabulary):
        parts += part
        behind.append(read - sum(len(vocabulary.texts[i]) for i in parts))
    assert len(behind) > 50 and max(behind) < 10 * vocabulary.longest
    assert b"".join(vocabulary.texts[i] for i in parts).decode() == text


def test_viterbi_against_the_library():
    """With the same pieces as a unigram model, the library finds no segmentation with a larger score."""
    sentencepiece = pytest.importorskip("sentencepiece")
    pb2 = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    model = pb2.ModelProto()
    with open(PIECE_MODEL, "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1
    library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    vocabulary, rng = read_vocabulary(), random.Random(7)
    encoder, same = Encoder(vocabulary), 0
    for _ in range(300):
        text = "".join(rng.choice("etaoin shrdlu") for _ in range(rng.randrange(1, 30))).strip().replace("  ", " ")
        ours, theirs = np.frombuffer(encoder.encode(text), np.int32).tolist(), library.encode(text)
        score = [sum(library.get_score(i) for i in ids) for ids in (ours, theirs)]
        assert score[0] >= score[1] and library.decode(ours) == text
        same += ours == theirs
    assert same > 200


def test_forward_sums_all_segmentations():
    pieces = li.Pieces(["a", "ab", "b", " a", " ", "abcd"])
    probability = np.array([[0.1, 0.2], [0.2, 0.1], [0.1, 0.3], [0.3, 0.1], [0.1, 0.1], [0.1, 0.1], [0.1, 0.1]])

    def total(word):
        if not word:
            return np.ones(2)
        out = np.zeros(2)
        for n in range(1, len(word) + 1):
            k = pieces.numbers.get(word[:n])
            k = 6 if k is None and n == 1 else k
            if k is not None:
                out += probability[k] * total(word[n:])
        return out

    known = [" ab", " abab", " abcdab", " zab", " ", " ba" * 3]
    got = li.log_probabilities(known, pieces, probability)
    assert np.allclose(np.exp(got), [total(w) for w in known])
    assert np.allclose(li._long_word(" abcdabab", pieces, probability), np.log(total(" abcdabab")))

    def uses(word, at=0):  # every segmentation with its probability and pieces
        if at == len(word):
            yield 1.0, []
        for n in range(1, len(word) - at + 1):
            k = pieces.numbers.get(word[at : at + n])
            k = 6 if k is None and n == 1 else k
            if k is not None:
                for p, rest in uses(word, at + n):
                    yield p * probability[k, 0], [k, *rest]

    expected = np.zeros(7)
    for word, weight in zip(known, itertools.count(1)):
        paths = list(uses(word))
        for p, used in paths:
            for k in used:
                expected[k] += weight * p / sum(p for p, _ in paths)
    assert np.allclose(li.expected_counts(known, np.arange(1, 7), pieces, probability[:, 0]), expected)


def test_ftrl_update():
    """Against the update written out for one weight at a time."""
    o = qc.Classifier(bits=4)
    model, z, n = qc.Ftrl(o), [0.0] * 17, [0.0] * 17
    rng = random.Random(8)
    for _ in range(60):
        at, label = sorted(rng.sample(range(17), 4)), rng.randrange(2)
        x = [rng.random() * 5 for _ in at]
        w = []
        for i in at:
            sign = int(z[i] > 0) - int(z[i] < 0)
            w.append(0.0 if abs(z[i]) <= o.l1 else -(z[i] - sign * o.l1) / ((o.beta + n[i] ** 0.5) / o.alpha + o.l2))
        p = 1 / (1 + np.exp(-sum(a * b for a, b in zip(w, x))))
        for i, wi, xi in zip(at, w, x):
            g = (p - label) * xi
            s = ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / o.alpha
            z[i], n[i] = z[i] + g - s * wi, n[i] + g * g
        model.learn(np.array(at), np.array(x), label)
    assert np.allclose(model.z, z) and np.allclose(model.n, n) and model.weights().any()


def test_held_out_accuracy(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang")
    lang = queries.op2_language_id(spark, folder).join(docs, "doc_id").filter("held_out")
    assert lang.filter("lang_pred = lang").count() >= 0.95 * lang.count() > 30
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    scored = queries.op4_quality_classifier(spark, folder).join(labels, "doc_id").filter("held_out")
    assert scored.filter("predicted = quality").count() >= 0.8 * scored.count() > 5


def test_repeats(spark):
    rng = random.Random(9)
    shared = [text_of(rng, n, 10**6) for n in (30, 33, 49, 50, 51, 70, 200)]
    docs = {}
    for i in range(90):
        parts = [text_of(rng, rng.randrange(1, 60), 10**6) for _ in range(3)]
        for k in rng.sample(range(len(shared)), 2):
            piece = shared[k].split(" ")
            cut = rng.choice([0, 0, 0, rng.randrange(len(piece))])
            parts.insert(rng.randrange(4), " ".join(piece[cut:]))
        docs[i] = " ".join(parts)
    # 48 words shared with one text and 48 with another, 38 of them the same: no passage of 50 words.
    whole = text_of(rng, 58, 10**6).split(" ")
    docs[93], docs[94], docs[95] = " ".join(whole), " ".join(whole[:48]), " ".join(whole[10:])
    # Three texts share the middle; a passage of 50 words is shared with the one that has less of it on either side.
    more = text_of(rng, 80, 10**6).split(" ")
    docs[96], docs[97] = " ".join(more), " ".join(more[:42]) + " x " + text_of(rng, 9)
    docs[98], docs[99] = "y " + " ".join(more[30:]), "z " + " ".join(more[10:62]) + " z"
    docs[90], docs[91], docs[92] = "same " * 70, docs[0], shared[6] + " between " + shared[6]
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(5)
    got, twice = {d: set() for d in docs}, brute.covered_words(docs, 50)
    for r in repeated_passages(frame).collect():
        assert r.n_words == r.end_word - r.first_word >= 50
        got[r.doc_id] |= set(range(r.first_word, r.end_word))
        assert any(set(range(i, i + 50)) <= twice[r.doc_id] for i in range(r.first_word, r.end_word - 49))
    assert all(twice[d] <= got[d] for d in docs)
    part = brute.covered_words(docs, Repeats().common)
    assert all(got[d] <= part[d] for d in docs)
    assert not got[93] and not got[94] and not got[95]
    assert got[91] == set(range(len(docs[91].split())))


def test_licences():
    mit = (
        "MIT License\n\nCopyright (c) 2020 Someone\n\nPermission is hereby granted, free of charge, to any person"
        " obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the"
        " Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish,"
        " distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is"
        "\nfurnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission"
        " notice shall be included in all\ncopies or substantial portions of the Software.\n\n"
    )
    assert [x[0] for x in recognise(mit)] == ["MIT"] and recognise(mit)[0][3] == ["MIT-grant", "MIT-notice"]
    first, second = mit.split("The above")
    assert recognise("The above" + second + first) == []  # in another order it is no licence
    assert recognise("some text without an end\n# SPDX-License-Identifier: BSD-3-Clause\nmore")[0][0].upper() == "BSD-3-CLAUSE"
    statements = {
        "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
        "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0-only",
        "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
        "Released under the MIT License.": "MIT",
        "This file is distributed under the terms of the Mozilla Public License 2.0.": "MPL-2.0",
    }
    for text, name in statements.items():
        assert [x[0] for x in recognise(f"Words before.\n{text} And after.\n{text}")] == [name, name]
    assert recognise("He was released under the old oak. We licensed under pressure.") == []


def test_rollup(spark, tmp_path):
    schema = "doc_id long, source string, lang string, tokenizer string, n_tokens long, old long, extra string"
    rows = [(i, f"s{i % 3}" if i % 4 else None, "en" if i % 5 else None, "v1", i, 2 * i, "x") for i in range(40)]
    counts = spark.createDataFrame(rows, schema)
    roll = TokenRollup(spark, str(tmp_path / "roll"))
    assert roll.totals().collect() == [] and roll.committed() == set()
    assert roll.commit("a/1", inserts(counts.withColumn("n_tokens", F.col("old"))))
    assert not roll.commit("a/1", inserts(counts))
    assert roll.commit("b", revisions(counts, "old"))
    roll.compact()
    assert not roll.commit("b", revisions(counts, "old")) and roll.committed() == {"a/1", "b"}
    assert roll.commit("none", counts.filter("false").select("source", "lang", "tokenizer", F.lit(1).alias("n_docs"), "n_tokens"))
    assert roll.commit("c", deletes(counts.filter("doc_id < 10")))
    assert TokenRollup(spark, str(tmp_path / "roll")).commit("c", deletes(counts)) is False
    (tmp_path / "roll/batch/d").mkdir()  # a writer that broke off
    (tmp_path / "roll/batch/d/part-0.parquet").write_text("half a file")
    expected = {}
    for d, source, lang, version, n, *_ in rows[10:]:
        docs, tokens = expected.get((source, lang, version), (0, 0))
        expected[source, lang, version] = docs + 1, tokens + n
    assert {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in roll.totals().collect()} == expected
    assert roll.commit("d", inserts(counts.filter("doc_id = 39")))
    roll.compact()
    roll.commit("e", deletes(counts.filter("doc_id >= 10").union(counts.filter("doc_id = 39"))))
    assert roll.totals().collect() == []


def test_pipeline(spark, folder):
    """The stages in plain Python, each on what the one before kept."""
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    good = {d for d, *_, kept in brute.quality(docs) if kept}
    docs = [x for x in docs if x[0] in good]
    docs = [(d, text) for (d, _, _), text in zip(docs, brute.without_boilerplate(docs)) if brute.words(text)]
    first = brute.near(docs, 5, 80)
    docs = [x for x in docs if first[x[0]] == x[0]]
    leaks = {d for d, _ in brute.contaminated(docs, items)}
    docs = {d: text for d, text in docs if d not in leaks}
    vocabulary = read_vocabulary()
    got = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id: r.ids for r in got} == {d: brute.segment(" " + t, vocabulary)[1] for d, t in docs.items()}
    assert len(got) == len(docs) > 100 and all(r.exact for r in got) and leaks


def test_long_segments_at_the_edge_of_batches(spark):
    """Segments that are too long to remember stand around the first and the last row of Arrow batches."""
    from assayer.llm.sentence_pieces import encode

    rng = random.Random(21)
    long = lambda: "".join(rng.choice("xyzé世") for _ in range(5000))
    texts = [f"short {i}" if (i + 3) % 1000 > 5 else f"{long()} and {long()}" for i in range(2005)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    encoder = Encoder(read_vocabulary())
    rows = encode(df).collect()
    assert len(rows) == len(texts) and all(r.exact for r in rows)
    assert all(r.ids == np.frombuffer(encoder.encode(texts[r.doc_id]), np.int32).tolist() for r in rows)


def test_licences_of_shuffled_sentences():
    """Texts made of known and unknown sentences, against every rule tried at every place."""
    from assayer.llm.license_scan import RULES, SENTENCES, LicenseScan

    sentence = {i: s for s, i in SENTENCES.items()}
    rules = [(name, rule) for name, rule in RULES if all(i in sentence for i in rule)]
    assert len(rules) >= 8
    rng = random.Random(22)

    def expected(parts, max_gap):
        known = [(at, p) for at, p in enumerate(parts) if p is not None]
        used, found = 0, []
        for k in range(len(known)):
            if k < used:
                continue
            for name, rule in RULES:
                window = known[k : k + len(rule)]
                in_order = [p for _, p in window] == list(rule)
                near = all(b - a <= max_gap + 1 for (a, _), (b, _) in zip(window, window[1:]))
                if in_order and near:
                    found.append((name, window[0][0], window[-1][0]))
                    used = k + len(rule)
                    break
        return found

    hits = 0
    for n in range(300):
        parts = []
        for _ in range(rng.randrange(1, 4)):
            rule = list(rng.choice(rules)[1])
            if rng.random() < 0.3:
                rng.shuffle(rule)
            if rng.random() < 0.2:
                rule.pop()
            for i in rule:
                parts += [None] * rng.choice((0, 0, 0, 1, 2, 3)) + [i]
        text = "\n\n".join(f"Filler number {rng.random()} stands here" if p is None else sentence[p].capitalize() for p in parts)
        options = LicenseScan(max_gap=n % 4)
        got = [(name, first, last) for name, first, last, _ in recognise(text, options)]
        assert got == expected(parts, options.max_gap)
        hits += len(got)
    assert hits > 150
