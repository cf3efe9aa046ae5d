"""What an operator decides takes effect as a whole: cases that an earlier version cut short."""

import random
from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline
from assayer.llm import language_id, queries
from assayer.llm.decontaminate import contaminated
from assayer.llm.license_scan import recognise
from assayer.llm.line_dedup import remove_boilerplate
from assayer.llm.quality_rules import QualityRules, keep_good
from assayer.llm.sentence_pieces import read_vocabulary
from assayer.llm.token_counts import count_tokens
from tests.llm import brute


def text_of(rng, n, vocabulary=10**6):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def good_texts(docs, max_documents=10):
    """docs: (doc_id, text, source). What the quality rules leave, as (doc_id, text, source)."""
    norm = lambda line: tuple(brute.words(line, lower=True))
    holders = defaultdict(set)
    for d, text, source in docs:
        for line in (text or "").split("\n"):
            holders[source, norm(line)].add(d)
    out = []
    for (d, text, source), (_, _, _, kept) in zip(docs, brute.quality(docs, max_documents)):
        if kept:
            stay = []
            for line in text.split("\n"):
                have = holders[source, norm(line)]
                if not norm(line) or len(have) <= max_documents or d == min(have):
                    stay.append(line)
            out.append((d, "\n".join(stay), source))
    return out


def pages(rng, n, sources):
    """Documents with lines that many of one source share, blank lines and own lines."""
    shared = [text_of(rng, 4) for _ in range(6)]
    docs = []
    for i in range(n):
        body = [text_of(rng, 15), rng.choice(["", " \t", "own"]), rng.choice(shared), text_of(rng, 15)]
        rng.shuffle(body)
        body += ["\n", shared[i % 6].upper()] if rng.random() < 0.3 else []
        docs.append((i, "\n".join(body), rng.choice(sources)))
    return docs


def test_quality_rules_remove_lines(spark):
    docs = pages(random.Random(21), 90, ["a", "b", None])
    frame = spark.createDataFrame([(*x, "kept", len(x[1])) for x in docs], "doc_id long, text string, source string, lost string, n_chars long")
    got = sorted(keep_good(frame, QualityRules(max_documents=3)).collect())
    expected = good_texts(docs, max_documents=3)
    assert [(r.doc_id, r.text, r.source) for r in got] == expected
    assert all(r.n_chars == len(r.text) and r.lost == "kept" for r in got)
    assert set(expected) - set(docs) and len({x[0] for x in expected}) > 60


def test_quality_rules_of_one_text_on_two_hosts(spark):
    """A verdict on one host is not carried to the same id and text on another."""
    line = "the line that every page holds"
    docs = [(i, f"{text_of(random.Random(i), 20)}\n{line}", "a") for i in range(5)]
    docs.append((4, docs[4][1], "b"))
    got = keep_good(spark.createDataFrame(docs, "doc_id long, text string, source string"), QualityRules(max_documents=3))
    assert sorted((r.doc_id, r.source) for r in got.collect() if line in r.text) == [(0, "a"), (4, "b")]
    assert got.count() == 6


def test_pipeline_removes_lines_of_hosts(spark, folder, tmp_path):
    docs = pages(random.Random(22), 80, ["a", "b"])
    items = spark.read.parquet(f"{folder}/benchmark.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(*x, len(x[1])) for x in docs]
    spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    good = good_texts(docs)
    texts = [(d, text) for (d, _, _), text in zip(good, brute.without_boilerplate(good)) if brute.words(text)]
    first = brute.near(texts, 5, 80)
    leaks = {d for d, _ in brute.contaminated(texts, [(r.item_id, r.text) for r in items.collect()])}
    expected = {d: text for d, text in texts if first[d] == d and d not in leaks}
    vocabulary = read_vocabulary()
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == {d: brute.segment(" " + t, vocabulary)[1] for d, t in expected.items()}
    assert set(good) - set(docs)


def test_line_dedup_of_short_pages(spark):
    """Boilerplate goes from all documents but the first, whatever they have left."""
    head, foot = "a long header that stands on every page of every site", "and a footer that is just as long as that"
    pages = [(i, f"{head}\nown {i}\n{foot}", f"s{i % 12}") for i in range(24)]
    bare = [(100, f"{head}\n{foot}", "s1"), (101, f"{foot}\n{foot}", "s2"), (101, f"{foot}\n{foot}", "s2")]
    copies = [(200 + i, "a text found on many sites\nwith two lines", f"s{i}") for i in range(12)]
    twice = [(300 + i, f"{head}\nthe same page twice\n{foot}", "s1") for i in range(2)]
    nameless = [(None, f"{foot}\nwithout an id", "s1")] * 2 + [(None, f"{foot}\nonce, without an id", "s1")]
    nameless += [(None, "only without id", f"s{i}") for i in range(10)]
    docs = pages + bare + copies + twice + nameless
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string")
    got = sorted(((r.doc_id, r.text, r.gone) for r in remove_boilerplate(frame, removed="gone").collect()), key=repr)
    expected = [(0, pages[0][1], 0)] + [(i, f"own {i}", 2) for i, *_ in pages[1:]] + [(100, "", 2), (101, "", 2), (101, "", 2)]
    expected += [(200, copies[0][1], 0)] + [(d, "", 2) for d, *_ in copies[1:]] + [(d, "the same page twice", 2) for d, *_ in twice]
    expected += [(None, "without an id", 1)] * 2 + [(None, "once, without an id", 1)] + [(None, "only without id", 0)] * 10
    assert got == sorted(expected, key=repr)
    with_ids = [d for d in docs if d[0] is not None]
    assert [x[1] for x in sorted((x for x in expected if x[0] is not None), key=lambda x: x[0])] == [
        text for _, text in sorted(zip((d[0] for d in with_ids), brute.without_boilerplate(with_ids)), key=lambda x: x[0])
    ]


def test_short_items_of_the_benchmark(spark):
    items = [(1, "Gates of  Dawn"), (2, "is"), (3, " "), (4, None), (5, "a sentence that is long enough to allow an edit")]
    docs = [(1, "the gates of dawn"), (2, "gates of dawns"), (3, "This, his"), (4, "what is it"), (5, ""), (6, None),
            (7, "x a sentence that is long enough to allow an edlt y")]
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in contaminated(*frames).collect()}
    assert got == brute.contaminated(docs, items) == {(1, 1), (4, 2), (7, 2), (7, 5)}


def test_languages_without_spaces(spark):
    """Sentences are one word each, longer than the limit of plain products."""
    rng = random.Random(9)
    signs = {"zh": "的一是不了人我在有他这为之大来以个中上们", "ja": "のにをはがでとたしてれさいなもるらかうこ"}
    rows = []
    for i in range(60):
        lang = ("zh", "ja")[i % 2]
        rows.append((i, "".join(rng.choice(signs[lang]) for _ in range(rng.randrange(60, 200))), lang))
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(frame.filter("doc_id < 40"))
    got = {r.doc_id: r for r in language_id.predict(frame, model).collect()}
    assert all(got[i].lang_pred == lang and got[i].score > 0.99 for i, _, lang in rows)


def test_expected_counts_of_long_words():
    """The sums in logarithms are those of plain products."""
    pieces = language_id.read_pieces(language_id.LanguageId().model)
    rng = np.random.default_rng(1)
    probability = rng.dirichlet(np.ones(pieces.size))
    words = [" international", " unbelievable", " x世y", " "]
    plain = language_id.expected_counts(words, np.array([1, 2, 3, 1]), pieces, probability)
    summed = np.zeros(pieces.size)
    for w, n in zip(words, (1, 2, 3, 1)):
        language_id._count_long(w, n, pieces, probability, summed)
    assert np.allclose(plain, summed, rtol=1e-9, atol=1e-12)


@pytest.mark.parametrize(
    "text,licences",
    [
        ("This work is licensed under a Creative Commons Attribution 4.0 International License.", ["CC-BY-4.0"]),
        ("Licensed under the GNU General Public License v3.0", ["GPL-3.0-only"]),
        ("Licensed under the GNU Lesser General Public License (LGPL) version 2.1 or later.", ["LGPL-2.1-or-later"]),
        ("This work is licensed under CC BY-SA 3.0.", ["CC-BY-SA-3.0"]),
        ("Content on this site is licensed under a Creative Commons Attribution-NonCommercial-NoDerivs 3.0 Unported License.", ["CC-BY-NC-ND-3.0"]),
        ("Dual licensed under MIT and Apache 2.0", ["MIT", "Apache-2.0"]),
        ("Licensed under either of Apache License, Version 2.0 or MIT license at your option.", ["Apache-2.0", "MIT"]),
        ("Available under the MIT and ISC licences.", ["MIT", "ISC"]),
        ("Available under the MIT, the BSD 3-Clause or the GPLv2+ licence.", ["MIT", "BSD-3-Clause", "GPL-2.0-or-later"]),
        ("Released under the GPL-3.0-or-later license.", ["GPL-3.0-or-later"]),
        ("Released under the Common Development and Distribution License 1.0 or the GPLv2.", ["CDDL-1.0", "GPL-2.0-only"]),
        ("Distributed under the GNU General Public License, version 7.", []),
        ("Released under the MIT and other licenses of the land.", []),
        ("// SPDX-License-Identifier: Apache-2.0 OR MIT", ["Apache-2.0", "MIT"]),
        ("/* SPDX-License-Identifier: (GPL-2.0-only WITH Linux-syscall-note AND BSD-3-Clause) OR GPL-2.0+ */", ["GPL-2.0-only WITH Linux-syscall-note", "BSD-3-Clause", "GPL-2.0+"]),
        ("SPDX-License-Identifier: MIT OR", []),
    ],
)
def test_licence_statements(text, licences):
    assert [x[0] for x in recognise(f"Words before.\n\n{text}\n\nAnd after.")] == licences


def test_licence_notices():
    """The notices as their publishers print them."""
    free = "This program is free software{} you can redistribute it and/or\nmodify it under the terms of the GNU {}\nas published by the Free Software Foundation{}.\n\n"
    hope = "This program is distributed in the hope that it will be useful,\nbut WITHOUT ANY WARRANTY; without even the implied warranty of\nMERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the\nGNU General Public License for more details.\n"
    for words, licence in (
        ((";", "General Public License", "; version 2\nof the License"), "GPL-2.0-only"),
        ((";", "General Public License", "; version 2"), "GPL-2.0-only"),
        ((";", "General Public License version 2", ""), "GPL-2.0-only"),
        ((";", "General Public License", "; either version 2\nof the License, or (at your option) any later version"), "GPL-2.0-or-later"),
        ((":", "General Public License", ", either version 3 of the License, or\n(at your option) any later version"), "GPL-3.0-or-later"),
        ((":", "Affero General Public License", ", either version 3 of the License, or\n(at your option) any later version"), "AGPL-3.0-or-later"),
        ((";", "Lesser General Public License", "; either version 2.1 of the License, or (at your option) any later version"), "LGPL-2.1-or-later"),
    ):
        (found,) = recognise(free.format(*words) + hope)
        assert found[0] == licence and found[3][-2:] == ["GNU-hope", "GNU-implied"]
    bsd = (
        "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that"
        " the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice,"
        " this\n   list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the"
        " above copyright notice,\n   this list of conditions and the following disclaimer in the documentation\n   and/or"
        " other materials provided with the distribution.\n\n"
    )
    end = "may be used to endorse or promote products derived from\nthis software without specific prior written permission.\n"
    assert [x[0] for x in recognise(bsd)] == ["BSD-2-Clause"]
    for holder in ("the copyright holder nor the names of its", "Example Inc. nor the names of its", "the University nor the names of its"):
        acknowledge = "3. All advertising materials mentioning features or use of this software\n   must display the following acknowledgement:\n   This product includes software developed by someone.\n\n"
        assert [x[0] for x in recognise(f"{bsd}{acknowledge}4. Neither the name of {holder} contributors\n{end}")] == ["BSD-4-Clause"]
        assert [x[0] for x in recognise(f"{bsd}3. Neither the name of {holder} contributors\n{end}")] == ["BSD-3-Clause"]


def test_token_totals_of_all_documents(spark, folder):
    expected = defaultdict(lambda: (0, 0))
    for r in count_tokens(spark.read.parquet(f"{folder}/documents.parquet")).collect():
        key = r.source, r.lang, r.tokenizer
        expected[key] = expected[key][0] + 1, expected[key][1] + r.n_tokens
    toxic = spark.read.parquet(f"{folder}/labels.parquet").filter("toxic = 1")
    got = queries.op1_token_counts(spark, folder).collect()
    assert {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in got} == expected and toxic.count()
