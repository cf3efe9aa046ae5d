"""Conversation repair, toxicity and periodic runs, against plain Python versions and in special cases."""

import heapq
import random
import re
import zlib
from fractions import Fraction
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest

from assayer.llm import conversation_repair as repair
from assayer.llm import hashing as h
from assayer.llm import periodic_runs as runs
from assayer.llm import queries, toxicity

WORD = re.compile("[^\x20\x09-\x0d]+")


# --- conversation repair


def cheapest(rows):
    """(cost, audit, lines) by search over all edits, smallest first; rows: (initial, fault, role, text)."""
    whole = re.compile(r"(s?(ua)+)?")
    prefix = re.compile(r"s?(ua)*u?")
    queue, seen = [(0, "", 0, "", ())], set()
    while queue:
        cost, audit, at, initials, lines = heapq.heappop(queue)
        if at == len(rows) and whole.fullmatch(initials):
            return cost, audit, list(lines)
        if (audit, at, initials) in seen or len(audit) > 2 * len(rows) + 2:
            continue
        seen.add((audit, at, initials))
        steps = [(3, "I", at, i, f"{r}:") for i, r in (("u", "user"), ("a", "assistant"))]
        if at < len(rows):
            initial, fault, role, text = rows[at]
            steps.append((4, "D", at + 1, "", None))
            if fault != "d":
                more = 3 if fault == "t" else 0
                steps += [(3 + more, "R", at + 1, i, f"{r}:{text}") for i, r in (("u", "user"), ("a", "assistant"))]
                if initial in "sua":
                    steps.append((more, "K", at + 1, initial, f"{role}:{text}"))
        for price, letter, after, initial, line in steps:
            if prefix.fullmatch(initials + initial):
                heapq.heappush(queue, (cost + price, audit + letter, after, initials + initial, lines + ((line,) if line is not None else ())))


def solved(codes, cut=None):
    """Cost and letters by the operator's blocks, cut after ``cut`` rows."""
    parts = [codes] if cut is None else [codes[: 2 * cut], codes[2 * cut :]]
    paths = [[x for row in repair.block_paths(part) for x in row] for part in parts if part]
    ranks = [[r for i in range(4) for r in repair._ranks(p[4 * i : 4 * i + 4])] for p in paths]
    cost, picks = repair.whole_path([[0 if x is None else x[0] for x in p] for p in paths], ranks)
    end = repair._END[picks[-1] % 4] if picks else ""
    return cost, "".join(p[at][1] for p, at in zip(paths, picks)) + end


def test_repair_is_the_cheapest_and_its_letters_come_first():
    rng = random.Random(3)
    for _ in range(400):
        n = rng.randrange(1, 6)
        codes = "".join(rng.choice("suax") + rng.choice("....td") for _ in range(n))
        rows = [(codes[2 * i], codes[2 * i + 1], codes[2 * i], "") for i in range(n)]
        expected = cheapest(rows)[:2]
        assert solved(codes) == expected, codes
        for cut in range(1, n):
            assert solved(codes, cut) == expected, (codes, cut)


def conversation_table():
    rng = random.Random(5)
    texts = ["Yes.", "no", "Why?", "", " \t", "one. two", None, "Yes."]
    rows = []
    for conv in list(range(60)) + [None]:
        for turn in rng.sample(range(9), rng.randrange(0, 7)) + [None] * rng.randrange(0, 2):
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", "tool", "", None, "user"]), rng.choice(texts)))
    return rows


def brute_repair(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        left = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            part = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            role, text = (" " if x is None else x for x in (role, text))
            text = "" if part == 1 else re.sub("[.!?]", "", text) if part == 2 else text
            left += [(turn, "user" if part == 4 else role, text)] * (0 if part == 0 else 2 if part == 3 else 1)
        left.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, marked, count = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in left:
            solid = "".join(WORD.findall(text))
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else None if solid[-1] in ".!?" else "truncated"
            seen.add((role, text))
            if fault:
                count[fault] += 1
            marked.append((role[:1] or " ", {"blank": "d", "duplicate": "d", "truncated": "t"}.get(fault, "."), role, text))
        turns = [r[0] for r in left if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
        cost, audit, lines = cheapest(marked)
        digest = sha256("\n".join(lines).encode()).hexdigest()
        out[conv] = (gaps, *count.values(), illegal, cost, audit, digest)
    return out


@pytest.mark.parametrize("block_bits", [12, 1])
def test_repaired_conversations(spark, monkeypatch, block_bits):
    monkeypatch.setattr(repair, "BLOCK_BITS", block_bits)  # blocks of two rows: conversations span many
    rows = conversation_table()
    frame = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, row_id int")
    got = {r.conv_id: tuple(r)[1:] for r in repair.repaired_conversations(frame).collect()}
    assert got == brute_repair(rows)


def test_repair_of_nothing_and_of_long_conversations(spark):
    schema = "conv_id string, turn int, role string, text string"
    assert repair.repaired_conversations(spark.createDataFrame([], schema)).count() == 0
    n = 9000  # more than two blocks
    rows = [("c", i, ("user", "assistant")[i % 2], f"row {i}.") for i in range(n)]
    fixed = repair.Repair(spark.createDataFrame(rows, schema))
    report = fixed.report().first()
    assert (report.gaps, report.illegal, report.cost, report.audit) == (0, 0, 0, "K" * n)
    lines = [f"{r.role}:{r.text}" for r in fixed.repaired().orderBy("row_id", "nth").collect()]
    assert fixed.digests().first().digest == sha256("\n".join(lines).encode()).hexdigest()


# --- periodic runs


def brute_runs(w, min_words=6, min_periods=4):
    n, out = len(w), []
    for q in range(1, n // min_periods + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            size = i + q - s
            smaller = any(all(w[s + k] == w[s + k + r] for k in range(size - r)) for r in range(1, q))
            if size >= max(min_words, min_periods * q) and not smaller:
                out.append((s, size, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def random_words(rng):
    n, k = rng.randrange(0, 70), rng.choice([1, 2, 2, 3, 5])
    w = [str(rng.randrange(k)) for _ in range(n)]
    if n and rng.random() < 0.6:
        p, a = rng.randrange(1, 9), rng.randrange(n)
        w = [w[i] if i < a else w[min(n - 1, a + (i - a) % p)] for i in range(n)]
    return w + [str(rng.randrange(k)) for _ in range(rng.randrange(20))]


def test_squares_of_the_automaton():
    rng = random.Random(1)
    for _ in range(800):
        w = random_words(rng)
        ids = {x: i for i, x in enumerate(sorted(set(w)))}
        for least in ((6, 4), (4, 2), (9, 3)):
            ends = runs.squares([ids[x] for x in w], *least)
            found = sorted(((s, e + 1 - s, q) for (s, q), e in ends.items()), key=lambda r: (r[0], r[2]))
            assert found == brute_runs(w, *least), w
        data, offsets = h.buffers(pa.array([" ".join(w), None, "\t\n".join(w[::-1])]))
        a, b, c = runs.runs_of(h.words(data, offsets, lower=False), runs.Runs())
        assert (a, b, c) == (brute_runs(w), [], brute_runs(w[::-1])), w


def test_links_are_a_tree_of_short_paths():
    """A word with many borders is no worse than the others: time of n log n."""
    a, b = [0], [0, 1]
    while len(b) < 20_000:
        a, b = b, b + a
    assert runs.squares(b, 6, 4) == {}
    assert runs.squares([0] * 20_000, 6, 4) == {(0, 1): 19_999}


def planted(text, doc_id):
    w = WORD.findall(text or "")
    n = len(w)
    if doc_id is not None and n:
        g, rest = divmod(zlib.crc32(str(doc_id).encode()), 10)
        if rest == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def expected_runs(doc_id, text):
    w = planted(text, doc_id)
    found = brute_runs(w)
    drop = {i for s, size, q in found for i in range(s + q, s + size)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if found else (None,) * 3
    return (
        doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None,
        sha256("".join(f"{s},{size},{q}\n" for s, size, q in found).encode()).hexdigest(),
        sha256(" ".join(x for i, x in enumerate(w) if i not in drop).encode()).hexdigest(),
    )


def test_runs_of_documents(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, " ".join(random_words(rng)), "x") for i in range(300)]
    rows += [(1, None, "x"), (10, "", "x"), (None, "a a a a a a a", "x"), (3, "é é  é é  é é  é é  \n", "x"), (3, " a b " * 3000, "x")]
    rows += [(5, "same same same same same same", "x")] * 2
    frame = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op13_periodic_runs"](spark, str(tmp_path)).collect()
    long = [r for r in got if r.n_runs and r.length == 6000]
    assert len(long) == 1 and long[0].period == 2
    short = sorted((tuple(r) for r in got if r not in long), key=repr)
    assert short == sorted((expected_runs(d, t) for d, t, _ in rows if len(t or "") < 9000), key=repr)
    assert runs.periodic_runs(frame.limit(0)).count() == 0


# --- toxicity


def plain_grams(text, order=5):
    text = (text or "").encode().lower() if (text or "").isascii() else (text or "").encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"))
    text = re.sub(rb"[\x20\x09-\x0d]+", b" ", text)
    padded = b" " * (order - 1) + text + b" "
    return [int.from_bytes(padded[i : i + order], "big") for i in range(len(padded) - order + 1)]


def test_ngrams_of_blocks():
    texts = ["Abc  d\n\né", "", None, " x", "Z ", "long " * 50]
    data, offsets = h.buffers(pa.array(texts))
    keys, at = toxicity.ngrams(data, offsets, 5)
    for i, text in enumerate(texts):
        assert keys[at[i] : at[i + 1]].tolist() == plain_grams(text), text


def corpus(rng, n):
    bad = ["idiot", "scum", "moron"]
    vocabulary = ["".join(rng.choice("etaoinshr") for _ in range(rng.randrange(2, 7))) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        w = [rng.choice(vocabulary) for _ in range(rng.randrange(20, 80))]
        toxic = int(rng.random() < 0.2)
        for _ in range(2 * toxic):
            w.insert(rng.randrange(len(w)), rng.choice(bad))
        docs.append((i, " ".join(w)))
        if i % 4:
            labels.append((i, toxic))
    return docs, labels, bad


def plain_ratios(docs, labels, d=2.0, order=5):
    """log P(toxic) / P(ordinary) of n-grams and histories, with dictionaries."""
    from collections import defaultdict

    label = dict(labels)
    count = {0: defaultdict(int), 1: defaultdict(int)}
    everything = set()
    for i, text in docs:
        grams = set(plain_grams(text, order))
        everything |= grams
        for g in grams if i in label else ():
            count[label[i]][g] += 1
    levels, current = {}, everything
    for k in range(order - 1, 0, -1):
        level = defaultdict(int)
        for g in current:
            level[g & ((1 << 8 * k) - 1)] += 1
        levels[k], current = level, set(level)
    total = sum(levels[1].values())
    shared = {g: max(n - 0.75, 0) / total + 0.75 * len(levels[1]) / total / 256 for g, n in levels[1].items()}
    for k in range(2, order):
        counts = list(levels[k].values())
        e = min(max(counts.count(1) / max(1, counts.count(1) + 2 * counts.count(2)), 0.1), 0.95)
        by = defaultdict(list)
        for g, n in levels[k].items():
            by[g >> 8].append(n)
        low = (1 << 8 * (k - 1)) - 1
        shared = {g: max(n - e, 0) / sum(by[g >> 8]) + e * len(by[g >> 8]) / sum(by[g >> 8]) * shared[g & low] for g, n in levels[k].items()}
    both = set(count[0]) | set(count[1])
    rest = {}
    for c in (0, 1):
        of = defaultdict(list)
        for g in both:
            of[g >> 8].append(count[c].get(g, 0))
        rest[c] = {hist: (sum(n), sum(min(x, d) for x in n) / sum(n) if sum(n) else 1.0) for hist, n in of.items()}
    out = {}
    for g in both:
        p = []
        for c in (1, 0):
            n, left = rest[c][g >> 8]
            p.append((max(count[c].get(g, 0) - d, 0) / n if n else 0) + left * shared[g & ((1 << 8 * (order - 1)) - 1)])
        out[g] = np.log(p[0] / p[1])
        out[-1 - (g >> 8)] = np.log(rest[1][g >> 8][1] / rest[0][g >> 8][1])
    return out


@pytest.fixture(scope="module")
def toxic_model(spark):
    docs, labels, bad = corpus(random.Random(2), 2500)
    frame = spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, label int")
    extra = labels + [(labels[0][0], None), (None, 1)]
    model = toxicity.train(frame, spark.createDataFrame(extra, "doc_id long, label int"))
    return docs, labels, bad, model


def test_ratios_against_dictionaries(spark, toxic_model):
    docs, labels, _, model = toxic_model
    got = {r.gram: r.ratio for r in model.ratios.collect()}
    expected = plain_ratios(docs, labels)
    assert set(got) == set(expected)
    assert all(abs(got[g] - expected[g]) < 1e-9 for g in got)


def test_toxic_documents_are_found(spark, toxic_model):
    docs, labels, bad, model = toxic_model
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.score(frame, model).collect()}
    truth = {i: int(any(b in text.split() for b in bad)) for i, text in docs}
    unlabelled = [i for i in truth if i % 4 == 0]
    assert np.mean([got[i].predicted == truth[i] for i in unlabelled]) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())


def test_model_that_is_too_large_to_send_is_joined(spark, toxic_model):
    from dataclasses import replace

    docs, _, _, model = toxic_model
    rows = docs[:40] + [(None, None), (7, ""), (7, " \n"), docs[0], docs[0], (9, "idiot " * 30_000)]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, score int")
    small = toxicity.score(frame, model)
    joined = toxicity.score(frame, replace(model, options=replace(model.options, small_model=0)))
    a, b = (sorted(((r.doc_id, r.text_key, round(r.score, 9), r.predicted) for r in x.collect()), key=repr) for x in (small, joined))
    assert a == b and len(a) == len(rows)


def test_without_examples(spark, toxic_model):
    docs, _, _, model = toxic_model
    frame = spark.createDataFrame(docs[:20], "doc_id long, text string")
    empty = toxicity.train(frame, spark.createDataFrame([], "doc_id long, label int"))
    assert {r.predicted for r in toxicity.score(frame, empty).collect()} == {0}
    assert toxicity.score(frame.limit(0), model).count() == 0
    nothing = toxicity.train(frame.limit(0), spark.createDataFrame([(1, 1)], "doc_id long, label int"))
    assert toxicity.score(frame, nothing).count() == 20
