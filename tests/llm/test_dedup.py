"""Substring, suffix and Jaccard operators against brute force, on small tables with every odd case."""

import random

import pytest

from cladewise.llm import jaccard_join, substring_dedup, suffix_dedup

SCHEMA = "doc_id long, text string, slice string, tokens int"  # two names clash with the operators' own


def corpus(seed: int):
    rng = random.Random(seed)
    vocabulary = [f"w{i}é" for i in range(40)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    texts = [say(rng.randrange(1, 80)) for _ in range(25)]
    passage, base = say(60), say(70).split()
    texts += [say(10) + " " + passage + " " + say(9) for _ in range(6)] + [passage] * 3
    for _ in range(12):
        w = list(base)
        w[rng.randrange(len(w))] = rng.choice(vocabulary)
        texts.append(" ".join(w))
    texts += ["", "  \t\n", "one", "one two", "ONE two", "a " * 400, "x" * 700, "é" * 300, None, say(3000)]
    rng.shuffle(texts)
    return [(i * 3 + 1, t, "s", 1) for i, t in enumerate(texts)]


def words(t):
    return (t or "").encode().split()


def brute_substrings(rows, width):
    first = {}
    for i, t, *_ in sorted(rows):
        w = words(t)
        for k in range(len(w) - width + 1):
            first.setdefault(tuple(w[k : k + width]), i)
    out = {}
    for i, t, *_ in rows:
        w = words(t)
        gone = [any(first[tuple(w[s : s + width])] < i for s in range(max(0, p - width + 1), min(p, len(w) - width) + 1)) for p in range(len(w))]
        out[i] = (len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode())
    return out


@pytest.mark.parametrize("seed,width,slice_bytes", [(1, 13, 4000), (2, 5, 1 << 20), (3, 1, 700)])
def test_substrings(spark, seed, width, slice_bytes):
    rows = corpus(seed)
    out = substring_dedup.dedup_substrings(spark.createDataFrame(rows, SCHEMA), width, slice_bytes).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in out} == brute_substrings(rows, width)


def test_substrings_odd_tables(spark):
    assert substring_dedup.dedup_substrings(spark.createDataFrame([], SCHEMA)).count() == 0
    text = " ".join(f"t{i}" for i in range(20))
    rows = [(None, text, "", 0), (5, text, "", 0), (5, text, "", 0)]
    out = sorted((r.doc_id is None, r.n_removed) for r in substring_dedup.dedup_substrings(spark.createDataFrame(rows, SCHEMA), carry=["slice"]).collect())
    assert out == [(False, 0), (False, 0), (True, 20)]


def brute_suffixes(rows, width):
    count = {}
    for _, t, *_ in rows:
        b = (t or "").encode()
        for p in range(len(b) - width + 1):
            count[b[p : p + width]] = count.get(b[p : p + width], 0) + 1
    out = {}
    for i, t, *_ in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - width + 1):
            if count[b[p : p + width]] > 1:
                gone[p : p + width] = b"\1" * width
        spans = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        out[i] = (len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone) if not g))
    return out


@pytest.mark.parametrize("seed,width,slice_bytes", [(4, 200, 3000), (5, 40, 1 << 20), (6, 40, 900)])
def test_suffixes(spark, seed, width, slice_bytes):
    rows = corpus(seed)
    out = suffix_dedup.dedup_suffixes(spark.createDataFrame(rows, SCHEMA), width, slice_bytes).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in out} == brute_suffixes(rows, width)


def test_suffixes_odd_tables(spark):
    assert suffix_dedup.dedup_suffixes(spark.createDataFrame([], SCHEMA)).count() == 0
    out = suffix_dedup.dedup_suffixes(spark.createDataFrame([(None, "z" * 250, "", 0), (None, "q" * 100, "", 0)], SCHEMA)).collect()
    assert sorted((r.n_bytes, r.n_removed) for r in out) == [(100, 0), (250, 250)]


@pytest.mark.parametrize("seed,width", [(12, 40), (13, 200)])
def test_suffix_family_takes_batches(spark, seed, width):
    """Each batch's spans against brute force over it and all earlier ones; levels of like size merge."""
    rows = corpus(seed)
    batches = [rows[k::4] for k in range(4)]
    family = suffix_dedup.SuffixFamily(spark, width, 3)
    assert family.add(spark.createDataFrame([], SCHEMA)).count() == 0 and not family.levels
    seen, merged = [], 0
    for k, batch in enumerate(batches):
        got = family.add(spark.createDataFrame(batch, SCHEMA), 4000)
        known = {t[p : p + width] for t in seen for p in range(len(t) - width + 1)}
        texts = {i: (t or "").encode() for i, t, *_ in batch}
        count = {}
        for t in texts.values():
            for p in range(len(t) - width + 1):
                count[t[p : p + width]] = count.get(t[p : p + width], 0) + 1
        for r in got.collect():
            t, cover = texts[r.doc_id], set()
            for p in range(len(t) - width + 1):
                if t[p : p + width] in known or count[t[p : p + width]] > 1:
                    cover |= set(range(p, p + width))
            assert r.n_bytes == len(t) and {b for s in r.spans for b in range(s.start, s.end)} == cover
        seen += texts.values()
        sizes = [n for n, _ in family.levels]
        assert sum(sizes) == sum(max(0, len(t) - width + 1) for t in seen) and all(a > 2 * b for a, b in zip(sizes, sizes[1:]))
        merged += len(sizes) < k + 1
    assert merged


def shingles(t, n):
    w = [bytes(x).lower() for x in words(t)]
    return frozenset([tuple(w)] if 0 < len(w) < n else [tuple(w[k : k + n]) for k in range(len(w) - n + 1)])


def brute_components(rows, n, num, den):
    sets = {i: shingles(t, n) for i, t, *_ in rows}
    label = {i: i for i in sets}
    ids, changed = sorted(sets), True
    link = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in link:
            m = min(label[a], label[b])
            if label[a] != m or label[b] != m:
                label[a] = label[b] = m
                changed = True
    return {i: (len(sets[i]), label[i]) for i in sets}


@pytest.mark.parametrize("seed,n,num,block", [(7, 3, 90, 1024), (8, 5, 80, 1024), (9, 3, 80, 3)])
def test_jaccard(spark, seed, n, num, block, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rows = corpus(seed)
    out = jaccard_join.jaccard_components(spark.createDataFrame(rows, SCHEMA), n, num, 100, 5000).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == brute_components(rows, n, num, 100)


def test_jaccard_odd_tables(spark):
    assert jaccard_join.jaccard_components(spark.createDataFrame([], SCHEMA)).count() == 0
    t = "a b c d e f g h"
    out = jaccard_join.jaccard_components(spark.createDataFrame([(None, t, "", 0), (2, t, "", 0), (2, t, "", 0), (9, None, "", 0)], SCHEMA)).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.n_shingles) for r in out) == [(0, 0, 4), (2, 2, 4), (2, 2, 4), (9, 9, 0)]
