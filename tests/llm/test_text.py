"""Token counts, encoding, classifiers, decontamination, archives, neighbours: odd cases and exact twins."""

import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cladewise.llm import decontaminate, permutation_index, quality, sentencepiece_viterbi, token_counts, toxicity, warc
from cladewise.llm._text import flat, mix, word_hashes
from cladewise.llm.pieces import MARK, vocabulary

SCHEMA = "doc_id long, text string, score string, votes string, word string"
TEXTS = ["", None, " ", "  two  spaces ", "Ünïcode 🙂 x", f"a {MARK} mark", "tab\tand\nlines\r\n", "x" * 5000, "the of and the of and " * 300, "the of and", "the of and"]


def docs(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t, "s", "v", "w") for i, t in enumerate(texts)], SCHEMA)


@pytest.fixture(scope="module")
def vocab():
    return vocabulary()


def brute_encode(v, text):
    """Best score and ids by plain dynamic programming over the whole text."""
    return plain_encode(v, " " + text if text else "")


def plain_encode(v, t):
    best, back = [0] + [None] * len(t), [0] * (len(t) + 1)
    for end in range(1, len(t) + 1):
        for start in range(end - 1, max(0, end - v.longest) - 1, -1):
            s = v.score.get(t[start:end], v.unknown if start == end - 1 else None)
            if s is not None and (best[end] is None or best[start] + s >= best[end]):
                best[end], back[end] = best[start] + s, start
    cuts = [len(t)]
    while cuts[-1]:
        cuts.append(back[cuts[-1]])
    ids = []
    for a, b in zip(cuts[:0:-1], cuts[-2::-1]):
        ids += [v.ids[t[a:b]]] if t[a:b] in v.ids else [v.byte_ids[x] for x in t[a:b].encode()]
    return ids


def test_encoding_round_trip_and_brute_force(spark, vocab):
    rows = sentencepiece_viterbi.encode(docs(spark)).orderBy("doc_id").collect()
    for r, text in zip(rows, TEXTS, strict=True):
        if text is None:
            assert (r.ids, r.n_ids, r.round_trip) == (None, 0, None)
        else:
            assert r.round_trip and r.ids == brute_encode(vocab, text) and r.n_ids == len(r.ids)
    back = sentencepiece_viterbi.decode_ids(sentencepiece_viterbi.encode(docs(spark))).orderBy("doc_id").collect()
    assert [r.text for r in back] == TEXTS
    assert sentencepiece_viterbi.encode(docs(spark, [])).count() == 0


def test_many_equal_rows_stay_linear(spark):
    """Rows equal in id and text don't meet each other: each is found, in about the time of one."""
    passage = " ".join(f"b{i}" for i in range(40))
    b = spark.createDataFrame([(1, passage)], "item_id long, text string")
    text = " ".join(f"w{i}" for i in range(200)) + " " + passage
    took = []
    for n in (1, 4000):
        d = spark.range(n).select(F.lit(None).cast("long").alias("doc_id"), F.lit(text).alias("text"))
        began = time.time()
        rows = decontaminate.contamination(d, b).groupBy("n_words", "n_hit", "contaminated").count().collect()
        took.append(time.time() - began)
        assert [tuple(r) for r in rows] == [(240, 40, True, n)]
    assert took[1] < 4 * took[0] + 5


def test_stream_in_chunks(vocab):
    rng = random.Random(3)
    text = "".join(rng.choice(["then", "ing", " ", "  ", "ö", "🙂", "a", "\n"]) for _ in range(800))
    for size in (1, 7, 1000):
        ids = list(sentencepiece_viterbi.encode_stream(vocab, [text[k : k + size] for k in range(0, len(text), size)]))
        assert ids == brute_encode(vocab, text)
    search = sentencepiece_viterbi.StreamingViterbi(vocab)
    assert len(search.feed("the of " * 2000)) > 1900 and not search.text  # committed at each pre-token's end
    word = "thenöing" * 3000
    inside = search.finish() and search.feed(word)  # committed within an open pre-token, where paths meet
    assert len(search.text) < 4 * vocab.longest and len(inside) > 5000
    assert inside + search.feed("   ") + search.feed("then" * 40) + search.finish() == plain_encode(vocab, word + "   " + "then" * 40)
    assert search.feed(" " * 300) + search.feed(" " * 300 + "a") + search.feed("b c") + search.finish() == plain_encode(vocab, " " * 600 + "ab c")


def test_remembered_ids_change_nothing(vocab, monkeypatch):
    monkeypatch.setattr(sentencepiece_viterbi, "REMEMBERED", 2)
    monkeypatch.setattr(sentencepiece_viterbi, "CHUNK", 11)
    search = sentencepiece_viterbi.StreamingViterbi(vocab)
    for text in [*TEXTS, *TEXTS]:
        assert sentencepiece_viterbi.encode_text(search, text).tolist() == brute_encode(vocab, text)


def test_counts_equal_encoding(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "NODES", 30)  # the trie is emptied again and again
    rows = token_counts.token_counts(docs(spark)).join(sentencepiece_viterbi.encode(docs(spark)), "doc_id").collect()
    assert len(rows) == len(TEXTS) and all(r.n_tokens == r.n_ids for r in rows)


def labelled(spark, kind):
    rng = random.Random(5)
    good = ["river", "stone", "window", "garden", "letter", "market"]
    rows, labels = [], []
    for i in range(400):
        w, y = [rng.choice(good) for _ in range(30)], int(i % 4 == 0)
        if y:
            w = w[:27] + ["lowbeast" + rng.choice("abc"), "idiot", "scum"] if kind == "toxic" else [x.upper() + "!!" for x in w]
        rows.append((i, " ".join(w), "s", "v", "w"))
        labels.append((i, 1 - y if kind == "quality" else y))
    rows += [(1000, None, "s", "v", "w"), (1001, "", "s", "v", "w"), (None, "river stone", "s", "v", "w"), (1002, "river " * 20000, "s", "v", "w")]
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, f"doc_id long, {kind} int")


@pytest.mark.parametrize("kind", ["toxic", "quality"])
def test_classifiers(spark, kind):
    d, labels = labelled(spark, kind)
    held = F.pmod(toxicity.fold(), F.lit(5)) == 0
    score = (toxicity.score_toxicity if kind == "toxic" else quality.score_quality)(d, labels.where(~held))
    rows = score.join(labels.withColumn("held", held), "doc_id", "left").collect()
    assert len(rows) == 404 and all(0 <= r.score <= 1 for r in rows)
    test = [r for r in rows if r.held]
    assert len(test) > 40 and sum(r.predicted == r[kind] for r in test) >= 0.95 * len(test)
    assert all(r.held == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows if r.held is not None)
    empty = score.where("doc_id in (1000, 1001)").select("score").distinct().count()
    assert empty == 1
    if kind == "quality":
        kept = {r.doc_id for r in quality.keep_quality(d, labels).collect()}
        assert {i for i in range(400) if i % 4} <= kept and not {i for i in range(400) if i % 4 == 0} & kept


def test_quality_scores_equal_plain_ones():
    """Features and scores of a trained model against words, bigrams and characters in plain Python."""
    texts = [t for t in TEXTS] + ["Ünï çode ünï", "a a a b", "x\ty  z"]

    def one(piece, second=None):
        data, offsets = flat(pa.array([piece] if second is None else [piece, second], pa.string()))
        h = word_hashes(data, offsets[:-1], offsets[1:])
        if second is not None:
            h = np.array([quality._SAME]) if piece == second else mix(h[1:] ^ (h[:1] * quality._ODD))
        return int(quality._bucket(h)[0])

    model = quality.Embeddings(list(quality.bags(pa.array(texts, pa.string()))), np.arange(len(texts)) % 2)
    scores = model.score(pa.array(texts, pa.string()))
    for text, score, (bucket, share) in zip(texts, scores, quality.bags(pa.array(texts, pa.string())), strict=True):
        t = text or ""
        w = [x.decode() for x in t.encode().split()]
        found = [one(x) for x in w] + [one(a, b) for a, b in zip(w, w[1:])] + [one(t[k : k + n]) for n in quality.GRAMS for k in range(len(t) - n + 1)]
        z = sum(float(model.weight[b]) for b in found) / max(len(found), 1) + model.offset
        assert math.isclose(score, 1 / (1 + math.exp(-z)), rel_tol=1e-5)
        assert dict(zip(bucket.tolist(), (share * len(found)).round().astype(int).tolist())) == dict(Counter(found))


def test_quality_sample_is_packed():
    """The sample travels and is held packed (less than a third of its buckets and shares), and the same is learned from it."""
    texts = [f"{' '.join(str(i * j % 1009 + i) + chr(97 + j % 26) for j in range(900))}" for i in range(20)] + ["", None]
    plain, label = list(quality.bags(pa.array(texts, pa.string()))), np.arange(len(texts)) % 2
    blobs = [quality.packed(*x) for x in quality.counts(pa.array(texts, pa.string()))]
    assert 3 * sum(map(len, blobs)) < sum(b.nbytes + s.nbytes for b, s in plain)
    for (bucket, share), (own, part) in zip(plain, quality.Bags(blobs), strict=True):
        assert (bucket == own).all() and (share == part).all() and own.dtype == np.int32 and part.dtype == np.float32
    a, b = quality.Embeddings(plain, label), quality.Embeddings(quality.Bags(blobs), label)
    assert (a.weight == b.weight).all() and a.offset == b.offset


def test_quality_model_is_learned_in_a_task(spark, monkeypatch):
    """Only the model comes to the driver: no table of the sample, whose memory the driver would keep."""
    from pyspark.sql.classic.dataframe import DataFrame

    docs = spark.createDataFrame([(i, f"{'good clear prose' if i % 2 else 'spam spam junk'} {i % 7}") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    monkeypatch.setattr(DataFrame, "toArrow", lambda self: pytest.fail("the sample came to the driver"))
    got = {r.doc_id: r.score for r in quality.score_quality(docs, labels).collect()}
    model = quality.Embeddings(list(quality.bags(pa.array([r.text for r in docs.orderBy("doc_id").collect()], pa.string()))), np.arange(60) % 2)
    want = model.score(pa.array([r.text for r in docs.orderBy("doc_id").collect()], pa.string()))
    assert np.allclose([got[i] for i in range(60)], want)
    assert {r.predicted for r in quality.score_quality(docs, labels.where("doc_id < 0")).collect()} == {0}




def test_toxicity_votes_and_scores_equal_plain_ones():
    """Votes and linear scores against plain Python on words of a text."""
    insults = {k: set(terms) for k, terms in enumerate(toxicity.LEXICONS)}
    mined, begin, pair = ["gnarl", "idiot"], "blarg", ("foul", "play")
    key = np.concatenate([toxicity._hash_words(mined), toxicity._hash_words([begin]) ^ toxicity._SALT, toxicity.word_pairs(toxicity.word_features(pa.array([" ".join(pair)])))[0]])
    voters = toxicity.Voters(key, np.array([toxicity.WORDS, toxicity.SURE, toxicity.BEGINNINGS, toxicity.PAIRS]), toxicity._hash_words(["oddly", "foul"]))
    texts = ["You are such an Idiot", "you one two three idiot", "blargness gnarl", "foul play", "play foul", "scum, trash! SCUM", "NOOOOOO WAY", "hey!!!!", "", None, "plain words", "you", "scum gnarl", "u GNARL", "idiot\nidiot idiot", "7777777", "oddly foul", "oddly foul oddly", "oddly " + "plain " * 40 + "oddly foul", "oddly foul oddly", "oddly " + "plain " * 400 + "oddly foul"]
    got = voters.votes(toxicity.word_features(pa.array(texts, pa.string())))
    classifier = toxicity.Classifier(np.concatenate([key[:3], toxicity._hash_words(["scum"])]))
    classifier.weight[:] = [1.0, 2.0, 4.0, 8.0]
    scores = classifier.score(toxicity.word_features(pa.array(texts, pa.string())))
    for text, votes, score in zip(texts, got, scores, strict=True):
        t = text or ""
        w, n = [x.decode() for x in plain_words(t)], max(len(t), 1)
        bad = [x in mined or any(x in v for v in insults.values()) for x in w]
        on = {k for k, v in insults.items() if v & set(w)} | ({toxicity.WORDS} if "gnarl" in w else set()) | ({toxicity.SURE} if "idiot" in w else set())
        on |= ({toxicity.BEGINNINGS} if any(x[:5] == begin for x in w) else set()) | ({toxicity.PAIRS} if pair in zip(w, w[1:]) else set())
        on |= {toxicity.ADDRESSED} if any(b and set(w[max(0, i - 3) : i]) & set(toxicity.ADDRESS) for i, b in enumerate(bad)) else set()
        on |= {toxicity.SEVERAL} if sum(bad) >= 3 else set()
        likely = sum(x in ("oddly", "foul") or any(x in v for v in insults.values()) for x in w)
        on |= {toxicity.DENSE} if likely >= toxicity.DENSE_LEAST and likely >= toxicity.DENSE_SHARE * len(w) else set()
        on |= ({toxicity.CAPITALS} if sum(c.isupper() for c in t) / n > 0.5 else set()) | ({toxicity.EXCLAIMED} if t.count("!") / n > 0.02 else set())
        on |= {toxicity.STRETCHED} if sum(c.isalpha() and t[k - 3 : k] == c * 3 for k, c in enumerate(t)) / n > 0.02 else set()
        assert int(votes) == sum(1 << k for k in on), text
        z = classifier.bias + ("gnarl" in w) + 2 * ("idiot" in w) + 4 * any(x[:5] == begin for x in w) + 8 * ("scum" in w)
        assert math.isclose(score, 1 / (1 + math.exp(-z)))
    with_votes = toxicity.Classifier(key[:1], voters=voters)
    with_votes.weight[1:] = np.arange(toxicity.VOTERS) / 8
    for votes, score in zip(got, with_votes.score(toxicity.word_features(pa.array(texts, pa.string()))), strict=True):
        assert math.isclose(score, 1 / (1 + math.exp(2 - sum(k / 8 for k in range(toxicity.VOTERS) if votes >> k & 1))))


def plain_label_model(masks, counts, prior, rounds, labelled):
    """The label model voter by voter, in plain Python."""
    n, last = toxicity.VOTERS, toxicity.CAPITALS
    bit = lambda m, k: m >> k & 1
    clip = lambda x, a, b: min(max(x, a), b)
    rate = [[0.02 if k >= last else 0.01 for k in range(n)], [0.04 if k >= last else 0.3 for k in range(n)]]
    for y in (0, 1):
        own = [(m, c) for m, label, c in labelled if label == y]
        total = sum(c for _, c in own)
        rate[y] = [clip((sum(c for m, c in own if bit(m, k)) + 10 * rate[y][k]) / (total + 10), 1e-4, 1 - 1e-4) for k in range(n)]
    corr = [[0.0] * n for _ in range(n)]

    def posterior(m):
        z = math.log(prior / (1 - prior))
        for k in range(n):
            a, b = (rate[1][k], rate[0][k]) if bit(m, k) else (1 - rate[1][k], 1 - rate[0][k])
            z += math.log(a / b) / (1 + sum(corr[k][j] for j in range(n) if bit(m, j) == bit(m, k)))
        return 1 / (1 + math.exp(-clip(z, -30, 30)))

    plain, every = masks, sum(counts) / max(sum(c for *_, c in labelled), 1)
    counts, masks = [*counts, *(c * every for *_, c in labelled)], [*masks, *(m for m, *_ in labelled)]
    for _ in range(rounds):
        q = [posterior(m) for m in plain] + [label for _, label, _ in labelled]
        by = [[c * (1 - p) for c, p in zip(counts, q)], [c * p for c, p in zip(counts, q)]]
        for y in (0, 1):
            rate[y] = [clip((sum(w for m, w in zip(masks, by[y]) if bit(m, k)) + 0.5) / (sum(by[y]) + 1), 1e-4, 1 - 1e-4) for k in range(n)]
        prior = clip(sum(by[1]) / sum(counts), 0.005, 0.5)
        extra = [[0.0] * n for _ in range(n)]
        for y in (0, 1):
            total = max(sum(by[y]), 1e-9)
            cov = lambda i, j: sum(w * (bit(m, i) - rate[y][i]) * (bit(m, j) - rate[y][j]) for m, w in zip(masks, by[y])) / total  # noqa: B023, E731
            var = [math.sqrt(max(cov(k, k), 1e-9)) for k in range(n)]
            for i in range(n):
                for j in range(n):
                    extra[i][j] += 0.5 * clip(cov(i, j) / var[i] / var[j], 0, 1) if j != i else 0
        corr = extra
    return [posterior(m) for m in plain], rate, prior


def test_label_model_equals_a_plain_one():
    rng = random.Random(6)
    masks = sorted({0, *(sum(1 << k for k in range(toxicity.VOTERS) if rng.random() < 0.25) for _ in range(12))})
    counts = [rng.randrange(1, 300) if m else 5000 for m in masks]
    labelled = [(m, label, rng.randrange(1, 40)) for m in masks[:9] for label in (0, 1)]
    for known in (labelled, []):
        model = toxicity.LabelModel(np.array(masks), np.array(counts, float), 0.1, 4, known)
        q, rate, prior = plain_label_model(masks, counts, 0.1, 4, known)
        assert np.allclose(model.posterior(np.array(masks)), q) and np.allclose(model.rate, rate) and math.isclose(model.prior, prior)


def test_classifiers_learn_from_one_text_of_an_id(spark):
    """A labelled id that repeats, rows equal or not, counts once; repeated rows score alike; the sample's bytes are bounded."""
    d, labels = labelled(spark, "quality")
    again = d.where("doc_id < 40").unionByName(d.where("doc_id < 40")).unionByName(d.where("doc_id < 40").withColumn("text", F.lit("other words")))
    sample = toxicity.training_sample(again, labels, "quality", 30, 4000).collect()
    assert len({r.doc_id for r in sample}) == len(sample) <= 30 and 0 < sum(len(r.text) for r in sample) <= 4000
    for f in (quality.score_quality, toxicity.score_toxicity):
        rows = f(again, labels.withColumnRenamed("quality", "toxic") if f is toxicity.score_toxicity else labels).collect()
        assert len(rows) == 120 and len({(r.doc_id, r.score) for r in rows}) <= 80


def test_classifiers_without_rows(spark):
    for f, c in ((toxicity.score_toxicity, "toxic"), (quality.score_quality, "quality")):
        none = spark.createDataFrame([], f"doc_id long, {c} int")
        assert f(docs(spark, []), none).count() == 0
        assert f(docs(spark), none).count() == len(TEXTS)


WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(t):
    return WORD.findall((t or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))))


@pytest.mark.parametrize("bits", [1 << 20, 64])
def test_decontamination(spark, bits, monkeypatch):
    monkeypatch.setattr(decontaminate, "MARK_BITS", bits)
    rng = random.Random(11)
    say = lambda n: " ".join(rng.choice(["Aé", "b2", "c", "d", "e", "f"]) for _ in range(n))
    items = [(i, say(n), "x") for i, n in enumerate([20, 13, 5, 40, 1])] + [(7, "", "x"), (8, None, "x"), (9, "!!", "x"), (10, "never seen here", "x")]
    texts = [say(30) + "-" + items[k][1].upper().replace("É", "é") + " . " + say(rng.randrange(400)) for k in (0, 1, 2, 3)] + [say(200), "", None, items[3][1], items[3][1]]
    rows = [(i if i != 4 else None, t, "s", "v", "w") for i, t in enumerate(texts)]
    got = decontaminate.contamination(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(items, "item_id long, text string, word string")).collect()
    assert len(got) == len(rows)
    expected = {}
    for i, t, *_ in rows:
        w, hit, found = plain_words(t), set(), set()
        for item, text, _ in items:
            x = plain_words(text)
            n = min(13, len(x))
            for s in range(len(x) - n + 1) if n else ():
                for k in range(len(w) - n + 1):
                    if w[k : k + n] == x[s : s + n]:
                        hit |= set(range(k, k + n))
                        found.add(str(item))
        expected[i] = (len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w))
    assert {r.doc_id: (r.n_words, r.n_hit, r["items"], r.contaminated) for r in got} == expected


def test_proximity(spark):
    d = spark.createDataFrame([(1, "x alpha y beta z gamma q"), (2, "alpha beta gamma"), (3, "alpha x x x x beta gamma")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    got = {(r.doc_id, r.exact) for r in decontaminate.matches(d, b, 13, 2).collect()}
    assert got == {(1, False), (2, True)}
    assert decontaminate.contamination(d.limit(0), b).count() == 0
    assert not any(r.n_hit for r in decontaminate.contamination(d, b.limit(0)).collect())


def test_share_is_exact(spark):
    item = " ".join(f"t{i}" for i in range(13))
    d = spark.createDataFrame([(n, item + " x" * n) for n in (26, 30, 31, 37)], "doc_id long, text string")
    b = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r.doc_id: r.contaminated for r in decontaminate.contamination(d, b, share=0.3).collect()}
    assert got == {n: 13 >= 0.3 * (13 + n) for n in (26, 30, 31, 37)}


def test_lists_are_stored_and_intersected(spark, monkeypatch):
    """Documents that hold the rarest word and others of a window at other offsets are turned away by the lists."""
    monkeypatch.setattr(decontaminate, "LOOKUPS", 2)
    item = "rare one two three four five six seven eight nine ten eleven twelve thirteen"
    d = spark.createDataFrame([(1, "x " + item + " y"), (2, "rare two one three four"), (3, " ".join(reversed(item.split()))), (4, "twelve " * 20000 + item)], "doc_id long, text string")
    b = spark.createDataFrame([(1, item), (2, item + " more words")], "item_id long, text string")
    windows = decontaminate.item_windows(b, 13)
    ranked = decontaminate.rarest_terms(windows, decontaminate.frequencies(d, windows.select(F.explode("window").alias("word")).distinct())).collect()
    assert len(ranked) == 4 and all(len(r["lists"]) == 3 and [x.n for x in r["lists"]] == sorted(x.n for x in r["lists"]) and "twelve" not in [x.word for x in r["lists"]] for r in ranked)
    got = {r.doc_id: (r.n_hit, r["items"]) for r in decontaminate.contamination(d, b).collect()}
    assert got == {1: (14, ["1", "2"]), 2: (0, []), 3: (0, []), 4: (14, ["1", "2"])}


def test_archive(spark):
    big, other = "é" * 80, "<p>" + "a\r\n\r\nb" * 40
    rows = [(5, "http://B.example.org/x?q=1", big, 1, 1), (3, "https://a.b.example.org", big, 1, 1), (9, None, big, 1, 1), (4, "http://B.example.org/x?q=1", other, 1, 1), (6, "u", "short", 1, 1), (7, "u", "short", 1, 1), (8, "bad url\r\nX: y", None, 1, 1), (None, "n", big, 1, 1), (10, "http://[bad", "", 1, 1), (10, "http://[bad", "", 1, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, file int, offset int")
    base = warc.shared_dir(spark)
    warc.write_archive(pages, f"{base}/warc")
    read = warc.read_archive(spark, f"{base}/warc").collect()
    assert sorted((r.page_id or 0, r.record_type, r.refers_to, r.payload_bytes) for r in read) == sorted([(0, "response", None, 160), (3, "response", None, 160), (4, "response", None, len(other)), (5, "revisit", 3, 160), (6, "response", None, 5), (7, "response", None, 5), (8, "response", None, 0), (9, "revisit", 3, 160), (10, "response", None, 0), (10, "response", None, 0)])
    assert {r.page_id: r.payload for r in read if r.record_type == "response"} == {None: big, 3: big, 4: other, 6: "short", 7: "short", 8: "", 10: ""}
    warc.write_index(warc.read_archive(spark, f"{base}/warc", payloads=False), f"{base}/index", 2)
    found = warc.lookup(spark, f"{base}/index", "http://b.example.org:80/x?q=1#frag")
    assert [r["page_id"] for r in found] == [4, 5] and not warc.lookup(spark, f"{base}/index", "http://nowhere.example")
    fields, payload = warc.read_range(spark, found[0]["file"], found[0]["offset"], found[0]["length"])
    assert payload.decode() == other and fields["page-id"] == "4"
    assert warc.archive(pages).count() == len(rows)
    assert warc.archive(pages.limit(0)).count() == 0


def test_index_ranges(spark, monkeypatch):
    """Every record of many blocks and files is found by directory, block and range, and nothing beside the ranges is read."""
    monkeypatch.setattr(warc, "BLOCK_LINES", 7)
    monkeypatch.setattr(warc, "FILE_BYTES", 4000)
    monkeypatch.setattr(warc, "CLASSES", (100, 1000, 2000))
    html = {i: "é" * (i * 37 % 1500) + str(i) for i in range(120)} | {120: "long " * 40000, 121: "", 122: None}
    url = {i: f"http://h{i % 11}.example.org/p{i % 40}" for i in html} | {5: "http://zz.example/", 6: "http://zz.example/", 121: None}
    pages = spark.createDataFrame([(i, url[i], h) for i, h in html.items()], "page_id long, url string, html string")
    base = warc.shared_dir(spark)
    warc.write_archive(pages, f"{base}/warc")
    sizes = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{base}/warc").select("length").collect()
    assert sum(r.length > 60_000 for r in sizes) == 1 and len(sizes) > 5
    warc.write_index(warc.read_archive(spark, f"{base}/warc", payloads=False), f"{base}/index", 3)
    read = []
    ranged = warc.read_bytes
    monkeypatch.setattr(warc, "read_bytes", lambda s, f, o, n: read.append((f, o, n)) or ranged(s, f, o, n))
    for in_memory in (1_000_000, 0):
        monkeypatch.setattr(warc, "DIRECTORY_LINES", in_memory)
        index = warc.CaptureIndex(spark, f"{base}/index")
        for u in set(url.values()) if in_memory else ["http://zz.example/", "http://h3.example.org/p3", None]:
            read.clear()
            found = index.captures(u)
            assert [r["page_id"] for r in found] == sorted(i for i in html if url[i] == u) and len(read) <= 3
            for r in found:
                fields, payload = warc.read_range(spark, r["file"], r["offset"], r["length"])
                assert fields["page-id"] == str(r["page_id"]) and (r["record_type"] == "revisit" or payload.decode() == (html[r["page_id"]] or ""))
    assert {r.page_id for r in warc.index_lines(spark, f"{base}/index").collect()} == set(html)


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(600, 16))
    v[100:220] = v[0]  # many copies
    rows = [(i, [float(x) for x in e], 1, 1) for i, e in enumerate(v)]
    bad = [(1000, None, 1, 1), (1020, [0.0] * 16, 1, 1), (1040, [1.0] * 15 + [float("nan")], 1, 1), (1060, [1.0] * 15 + [float("inf")], 1, 1), (1080, [1.0] * 15 + [None], 1, 1), (None, [1.0] * 16, 1, 1), (1100, [1.0] * 3, 1, 1)]
    t = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, rank int, places int")
    out = permutation_index.nearest(t, t.where("vec_id % 20 = 0"), k=20).orderBy("query_id", "rank").collect()
    f = v.astype(np.float32).astype(float)
    for q in range(0, 600, 20):
        got = [r for r in out if r.query_id == q]
        assert [r.rank for r in got] == list(range(1, 21)) and all(math.isclose(r.score, f[r.vec_id] @ f[q], abs_tol=1e-12) for r in got)
        if q in (0, 120):  # ties go to the smaller ids
            assert [r.vec_id for r in got] == permutation_index.brute_force(f, np.arange(600), f[q], q)
    assert not any(r.query_id >= 1000 or r.vec_id >= 1000 for r in out)
    assert permutation_index.nearest(t.limit(0), t.limit(0)).count() == 0
    assert permutation_index.nearest(t.where("vec_id < 5"), t.where("vec_id = 0"), k=20).count() == 4


def test_neighbours_of_odd_ids(spark):
    """Whichever row has another dimension, the others are searched; of two vectors of one id the nearer counts."""
    rows = [(i, [1.0, i / 60, 0.0, 0.5]) for i in range(60)]
    for odd in (0, 7, 20, 59):
        t = spark.createDataFrame([(i, e if i != odd else [1.0, 2.0]) for i, e in rows], "vec_id long, embedding array<double>")
        got = permutation_index.nearest(t, t.where("vec_id % 20 = 0"), k=5).groupBy("query_id").count().collect()
        assert {r.query_id: r["count"] for r in got} == {q: 5 for q in (0, 20, 40) if q != odd}
    t = spark.createDataFrame([(0, [1.0, 0.0]), (1, [3.0, 0.0]), (1, [5.0, 0.0]), (1, [5.0, 0.0]), (2, [4.0, 0.0])], "vec_id long, embedding array<double>")
    got = permutation_index.nearest(t, t.where("vec_id = 0"), k=5).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(1, 5.0), (2, 4.0)]


@pytest.mark.parametrize("spread", [0.0, 0.5, 1.0])
def test_neighbours_recall(spark, spread):
    """Recall over several blocks, for vectors of equal and of unequal length, at the production setting."""
    rng = np.random.default_rng(3)
    v = rng.normal(size=(8000, 32))
    v *= (rng.lognormal(0, spread, len(v)) / np.linalg.norm(v, axis=1))[:, None]
    t = spark.createDataFrame([(i, e.tolist()) for i, e in enumerate(v)], "vec_id long, embedding array<double>")
    out = permutation_index.nearest(t, t.where("vec_id % 100 = 0"), block_bytes=2000 * 32 * 8).collect()
    recall = [len({r.vec_id for r in out if r.query_id == q} & set(permutation_index.brute_force(v, np.arange(len(v)), v[q], q))) / 20 for q in range(0, 8000, 100)]
    assert np.mean(recall) >= 0.9
