"""Vector codes, chat formatting and the Merkle manifest against brute force, with odd rows."""

import hashlib
import math
import random
import zlib
from collections import defaultdict
from itertools import groupby

import numpy as np
import pytest
from pyspark.sql import functions as F

from cladewise.llm import chat_format, merkle, vector_codes
from cladewise.llm.chat_format import Template

# vector codes


def plain_codes(rows, parts, entries, rounds):
    """{row number: (code, error)} and the books, in Python's integers."""
    kept = [(i, v, [math.floor(4096 * c) for c in x]) for i, (v, x) in enumerate(rows)]
    width = len(kept[0][2]) // parts
    by_id = {}
    for _, v, x in kept:
        by_id[v] = min(by_id.get(v, x), x)
    heads = [by_id[v] for v in sorted(by_id, key=lambda v: (v is None, v or 0))[:entries]]
    books = [[h[p * width : (p + 1) * width] for h in heads] for p in range(parts)]
    cut = lambda x, p: x[p * width : (p + 1) * width]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            own = defaultdict(list)
            for _, _, x in kept:
                own[near(cut(x, p), books[p])[1]].append(cut(x, p))
            books[p] = [[sum(c) // len(own[k]) for c in zip(*own[k])] if own[k] else e for k, e in enumerate(books[p])]
    out = {}
    for i, _, x in kept:
        best = [near(cut(x, p), books[p]) for p in range(parts)]
        out[i] = "".join(f"{k:02x}" for _, k in best), sum(d for d, _ in best)
    return out, books


VECTORS = "row int, vec_id long, embedding array<double>, label string, code string, x int, rows int"


def vectors(spark, rows, labels=None):
    return spark.createDataFrame([(i, v, x, None if labels is None else labels[i], "c", 1, 2) for i, (v, x) in enumerate(rows)], VECTORS)


@pytest.mark.parametrize("scale", [1.0, 1e6, 1e12, 1e300])
def test_codes_against_plain_integers(spark, scale):
    rng = random.Random(5)
    rows = [(i % 90 if i % 31 else None, [rng.choice([-1, 1]) * rng.random() * scale for _ in range(6)]) for i in range(120)]
    rows += rows[:7]
    labels = [None if i % 5 == 0 else f"l{i % 4}" for i in range(len(rows))]
    want, books = plain_codes(rows, 3, 5, 4)
    got = vector_codes.compress(vectors(spark, rows, labels), parts=3, entries=5, rounds=4).collect()
    fits = lambda n: n if n < 2**63 else None
    total = defaultdict(int)
    for i, (_, e) in want.items():
        total[labels[i]] += e
    whole = lambda l: None if any(want[i][1] >= 2**63 for i in want if labels[i] == l) else fits(total[l])  # noqa: E731, E741
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(((r.vec_id, r.label, r.code, r.error, r.label_error) for r in got), key=key) == sorted(((rows[i][0], labels[i], c, fits(e), whole(labels[i])) for i, (c, e) in want.items()), key=key)
    flat = ",".join(str(v) for part in books for entry in part for v in entry)
    assert {r.codebooks_sha256 for r in got} == {hashlib.sha256(flat.encode()).hexdigest()}


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, -0.5]), (2, None), (3, [nan, 1.0]), (4, [None, 1.0]), (5, [inf, 0.0]), (6, []), (7, [1.0]), (8, [1.0, 2.0, 3.0]), (9, [0.25, 0.0])]
    got = {r.vec_id: (r.code, r.error) for r in vector_codes.compress(vectors(spark, rows), parts=2).collect()}
    assert got == {1: ("0000", 0), 9: ("0101", 0)}
    assert vector_codes.compress(vectors(spark, rows).limit(0)).count() == 0
    assert vector_codes.compress(vectors(spark, [(1, None)]), parts=2).count() == 0


def test_codes_stand_for_near_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(v) for v in rng.normal(size=8)]) for i in range(200)]
    kept = vector_codes.kept_vectors(vectors(spark, rows), 8)
    trained = vector_codes.train(kept, 8, 16, 6)
    coded = vector_codes.encoded(kept, trained)
    error = {r.vec_id: r.error for r in coded.collect()}
    for r in vector_codes.decoded(coded, trained).collect():
        away = sum((a - b) ** 2 for a, b in zip(r.x, rows[r.vec_id][1]))
        assert abs(math.sqrt(away) - math.sqrt(error[r.vec_id]) / 4096) < 8 / 4096  # a component is off by less than a step


# chat formatting

TRICKY = ["", "plain", "<turn>", "\\<turn>", "<\\turn>", "</turn>\n", "</turn>", "<says><more>", "<<more>", "\\", "\\\\<says>\\", "<turn", "tail </tu", "🙂 <more>\\é", r"\### Assistant: </turn> ok", "$1 \\$2", "\n", "role\nuser\n"]


def plain_turns(rows):
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t is not None, t or 0, role or "", text or ""))
    return {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in by.items()}


def conversations():
    rng = random.Random(8)
    rows = []
    for c in range(40):
        for t in range(rng.randrange(1, 9)):
            rows.append((c, t, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice(TRICKY) + rng.choice(TRICKY)))
    rows += [(50, None, "user", "null turn"), (50, 0, "assistant", "zero"), (50, 0, "assistant", "tie"), (50, 0, "assistant", "tie"), (51, 1, None, None), (52, 3, "assistant", None), (None, 1, "user", "no id"), (None, 2, "assistant", "no id"), (53, 0, "<says>\\role", "odd role"), (54, 0, "assistant", "long <turn> " * 30_000)]
    rows += [(55, t, "assistant" if t % 3 else "user", f"text {t} é") for t in range(1500)]
    return rows


CHATS = "conv_id long, turn long, role string, text string, turns string, formatted string"


def test_chats_come_back_whole(spark):
    rows = conversations()
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame([r + ("t", "f") for r in rows], CHATS)
    chats = chat_format.format_chats(df)
    want = plain_turns(rows)
    back = {r.conv_id: r for r in chats.select("*", chat_format.turns_of(F.col("formatted")).alias("turns"), chat_format.learnt_text(F.col("formatted"), F.col("loss_spans")).alias("learnt")).collect()}
    digests = {r.conv_id: r for r in chat_format.read_back(chats).collect()}
    assert set(back) == set(want)
    t = Template()
    unescape = lambda s: s.replace("\\\\", "\0").replace("<\\", "<").replace("\0", "\\")
    for c, turns in want.items():
        r = back[c]
        assert [tuple(x) for x in r.turns] == turns
        spans = [unescape(r.formatted[s.start : s.start + s.length]) for s in r.loss_spans]
        learnt = [x for role, x in turns if role == "assistant"]
        assert spans == learnt and r.learnt == "".join(learnt)
        assert r.formatted.count(t.opening) == len(list(groupby(turns, lambda x: x[0]))) == r.formatted.count(t.closing)  # adjacent turns of a role are one block
        told = "".join(f"{role}\n{x}\n" for role, x in turns)
        d = digests[c]
        assert (d.n_turns, d.turns_sha256) == (len(turns), hashlib.sha256(told.encode()).hexdigest())
        assert (d.loss_chars, d.loss_sha256, d.formatted_chars) == (len(r.learnt), hashlib.sha256(r.learnt.encode()).hexdigest(), len(r.formatted))
    assert chat_format.format_chats(df.limit(0)).count() == 0


def test_other_templates(spark):
    template = Template("#Turn ", "#: ", "#+ ", "#.\n", escape="~", learnt=("bot", "tool"))
    rows = [(1, 0, "bot", "a #: ~#+ $1"), (1, 1, "bot", "#.\n"), (1, 2, "tool", "~~"), (1, 3, "user", "x")]
    chats = chat_format.format_chats(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string"), template)
    r = chats.select("formatted", chat_format.turns_of(F.col("formatted"), template).alias("turns"), chat_format.learnt_text(F.col("formatted"), F.col("loss_spans"), template).alias("learnt")).first()
    assert [tuple(x) for x in r.turns] == [x[2:] for x in rows] and r.learnt == "".join(x[3] for x in rows[:3])
    assert r.formatted == "#Turn bot#: a #~: ~~#~+ $1#+ #~.\n#.\n#Turn tool#: ~~~~#.\n#Turn user#: x#.\n"
    for bad in [("<a", "<b", "<c", "d"), ("<a<", "<b", "<c", "<d"), ("<a", "<a", "<c", "<d"), ("<a", "<ab", "<c", "<d"), ("<\\a", "<b", "<c", "<d")]:
        with pytest.raises(ValueError):
            Template(*bad)


def test_chats_run_without_python(spark):
    df = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    rows = chat_format.added_conversation(-7, [("user", "a"), ("assistant", "b")], spark)
    plan = chat_format.read_back(chat_format.format_chats(rows))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("Exchange") <= 1
    assert {r.conv_id for r in chat_format.format_chats(df.union(rows)).collect()} == {1, -7}


# Merkle manifest


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def plain_leaf(r, more=0):
    values = [r["doc_id"], r["source"], r["lang"], None if r["n_chars"] is None else r["n_chars"] + more, r["text"]]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(nodes, arity):
    """Root, and for each node the (left, right) of its path."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[k : k + arity] for k in range(0, len(nodes), arity)]
        for leaf, k in enumerate(at):
            run, i = runs[k // arity], k % arity
            paths[leaf].append(("".join(run[:i]), "".join(run[i + 1 :])))
        at, nodes = [k // arity for k in at], [sha("".join(r)) for r in runs]
    return nodes[0], paths


def plain_manifest(rows, arity):
    by = defaultdict(list)
    for r in rows:
        by[r["lang"]].append(r)
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    subs, leaves = [], []
    for lang in langs:
        own = sorted(by[lang], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, plain_leaf(r)))
        sub, paths = plain_tree([plain_leaf(r) for r in own], arity)
        subs.append(sub)
        leaves.append(list(zip(own, paths)))
    root, tops = plain_tree(subs, arity)
    out = []
    for sub, top, own in zip(subs, tops, leaves):
        for r, path in own:
            path = path + top
            node = plain_leaf(r, int(r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0))
            for left, right in path:
                node = sha(left + node + right)
            out.append((r["doc_id"], plain_leaf(r), sub, root, sha("".join(a + b for a, b in path)), node, node == root))
    return out


DOCS = "doc_id long, source string, lang string, n_chars long, text string, tree string, pos int, leaf string"


@pytest.mark.parametrize("arity, levels", [(2, 12), (2, 2), (3, 1)])
def test_manifest_against_plain_trees(spark, arity, levels):
    rng = random.Random(2)
    langs = ["en"] * 12 + ["de", "fr", None, "Ω", "z", "", "a,b"]
    rows = [{"doc_id": i, "source": rng.choice(["s", None, ""]), "lang": rng.choice(langs), "n_chars": rng.choice([None, i, 2**63 - 1]), "text": rng.choice([None, "", "é🙂", f"text {i}"])} for i in range(150)]
    rows += [dict(rows[0]), dict(rows[0]), rows[1] | {"text": "other"}, rows[2] | {"doc_id": None}, rows[3] | {"doc_id": None, "text": "y" * 300_000}, rows[5] | {"lang": "alone"}]
    rng.shuffle(rows)
    df = spark.createDataFrame([tuple(r.values()) + ("t", 1, "l") for r in rows], DOCS)
    got = [tuple(r) for r in merkle.verified(merkle.manifest(df, arity, levels)).collect()]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(got, key=key) == sorted(plain_manifest(rows, arity), key=key)
    assert merkle.manifest(df.limit(0), arity, levels).count() == 0
    one = merkle.verified(merkle.manifest(df.where("lang = 'alone'"), arity, levels)).first()
    assert one.leaf == one.subroot == one.root and one.proof_sha256 == sha("")


def test_one_id_in_most_rows_is_dealt_over_parts(spark):
    rows = spark.range(4000).select(F.lit(0).alias("tree"), F.lit(7).alias("doc_id"), F.lit("same").alias("leaf"))
    at = merkle.placed(merkle.written(rows), ["doc_id", "leaf"])
    assert sorted(r.pos for r in at.collect()) == list(range(4000))
