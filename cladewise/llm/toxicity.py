"""Toxicity by weak supervision.

Voters are distinct sources: three fixed lexicons; words, word beginnings and
word pairs mined from labelled training rows (words in two grades of precision);
an insult soon after "you"; a text with several insults; one in which words that
are likely insults, in any language, are dense; and the shares of capitals, of
exclamation marks and of stretched letters. Each votes toxic or abstains. A
generative label model, begun with the rates of labelled rows and fitted by
expectation maximisation on the counts of all vote patterns of all documents,
estimates how often each voter fires on toxic and on clean texts and how much
voters repeat each other; correlated voters that say the same count less. A linear classifier over
words, word beginnings and votes is trained on the posterior labels of a bounded
sample and scores every text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import written
from ._text import LOWER, NON_ALNUM, flat, mix, pieces, span_hashes, word_hashes, word_spans, _BYTE

#: Most training rows that are gathered to mine lexicons and to fit the classifier.
SAMPLE_ROWS = 16_000
#: Bytes of a word beginning, and most features mined of a kind or selected.
BEGINNING, FEATURES = 5, 4096

#: Common insults in three groups.
LEXICONS = (
    ("idiot", "moron", "stupid", "dumb", "imbecile", "fool"),
    ("trash", "scum", "garbage", "filth", "vermin", "worthless"),
    ("loser", "clown", "pathetic", "disgusting", "ugly", "hate"),
)
#: Words that address the reader.
ADDRESS = ("you", "your", "youre", "u", "ur")
#: Voters by number: after the lexicons, what is mined (beginnings, pairs, words, words of high precision), then patterns.
BEGINNINGS, PAIRS, WORDS, SURE, ADDRESSED, SEVERAL, DENSE, CAPITALS, EXCLAIMED, STRETCHED = range(len(LEXICONS), len(LEXICONS) + 10)
VOTERS = STRETCHED + 1
#: Precision from which a mined word counts as sure (with half a clean row added); words between "you" and an insult; insults that make several.
SURE_PRECISION, NEAR, MANY = 0.95, 3, 3
#: Sample rows and precision (with one clean row added) from which a word is a likely insult; how many, and which share of a text's words, make them dense.
LIKELY_SUPPORT, LIKELY_PRECISION, DENSE_LEAST, DENSE_SHARE = 2, 0.6, 3, 0.012

_SALT = np.uint64(0x5BD1E9955BD1E995)
_PAIR = np.uint64(0x9E3779B97F4A7C15)


def _hash_words(terms) -> np.ndarray:
    data, offsets = flat(pa.array(list(terms), pa.string()))
    return word_hashes(data, offsets[:-1], offsets[1:])


def word_features(column):
    """For each word of each row: row, hash of the word, hash of its beginning; per row: shares of capitals, exclamation marks and letters that repeat the three before."""
    data, offsets = flat(column)
    rows, whole, begin, patterns = [], [], [], np.zeros((len(offsets) - 1, 3))
    size = np.maximum(np.diff(offsets), 1)
    stretched = np.zeros(len(data), bool)
    same = data[1:] == data[:-1]
    stretched[3:] = same[2:] & same[1:-1] & same[:-2] & ~NON_ALNUM[data[3:]] & ~((data[3:] >= 0x30) & (data[3:] <= 0x39))
    for k, hit in enumerate(((data >= 0x41) & (data <= 0x5A), data == 0x21, stretched)):
        sums = np.concatenate([[0], np.cumsum(hit)])
        patterns[:, k] = (sums[offsets[1:]] - sums[offsets[:-1]]) / size
    for a, b in pieces(offsets):
        part = LOWER[data[offsets[a] : offsets[b]]]
        starts, ends, row = word_spans(part, offsets[a : b + 1] - offsets[a], NON_ALNUM)
        rows.append(row + a)
        whole.append(word_hashes(part, starts, ends))
        begin.append(span_hashes(_BYTE[part], starts, np.minimum(ends, starts + BEGINNING)) ^ _SALT)
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64), patterns
    return np.concatenate(rows), np.concatenate(whole), np.concatenate(begin), patterns


def word_pairs(features) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every two words that follow each other in a row."""
    row, whole, *_ = features
    inside = row[1:] == row[:-1]
    return mix(whole[1:] ^ (whole[:-1] * _PAIR))[inside], row[1:][inside]


class Lookup:
    """Numbers of known 64-bit keys; a bitmap turns most others away."""

    def __init__(self, keys: np.ndarray):
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        self.bitmap = np.zeros(1 << 20, bool)
        self.bitmap[(self.keys & np.uint64(0xFFFFF)).astype(np.int64)] = True

    def __call__(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the values that are known, and their keys' numbers."""
        at = np.flatnonzero(self.bitmap[(values & np.uint64(0xFFFFF)).astype(np.int64)])
        if not len(self.keys) or not len(at):
            return at[:0], at[:0]
        near = np.minimum(np.searchsorted(self.keys, values[at]), len(self.keys) - 1)
        same = self.keys[near] == values[at]
        return at[same], self.order[near[same]]


class Voters:
    """The lexicons and mined lists as one lookup, and the patterns; a document's votes are the bits of an integer.

    ``mined``: hashes of mined features and the voter (BEGINNINGS to SURE) of
    each; ``likely``: hashes of words that count for density, beside the lexicons.
    """

    def __init__(self, mined: np.ndarray, kind: np.ndarray, likely: np.ndarray | None = None):
        keys, voter = [mined], [kind]
        for k, terms in enumerate(LEXICONS):
            keys.append(_hash_words(terms))
            voter.append(np.full(len(terms), k))
        distinct, number = np.unique(np.concatenate(keys), return_inverse=True)
        self.lookup, self.bits = Lookup(distinct), np.zeros(len(distinct), np.int64)
        np.bitwise_or.at(self.bits, number.ravel(), 1 << np.concatenate(voter).astype(np.int64))
        self.address = Lookup(_hash_words(ADDRESS))
        self.likely = Lookup(np.unique(np.concatenate([*keys[1:], np.zeros(0, np.uint64) if likely is None else likely])))

    def votes(self, features) -> np.ndarray:
        row, whole, begin, patterns = features
        fired, votes = np.zeros((len(patterns), VOTERS), bool), np.zeros(len(patterns), np.int64)
        pair, pair_row = word_pairs(features)
        for values, own in ((begin, row), (pair, pair_row)):
            at, number = self.lookup(values)
            np.bitwise_or.at(votes, own[at], self.bits[number])
        insults, number = self.lookup(whole)
        np.bitwise_or.at(votes, row[insults], self.bits[number])
        you = np.zeros(len(whole), bool)
        you[self.address(whole)[0]] = True
        for back in range(1, NEAR + 1):
            before = np.maximum(insults - back, 0)
            hit = (insults >= back) & you[before] & (row[before] == row[insults])
            fired[row[insults[hit]], ADDRESSED] = True
        fired[:, SEVERAL] = np.bincount(row[insults], minlength=len(patterns)) >= MANY
        dense = np.bincount(row[self.likely(whole)[0]], minlength=len(patterns))
        fired[:, DENSE] = (dense >= DENSE_LEAST) & (dense >= DENSE_SHARE * np.bincount(row, minlength=len(patterns)))
        fired[:, CAPITALS], fired[:, EXCLAIMED], fired[:, STRETCHED] = patterns[:, 0] > 0.5, patterns[:, 1] > 0.02, patterns[:, 2] > 0.02
        return votes | fired @ (1 << np.arange(VOTERS))


def distinct_pairs(features: np.ndarray, row: np.ndarray):
    """The distinct features, and for each distinct (feature, row): number of the feature, row."""
    key, number = np.unique(features, return_inverse=True)
    rows = int(row.max(initial=0)) + 1
    pair = np.unique(number.astype(np.int64) * rows + row)
    return key, pair // rows, pair % rows


def tally(features, weight: np.ndarray, pairs: bool) -> pa.RecordBatch:
    """For each word and beginning of a batch (and pair of words): its kind, rows that have it, and the sum of their weights."""
    row, whole, begin, _ = features
    kinds = [(WORDS, whole, row), (BEGINNINGS, begin, row)] + ([(PAIRS, *word_pairs(features))] if pairs else [])
    out = []
    for kind, values, own in kinds:
        key, number, own = distinct_pairs(values, own)
        out.append((np.full(len(key), kind, np.int32), key.view(np.int64), np.bincount(number, minlength=len(key)), np.bincount(number, weight[own], len(key))))
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["kind", "feature", "n", "t"])


class LabelModel:
    """Rates at which voters fire on toxic and clean texts, prior, and correlations given the class.

    ``labelled``: (mask, label, number) of labelled rows. The model begins with
    their rates, and in each round they count as much as all documents together,
    with the class they have; without them it begins with guesses.
    """

    def __init__(self, masks: np.ndarray, counts: np.ndarray, prior: float, rounds: int = 30, labelled=()):
        known = np.array([tuple(r) for r in labelled], float).reshape(-1, 3)
        self.rate = np.stack([np.full(VOTERS, 0.01), np.full(VOTERS, 0.3)])
        self.rate[:, CAPITALS:] = [[0.02], [0.04]]  # patterns alone say little to begin with
        for y in (0, 1):
            own = known[known[:, 1] == y]
            fired = (own[:, :1].astype(int) >> np.arange(VOTERS) & 1).T @ own[:, 2]
            self.rate[y] = np.clip((fired + 10 * self.rate[y]) / (own[:, 2].sum() + 10), 1e-4, 1 - 1e-4)
        self.prior, self.correlation = prior, np.zeros((VOTERS, VOTERS))
        votes = (np.concatenate([masks, known[:, 0].astype(masks.dtype)])[:, None] >> np.arange(VOTERS)) & 1
        every = np.concatenate([counts, known[:, 2] * (counts.sum() / max(known[:, 2].sum(), 1))])
        for _ in range(rounds):
            q = np.concatenate([self.posterior(masks), known[:, 1]])
            for y, w in enumerate((every * (1 - q), every * q)):
                self.rate[y] = np.clip((w @ votes + 0.5) / (w.sum() + 1), 1e-4, 1 - 1e-4)
            self.prior = float(np.clip(every @ q / every.sum(), 0.005, 0.5))
            self._correlate(votes, every, q)

    def _correlate(self, votes, counts, q) -> None:
        excess = np.zeros((VOTERS, VOTERS))
        for y, w in enumerate((counts * (1 - q), counts * q)):
            share = w / max(w.sum(), 1e-9)
            centred = votes - self.rate[y]
            cov = (centred * share[:, None]).T @ centred
            spread = np.sqrt(np.maximum(np.diag(cov), 1e-9))
            excess += 0.5 * np.clip(cov / spread[:, None] / spread[None, :], 0, 1)
        np.fill_diagonal(excess, 0)
        self.correlation = excess

    def posterior(self, masks: np.ndarray) -> np.ndarray:
        votes = (np.asarray(masks)[:, None] >> np.arange(VOTERS)) & 1
        fire = np.log(self.rate[1] / self.rate[0])
        still = np.log((1 - self.rate[1]) / (1 - self.rate[0]))
        logit = np.log(self.prior / (1 - self.prior)) + np.zeros(len(votes))
        for own, says in ((votes, fire), (1 - votes, still)):  # those that say the same count less the more they repeat each other
            logit += (own / (1 + own @ self.correlation)) @ says
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


class Classifier:
    """Logistic regression on the presence of selected words and beginnings, and on the votes of ``voters``, if there are any."""

    def __init__(self, keys: np.ndarray, bias: float = -2.0, voters: Voters | None = None):
        self.lookup, self.voters, self.first_vote = Lookup(keys), voters, len(keys)
        self.weight, self.bias = np.zeros(len(keys) + (VOTERS if voters else 0)), bias

    def present(self, features) -> tuple[np.ndarray, np.ndarray]:
        """Rows and features of all distinct (row, selected feature) of a batch, by row."""
        row, whole, begin, _ = features
        rows, numbers = [], []
        for values in (whole, begin):
            at, number = self.lookup(values)
            rows.append(row[at])
            numbers.append(number)
        if self.voters:
            own, voter = np.nonzero(self.voters.votes(features)[:, None] >> np.arange(VOTERS) & 1)
            rows.append(own)
            numbers.append(self.first_vote + voter)
        width = len(self.weight) + 1
        pair = np.unique(np.concatenate(rows) * width + np.concatenate(numbers))
        return pair // width, pair % width

    def fit(self, docs: list[np.ndarray], q: np.ndarray, epochs: int = 20, seed: int = 1) -> None:
        """Stochastic gradient descent on posterior labels, in batches of 32, with steps scaled by past gradients."""
        size = np.array([len(d) for d in docs])
        edge, column = np.concatenate([[0], np.cumsum(size)]), np.concatenate([*docs, np.zeros(0, np.int32)]).astype(np.int64)
        rng, square = np.random.default_rng(seed), np.ones(len(self.weight))
        for _ in range(epochs):
            for part in np.array_split(rng.permutation(len(q)), max(1, len(q) // 32)):
                n = size[part]
                owner = np.repeat(np.arange(len(part)), n)
                on = column[np.repeat(edge[part], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
                if self.voters:  # half of the texts show their votes alone, so that votes carry texts of unknown words
                    shown = (on >= self.first_vote) | (rng.random(len(part)) < 0.5)[owner]
                    owner, on = owner[shown], on[shown]
                z = self.bias + np.bincount(owner, self.weight[on], len(part))
                g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - q[part]
                self.bias -= 0.02 * g.sum()
                step = np.bincount(on, g[owner], len(self.weight))
                square += step * step
                self.weight -= 0.5 * step / np.sqrt(square) + 1e-5 * self.weight

    def score(self, features) -> np.ndarray:
        row, number = self.present(features)
        z = self.bias + np.bincount(row, self.weight[number], len(features[3]))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fold(doc_id="doc_id"):
    """crc32 of the id as text; a null id has none."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary"))


def training_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, most_bytes: int | None = None) -> DataFrame:
    """doc_id, text, label of at most ``rows`` labelled ids (those of the smallest hashes), one text of each, in the shared folder.

    ``most_bytes``: of those, in the same order, the ones whose texts fit into so many bytes together.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("double").alias("label"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(known), "doc_id")
    sample = written(found.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max("label").alias("label")))
    if most_bytes is None:
        return sample
    left, taken = most_bytes, []
    for r in sample.select("doc_id", F.octet_length("text").alias("n")).orderBy(F.xxhash64("doc_id"), "doc_id").collect():
        if r.n <= left:
            left -= r.n
            taken.append((r.doc_id,))
    return sample.join(F.broadcast(docs.sparkSession.createDataFrame(taken, "doc_id long")), "doc_id")


def _tallies(sample: DataFrame, weigh, pairs: bool = False) -> DataFrame:
    """kind, feature, n, t over the sample: batches are summed up before they are shuffled. ``weigh``: weights of a batch from its features and labels."""

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                features = word_features(part.column("text"))
                yield tally(features, weigh(features, np.asarray(part.column("label"))), pairs)

    return sample.select("text", "label").mapInArrow(run, "kind int, feature long, n long, t double").groupBy("kind", "feature").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))


def _keys(rows) -> np.ndarray:
    return np.sort(np.array([r[0] for r in rows], np.int64)).view(np.uint64)


def score_toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, support: int = 5, precision: float = 0.9) -> DataFrame:
    """doc_id, score, predicted (score >= 0.5) and votes (bits of the voters that fired) for every row of ``docs``.

    ``labels`` (doc_id, toxic) are the rows to learn from; the caller leaves out
    held-out ones. Lexicons are mined from what occurs in ``support`` sample
    rows or more, ``precision`` of them (with one clean row added) toxic; words
    that count for density need less of both.
    Scores depend on the text alone. A null or empty text scores as a text in
    which nothing fires; a null doc_id is kept; repeated rows score alike;
    without labels only the fixed lexicons are known; an empty table gives no rows.
    """
    spark = docs.sparkSession
    sample = training_sample(docs, labels, "toxic", sample_rows)
    counted = written(_tallies(sample, lambda features, label: label, pairs=True).where(F.col("t") >= LIKELY_PRECISION * (F.col("n") + 1)))
    mined = counted.where((F.col("n") >= support) & (F.col("t") >= precision * (F.col("n") + 1)))
    likely = counted.where((F.col("kind") == WORDS) & (F.col("n") >= LIKELY_SUPPORT)).orderBy(F.desc("t"), "feature").limit(FEATURES).select("feature").collect()
    place = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("t"), "feature"))
    sure = F.when((F.col("kind") == WORDS) & (F.col("t") >= SURE_PRECISION * (F.col("n") + 0.5)), SURE).otherwise(F.col("kind"))
    mined = mined.withColumn("place", place).where(F.col("place") <= FEATURES).select("feature", sure.alias("kind")).orderBy("kind", "feature").collect()
    voters = Voters(np.array([r[0] for r in mined], np.int64).view(np.uint64), np.array([r[1] for r in mined], np.int64), _keys(likely))
    shared = spark.sparkContext.broadcast(voters)
    one = docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text")

    def vote(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                votes = shared.value.votes(word_features(batch.column("text").slice(a, 1024)))
                yield pa.RecordBatch.from_arrays([pa.array(votes.astype(np.int32))], names=["votes"])

    def labelled_vote(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                votes = shared.value.votes(word_features(part.column("text")))
                yield pa.RecordBatch.from_arrays([pa.array(votes.astype(np.int32)), part.column("label").cast(pa.int32())], names=["votes", "label"])

    # 2**13 patterns at most come to the driver, twice as many with labels
    labelled = sample.select("text", "label").mapInArrow(labelled_vote, "votes int, label int").groupBy("votes", "label").count().orderBy("votes", "label").collect()
    patterns = one.select("text").mapInArrow(vote, "votes int").groupBy("votes").count().orderBy("votes").collect()
    masks, counts = np.array([r[0] for r in patterns] or [0]), np.array([r[1] for r in patterns] or [1], float)
    prior = sample.agg(F.avg("label")).first()[0]
    model = LabelModel(masks, counts, float(np.clip(0.1 if prior is None else prior, 0.02, 0.5)), labelled=[tuple(r) for r in labelled])
    q = spark.sparkContext.broadcast(dict(zip(masks.tolist(), model.posterior(masks).tolist(), strict=True)))

    def posterior(features, label):
        return np.array([q.value.get(int(v), 0.0) for v in shared.value.votes(features)])

    lift = (F.col("t") + 0.05) / (F.col("n") + 1)
    share = float(counts @ model.posterior(masks) / counts.sum())
    chosen = _tallies(sample, posterior).drop("kind").where((F.col("n") >= 3) & (lift > max(0.5, min(0.9, 3 * share))))
    chosen = _keys(chosen.orderBy(F.desc(lift * F.log1p("n")), "feature").limit(FEATURES).select("feature").collect())
    classifier = Classifier(chosen, voters=voters)
    blank = spark.sparkContext.broadcast(classifier)

    def present(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                features = word_features(part.column("text"))
                row, number = blank.value.present(features)
                edge = np.searchsorted(row, np.arange(part.num_rows + 1))
                on = [number[x:y].astype(np.int32).tobytes() for x, y in zip(edge[:-1], edge[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(on, pa.binary()), pa.array(posterior(features, None))], names=["doc_id", "on", "q"])

    rows = sample.select("doc_id", "text", "label").mapInArrow(present, "doc_id long, on binary, q double").orderBy("doc_id", "on").collect()
    if rows and len(chosen):
        classifier.fit([np.frombuffer(r[1], np.int32) for r in rows], np.array([r[2] for r in rows]))
    else:
        terms = _hash_words([t for group in LEXICONS for t in group])
        classifier = Classifier(terms)
        classifier.weight += 4.0
    final = spark.sparkContext.broadcast(classifier)

    def score(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                f = word_features(part.column("text"))
                s = final.value.score(f)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(s), pa.array((s >= 0.5).astype(np.int32)), pa.array(shared.value.votes(f).astype(np.int32))], names=["doc_id", "score", "predicted", "votes"])

    return one.mapInArrow(score, "doc_id long, score double, predicted int, votes int")
