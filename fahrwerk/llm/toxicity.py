"""Toxicity by weak supervision.

Voters are lexicon words, patterns, and words or word beginnings mined from
labelled rows by their log-likelihood ratio; the label of a row is one more
voter.  One pass over all texts keeps what fires; on that small table a
generative label model is fitted by EM over all documents: each voter's rate
of firing under both classes, and the correlations of all pairs of voters
within a class, by which votes that repeat each other count less.  A logistic
regression is trained on the posterior labels of a bounded sample of labelled
rows and of as many rows without a label, and scores every document.  It is
fitted from sums over the sample's partitions; rows never come to the driver.

Only rows whose crc32(doc_id) mod 5 is not 0 are learned from, at most
``limit`` labelled ones, chosen by a hash of doc_id; language, source and
doc_id are never inputs.  Null and empty texts score as texts in which nothing
fires; very long ones are read whole.  Equal texts have equal scores.  Rows
that repeat a doc_id are scored each by its own text; a doc_id with several
labels takes the larger one.  Without any usable label the lexicon alone
decides.  An empty table gives an empty result.  Columns beyond doc_id and
text are not read; ``drop_toxic`` keeps them, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textvec as tv
from .common import materialize, release

LABELLED_LIMIT = 20_000
#: The classifier's sample lies in so many partitions, each of which sends sums.
SAMPLE_PARTS = 8
#: Log-odds of the other voters together at most; a label's are less, so that voters can outvote it.
MOST_ODDS = 6.0
MINED = 256
LEAST_TOXIC = 5
#: Least log-likelihood ratio of a mined voter (chance gives as much to about one feature in 100,000).
LEAST_GAIN = 10.0
STARTS = (4, 5, 6, 7, 8)
ROUNDS = 3
GOLD_ACCURACY = 0.98
#: Common English insults.
LEXICON = (
    "idiot idiots stupid moron morons dumb fool loser losers trash garbage scum filth pathetic worthless useless "
    "disgusting clown jerk creep freak ugly hate hateful vermin coward liar pig rat imbecile cretin dimwit bastard "
    "bitch damn crap shit fuck fucking asshole whore slut retard subhuman kill die"
).split()
PATTERNS = ("shouting", "exclaiming", "masked")
FEATURES = "n_words long, idx array<int>, cnt array<int>"


def _word_hash(words: list[str]) -> np.ndarray:
    out = []
    for w in words:
        b = np.frombuffer(w.encode(), np.uint8)
        out.append(tv.word_hashes(b, np.array([0]), np.array([len(b)]))[0])
    return np.array(out, dtype=np.uint64)


def features(buf: np.ndarray, off: np.ndarray):
    """(hash, text) of all words and word beginnings in texts, and the number of words of each text."""
    starts, ends, first = tv.bounds(buf, off, tv.NOT_LETTERS)
    lens = ends - starts
    doc = np.searchsorted(first, np.arange(len(starts)), side="right") - 1
    hashes, docs = [tv.word_hashes(buf, starts, ends)], [doc]
    table, power = tv._TABLE[tv._FOLD], tv.powers(max(STARTS) + 1)
    h = np.zeros(len(starts), np.uint64)
    for k in range(max(STARTS)):
        long = np.flatnonzero(lens > k)
        h[long] += table[buf[starts[long] + k]] * power[k]
        if k + 1 in STARTS:
            hashes.append(tv.mix(h[long] + np.uint64((k + 1) << 50)))
            docs.append(doc[long])
    return np.concatenate(hashes), np.concatenate(docs), np.diff(first)


def _patterns(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """For each text and pattern, how often it shows: capitals, exclamation marks, masked letters."""
    upper = (buf >= 65) & (buf <= 90)
    letter = upper | ((buf >= 97) & (buf <= 122))
    bang = buf == 33
    star = np.zeros(len(buf), bool)
    if len(buf) > 2:
        star[1:-1] = ((buf[1:-1] == 42) | (buf[1:-1] == 64) | (buf[1:-1] == 36)) & letter[:-2] & letter[2:]
    total = lambda m: np.diff(np.concatenate([[0], np.cumsum(m)])[off])
    caps, letters = total(upper), total(letter)
    return np.stack([np.where(2 * caps > letters, caps, 0), np.where(total(bang) * 20 > np.maximum(letters, 1), total(bang), 0), total(star)], axis=1)


class Finder:
    """Finds voters in texts: hashes of words and beginnings, after a bitmap of their low bits."""

    def __init__(self, hashes: np.ndarray):
        self.order = np.argsort(hashes)
        self.sorted = hashes[self.order]
        self.bits = np.zeros(1 << 16, bool)
        self.bits[(hashes & np.uint64(0xFFFF)).astype(np.int64)] = True
        self.voters = len(hashes) + len(PATTERNS)

    def find(self, buf: np.ndarray, off: np.ndarray):
        """(text, voter, count) triples sorted by text, and words of each text."""
        h, doc, words = features(buf, off)
        near = np.flatnonzero(self.bits[(h & np.uint64(0xFFFF)).astype(np.int64)])
        h, doc = h[near], doc[near]
        at = np.minimum(np.searchsorted(self.sorted, h), len(self.sorted) - 1)
        hit = self.sorted[at] == h
        key = doc[hit] * self.voters + self.order[at[hit]]
        shown = _patterns(buf, off)
        r, c = np.nonzero(shown)
        key, count = np.unique(key, return_counts=True)
        key = np.concatenate([key, r * self.voters + self.voters - len(PATTERNS) + c])
        count = np.concatenate([count, shown[r, c]])
        order = np.argsort(key, kind="stable")
        key, count = key[order], count[order]
        return key // self.voters, key % self.voters, count, words


def _lists(doc, voter, count, n):
    """Arrow lists of what fires in each of ``n`` texts."""
    off = pa.array(np.searchsorted(doc, np.arange(n + 1)), pa.int32())
    return pa.ListArray.from_arrays(off, pa.array(voter, pa.int32())), pa.ListArray.from_arrays(off, pa.array(count, pa.int32()))


def _found(hashes: np.ndarray, keep: list[str]):
    def run(batches):
        finder = Finder(hashes)
        for *kept, texts in tv.rows(batches, [*keep, "text"]):
            for i, buf, off in tv.slices(texts):
                doc, voter, count, words = finder.find(buf, off)
                idx, cnt = _lists(doc, voter, count, len(words))
                yield pa.RecordBatch.from_arrays([*(k.slice(i, len(words)) for k in kept), pa.array(words, pa.int64()), idx, cnt], [*keep, "n_words", "idx", "cnt"])

    return run


def _mined(batches):
    """Documents of each class that hold a feature, summed over a partition of the bounded sample."""
    parts = []
    for toxic, texts in tv.rows(batches, ["toxic", "text"]):
        label = toxic.to_numpy(zero_copy_only=False).astype(np.int64)
        for i, buf, off in tv.slices(texts):
            h, doc, _ = features(buf, off)
            order = np.lexsort((doc, h))
            h, doc = h[order], doc[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
            h, y = h[new], label[i + doc[new]]
            u, first = np.unique(h, return_index=True)
            if len(u):
                parts.append((u, np.add.reduceat(y, first), np.diff(np.append(first, len(h)))))
    if parts:
        h, pos, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        u, inverse = np.unique(h, return_inverse=True)
        pos, n = np.bincount(inverse, pos).astype(np.int64), np.bincount(inverse, n).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(pos), pa.array(n - pos)], ["h", "pos", "neg"])


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def labelled_sample(labels: DataFrame, limit: int) -> DataFrame:
    """doc_id, toxic of at most ``limit`` labelled rows that may be learned from."""
    usable = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    return materialize(usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit))


def mine(sample: DataFrame, most: int = MINED) -> np.ndarray:
    """Hashes of the words and beginnings that tell toxic from other rows best."""
    n = sample.agg(F.sum("toxic"), F.count("*")).first()
    n1, n0 = n[0] or 0, n[1] - (n[0] or 0)
    if not n1 or not n0:
        return np.zeros(0, np.uint64)
    counts = sample.select("toxic", "text").mapInArrow(_mined, "h long, pos long, neg long").groupBy("h").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    both = (F.col("pos") + F.col("neg")) / (n1 + n0)
    term = lambda a, e: F.when(a > 0, a * F.log(a / e)).otherwise(0.0)
    gain = term(F.col("pos"), both * n1) + term(F.col("neg"), both * n0) + term(n1 - F.col("pos"), (1 - both) * n1) + term(n0 - F.col("neg"), (1 - both) * n0)
    better = (F.col("pos") + 0.5) / (n1 + 1) > 2 * (F.col("neg") + 0.5) / (n0 + 1)
    best = counts.where((F.col("pos") >= LEAST_TOXIC) & better & (gain >= LEAST_GAIN)).orderBy(F.round(gain, 6).desc(), "h").limit(most)
    return np.array([r.h for r in best.select("h").collect()], dtype=np.int64).view(np.uint64)


def matrix(idx, cnt, words, voters: int) -> np.ndarray:
    """Counts of each voter in each row."""
    x = np.zeros((len(words), voters))
    lens = [len(i) for i in idx]
    if sum(lens):
        x[np.repeat(np.arange(len(words)), lens), np.concatenate(idx).astype(np.int64)] = np.concatenate(cnt)
    return x


def inputs(counts: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The classifier's inputs: density and presence of each voter."""
    return np.hstack([np.log1p(300 * counts / np.maximum(words, 1)[:, None]), counts > 0])


class LabelModel:
    """Firing rates under both classes, how often a label says 1 under both, and discounts for voters that repeat each other."""

    def __init__(self, prior: float, rates: np.ndarray, floors: np.ndarray, label: tuple[float, float] = (1 - GOLD_ACCURACY, GOLD_ACCURACY)):
        self.prior, self.rates, self.floors = prior, np.clip(rates, 1e-4, 1 - 1e-4), floors
        self.label = tuple(min(max(r, 1 - GOLD_ACCURACY), GOLD_ACCURACY) for r in label)
        self.discount = np.ones(rates.shape[1])

    def votes(self, counts: np.ndarray, words: np.ndarray) -> np.ndarray:
        """A voter fires if it shows more densely than its floor."""
        return (counts > 0) & (counts >= self.floors * np.maximum(words, 1)[:, None])

    def log_odds(self, votes: np.ndarray) -> np.ndarray:
        fired = np.log(self.rates[1] / self.rates[0]) * self.discount
        silent = np.log((1 - self.rates[1]) / (1 - self.rates[0])) * self.discount
        return np.log(self.prior / (1 - self.prior)) + votes @ fired + (1.0 - votes) @ silent

    def posterior(self, votes: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """Probability of class 1, given the votes and the label (0, 1, or -1 for none)."""
        r0, r1 = self.label
        said = np.array([np.log((1 - r1) / (1 - r0)), np.log(r1 / r0), 0.0])[labels]
        return 1 / (1 + np.exp(-(np.clip(self.log_odds(votes), -MOST_ODDS, MOST_ODDS) + said)))


def _moments(model: LabelModel):
    """For one E step: sums of posteriors (i = -1), of labels 0 and 1 (-3, -2), of votes, and of pairs of votes, under both classes."""

    def run(batches):
        m = model.rates.shape[1]
        total, label, single, pair = np.zeros(2), np.zeros((2, 2)), np.zeros((2, m)), np.zeros((2, m, m))
        for n, idx, cnt, toxic in tv.rows(batches, ["n_words", "idx", "cnt", "toxic"]):
            for i in range(0, len(n), 2000):
                words = n.slice(i, 2000).to_numpy()
                x = matrix(*([v.values.to_numpy() for v in c.slice(i, 2000)] for c in (idx, cnt)), words, m)
                votes = model.votes(x, words).astype(float)
                marks = toxic.slice(i, 2000).fill_null(-1).to_numpy()
                q = model.posterior(votes, marks)
                for y, p in ((0, 1 - q), (1, q)):
                    total[y] += p.sum()
                    label[y] += [p[marks == k].sum() for k in (0, 1)]
                    single[y] += p @ votes
                    pair[y] += votes.T @ (votes * p[:, None])
        for y in (0, 1):
            r, c = np.nonzero(np.triu(pair[y], 1))
            i = np.concatenate([[-3, -2, -1], np.arange(m), r])
            j = np.concatenate([[-3, -2, -1], np.arange(m), c])
            v = np.concatenate([label[y], [total[y]], single[y], pair[y][r, c]])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), y), pa.int32()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(v)], ["y", "i", "j", "v"])

    return run


def own_share(correlation: np.ndarray) -> np.ndarray:
    """Weights with which correlated votes count as independent ones: 1 for one that stands alone, 1 / n for each of n that always agree."""
    m = len(correlation)
    return np.clip(np.linalg.solve(correlation + 1.05 * np.eye(m), np.full(m, 1.05)), 1 / (1 + correlation.sum(axis=0)), 1)


def fit_label_model(fired: DataFrame, model: LabelModel, rounds: int = ROUNDS) -> LabelModel:
    """EM over all rows of ``fired``; each round sends only sums over voters and pairs of voters."""
    m = model.rates.shape[1]
    for _ in range(rounds):
        sums = fired.select("n_words", "idx", "cnt", "toxic").mapInArrow(_moments(model), "y int, i int, j int, v double").groupBy("y", "i", "j").agg(F.sum("v").alias("v")).toPandas()
        total, label, single, pair = np.zeros(2), np.zeros((2, 2)), np.zeros((2, m)), np.zeros((2, m, m))
        for y in (0, 1):
            s = sums[sums.y == y]
            total[y] = s.v[s.i == -1].sum()
            label[y] = [s.v[s.i == k].sum() for k in (-3, -2)]
            one = s[(s.i >= 0) & (s.i == s.j)]
            single[y][one.i.to_numpy()] = one.v
            two = s[s.i < s.j]
            pair[y][two.i.to_numpy(), two.j.to_numpy()] = two.v
            pair[y] += pair[y].T
        if total.sum() <= 0:
            return model
        rates = np.clip((single + 0.5) / (total[:, None] + 1), 1e-4, 1 - 1e-4)
        # Votes that repeat each other do so in either class; toxic texts of one kind share words in theirs alone.
        within = np.full((m, m), np.inf)
        for y in (0, 1):
            cov = pair[y] / max(total[y], 1) - np.outer(rates[y], rates[y])
            sd = np.sqrt(rates[y] * (1 - rates[y]))
            within = np.minimum(within, cov / np.outer(sd, sd))
        np.fill_diagonal(within, 0)
        prior = float(np.clip(total[1] / total.sum(), 1e-3, 0.5))
        model = LabelModel(prior, rates, model.floors, tuple((label[:, 1] + GOLD_ACCURACY * np.array([0, 1])) / (label.sum(axis=1) + 1)))
        model.discount = own_share(np.clip(within, 0, 1))
    return model


def _summed(rows: DataFrame, size: int, add) -> np.ndarray:
    """The sum of ``add(counts, words, labels)``, vectors of ``size``, over the few partitions of a bounded sample; a label of -1 stands for none."""

    def run(batches):
        out = np.zeros(size)
        for n, idx, cnt, toxic in tv.rows(batches, ["n_words", "idx", "cnt", "toxic"]):
            for i in range(0, len(n), 2000):
                words = n.slice(i, 2000).to_numpy()
                x = [[v.values.to_numpy() for v in c.slice(i, 2000)] for c in (idx, cnt)]
                out += add(x, words, toxic.slice(i, 2000).fill_null(-1).to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], ["v"])

    parts = rows.select("n_words", "idx", "cnt", "toxic").mapInArrow(run, "v binary").toLocalIterator()
    return sum((np.frombuffer(r.v, np.float64) for r in parts), np.zeros(size))


def train(rows: DataFrame, model: LabelModel, strength: float = 3.0, steps: int = 15):
    """Logistic regression on posterior labels by Newton's method; returns (weights, intercept).

    Each step sums gradient and curvature over the sample's partitions.
    """
    m = model.rates.shape[1]
    d = 2 * m

    def spread(x, words, y):
        z = inputs(matrix(*x, words, m), words)
        return np.concatenate([[len(z)], z.sum(axis=0), (z * z).sum(axis=0)])

    sums = _summed(rows, 2 * d + 1, spread)
    mean = sums[1 : d + 1] / sums[0]
    sd = np.sqrt(np.maximum(sums[d + 1 :] / sums[0] - mean**2, 0)) + 1e-6
    ridge = np.append(np.full(d, strength), 1e-3)
    w = np.zeros(d + 1)
    for _ in range(steps):

        def slope(x, words, y, w=w):
            counts = matrix(*x, words, m)
            q = model.posterior(model.votes(counts, words).astype(float), y)
            z = np.hstack([(inputs(counts, words) - mean) / sd, np.ones((len(words), 1))])
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            return np.concatenate([z.T @ (p - q), ((z * (p * (1 - p))[:, None]).T @ z).ravel()])

        sums = _summed(rows, (d + 1) * (d + 2), slope)
        step = np.linalg.solve(sums[d + 1 :].reshape(d + 1, d + 1) + np.diag(ridge), sums[: d + 1] + ridge * w)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1] / sd, float(w[-1] - (w[:-1] * mean / sd).sum())


class Classifier:
    """Voters' hashes with the trained weights."""

    def __init__(self, hashes, weights, intercept):
        self.hashes, self.weights, self.intercept = hashes, weights, intercept

    def score(self, counts: np.ndarray, words: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(inputs(counts, words) @ self.weights + self.intercept, -30, 30)))


def fit(documents: DataFrame, labels: DataFrame, limit: int = LABELLED_LIMIT) -> tuple[Classifier, DataFrame]:
    """The classifier, and the table of what fires in each row of ``documents`` (with doc_id)."""
    docs = documents.select("doc_id", "text")
    chosen = labelled_sample(labels, limit)
    sample = materialize(docs.join(F.broadcast(chosen), "doc_id").select("toxic", "text"))  # bounded by ``limit``
    words = _word_hash(LEXICON)
    mined = mine(sample)
    release(sample)
    hashes = np.concatenate([words, mined[~np.isin(mined, words)]])
    m = len(hashes) + len(PATTERNS)
    found = docs.mapInArrow(_found(hashes, ["doc_id"]), f"doc_id long, {FEATURES}")
    fired = materialize(found.join(F.broadcast(chosen), "doc_id", "left"))
    # Labelled rows, and about as many others.
    share = min(1.0, chosen.count() / max(1, fired.count()))
    some = F.col("toxic").isNull() & ~held_out() & (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = materialize(fired.where(F.col("toxic").isNotNull() | some).select("n_words", "idx", "cnt", "toxic").repartition(SAMPLE_PARTS))
    release(chosen)

    def densities(x, n, y):
        counts = matrix(*x, n, m)
        rate, shows = counts / np.maximum(n, 1)[:, None], (counts > 0).astype(float)
        return np.concatenate([f(k) for k in (0, 1) for f in (lambda k: [(y == k).sum()], lambda k: (y == k) @ rate, lambda k: (y == k) @ shows)])

    sums = _summed(rows, 2 * (2 * m + 1), densities).reshape(2, -1)
    n1, n0 = sums[1, 0], sums[0, 0]
    if not n1 or not n0:
        release(rows)
        weights = np.zeros(2 * m)
        weights[m : m + len(words)] = 3.0
        return Classifier(hashes, weights, -1.5), fired
    # Floors: halfway between the mean densities under both classes, where the toxic one is higher.
    mean = sums[:, 1 : m + 1] / np.maximum(sums[:, m + 1 :], 1)
    floors = np.where(mean[1] > mean[0], np.sqrt(mean[0] * mean[1]), 0.0)
    start = LabelModel(float(np.clip(n1 / (n1 + n0), 1e-3, 0.5)), np.full((2, m), 0.5), floors)
    votes = _summed(rows, 2 * m, lambda x, n, y: np.concatenate([(y == k) @ start.votes(matrix(*x, n, m), n).astype(float) for k in (0, 1)])).reshape(2, m)
    start.rates = np.clip((votes + 0.5) / (np.array([[n0], [n1]]) + 1), 1e-4, 1 - 1e-4)
    model = fit_label_model(fired, start)
    weights, intercept = train(rows, model)
    release(rows)
    return Classifier(hashes, weights, intercept), fired


def _scored(model: Classifier):
    def run(batches):
        m = len(model.hashes) + len(PATTERNS)
        for ids, n, idx, cnt in tv.rows(batches, ["doc_id", "n_words", "idx", "cnt"]):
            for i in range(0, len(n), 2000):
                words = n.slice(i, 2000).to_numpy()
                x = matrix(*([v.values.to_numpy() for v in c.slice(i, 2000)] for c in (idx, cnt)), words, m)
                yield pa.RecordBatch.from_arrays([ids.slice(i, 2000), pa.array(model.score(x, words))], ["doc_id", "score"])

    return run


def toxicity_scores(documents: DataFrame, labels: DataFrame, limit: int = LABELLED_LIMIT) -> DataFrame:
    """doc_id, held_out, score, predicted of each row."""
    model, fired = fit(documents, labels, limit)
    scored = fired.mapInArrow(_scored(model), "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(documents: DataFrame, labels: DataFrame, limit: int = LABELLED_LIMIT) -> DataFrame:
    """``documents`` without the rows that score as toxic."""
    model, fired = fit(documents, labels, limit)
    release(fired)

    def keep(batches):
        finder = Finder(model.hashes)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            ok = []
            for _, buf, off in tv.slices(texts):
                doc, voter, count, words = finder.find(buf, off)
                x = np.zeros((len(words), finder.voters))
                x[doc, voter] = count
                ok.append(model.score(x, words) < 0.5)
            if ok:
                yield batch.filter(pa.array(np.concatenate(ok)))

    # Written here, as whoever writes it may hand whole texts to Python in batches of any size.
    return materialize(documents.mapInArrow(tv.trimmed(keep), documents.schema))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
