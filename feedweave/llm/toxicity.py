"""Toxicity by weak supervision.

Voters are lexicon entries and patterns: each votes "toxic" where it fires and abstains
elsewhere.  A generative label model estimates by expectation maximisation, from the
votes alone, how often each voter fires on toxic and on clean texts and how voters
correlate within the two classes; a vote that others repeat counts for less.  Labels
choose the entries of the lexicon and, once the label model stands, the scale of its
posteriors; they are no part of its estimation.  A linear classifier is trained on the
posterior labels, over the voters and weaker features, and scores texts.

Features are counted in Spark.  The models are fitted on the driver on a bounded sample
of labelled rows (SAMPLE_ROWS), of which it gets the features chosen and no text; scoring
reads every text in place, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedweave.llm import text as tx
from feedweave.llm.session import cut

#: The most labelled rows that the models are fitted on.
SAMPLE_ROWS = 6_000
#: The log-likelihood ratio against chance that a voter of the lexicon and a feature of the
#: classifier need, and how many times as often a voter must fire on toxic rows.
SURE, WEAK, LIFT = 11.0, 8.0, 20
#: Characters of the word beginnings that are features beside whole words and pairs of words.
BEGINNINGS = (3, 4, 5, 6, 7)
#: Insults of general use, voters from the start whatever the labels say.
SEED_WORDS = ("idiot", "stupid", "moron", "loser", "scum", "trash", "worthless", "pathetic", "disgusting")
#: Features of patterns.
PATTERNS = ("shouting", "exclaiming", "shouted words", "masked letters", "drawn-out letters", "digits in words", "rows of symbols", "mixed marks", "address")
#: Words that speak to someone, for the last of them.
ADDRESS = ("you", "your", "you're", "yourself", "du", "dich", "dein", "tu", "toi", "vous", "te", "ti")

#: Set in the features that are pairs of words, which the classifier uses and the lexicon doesn't.
_PAIR = np.uint64(1)
_BYTES = np.arange(256)
_UPPER, _LOWER, _DIGIT = (_BYTES >= 65) & (_BYTES <= 90), (_BYTES >= 97) & (_BYTES <= 122), (_BYTES >= 48) & (_BYTES <= 57)
_LETTER = _UPPER | _LOWER | (_BYTES >= 128)
_SYMBOL = np.isin(_BYTES, list(b"*#$%@&"))


def _patterns(text: np.ndarray, local: np.ndarray, w: tx.Words, base: int) -> Iterator[tuple[np.ndarray, int]]:
    """(rows in which a pattern holds, its feature)."""
    n = len(local) - 1

    def times(places: np.ndarray) -> np.ndarray:
        return np.bincount(np.searchsorted(local, places, "right") - 1, minlength=n) if len(places) else np.zeros(n, np.int64)

    def inside(hit: np.ndarray, width: int) -> np.ndarray:
        """Places of hits of `width` bytes that don't go on into the next row."""
        places = np.flatnonzero(hit)
        row = np.searchsorted(local, places, "right") - 1
        return places[places + width <= local[row + 1]]

    upper, letter, symbol = _UPPER[text], _LETTER[text], _SYMBOL[text]
    ups, lows = times(np.flatnonzero(upper)), times(np.flatnonzero(_LOWER[text]))
    yield np.flatnonzero(ups > np.maximum(lows, 20)), 1
    yield np.flatnonzero(times(np.flatnonzero(text == 33)) >= 3), 2
    sums = np.concatenate([[0], np.cumsum(upper)])
    size = w.ends - w.starts
    loud = (size >= 4) & (sums[w.ends - base] - sums[w.starts - base] >= size - 1)
    yield np.flatnonzero(times(w.starts[loud] - base) >= 3), 3
    yield np.flatnonzero(times(inside(letter[:-2] & symbol[1:-1] & letter[2:], 3)) >= 1), 4
    same = letter[:-1] & (text[:-1] == text[1:])
    yield np.flatnonzero(times(inside(same[:-2] & same[1:-1] & same[2:], 4)) >= 1), 5
    yield np.flatnonzero(times(inside(letter[:-2] & _DIGIT[text[1:-1]] & letter[2:], 3)) >= 1), 6
    yield np.flatnonzero(times(inside(symbol[:-2] & symbol[1:-1] & symbol[2:], 3)) >= 1), 7
    yield np.flatnonzero(times(inside(((text[:-1] == 33) & (text[1:] == 63)) | ((text[:-1] == 63) & (text[1:] == 33)), 2)) >= 1), 8
    yield np.flatnonzero(20 * times(w.starts[np.isin(w.hashes, _address())] - base) > np.diff(w.bounds)), 9


def _address() -> np.ndarray:
    return np.concatenate(tx.word_hashes([" ".join(ADDRESS)]))


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of the words, word beginnings and pairs of words beside each other of
    the rows, and of their patterns; a feature may come several times.  Words are whole but
    for the marks at their ends; a beginning is shorter than its word."""
    w = tx.words(data, offsets)
    base = int(offsets[0])
    text, local = data[base : int(offsets[-1])], offsets - base
    row = np.repeat(np.arange(len(w.bounds) - 1), np.diff(w.bounds))
    starts, ends = w.starts - base, w.ends - base
    for _ in range(3):
        ends = ends - (~(_LETTER | _DIGIT)[text[np.maximum(ends - 1, 0)]] & (ends - starts > 1))
    whole = w.ranges.hashes(starts, ends)
    rows, out = [row], [whole & ~_PAIR]
    characters = np.append(np.flatnonzero((text & 0xC0) != 0x80), len(text))
    first = np.searchsorted(characters, starts)
    for n in BEGINNINGS:
        end = characters[np.minimum(first + n, len(characters) - 1)]
        some = end < ends
        rows.append(row[some])
        out.append(tx.mix(w.ranges.hashes(starts[some], end[some]) ^ np.uint64(n)) & ~_PAIR)
    beside = np.flatnonzero(row[1:] == row[:-1])
    rows.append(row[beside])
    out.append(tx.pair(whole[beside], whole[beside + 1]) | _PAIR)
    for held, number in _patterns(text, local, w, base) if len(text) > 4 else ():
        rows.append(held)
        out.append(np.full(len(held), number, np.uint64))
    return np.concatenate(rows), np.concatenate(out)


class Known:
    """Sorted features, to be found among many others."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.rough = np.zeros(1 << 20, bool)
        self.rough[keys >> np.uint64(44)] = True

    def find(self, rows: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (row, index of the feature) of those that are known."""
        some = self.rough[(found >> np.uint64(44)).astype(np.int64)] if len(self.keys) else np.zeros(len(found), bool)
        rows, found = rows[some], found[some]
        if not len(rows):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.keys, found), len(self.keys) - 1)
        hit = self.keys[at] == found
        once = np.unique(rows[hit] * len(self.keys) + at[hit])
        return once // len(self.keys), once % len(self.keys)


@dataclass
class Model:
    """Sorted features with their weights, and the bias."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, column: pa.Array) -> np.ndarray:
        data, offsets = tx.buffers(column)
        total, known = np.full(len(column), self.bias), Known(self.keys)
        for low, high in tx.slices(offsets):
            row, at = known.find(*features(data, offsets[low : high + 1]))
            total[low:high] += np.bincount(row, self.weights[at], high - low)
        return 1 / (1 + np.exp(-np.clip(total, -50, 50)))


@dataclass
class LabelModel:
    """What the votes say of the voters: how often each fires on toxic and on clean texts,
    correlations within the classes, the weight of each vote, and the share of toxic texts."""

    on: np.ndarray
    off: np.ndarray
    correlation: np.ndarray
    weight: np.ndarray
    prior: float

    @property
    def accuracy(self) -> np.ndarray:
        """Probability that a text is toxic on which the voter fires, were there no other."""
        return self.prior * self.on / (self.prior * self.on + (1 - self.prior) * self.off)

    def logit(self, fired: np.ndarray) -> np.ndarray:
        return np.log(self.prior / (1 - self.prior)) + fired @ (self.weight * np.log(self.on / self.off))


def label_model(fired: np.ndarray, rounds: int = 15) -> LabelModel:
    """Estimated from the rows x voters matrix of votes, 1 where a voter fires, without labels.

    A text with c votes starts at the probability c / (c + 1).  Each round estimates the
    voters' rates and their correlations within each class from the posteriors, and the
    posteriors from the rates; a vote weighs one over the sum of the voter's squared
    correlations with all voters, which is 1 for those that fire on the same texts.  A text without votes counts as clean.
    """
    n = len(fired)
    some = np.flatnonzero(fired.any(1))  # only these have anything to add to counts of votes
    # voters that fire on the same rows are one column, which counts as often as there are of them
    columns, which, times = np.unique(fired[some].astype(np.float32), axis=1, return_inverse=True, return_counts=True)
    votes = columns @ times
    p = votes / (votes + 1)
    for _ in range(rounds):
        prior = float(np.clip(p.sum() / max(n, 1), 1e-3, 1 - 1e-3))
        rates, correlation = [], np.zeros((len(times), len(times)), np.float32)
        for share, q, mass in ((prior, p, p.sum()), (1 - prior, 1 - p, n - p.sum())):
            rate = np.clip((columns.T @ q + 0.1) / (mass + 1), 1e-5, 1 - 1e-5)
            together = (columns * q[:, None].astype(np.float32)).T @ columns / max(mass, 1e-9)
            deviation = np.sqrt(rate * (1 - rate))
            correlation += share * (together - np.outer(rate, rate)) / np.outer(deviation, deviation)
            rates.append(rate)
        correlation = np.clip(correlation, -1, 1)
        np.fill_diagonal(correlation, 1)
        on, off = rates
        weight = 1 / (correlation**2 @ times)
        logit = np.log(prior / (1 - prior)) + columns @ (times * weight * np.log(on / off))
        p = 1 / (1 + np.exp(-np.clip(logit, -50, 50)))
    which = which.ravel()
    return LabelModel(on[which], off[which], correlation[which][:, which], weight[which], prior)


def calibrated(logit: np.ndarray, toxic: np.ndarray, silent: np.ndarray) -> np.ndarray:
    """Posteriors on the labels' scale: a logistic curve over the logits of the rows with
    votes, and for rows without any the share of toxic ones among them, a half at most."""
    out = np.empty(len(logit))
    out[silent] = min(0.5, toxic[silent].mean()) if silent.any() else 0
    x, y = logit[~silent], toxic[~silent]
    slope, shift = 1.0, 0.0
    for _ in range(30 if len(x) else 0):  # Newton's method, held back a little
        p = 1 / (1 + np.exp(-np.clip(slope * x + shift, -50, 50)))
        v = p * (1 - p) + 1e-6
        g = np.array([((y - p) * x).sum() - 0.01 * (slope - 1), (y - p).sum() - 0.01 * shift])
        h = np.array([[(v * x * x).sum() + 0.01, (v * x).sum()], [(v * x).sum(), v.sum() + 0.01]])
        step = np.clip(np.linalg.solve(h, g), -1, 1)
        slope, shift = max(0.05, slope + step[0]), shift + step[1]
    out[~silent] = 1 / (1 + np.exp(-np.clip(slope * x + shift, -50, 50)))
    return out


def classifier(rows: np.ndarray, at: np.ndarray, target: np.ndarray, keys: np.ndarray, steps: int = 600, rate: float = 0.1, decay: float = 1e-4) -> Model:
    """Logistic regression on the posterior labels by full-batch Adam; `rows` and `at` are
    the rows' features, as places in `keys`."""
    n, m = len(target), len(keys)
    order = np.lexsort((rows, at))
    rows, at = rows[order], at[order]
    w, b = np.zeros(m), 0.0
    weight = np.where(target > 0.5, 0.5 / max(target.mean(), 0.05), 0.5 / max(1 - target.mean(), 0.05)) / max(n, 1)
    first, second = np.zeros(m + 1), np.zeros(m + 1)
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(rows, w[at], n) + b, -50, 50)))
        error = (p - target) * weight
        g = np.append(np.bincount(at, error[rows], m) + decay * w, error.sum())
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        step = rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-9)
        w, b = w - step[:m], b - step[m]
    return Model(keys, w, float(b))


def held_out(key: str) -> F.Column:
    return F.crc32(F.col(key).cast("string")) % 5 == 0


def _counted(sample: DataFrame) -> DataFrame:
    """(feature, toxic, clean): the rows of (_id, _text, _toxic) of either label that have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tx.buffers(batch.column(1))
            toxic = np.asarray(batch.column(2))
            for low, high in tx.slices(offsets):
                rows, found = features(data, offsets[low : high + 1])
                order = np.lexsort((rows, found))
                rows, found = rows[order], found[order]
                once = np.ones(len(rows), bool)
                once[1:] = (rows[1:] != rows[:-1]) | (found[1:] != found[:-1])
                keys, where = np.unique(found[once], return_inverse=True)
                on = np.bincount(where, toxic[low:high][rows[once]], len(keys)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(on), pa.array(np.bincount(where, minlength=len(keys)) - on)], ["feature", "toxic", "clean"])
        tx.release()

    return sample.mapInArrow(run, "feature long, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _chosen(sample: DataFrame, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(_id, place in keys) of the rows of `sample` that have these features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(keys)
        for batch in batches:
            data, offsets = tx.buffers(batch.column(1))
            ids = np.asarray(batch.column(0))
            for low, high in tx.slices(offsets):
                rows, at = known.find(*features(data, offsets[low : high + 1]))
                yield pa.RecordBatch.from_arrays([pa.array(ids[low:high][rows]), pa.array(at)], ["id", "at"])
        tx.release()

    got = sample.mapInArrow(run, "id long, at long").toArrow()
    return got["id"].to_numpy(), got["at"].to_numpy()


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = SAMPLE_ROWS) -> Model:
    """The classifier, fitted on at most `rows` labelled rows that aren't held out.

    The rows are those of the smallest hashes of their keys.  A key labelled several
    times counts as toxic if one of its labels does; of several texts of a key the
    smallest counts, null as empty; null labels and keys are left out.  Without labels of
    both kinds the seed words alone decide.
    """
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(key)).groupBy(key).agg((F.max(label) > 0).cast("int").alias("_toxic"))
    known = known.orderBy(F.xxhash64(key), key).limit(rows)  # at most `rows` rows of two numbers: small enough to broadcast
    texts = docs.select(F.col(key), F.coalesce(text, F.lit("")).alias("_text")).join(F.broadcast(known), key)
    sample = cut(texts.groupBy(F.xxhash64(key).alias("_id"), key).agg(F.min("_text").alias("_text"), F.max("_toxic").alias("_toxic")).drop(key))
    flags = sample.select("_id", "_toxic").orderBy("_id").collect()  # at most `rows`
    ids, toxic = np.array([r["_id"] for r in flags], np.int64), np.array([float(r["_toxic"]) for r in flags])
    seeds = np.union1d(np.concatenate(tx.word_hashes([" ".join(SEED_WORDS)])) & ~_PAIR, np.arange(1, len(PATTERNS) + 1, dtype=np.uint64))
    if not 0 < toxic.sum() < len(toxic):
        keys = np.setdiff1d(seeds, np.arange(1, len(PATTERNS) + 1, dtype=np.uint64))
        return Model(keys, np.full(len(keys), 2.0), -3.0)
    n = {"toxic": float(toxic.sum()), "clean": float(len(toxic) - toxic.sum())}
    rate = (F.col("toxic") + F.col("clean")) / len(toxic)
    parts = [(F.col(c), rate * n[c]) for c in n] + [(n[c] - F.col(c), (1 - rate) * n[c]) for c in n]
    ratio = 2 * sum((F.when(x > 0, x * F.log(x / e)).otherwise(0.0) for x, e in parts), F.lit(0.0))
    # of chance alone a ratio of WEAK is rare, so that few features of the sample come to the driver
    got = _counted(sample).where("toxic + clean >= 3").withColumn("ratio", ratio).where(F.col("ratio") >= WEAK).toArrow()
    keys = got["feature"].to_numpy().view(np.uint64)
    on, off, sure = (got[c].to_numpy() for c in ("toxic", "clean", "ratio"))
    lexicon = np.union1d(keys[(sure >= SURE) & (on / n["toxic"] > LIFT * off / n["clean"])], seeds)
    keys = np.union1d(keys, seeds)
    who, at = _chosen(sample, keys)
    who = np.searchsorted(ids, who)
    voter = np.isin(keys, lexicon) & ((keys & _PAIR == 0) | (keys <= len(PATTERNS)))
    column = np.cumsum(voter) - 1
    votes = np.zeros((len(ids), int(voter.sum())), np.float32)
    mine = voter[at]
    votes[who[mine], column[at[mine]]] = 1
    target = calibrated(label_model(votes).logit(votes), toxic, votes.sum(1) == 0)
    return classifier(who, at, target, keys)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, score, predicted) of each row; a null or empty text has the score of
    a text without any feature.  Rows with null keys are scored, held_out null; rows with
    the same key are each scored.  An empty table gives no rows."""
    schema = T.StructType([docs.schema[key], T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(batch.column(1)))], [key, "score"])

    scored = docs.select(key, text).mapInArrow(run, schema)
    return scored.select(key, held_out(key).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def remove_toxic(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """`docs` without the rows that the model predicts to be toxic, other columns as they
    are.  A null or empty text has no feature, and stays unless the model's bias alone is
    toxic; repeated rows go or stay together, and an empty table stays empty."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.scores(batch.column(at)) < 0.5))
        tx.release()

    return docs.mapInArrow(run, docs.schema)
