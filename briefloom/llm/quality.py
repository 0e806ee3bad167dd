"""Quality classifier by positive-unlabelled learning.

Positives are documents labelled good; the unlabelled set is web text without labels. With the class prior ``p`` (the
share of good documents among all) the risk of a scorer is

    p * E_pos[loss(+)] + max(0, E_unl[loss(-)] - p * E_pos[loss(-)])

whose second part, the risk on the negatives that hide in the unlabelled text, must not turn negative: when it does
in a batch, the step goes the other way (non-negative unbiased risk). The prior is estimated from the same two samples;
labelled bad documents have no part in anything but that they are not unlabelled. The scorer is a small network on layout
statistics of the whole text: neighbouring character classes, word lengths, repetition of words and lines. It is fitted
on a bounded sample; all documents are scored where they are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from briefloom.llm.common import byte_cuts, ids_and_texts, prepare, text_bytes, text_or_empty, text_sizes
from briefloom.llm.decontam import word_keys, word_places

#: Rows that the fit reads at most: positives, unlabelled documents.
MAX_POSITIVES = 8_000
MAX_UNLABELLED = 16_000
#: What is taken for the class prior before any row is seen, and how many positives it takes to count as much.
USUAL_PRIOR = 0.9
USUAL_WEIGHT = 60

_CLASSES = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", ".", ",", "!?", ":;", "'\"`", "()[]{}<>", "|", "*#&$%@", "-_/\\+=~^")
_CLASS = np.full(256, len(_CLASSES), np.int64)  # then control characters, then all beyond ASCII
for _i, _chars in enumerate(_CLASSES):
    _CLASS[list(_chars.encode())] = _i
_CLASS[128:] = len(_CLASSES) + 1
_N = len(_CLASSES) + 2
N_FEATURES = _N * _N + 10


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def _distinct(owner: np.ndarray, keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per text: number of different keys, and occurrences of the most frequent one."""
    order = np.lexsort((keys, owner))
    o, k = owner[order], keys[order]
    fresh = np.flatnonzero(np.concatenate([[True], (o[1:] != o[:-1]) | (k[1:] != k[:-1])])) if len(o) else np.zeros(0, np.int64)
    runs = np.diff(np.append(fresh, len(o)))
    top = np.zeros(n)
    np.maximum.at(top, o[fresh], runs)
    return np.bincount(o[fresh], minlength=n), top


def features(column: pa.Array) -> np.ndarray:
    """Layout statistics of each text as a row of numbers; an empty or null text has zeros."""
    data, offsets = text_bytes(column)
    n, sizes = len(column), np.diff(offsets)
    owner = np.repeat(np.arange(n), sizes)
    kinds = _CLASS[data]
    out = np.zeros((n, N_FEATURES), np.float32)
    if len(data) > 1:
        inside = owner[1:] == owner[:-1]
        pairs = np.bincount(((owner[:-1] * _N + kinds[:-1]) * _N + kinds[1:])[inside], minlength=n * _N * _N).reshape(n, -1)
        out[:, : _N * _N] = np.sqrt(_share(pairs, sizes[:, None]))
    starts, ends, firsts = word_places(data, offsets)
    words = np.diff(firsts)
    of_word = np.repeat(np.arange(n), words)
    keys = word_keys(data, starts, ends) if len(starts) else np.zeros(0, np.uint64)
    lengths = (ends - starts).astype(np.float64)
    mean = _share(np.bincount(of_word, lengths, n), words)
    spread = np.sqrt(np.maximum(0, _share(np.bincount(of_word, lengths**2, n), words) - mean**2))
    different, top = _distinct(of_word, keys, n)
    again = np.zeros(n)
    if len(keys) > 1:
        again = np.bincount(of_word[1:][(keys[1:] == keys[:-1]) & (of_word[1:] == of_word[:-1])], minlength=n)
    # Lines, keyed by what their words add up to.
    line = np.cumsum(data == 10)
    line_of_word = line[starts] if len(starts) else np.zeros(0, np.int64)
    change = np.flatnonzero(np.concatenate([[True], (np.diff(line_of_word) != 0) | (np.diff(of_word) != 0)])) if len(starts) else np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        sums = np.add.reduceat(keys, change) if len(change) else keys
    lines = np.bincount(of_word[change], minlength=n)
    different_lines, _ = _distinct(of_word[change], sums, n)
    out[:, _N * _N :] = np.stack(
        [
            np.log1p(sizes) / 10, np.log1p(words) / 10, mean / 10, spread / 10, _share(different, words), _share(top, words),
            _share(again, words), np.log1p(lines) / 5, _share(lines - different_lines, lines), np.log1p(_share(words, lines)) / 5,
        ],
        axis=1,
    )
    return out


@dataclass
class Scorer:
    """One hidden layer on standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float

    def hidden(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = np.clip((x - self.mean) * self.scale, -6, 6)
        return z, np.maximum(0, z @ self.w1 + self.b1)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Estimated probability of the positive class."""
        return _sigmoid((self.hidden(x)[1] @ self.w2 + self.b2).astype(np.float64))


def _sigmoid(t: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(t, -30, 30)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 4_000, width: int = 24, batch: int = 512, seed: int = 7) -> Scorer:
    """Minimise the non-negative risk with the sigmoid loss by Adam over mini-batches. The same rows give the same scorer."""
    d = N_FEATURES
    if not len(positive) or not len(unlabelled):
        flat = np.zeros(width, np.float32)
        sure = float(np.log(max(prior, 1e-3) / max(1 - prior, 1e-3)))
        return Scorer(np.zeros(d, np.float32), np.ones(d, np.float32), np.zeros((d, width), np.float32), flat, flat.copy(), sure)
    rng = np.random.default_rng(seed)
    both = np.concatenate([positive, unlabelled])
    mean, scale = both.mean(0), 1 / np.maximum(both.std(0), np.float32(1e-3))
    net = Scorer(mean, scale, rng.normal(0, d**-0.5, (d, width)).astype(np.float32), np.zeros(width, np.float32), rng.normal(0, width**-0.5, width).astype(np.float32), 0.0)
    names = ("w1", "b1", "w2", "b2")
    first, second = ({k: np.zeros_like(np.asarray(getattr(net, k), float)) for k in names} for _ in range(2))
    for step in range(1, steps + 1):
        rate = 3e-3 * (1 - step / (steps + 1))
        xp = positive[rng.integers(0, len(positive), batch)]
        xu = unlabelled[rng.integers(0, len(unlabelled), batch)]
        x = np.concatenate([xp, xu])
        z, h = net.hidden(x)
        s = _sigmoid(h @ net.w2 + net.b2).astype(np.float32)
        sp, su = s[:batch], s[batch:]
        hidden_negative = su.mean() - prior * sp.mean()
        # Derivatives by the output of loss(+) = 1 - s and loss(-) = s.
        dp, du = sp * (1 - sp), su * (1 - su)
        if hidden_negative >= 0:
            g = np.concatenate([-2 * prior * dp, du]) / batch
        else:
            g = np.concatenate([prior * dp, -du]) / batch
        back = np.outer(g, net.w2) * (h > 0)
        grads = {"w1": z.T @ back + 1e-4 * net.w1, "b1": back.sum(0), "w2": h.T @ g + 1e-4 * net.w2, "b2": g.sum()}
        for k in names:
            first[k] = 0.9 * first[k] + 0.1 * grads[k]
            second[k] = 0.999 * second[k] + 0.001 * grads[k] ** 2
            move = rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
            setattr(net, k, getattr(net, k) - move if k == "b2" else (getattr(net, k) - move).astype(np.float32))
    return net


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives in unlabelled rows, from the two samples alone.

    Half of each trains a scorer. On the other halves, the share of unlabelled rows above a cut is at least the prior
    times the share of positives above it, so the least ratio of the two, at the cut where it is surest, is the
    estimate. Few rows say little: the estimate is weighed against ``USUAL_PRIOR``, which counts as much as
    ``USUAL_WEIGHT`` positives.
    """
    if not len(positive) or not len(unlabelled):
        return 0.5
    train, test = (positive[::2], unlabelled[::2]), (positive[1::2], unlabelled[1::2])
    if not all(map(len, (*train, *test))):
        return USUAL_PRIOR
    scorer = fit(*train, prior=0.5, steps=400)
    good, free = (np.sort(scorer.score(x)) for x in test)
    cuts = np.unique(np.concatenate([good, free]))
    above_good, above_free = (1 - np.searchsorted(x, cuts) / len(x) for x in (good, free))
    cuts_with_good = above_good > 0
    above_good, above_free = above_good[cuts_with_good], above_free[cuts_with_good]
    unsure = len(good) ** -0.5 + len(free) ** -0.5
    best = int(np.argmin((above_free + unsure) / above_good))
    found = min(1.0, float(above_free[best] / above_good[best]))
    return (len(good) * found + USUAL_WEIGHT * USUAL_PRIOR) / (len(good) + USUAL_WEIGHT)


def held_out(key: Column) -> Column:
    """Rows kept for evaluation: CRC-32 of the identifier as text divisible by five. Null identifiers are not."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


_SLOTS = 1 << 30
_AT_ONCE = 1 << 20  # bytes of text whose features are computed together


def _slot(key: Column) -> Column:
    """A number below ``_SLOTS`` that depends on the identifier only: the same share of rows at any size."""
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(_SLOTS))


@F.arrow_udf(T.BinaryType())
def _features_udf(texts: pa.Array) -> pa.Array:
    out: list[bytes] = []
    for start, stop in byte_cuts(text_sizes(texts), _AT_ONCE):
        out += [row.tobytes() for row in features(texts.slice(start, stop - start))]
    return pa.array(out, pa.binary())


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id",
    label_col: str = "quality", max_positives: int = MAX_POSITIVES, max_unlabelled: int = MAX_UNLABELLED, prior: float | None = None,
) -> Scorer:
    """Fit on positives and unlabelled documents that are not held out, at most ``max_positives`` and ``max_unlabelled``.

    The rows are chosen by a hash of their identifier. Several labels of one identifier count as the worst; rows without
    identifier or label do not count. ``prior``: share of good documents; by default ``estimate_prior`` of the drawn
    rows; bad labels have no part in it. Without positives or without unlabelled text every document scores the prior.
    """
    known = (
        labels.select(F.col(f"`{label_id_col}`").alias("__id"), F.col(f"`{label_col}`").cast("int").alias("label"))
        .where(F.col("__id").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("__id")))
        .groupBy("__id")
        .agg(F.min("label").alias("label"))
    )
    n_known, n_good = known.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.when(F.col("label") == 1, 1)), F.lit(0))).first()
    n_docs = docs.count()
    # A few more than wanted are drawn, so that the cut below always finds enough.
    good_slots = int(min(1.0, 1.3 * max_positives / max(1, n_good)) * _SLOTS)
    free_slots = int(min(1.0, 1.3 * max_unlabelled / max(1, n_docs - n_known)) * _SLOTS)
    slot = _slot(F.col("__id"))
    drawn = slot < max(good_slots, free_slots)
    texts = ids_and_texts(docs, id_col, text_col).where(F.col("__id").isNotNull() & ~held_out(F.col("__id")) & drawn)
    marked = texts.join(known.where(drawn), "__id", "left")

    def least(rows: DataFrame, limit: int) -> DataFrame:
        """The bound holds before rows leave the executors, however many share one identifier."""
        made = rows.select(
            F.col("label").isNotNull().alias("good"), slot.alias("slot"), F.xxhash64("__text").alias("tie"),
            _features_udf(text_or_empty(F.col("__text"))).alias("x"),
        )
        return made.orderBy("slot", "tie").limit(limit)

    positives = least(marked.where((F.col("label") == 1) & (slot < good_slots)), max_positives)
    rows = positives.unionAll(least(marked.where(F.col("label").isNull() & (slot < free_slots)), max_unlabelled)).toArrow()
    order = np.lexsort((rows["tie"].to_numpy(), rows["slot"].to_numpy()))  # the same rows in the same order, however read
    x = np.frombuffer(b"".join(rows["x"].to_pylist()), np.float32).reshape(-1, N_FEATURES)[order]
    good = rows["good"].to_numpy(zero_copy_only=False).astype(bool)[order]
    positive, unlabelled = x[good][:max_positives], x[~good][:max_unlabelled]
    return fit(positive, unlabelled, estimate_prior(positive, unlabelled) if prior is None else prior)


def quality_score(scorer: Scorer, text: Column) -> Column:
    """Score between 0 and 1 of whole texts; null counts as empty."""

    @F.arrow_udf(T.DoubleType())
    def score(texts: pa.Array) -> pa.Array:
        parts = [scorer.score(features(texts.slice(a, b - a))) for a, b in byte_cuts(text_sizes(texts), _AT_ONCE)]
        return pa.array(np.concatenate([np.zeros(0), *parts]), pa.float64())

    return score(text_or_empty(text.cast("string")))


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, **training) -> DataFrame:
    """``id_col, held_out, score, predicted`` of every document.

    One row per input row, repeated rows included; null texts score as empty ones, null identifiers pass through and are
    never learned from. Without good labels, or without unlabelled documents to learn from, all have one score, between 0
    and 1 as every score; an empty table gives an empty one. Other columns are never inputs of a score.
    """
    scorer = train(docs, labels, id_col, text_col, **training)
    key = F.col(f"`{id_col}`")
    scored = docs.select(key.alias(id_col), held_out(key).alias("held_out"), quality_score(scorer, F.col(f"`{text_col}`")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, **training) -> DataFrame:
    """The documents that score at least ``threshold``, with all their columns.

    Repeated rows stay or go together, null texts score as empty ones, rows with a null identifier are judged as others.
    Without good labels nothing can be learned and all stay; an empty table gives an empty one.
    """
    prepare(docs.sparkSession)
    scorer = train(docs, labels, id_col, text_col, **training)
    return docs.where(quality_score(scorer, F.col(f"`{text_col}`")) >= threshold)
