"""Language identification: interpolated Kneser-Ney character models in sorted hash arrays.

Texts become streams of lower-case letters with one space for everything in
between.  Each language has a Kneser-Ney model of up to four characters, fitted
on a bounded sample of labelled documents.  All models share one sorted array of
64-bit n-gram hashes an order, with a column of log2 probabilities for each
language beside it, so that one search gives an n-gram's cost in every language.
A document gets the language of the lowest cross-entropy per character; a second
bounded sample, not counted in the models, calibrates the score and the
cross-entropy above which a document is held to be in none of the languages.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from obol.llm.common import ship, staged
from obol.llm.textbytes import mix64, slices

ORDER = 4
#: Most characters of all documents that the models are fitted on, shared evenly among the languages
#: (a language may exceed its share by one document).  It bounds the n-grams, hence the arrays sent to the executors.
SAMPLE_CHARS = 1 << 22
#: Most characters of the documents that calibrate score and rejection.
CALIBRATION_CHARS = 1 << 20
#: Share of the labelled documents that calibrate and are not counted.
CALIBRATES = 0.1
#: Share of calibration documents of a language that may be rejected.
REJECTED = 0.01
#: Calibration documents of a language below which its limit stays open.
LEAST_TRIALS = 20
DISCOUNT_FLOOR = 0.1
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPACE = 32


@lru_cache(1)
def _alphabet() -> np.ndarray:
    """For every code point its lower-case letter, or a space."""
    out = np.full(sys.maxunicode + 1, _SPACE, np.uint32)
    for cp in range(sys.maxunicode + 1):
        c = chr(cp)
        if c.isalpha():
            low = c.lower()
            out[cp] = ord(low) if len(low) == 1 else cp
    return out


def letters(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Normalised code points of all texts, and the bounds of each; every text has ORDER - 1 spaces before and one after.

    Runs of other characters are one space.
    """
    raw = [t.decode("utf-8", "replace") for t in texts]
    joined = np.frombuffer((" " + " ".join(raw) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.fromiter(map(len, raw), np.int64, len(raw)) + 1
    start = np.concatenate([[1], 1 + np.cumsum(size)])
    code = _alphabet()[joined]
    space = code == _SPACE
    keep = np.ones(len(code), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    # the place before each text keeps its space: it ends the text before, or begins the first
    keep[start - 1] = True
    inner = start[:-1][size > 1]
    keep[inner] &= ~space[inner]
    last = start[1:] - 2
    drop = (size > 1) & space[last]
    keep[last[drop]] = False
    before = np.concatenate([[0], np.cumsum(keep)])
    kept = code[keep]
    bounds = before[start - 1]
    lengths = np.diff(bounds)
    out = np.full(len(kept) + (ORDER - 1) * len(texts), _SPACE, np.uint32)
    shift = np.repeat(np.arange(1, len(texts) + 1), lengths) * (ORDER - 1)
    # a text's characters, then the space that ends it
    out[np.arange(bounds[0] + 1, bounds[-1] + 1) - 1 + shift - bounds[0]] = kept[bounds[0] + 1:bounds[-1] + 1]
    first = np.concatenate([[0], np.cumsum(lengths + ORDER - 1)])
    return out[:first[-1]], first


def positions(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the characters to predict (all but the ORDER - 1 leading spaces) and the row of each."""
    n = np.diff(first) - (ORDER - 1)
    row = np.repeat(np.arange(len(n)), n)
    return np.arange(len(row)) + (row + 1) * (ORDER - 1), row


def ngram_hashes(code: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Hashes of the 1 to ORDER characters that end at each place; the last item's prefix is ``context_hashes``."""
    value = mix64(code.astype(np.uint64) + np.uint64(1))
    out, acc, power = [], np.zeros(len(at), np.uint64), np.uint64(1)
    with np.errstate(over="ignore"):
        for k in range(ORDER):
            acc = acc + value[at - k] * power
            power = power * _BASE
            out.append(acc)
    return out


@dataclass
class Model:
    """For each order n = 1..ORDER: sorted n-gram hashes, log2 probability [n-gram, language];
    for each context of n - 1 characters: sorted hashes, log2 of the weight of the lower order [context, language]."""
    langs: list[str]
    grams: list[np.ndarray]
    probs: list[np.ndarray]
    contexts: list[np.ndarray]
    weights: list[np.ndarray]
    unseen: np.ndarray
    slope: float = 1.0
    offset: float = 0.0
    limits: np.ndarray | None = None

    def costs(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Bits per character of every text in every language, and the number of its letters."""
        code, first = letters(texts)
        at, row = positions(first)
        n_letters = np.bincount(row, weights=code[at] != _SPACE, minlength=len(texts)).astype(np.int64)
        total = np.zeros((len(texts), len(self.langs)))
        size = np.maximum(np.diff(first) - (ORDER - 1), 1)
        step = 1 << 20
        for lo in range(0, len(at), step):
            place, own = at[lo:lo + step], row[lo:lo + step]
            hashes, before = ngram_hashes(code, place), ngram_hashes(code, place - 1)
            logs = np.empty((len(place), len(self.langs)), np.float32)
            left = np.arange(len(place))
            carry = np.zeros((len(place), len(self.langs)), np.float32)
            for n in range(ORDER, 0, -1):
                found, where = _find(self.grams[n - 1], hashes[n - 1][left])
                logs[left[found]] = self.probs[n - 1][where[found]] + carry[found]
                left, carry = left[~found], carry[~found]
                if not len(left):
                    break
                if n > 1:
                    known, where = _find(self.contexts[n - 2], before[n - 2][left])
                    carry[known] += self.weights[n - 2][where[known]]
            logs[left] = self.unseen + carry
            starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            total[own[starts]] += np.add.reduceat(logs.astype(np.float64), starts, axis=0)
        return -total / size[:, None], n_letters


def _find(table: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each hash is in the sorted ``table``, and its place."""
    if not len(table):
        return np.zeros(len(wanted), bool), np.zeros(len(wanted), np.int64)
    where = np.minimum(np.searchsorted(table, wanted), len(table) - 1)
    return table[where] == wanted, where


def kneser_ney(langs: list[str], lang: np.ndarray, gram: np.ndarray, count: np.ndarray) -> Model:
    """Models from the counted n-grams of ORDER characters: language number, code points [n, ORDER], count."""
    n_lang = len(langs)
    grams, probs, contexts, weights = [], [], [], []
    hashed = []
    # hashes of the last k characters of each gram, k = 1..ORDER, and of the k characters before the last
    flat = np.ascontiguousarray(gram, np.uint32).reshape(-1)
    ends = np.arange(1, len(gram) + 1) * ORDER - 1
    if len(gram):
        hashed, prefix = ngram_hashes(flat, ends), ngram_hashes(flat, ends - 1)[:ORDER - 1]
    seen = np.zeros((0, n_lang))
    for n in range(1, ORDER + 1):
        if not len(gram):
            grams.append(np.zeros(0, np.uint64))
            probs.append(np.zeros((0, n_lang), np.float32))
            if n > 1:
                contexts.append(np.zeros(0, np.uint64))
                weights.append(np.zeros((0, n_lang), np.float32))
            continue
        table, where = np.unique(hashed[n - 1], return_inverse=True)
        c = np.zeros((len(table), n_lang))
        if n == ORDER:
            np.add.at(c, (where, lang), count)
        else:
            # continuation counts: distinct characters before the n-gram; the n + 1 last characters tell them apart
            longer, one = np.unique(np.stack([hashed[n], lang.astype(np.uint64)]), axis=1, return_index=True)
            np.add.at(c, (where[one], lang[one]), 1)
        ones, twos = (c == 1).sum(0), (c == 2).sum(0)
        discount = np.where(ones + 2 * twos > 0, ones / np.maximum(ones + 2 * twos, 1), 0.5)
        discount = np.clip(discount, DISCOUNT_FLOOR, 0.95)
        rep = np.zeros(len(table), np.int64)
        rep[where] = np.arange(len(where))  # one gram with this ending
        if n == 1:
            mass = c.sum(0)
            floor = 1.0 / (len(table) + 1)
            spare = discount * (c > 0).sum(0) / np.maximum(mass, 1)
            spare = np.where(mass > 0, spare, 1.0)
            p = np.maximum(c - discount, 0) / np.maximum(mass, 1) + spare * floor
            unseen = np.log2(spare * floor)
        else:
            ctx, of = np.unique(prefix[n - 2], return_inverse=True)
            of_gram = of[rep]
            mass, kinds = np.zeros((len(ctx), n_lang)), np.zeros((len(ctx), n_lang))
            np.add.at(mass, of_gram, c)
            np.add.at(kinds, of_gram, c > 0)
            spare = np.where(mass > 0, discount * kinds / np.maximum(mass, 1), 1.0)
            lower_at = np.searchsorted(lower, hashed[n - 2][rep])
            p = np.maximum(c - discount, 0) / np.maximum(mass[of_gram], 1) + spare[of_gram] * seen[lower_at]
            contexts.append(ctx)
            weights.append(np.log2(spare).astype(np.float32))
        grams.append(table)
        probs.append(np.log2(p).astype(np.float32))
        seen, lower = p, table
    if not len(gram):
        unseen = np.zeros(n_lang)
    return Model(langs, grams, probs, contexts, weights, np.asarray(unseen, np.float32))


def _sample(rows: DataFrame, totals: dict[str, int], share: int, start: float = 0.0) -> DataFrame:
    """Rows (``lang``, ``u`` uniform from ``start`` to 1, ``chars``) of about ``share`` characters a language.

    A language's documents are taken in order of ``u`` while those before hold
    less than the share; the range of ``u`` is cut first, so that the window
    orders about twice the share, not the corpus.
    """
    end = F.create_map(*[x for l, n in totals.items() for x in (F.lit(l), F.lit(start + 2.0 * share / max(n, 1)))])
    before = Window.partitionBy("lang").orderBy("u", "chars", "digest").rowsBetween(Window.unboundedPreceding, -1)
    return rows.where(F.col("u") < end[F.col("lang")]) \
        .withColumn("before", F.coalesce(F.sum("chars").over(before), F.lit(0))).where(F.col("before") < share).drop("before")


def fit(docs: DataFrame, sample_chars: int = SAMPLE_CHARS, calibration_chars: int = CALIBRATION_CHARS) -> Model:
    """Models of every language of ``docs`` (doc_id, text, lang; rows without text or lang teach nothing).

    Documents are sampled by a hash of id and text, so reruns agree; with
    little text all of it is used.  The driver receives the distinct n-grams of
    the sample, at most ``sample_chars`` rows, and one row per calibration
    document.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull()) \
        .select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), F.length("text").cast("long").alias("chars"),
                F.xxhash64("doc_id", "text").alias("digest"), F.xxhash64(F.lit(7), "doc_id", "text").alias("v"))
    rows = rows.withColumn("u", F.shiftrightunsigned("v", 11).cast("double") / float(1 << 53)).drop("v")
    found = rows.groupBy("lang").agg(F.sum("chars").alias("n"), F.max("u").alias("most")).collect()  # one row a language
    totals = {r["lang"]: r["n"] for r in found}
    langs = sorted(totals)
    if not langs:
        return kneser_ney([], np.zeros(0, np.int64), np.zeros((0, ORDER), np.uint32), np.zeros(0))
    number = {l: i for i, l in enumerate(langs)}
    # documents below this place calibrate, the others are counted; one at least of each language is counted
    least = F.create_map(*[x for r in found for x in (F.lit(r["lang"]), F.lit(min(CALIBRATES, r["most"])))])[F.col("lang")]
    chosen = staged(_sample(rows.where(F.col("u") >= least), totals, -(-sample_chars // len(langs)), CALIBRATES).select("lang", "text"), "lid-sample")
    trial = staged(_sample(rows.where(F.col("u") < least), totals, -(-calibration_chars // len(langs))).select("lang", "text"), "lid-trial")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            code, first = letters(texts)
            at, row = positions(first)
            own = np.asarray([number[x] for x in part.column(0).to_pylist()], np.uint32)[row]
            table = np.stack([own, *[code[at - k] for k in range(ORDER - 1, -1, -1)]], axis=1)
            kinds, n = np.unique(np.ascontiguousarray(table).view("V%d" % (4 * (ORDER + 1))).reshape(-1), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([k.tobytes() for k in kinds], pa.binary()), pa.array(n, pa.int64())], names=["gram", "n"])

    grams = chosen.mapInArrow(count, "gram binary, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    table = np.frombuffer(b"".join(grams["gram"].to_pylist()), np.uint32).reshape(-1, ORDER + 1)
    order = np.lexsort(table.T[::-1])
    table = table[order]
    model = kneser_ney(langs, table[:, 0].astype(np.int64), table[:, 1:], grams["n"].to_numpy()[order].astype(float))
    return calibrated(model, trial)


def calibrated(model: Model, trial: DataFrame, rejected: float = REJECTED) -> Model:
    """``model`` with score and rejection fitted on ``trial`` (lang, text), rows that it has not counted.

    The score is a logistic function of the lead of the best over the second
    language in bits, per root of the characters; a language's limit is the
    cross-entropy that a share ``rejected`` of its trial documents exceeds.
    """
    shared = trial.sparkSession.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            cost, n = shared.value.costs(texts)
            best = cost.argmin(1)
            lead = _leads(cost, n)
            names = np.asarray(shared.value.langs, object)[best]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names.tolist(), pa.string()), pa.array(cost.min(1)), pa.array(lead), pa.array(n)],
                                             names=["lang", "best", "cost", "lead", "n"])

    rows = trial.mapInArrow(measure, "lang string, best string, cost double, lead double, n long").where("n > 0").toPandas()
    model.limits = np.full(len(model.langs), np.inf)
    if len(rows) and len(model.langs) > 1:
        rows = rows.sort_values(["lang", "best", "cost", "lead"])
        good = (rows.lang == rows.best).to_numpy()
        for i, l in enumerate(model.langs):
            own = rows.cost[good & (rows.lang == l)].to_numpy()
            if len(own) >= LEAST_TRIALS:
                # a margin of the spread keeps documents like those seen, should the trial be small
                model.limits[i] = np.quantile(own, 1 - rejected) + own.std()
        model.slope, model.offset = _logistic(rows.lead.to_numpy(), good)
    return model


def _leads(cost: np.ndarray, n: np.ndarray) -> np.ndarray:
    if cost.shape[1] < 2:
        return np.zeros(len(cost))
    two = np.partition(cost, 1, axis=1)
    return (two[:, 1] - two[:, 0]) * np.sqrt(np.maximum(n, 1))


def _logistic(x: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Platt's fit of P(good) = 1 / (1 + exp(-(slope x + offset))) with smoothed targets, by Newton steps."""
    n_good = int(good.sum())
    target = np.where(good, (n_good + 1) / (n_good + 2), 1 / (len(x) - n_good + 2))
    design = np.stack([x, np.ones(len(x))], 1)
    w = np.array([0.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        grad = design.T @ (target - p) - 1e-3 * w
        hess = (design * (p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return float(max(w[0], 0.0)), float(w[1])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` but those named like the new ones, and lang_pred, score, bits_per_char, accepted.

    Only ``text`` decides.  Null text and text without a letter are ``und``
    with score 0 and no cross-entropy, and so is all text if the model has no
    language; equal texts get equal results.  ``accepted`` is false where the
    cross-entropy is above the calibrated limit of the language chosen: the
    text is probably in none of those learned.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)
    names = ["lang_pred", "score", "bits_per_char", "accepted"]
    keep = [c for c in docs.columns if c not in names]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for part, texts in slices(batches, "_text"):
            if m.langs:
                cost, n = m.costs(texts)
                best, sure = cost.argmin(1), 1 / (1 + np.exp(-np.clip(m.slope * _leads(cost, n) + m.offset, -30, 30)))
                low, has = cost.min(1), n > 0
                if len(m.langs) == 1:
                    sure = np.ones(len(n))
                name = np.where(has, np.asarray([*m.langs], object)[best], "und")
                fine = has & (low <= (m.limits[best] if m.limits is not None else math.inf))
            else:
                has = np.zeros(len(texts), bool)
                low, sure, fine, name = np.zeros(len(texts)), np.zeros(len(texts)), has, np.full(len(texts), "und", object)
            new = [pa.array(name.tolist(), pa.string()), pa.array(np.where(has, sure, 0.0)), pa.array(low, mask=~has), pa.array(fine)]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], *new], names=[*part.schema.names[:-1], *names])

    from pyspark.sql.types import StructType
    schema = StructType(docs.select(*keep).schema.fields + StructType.fromDDL("lang_pred string, score double, bits_per_char double, accepted boolean").fields)
    return docs.select(*keep, F.col("text").cast("string").alias("_text")).mapInArrow(score, schema)


def held_out() -> Column:
    """Whether crc32(doc_id as text) mod 4 is 2; false for a null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, **bounds) -> DataFrame:
    """doc_id, held_out, lang_pred, score, bits_per_char, accepted of every document.

    Learns from the text and lang of documents that are not held out (null
    ids among them); see ``fit`` and ``predict`` for nulls, empty texts,
    repeated rows and empty tables.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text", "lang")
    model = fit(rows.where(~F.col("held_out")), **bounds)
    return predict(rows.drop("lang"), model).drop("text")
