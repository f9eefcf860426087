"""Toxicity by a factorization machine over hashed terms.

Besides a weight, every term has a short factor vector, and the products of the vectors of two
terms score their meeting in one text, such as an insult with a group that is mentioned. The
machine is trained on a bounded sample of labelled texts in one task; its weights have a fixed
size and are sent to all tasks, which score whole texts in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from calorix.llm.base import query, table
from calorix.llm.text import SIGNS, chunks, run_of, span_hashes, text_bytes, word_spans


@dataclass(frozen=True)
class MachineRules:
    """bits: terms are hashed to 2**bits places; factors: length of a factor vector;
    max_rows: bound of the training sample, the labelled rows with the smallest id hashes;
    min_texts, min_score: only terms in so many sampled texts whose share of toxic texts lies so many
    standard deviations from the mean have weights, else rare words of the sample are learned
    by heart; weight: of a toxic text in the loss, as they are few; the rest steers the training."""

    bits: int = 18
    factors: int = 6
    max_rows: int = 16_000
    min_texts: int = 4
    min_score: float = 3.0
    weight: float = 4.0
    epochs: int = 20
    batch: int = 256
    rate: float = 0.15
    shrink: float = 2e-4


def text_terms(column: pa.Array, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For runs of texts: the distinct hashed terms, and the number of them in each text."""
    data, offsets = text_bytes(column)
    for lo, hi in chunks(offsets):
        at = offsets[lo : hi + 1]
        starts, ends, first = word_spans(data[at[0] : at[-1]], at - at[0], SIGNS)
        terms = span_hashes(data[at[0] : at[-1]], starts, ends, fold=True) >> np.uint64(64 - bits)
        text = run_of(np.diff(first)).astype(np.uint64)
        both = np.unique((text << np.uint64(bits)) | terms)
        counts = np.bincount((both >> np.uint64(bits)).astype(np.int64), minlength=hi - lo)
        yield (both & np.uint64((1 << bits) - 1)).astype(np.int32), counts


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of each run of ``values``; empty runs give 0."""
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=float)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def machine_scores(
    bias: float, weights: np.ndarray, factors: np.ndarray, terms: np.ndarray, counts: np.ndarray
) -> np.ndarray:
    """Probability of each text; ``factors`` has a row per term."""
    v = factors[terms]
    pairs = 0.5 * (_sums(v, counts) ** 2 - _sums(v * v, counts)).sum(axis=1)
    return 1 / (1 + np.exp(-np.clip(bias + _sums(weights[terms], counts) + pairs, -30, 30)))


def train_machine(
    terms: np.ndarray, counts: np.ndarray, labels: np.ndarray, rules: MachineRules
) -> tuple[float, np.ndarray, np.ndarray]:
    """Bias, weights and factors by Adagrad on the logistic loss; the same for the same rows."""
    size = 1 << rules.bits
    draw = np.random.default_rng(7)
    share = min(max(labels.mean() if len(labels) else 0.5, 1e-3), 1 - 1e-3)
    texts = np.bincount(terms, minlength=size)
    toxic = np.bincount(terms, np.repeat(labels, counts), size)
    score = np.abs(toxic - share * texts) / np.sqrt(np.maximum(texts, 1) * share * (1 - share))
    known = (texts >= rules.min_texts) & (score >= rules.min_score)
    keep = known[terms]
    counts = np.diff(np.concatenate([[0], np.cumsum(keep)])[np.concatenate([[0], np.cumsum(counts)])])
    terms = terms[keep]
    bias = float(np.log(share / (1 - share)))
    w, v = np.zeros(size), draw.normal(0, 0.02, (size, rules.factors)) * known[:, None]
    gw, gv = np.full(size, 1e-2), np.full((size, rules.factors), 1e-2)
    ends = np.cumsum(counts)
    starts = ends - counts
    for _ in range(rules.epochs):
        order = draw.permutation(len(labels))
        for b in range(0, len(order), rules.batch):
            rows = order[b : b + rules.batch]
            n = counts[rows]
            at = np.repeat(starts[rows] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            t = terms[at]
            p = machine_scores(bias, w, v, t, n)
            off = (p - labels[rows]) * np.where(labels[rows] > 0, rules.weight, 1.0)
            bias -= 0.02 * off.mean()
            own, inverse = np.unique(t, return_inverse=True)
            each = np.repeat(off, n)
            dw = np.bincount(inverse, each, len(own)) + rules.shrink * w[own] * len(rows)
            gw[own] += dw * dw
            w[own] -= rules.rate * dw / np.sqrt(gw[own])
            vt = v[t]
            pull = each[:, None] * (np.repeat(_sums(vt, n), n, axis=0) - vt)
            for k in range(rules.factors):
                dv = np.bincount(inverse, pull[:, k], len(own)) + rules.shrink * v[own, k] * len(rows)
                gv[own, k] += dv * dv
                v[own, k] -= 0.2 * rules.rate * dv / np.sqrt(gv[own, k])
    return bias, w, v


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learned from; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def fit_machine(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    rules: MachineRules | None = None,
) -> tuple[float, np.ndarray, np.ndarray]:
    """Train on a sample of the labelled rows that are not held out.

    A document with several labels counts as its largest; null ids and labels are left out. With
    no labelled row every text scores one half.
    """
    rules = rules or MachineRules()
    own = F.col(id_col)
    usable = labels.where(own.isNotNull() & F.col(label_col).isNotNull() & ~held_out(own))
    sample = (
        usable.groupBy(own.alias("_id"))
        .agg(F.max(label_col).cast("int").alias("_label"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(rules.max_rows)
    )
    rows = (
        docs.select(own.alias("_id"), F.col(text_col).cast("string").alias("_text"))
        # at most max_rows narrow rows
        .join(F.broadcast(sample), "_id")
        .select("_id", "_label", "_text")
    )

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(text_terms(batch.column(2), rules.bits))
            terms = np.concatenate([t for t, _ in found]) if found else np.zeros(0, np.int32)
            counts = np.concatenate([n for _, n in found]) if found else np.zeros(0, np.int64)
            at = np.concatenate([[0], np.cumsum(counts)])
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(terms, pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), batch.column(1), lists],
                names=["_id", "_label", "_terms"],
            )

    bounded = rows.mapInArrow(featured, "_id long, _label int, _terms array<int>")

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["_id", "_label"], kind="stable")
        counts = frame["_terms"].map(len).to_numpy(np.int64)
        terms = np.concatenate([np.zeros(0, np.int32), *frame["_terms"]]).astype(np.int32)
        bias, w, v = train_machine(terms, counts, frame["_label"].to_numpy(float), rules)
        used = np.flatnonzero(w)
        model = np.column_stack([w[used], v[used]]).astype(np.float32)
        return pd.DataFrame(
            {
                "bias": [bias],
                "terms": [used.astype(np.int32).tobytes()],
                "model": [model.tobytes()],
            }
        )

    # one group: the sample, at most max_rows rows
    fitted = bounded.groupBy(F.lit(0).alias("_g")).applyInPandas(
        fit, "bias double, terms binary, model binary"
    )
    size = 1 << rules.bits
    w, v = np.zeros(size, np.float32), np.zeros((size, rules.factors), np.float32)
    found = fitted.first()
    if found is None:
        return 0.0, w, v
    used = np.frombuffer(found.terms, np.int32)
    model = np.frombuffer(found.model, np.float32).reshape(len(used), rules.factors + 1)
    w[used], v[used] = model[:, 0], model[:, 1:]
    return found.bias, w, v


def score_texts(
    docs: DataFrame,
    model: tuple[float, np.ndarray, np.ndarray],
    id_col: str = "doc_id",
    text_col: str = "text",
    rules: MachineRules | None = None,
) -> DataFrame:
    """``doc_id, score`` for every row; null and empty texts score as a text without terms."""
    rules = rules or MachineRules()
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 4 * (factors + 1) * 2**bits bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bias, w, v = sent.value
        for batch in batches:
            scores = [machine_scores(bias, w, v, *x) for x in text_terms(batch.column(1), rules.bits)]
            score = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(score, pa.float64())],
                names=["doc_id", "score"],
            )

    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id long, score double")


@query("op10_toxicity")
def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Score of every document by a machine trained on the labels that are not held out."""
    docs = table(spark, folder, "documents")
    model = fit_machine(docs, table(spark, folder, "labels"))
    return score_texts(docs, model).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
