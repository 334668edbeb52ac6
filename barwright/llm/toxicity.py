"""Toxicity by multiple-instance learning: a document is toxic if one of its sentences is.

Sentence scores are logistic in the words and word beginnings that a sentence has; a document's score is their noisy-or, 1 - prod(1 - p). Only documents carry labels; the fit follows the likelihood of those through the noisy-or. Scoring also says which sentences offend.

The fit uses a bounded sample of labelled rows, `sample` documents with the smallest hash of doc_id. Null and empty texts are one empty sentence and get the model's base score. Several labels of a document count as toxic if one does; null labels are none. Without any label of either kind every score is 0. Extra columns take no part, columns of the names that are added give way, and repeated rows are scored alike; a null doc_id has a null held_out and no label. Of sentences that offend alike the first is named. A text of any length is scored whole."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barwright.llm import textcodes
from barwright.llm.common import per_batch, stored, table, texts_of

SAMPLE = 30_000
FEATURES = 4_096
THRESHOLD = 0.3
#: Letters of the word beginnings that are features beside the words themselves.
BEGINNINGS = (3, 4, 5, 6, 7)
_SIEVE = 22
#: Signs that end a sentence.
ENDS = [ord(c) for c in ".!?\n。！？"]


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature hashes, the sentence (numbered through the batch) of each, and each text's first sentence, and one more."""
    code, at = textcodes.codes([t.lower() for t in texts])
    letter = textcodes.classes()[code] == textcodes.LETTER
    edge = np.diff(letter.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    stop = np.isin(code, ENDS) | (code == textcodes.END)
    # a sentence begins with the first word after a stop; a text without words is one empty sentence
    stops = np.cumsum(stop)[starts] if len(starts) else starts
    text_of = np.searchsorted(at, starts, side="right") - 1
    new = np.diff(stops, prepend=-1) != 0
    per_text = np.maximum(np.bincount(text_of[new], minlength=len(texts)), 1)
    first = np.concatenate([[0], np.cumsum(per_text)])
    nth = np.cumsum(new) - 1
    had = np.concatenate([[0], np.cumsum(np.bincount(text_of[new], minlength=len(texts)))])
    sentence = nth - had[text_of] + first[text_of]
    hashes, owner = [textcodes.span_hash(code, starts, ends)], [sentence]
    size = ends - starts
    for k in BEGINNINGS:
        some = size > k
        hashes.append(textcodes.span_hash(code, starts[some], starts[some] + k) ^ np.uint64(0x5BD1E995 * k))
        owner.append(sentence[some])
    return np.concatenate(hashes), np.concatenate(owner), first


@dataclass
class Model:
    """Sorted feature hashes, their weights, and a sentence's score without any."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float

    def sieve(self) -> np.ndarray:
        out = np.zeros(1 << _SIEVE, dtype=bool)
        out[(self.keys >> np.uint64(64 - _SIEVE)).astype(np.int64)] = True
        return out


def hits(keys: np.ndarray, sieve: np.ndarray, hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers in keys of the hashes among them, once a sentence, and the sentence of each."""
    some = sieve[(hashes >> np.uint64(64 - _SIEVE)).astype(np.int64)]
    hashes, owner = hashes[some], owner[some]
    place = np.minimum(np.searchsorted(keys, hashes), max(len(keys) - 1, 0))
    same = keys[place] == hashes if len(keys) else np.zeros(0, dtype=bool)
    pair = np.unique(owner[same].astype(np.int64) * max(len(keys), 1) + place[same])
    return pair % max(len(keys), 1), pair // max(len(keys), 1)


def labelled(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """text and toxic of a bounded sample of the labelled documents that may be learnt from. What is broadcast is `sample` rows at most."""
    from barwright.llm.langid import held_out_fold

    marks = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out_fold(4, 2)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    some = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    return docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("text", "toxic")


def feature_counts(train: DataFrame) -> DataFrame:
    """feature, n documents and n toxic ones, counted within each batch before the shuffle."""

    def make():
        def work(batch: pa.RecordBatch) -> pa.Table:
            hashes, owner, first = features(texts_of(batch))
            toxic = np.array(batch.column(1).to_pylist(), dtype=np.int64)
            doc = np.searchsorted(first, owner, side="right") - 1
            order = np.lexsort((doc, hashes))
            h, d = hashes[order], doc[order]
            one = np.ones(len(h), dtype=bool)
            one[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
            h, d = h[one], d[one]
            u, at, n = np.unique(h, return_index=True, return_counts=True)
            pos = np.add.reduceat(toxic[d], at) if len(u) else n
            return pa.table({"feature": u.view(np.int64), "n": n.astype(np.int64), "pos": pos.astype(np.int64)})

        return work

    return train.mapInArrow(per_batch(make), "feature bigint, n bigint, pos bigint").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most: int = FEATURES) -> Model:
    train = stored(labelled(docs, labels, sample), "toxic-train")
    total = train.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("pos")).first()
    n, pos = int(total["n"]), int(total["pos"])
    if not pos or pos == n:
        return Model(np.zeros(0, np.uint64), np.zeros(0), -np.inf if not pos else np.inf)
    share = pos / n
    lean = (F.col("pos") - F.lit(share) * F.col("n")) / F.sqrt(F.col("n") * (share * (1 - share)))
    best = feature_counts(train).where((F.col("n") >= 5) & (lean > 4)).orderBy(lean.desc(), "feature").limit(most).select("feature").collect()
    keys = np.sort(np.array([r["feature"] for r in best], dtype=np.int64).view(np.uint64))
    sieve = Model(keys, keys, 0.0).sieve()

    def make():
        def work(batch: pa.RecordBatch) -> pa.Table:
            hashes, owner, first = features(texts_of(batch))
            feature, sentence = hits(keys, sieve, hashes, owner)
            doc = np.searchsorted(first, sentence, side="right") - 1
            at = pa.array(np.searchsorted(doc, np.arange(batch.num_rows + 1)).astype(np.int32))
            return pa.table({"toxic": batch.column(1), "sentences": np.diff(first).astype(np.int32), "feature": pa.ListArray.from_arrays(at, pa.array(feature.astype(np.int32))), "sentence": pa.ListArray.from_arrays(at, pa.array((sentence - first[doc]).astype(np.int32)))})

        return work

    return descend(keys, train.mapInArrow(per_batch(make), "toxic int, sentences int, feature array<int>, sentence array<int>").toArrow())  # `sample` rows at most, of selected features alone


def descend(keys: np.ndarray, rows: pa.Table, steps: int = 600, rate: float = 0.05, penalty: float = 2e-5) -> Model:
    """Ascent of the penalised likelihood (Adam) over documents' noisy-or; rows: toxic, sentences (how many), and each feature's number and sentence. Sentences without features share one score and need only be counted."""
    y, sentences = (rows.column(c).to_numpy().astype(float) for c in ("toxic", "sentences"))
    lists = rows.column("feature").combine_chunks()
    feature = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    owner = np.repeat(np.arange(len(y)), lists.value_lengths().to_numpy(zero_copy_only=False))
    local = rows.column("sentence").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    span = int(local.max(initial=0)) + 1
    some, sentence = np.unique(owner * span + local, return_inverse=True)
    doc = some // span
    empty = sentences - np.bincount(doc, minlength=len(y))
    n_docs, n_features = len(y), len(keys)
    w = np.zeros(n_features + 1)
    w[-1] = -6.0
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        z = w[-1] + np.bincount(sentence, weights=w[feature], minlength=len(doc)) if len(doc) else np.zeros(0)
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        p0 = 1 / (1 + np.exp(-np.clip(w[-1], -30, 30)))
        log_none = np.bincount(doc, weights=np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=n_docs) + empty * np.log1p(-p0)
        none = np.exp(np.minimum(log_none, -1e-9))
        pull = np.where(y > 0, none / (1 - none), -1.0)  # of a document on its sentences, to be times their p
        by_sentence = pull[doc] * p
        grad = np.concatenate([np.bincount(feature, weights=by_sentence[sentence], minlength=n_features) if len(feature) else np.zeros(n_features), [by_sentence.sum() + (pull * empty).sum() * p0]]) / n_docs
        grad[:-1] -= penalty * w[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return Model(keys, w[:-1], float(w[-1]))


def scored(docs: DataFrame, model: Model, located: bool = True) -> DataFrame:
    """docs with score and, if located, worst_sentence (its number in the text, from 0) and sentence_score of the one that offends most, in place of columns of those names."""
    docs = docs.drop("score", "worst_sentence", "sentence_score")
    names = docs.columns

    def make():
        sieve = model.sieve()

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            hashes, owner, first = features(texts_of(batch))
            feature, sentence = hits(model.keys, sieve, hashes, owner)
            z = model.bias + np.bincount(sentence, weights=model.weights[feature] if len(feature) else None, minlength=int(first[-1]))
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30))) if np.isfinite(model.bias) else np.full(len(z), float(model.bias > 0))
            none = np.add.reduceat(np.log1p(-np.minimum(p, 1 - 1e-12)), first[:-1]) if batch.num_rows else p
            columns = [*batch.columns, pa.array(-np.expm1(none))]
            if located:
                worst = [int(np.argmax(p[a:b])) for a, b in zip(first.tolist(), first[1:].tolist(), strict=False)]
                columns += [pa.array(worst, pa.int32()), pa.array(p[first[:-1] + np.array(worst, dtype=np.int64)])]
            return pa.RecordBatch.from_arrays(columns, names=[*names, "score", *["worst_sentence", "sentence_score"] * located])

        return work

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(per_batch(make), f"{schema}, score double" + ", worst_sentence int, sentence_score double" * located)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barwright.llm.langid import held_out_fold

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return scored(docs, model).select("doc_id", held_out_fold(4, 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "worst_sentence", "sentence_score")
