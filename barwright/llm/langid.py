"""Language identification by rank-order profiles (Cavnar and Trenkle, 1994).

A language's profile is its most frequent letter n-grams (one to three letters, words set apart by a blank), most frequent first, counted over all training documents. A document's own profile is compared to each by the sum of out-of-place distances.

Null texts and texts without a letter are `und` with score 0. Ties between n-grams go to the smaller code, ties between languages to the smaller name. With no training rows, or an empty table, every row that there is is `und`. Rows are independent, and columns of the names that are added give way; a null doc_id has a null held_out and is learnt from. A text of any length counts whole, its n-grams sorted once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from barwright.llm import textcodes
from barwright.llm.common import per_batch, table, texts_of

PROFILE = 400
UNKNOWN = "und"
_BITS = 21


def gram_keys(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all n-grams of one to three letters, text by text, and where each text's start, and one more. A key holds its letters, 21 bits each; a blank, before and after each word, is 1."""
    code, at = textcodes.codes([t.lower() for t in texts])
    letter = textcodes.classes()[code] == textcodes.LETTER
    before = np.concatenate([[False], letter[:-1]])
    keep = letter | before | (np.arange(len(code)) == 0)
    # a blank stands before a text's first word, too
    keep[at[:-1][at[:-1] < len(code)]] = True
    seq = np.where(letter, code, 1)[keep].astype(np.int64)
    text_of = np.repeat(np.arange(len(texts)), np.diff(at))[keep]
    first_letter = np.zeros(len(code), dtype=bool)
    first_letter[at[:-1]] = letter[at[:-1]]
    if first_letter.any():  # no sign precedes the word: add the blank
        places = np.flatnonzero(first_letter[keep])
        seq, text_of = np.insert(seq, places, 1), np.insert(text_of, places, text_of[places])
    n = len(seq)
    blank = seq == 1
    same1 = np.zeros(n, dtype=bool)
    same2 = np.zeros(n, dtype=bool)
    same1[:-1] = (text_of[1:] == text_of[:-1]) & ~(blank[1:] & blank[:-1])
    same2[:-2] = (text_of[2:] == text_of[:-2]) & ~blank[1:-1]
    two, three = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    two[:-1] = seq[:-1] | seq[1:] << _BITS
    three[:-2] = two[:-2] | seq[2:] << 2 * _BITS
    grams = np.stack([seq, two, three], axis=1)
    valid = np.stack([~blank, same1, same2], axis=1)
    per_text = np.bincount(text_of, weights=valid.sum(axis=1), minlength=len(texts)).astype(np.int64)
    return grams[valid], np.concatenate([[0], np.cumsum(per_text)])


def profile_counts(train: DataFrame) -> DataFrame:
    """lang, gram, n over all rows of train (text, lang); each batch is counted before anything moves."""

    def make():
        def work(batch: pa.RecordBatch) -> pa.Table | None:
            keys, at = gram_keys(texts_of(batch))
            langs = np.array(batch.column(1).to_pylist(), dtype=object)
            size = np.diff(at)
            out = []
            for lang in sorted(set(langs)):
                gram, n = np.unique(keys[np.repeat(langs == lang, size)], return_counts=True)
                out.append(pa.table({"lang": pa.array([lang] * len(gram), pa.string()), "gram": gram, "n": n}))
            return pa.concat_tables(out) if out else None

        return work

    return train.select("text", "lang").mapInArrow(per_batch(make), "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def fit_profiles(train: DataFrame, size: int = PROFILE) -> dict[str, list[int]]:
    """Each language's n-grams, most frequent first: what comes to the driver is no more than size numbers a language, however many rows there are."""
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    rows = profile_counts(train).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)
    found = rows.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("rank", "gram"))).alias("grams")).collect()
    return {r["lang"]: [g["gram"] for g in r["grams"]] for r in found}


class Classifier:
    def __init__(self, profiles: dict[str, list[int]], size: int = PROFILE) -> None:
        self.langs, self.size = sorted(profiles), size
        self.known = np.unique(np.array([g for p in profiles.values() for g in p], dtype=np.int64))
        self.rank = np.full((len(self.langs), len(self.known)), -1, dtype=np.int32)
        for i, lang in enumerate(self.langs):
            self.rank[i, np.searchsorted(self.known, profiles[lang])] = np.arange(len(profiles[lang]))

    def __call__(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """The nearest language, and one less its share of the largest distance there can be."""
        keys, at = gram_keys(texts)
        names, scores = [], []
        for a, b in zip(at.tolist(), at[1:].tolist(), strict=False):
            if a == b or not self.langs:
                names.append(UNKNOWN)
                scores.append(0.0)
                continue
            gram, n = np.unique(keys[a:b], return_counts=True)
            top = np.argsort(-n, kind="stable")[: self.size]
            place = np.minimum(np.searchsorted(self.known, gram[top]), len(self.known) - 1)
            rank = np.where(self.known[place] == gram[top], self.rank[:, place], -1)
            away = np.where(rank < 0, self.size, np.abs(rank - np.arange(len(top)))).sum(axis=1)
            best = int(np.argmin(away))
            names.append(self.langs[best])
            scores.append(1.0 - float(away[best]) / (self.size * len(top)))
        return names, scores


def predicted(docs: DataFrame, profiles: dict[str, list[int]], size: int = PROFILE, lang_name: str = "lang_pred", score_name: str = "score") -> DataFrame:
    """docs with the language and its score, in place of columns of those names."""
    docs = docs.drop(lang_name, score_name)
    names = docs.columns

    def make():
        judge = Classifier(profiles, size)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            lang, score = judge(texts_of(batch))
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*names, lang_name, score_name])

        return work

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(per_batch(make), f"{schema}, `{lang_name}` string, `{score_name}` double")


def held_out_fold(mod: int, fold: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % mod == fold


def identify(docs: DataFrame, size: int = PROFILE) -> DataFrame:
    """doc_id, held_out, lang_pred, score; profiles from the rows with a lang whose fold is not held out."""
    train = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~F.coalesce(held_out_fold(5, 0), F.lit(False)))
    judged = predicted(docs.select("doc_id", "text"), fit_profiles(train, size), size)
    return judged.select("doc_id", held_out_fold(5, 0).alias("held_out"), "lang_pred", "score")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
