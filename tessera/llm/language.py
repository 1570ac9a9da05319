"""Language identification by words first, with a backoff to shorter and shorter character n-grams.

For each language the model knows the log frequency of its words and of its words' character n-grams of
five letters to one. A word of a text that is known scores by its frequency in each language; an
unseen one by its n-grams of the greatest length of which any is known. The sums decide.

The model is counted from a bounded sample of labelled texts: about ``PER_LANGUAGE`` for each language, by a
hash of id and text, of at most ``MAX_CHARS`` characters each. Which texts these are depends on counts over all labelled
rows; every language takes part. Prediction reads whole texts and has no shuffle.

Defined cases: a text that is null or has no letter is ``und`` with score 0; null languages teach nothing;
without any labelled text everything is ``und``; ties go to the language first in the alphabet; very long texts are
read whole; repeated rows get equal predictions; extra columns are carried along, but for those that are added; an
empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

PER_LANGUAGE, MAX_CHARS, GRAMS, MIN_COUNT = 1500, 100_000, 5, 2
UNKNOWN = "und"
_WORD = re.compile(r"[^\W\d_]+")


def word_list(text: str) -> list[str]:
    found = _WORD.findall(text.lower())
    if all(map(str.isalpha, found)):
        return found
    # fractions, superscripts and Roman numerals count as characters of words, but aren't letters
    return [x for w in found for x in "".join(c if c.isalpha() else " " for c in w).split()]


def grams(word: str, n: int) -> list[str]:
    padded = f"<{word}>" if n > 1 else word
    return [padded[k : k + n] for k in range(len(padded) - n + 1)]


def fit(counts_of: dict[str, Counter]) -> dict | None:
    """Names of the languages, and a table of log frequencies for words and for each length of n-grams, from counts of
    the words of each language."""
    names = sorted(counts_of)
    if not names:
        return None
    counts = [counts_of[x] for x in names]
    parts = [[Counter() for _ in names] for _ in range(GRAMS)]
    for k, words in enumerate(counts):
        for w, c in words.items():
            for n in range(1, GRAMS + 1):
                for g in grams(w, n):
                    parts[n - 1][k][g] += c

    def table(each: list[Counter], least: int) -> dict[str, np.ndarray]:
        keys = [x for x in set().union(*each) if sum(c[x] for c in each) >= least]
        if not keys:
            return {}
        raw = np.array([[c[x] for c in each] for x in keys], np.float64) + 0.3
        logs = np.log(raw / raw.sum(axis=0)).astype(np.float32)
        return dict(zip(keys, logs))

    return {"names": names, "words": table(counts, MIN_COUNT), "grams": [table(p, MIN_COUNT) for p in parts]}


def word_score(model: dict, word: str) -> np.ndarray:
    """Log frequencies of a word in each language, by the longest strings that the model knows."""
    if (known := model["words"].get(word)) is not None:
        return known
    for n in range(GRAMS, 0, -1):
        found = [s for g in grams(word, n) if (s := model["grams"][n - 1].get(g)) is not None]
        if found:
            return np.mean(found, axis=0)
    return np.zeros(len(model["names"]), np.float32)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict | None:
    """The model of a bounded sample; its words are counted where the texts are, and only counts come to the driver."""
    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (F.length(text_col) <= MAX_CHARS))
    rows = rows.select(F.xxhash64(id_col, text_col).alias("h"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    # a share of the hash range for each language, so that no language has to be sorted
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"))
    share = sizes.select("lang", F.least(F.lit(1.0), F.lit(PER_LANGUAGE) / F.col("n")).alias("share"))
    chosen = rows.join(share, "lang").filter(F.pmod("h", F.lit(1_000_003)) < F.col("share") * 1_000_003).select("lang", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, Counter] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found.setdefault(lang, Counter()).update(word_list(text))
            each = [(lang, w, n) for lang, words in found.items() for w, n in [*words.items(), ("", 0)]]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in each], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["lang", "word", "n"])

    sums = chosen.mapInArrow(work, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    out: dict[str, Counter] = {}
    for r in sums.toLocalIterator():
        out.setdefault(r["lang"], Counter())
        if r["n"]:
            out[r["lang"]][r["word"]] = r["n"]
    return fit(out)


def identify(df: DataFrame, model: dict | None, text_col: str = "text") -> DataFrame:
    """``df`` with ``lang_pred`` and ``score``."""
    df = df.drop("lang_pred", "score")
    shared = df.sparkSession.sparkContext.broadcast(model)
    at = df.columns.index(text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, place, rows = shared.value, {}, []
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part, names, scores = batch.slice(lo, 512), [], []
                texts = [Counter(word_list(t or "")) for t in part.column(at).to_pylist()]
                if model:
                    for w in set().union(*texts) - place.keys():
                        place[w] = len(rows)
                        rows.append(word_score(model, w))
                    table = np.array(rows, np.float64)
                for words in texts:
                    if not words or not model:
                        names.append(UNKNOWN)
                        scores.append(0.0)
                        continue
                    n = np.fromiter(words.values(), np.float64, len(words))
                    total = n @ table[[place[w] for w in words]]
                    best = int(total.argmax())
                    # a posterior that is tempered, as words aren't independent
                    p = np.exp((total - total[best]) / max(1.0, np.sqrt(n.sum())))
                    names.append(model["names"][best])
                    scores.append(float(1 / p.sum()))
                if len(rows) > 300_000:
                    place, rows = {}, []
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names), pa.array(scores, pa.float64())], names=[*part.schema.names, "lang_pred", "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(work, f"{schema}, lang_pred string, score double")


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def op6_language(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.filter(~held_out()))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
