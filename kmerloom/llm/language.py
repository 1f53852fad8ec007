"""Language identification (operator 4).

Character n-grams of one to three letters are hashed into a fixed number of features,
weighted by TF-IDF and normalised. Document frequencies are counted over all labelled
training rows, with one vector of counts per task summed by Spark. A multinomial
logistic regression with elastic-net penalties is trained by follow-the-regularised-
leader (FTRL-proximal), which leaves most weights at zero, on a sample of about
``per_language`` documents of each language: this bound is a parameter and all else
covers all rows. A part of the sample that training does not see sets the temperature
of the probabilities. The fitted model has a fixed size for each language; it alone
is broadcast, and every whole text is scored.

Defined cases: a text that is null or has no letter is ``und`` with score 0, and so
is every text if no row has a label; of more than ``max_languages`` labels the most frequent are learned; a null ``doc_id`` counts as the empty string
where rows are dealt into folds; rows with a null ``lang`` are scored but teach nothing;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Features, a power of two.
SIZE = 1 << 15
UNKNOWN = "und"
_STEP = 1 << 18  # characters hashed at a time


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def ngram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Indices and counts of the hashed n-grams of a whole text; empty if it has no letter.

    Runs of other characters than letters count as one blank.
    """
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[points]
    if not letter.any():
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first of a run of other characters
    c = np.where(letter, points, 32)[keep].astype(np.uint32)
    c = np.concatenate((c[:0] if c[0] == 32 else np.array([32], np.uint32), c, np.array([32], np.uint32)))
    total = np.zeros(SIZE, np.int64)
    shift = np.uint32(32 - SIZE.bit_length() + 1)
    for at in range(0, len(c), _STEP):
        x = c[at : at + _STEP + 2]
        one = x * np.uint32(2654435761)
        two = (one[:-1] ^ (x[1:] * np.uint32(2246822519))) * np.uint32(3266489917)
        three = (two[:-1] ^ (x[2:] * np.uint32(668265263))) * np.uint32(374761393)
        n = min(_STEP, len(c) - at)
        for h in (one[:n], two[:n], three[:n]):
            total += np.bincount(h >> shift, minlength=SIZE)
    index = np.flatnonzero(total)
    return index.astype(np.int32), total[index].astype(np.float32)


@dataclass
class LanguageModel:
    """Weights and bias by language, inverse document frequencies, and the temperature."""

    languages: list[str]
    weights: np.ndarray
    bias: np.ndarray
    idf: np.ndarray
    temperature: float

    def features(self, index: np.ndarray, count: np.ndarray) -> np.ndarray:
        x = np.log1p(count) * self.idf[index]
        return x / max(float(np.sqrt((x * x).sum())), 1e-12)

    def predict(self, text: str | None) -> tuple[str, float]:
        index, count = ngram_counts(text)
        if not len(index) or not self.languages:
            return UNKNOWN, 0.0
        z = (self.weights[:, index] @ self.features(index, count) + self.bias) / self.temperature
        p = np.exp(z - z.max())
        best = int(p.argmax())
        return self.languages[best], float(p[best] / p.sum())


def held_out(folds: int = 5) -> Column:
    """Whether a row belongs to the fold that training never sees."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds == 0


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Documents that hold each feature, and documents with a letter, over all of ``docs``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df = np.zeros(SIZE + 1, np.int64)
        for batch in batches:
            for text in batch["text"]:
                index, _ = ngram_counts(text)
                df[index] += 1
                df[SIZE] += len(index) > 0
        at = np.flatnonzero(df)
        yield pd.DataFrame({"feature": at.astype(np.int32), "n": df[at]})

    rows = docs.select("text").mapInPandas(run, "feature int, n bigint").groupBy("feature").agg(F.sum("n").alias("n")).collect()  # SIZE + 1 rows at most
    out = np.zeros(SIZE + 1, np.int64)
    for r in rows:
        out[r["feature"]] = r["n"]
    return out[:SIZE], int(out[SIZE])


def _weights(z: np.ndarray, n: np.ndarray, alpha: float, beta: float, l1: float, l2: float) -> np.ndarray:
    shrunk = np.sign(z) * np.maximum(np.abs(z) - l1, 0)
    return -shrunk / ((beta + np.sqrt(n)) / alpha + l2)


def train_ftrl(
    rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, epochs: int, alpha: float, beta: float, l1: float, l2: float, seed: int
) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias from (indices, values, class) rows; the bias is not penalised."""
    z, n = np.zeros((classes, SIZE)), np.zeros((classes, SIZE))
    zb, nb = np.zeros(classes), np.zeros(classes)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            index, x, label = rows[k]
            zi, ni = z[:, index], n[:, index]
            w = _weights(zi, ni, alpha, beta, l1, l2)
            b = _weights(zb, nb, alpha, beta, 0, 0)
            s = w @ x + b
            p = np.exp(s - s.max())
            p /= p.sum()
            p[label] -= 1
            g = p[:, None] * x[None, :]
            more = ni + g * g
            z[:, index] = zi + g - (np.sqrt(more) - np.sqrt(ni)) / alpha * w
            n[:, index] = more
            mb = nb + p * p
            zb += p - (np.sqrt(mb) - np.sqrt(nb)) / alpha * b
            nb = mb
    return _weights(z, n, alpha, beta, l1, l2), _weights(zb, nb, alpha, beta, 0, 0)


def calibrate(scores: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss, on a grid from 1/64 to 64."""
    if not len(labels):
        return 1.0

    def loss(t: float) -> float:
        s = scores / t
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(labels)), labels]).mean())

    return min((2.0 ** (k / 8) for k in range(-48, 49)), key=loss)


def fit(
    docs: DataFrame, per_language: int = 1200, max_languages: int = 200, most_rows: int = 60_000, epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02, seed: int = 5
) -> LanguageModel:
    """A model of the rows of ``docs`` (doc_id, text, lang) with a label.

    About ``per_language`` documents of each language train it, picked by a hash of
    ``doc_id``, fewer if that made more than ``most_rows``; a fifth of them sets the temperature. Statistics cover all rows. The
    model holds SIZE weights for each language, so of more than ``max_languages`` labels the most frequent ones are learned (of
    equally frequent ones the first by name); documents with another label are not learned from but predicted like all.
    """
    known = docs.filter(F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    counted = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(max_languages).collect()
    by_lang = {r["lang"]: r["n"] for r in counted}
    languages = sorted(by_lang)
    df, total = document_frequencies(known)
    idf = np.log((1 + total) / (1 + df)).astype(np.float32) + np.float32(1)
    if not languages:
        return LanguageModel([], np.zeros((0, SIZE), np.float32), np.zeros(0, np.float32), idf, 1.0)
    per_language = min(per_language, max(1, most_rows // len(languages)))
    draw = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 20)) / float(1 << 20)
    share = F.create_map(*[F.lit(x) for lang, n in by_lang.items() for x in (lang, min(1.0, per_language / n))])
    sample = known.filter(F.col("lang").isin(languages)).filter(draw < share[F.col("lang")])
    model = LanguageModel(languages, np.zeros((len(languages), SIZE), np.float32), np.zeros(len(languages), np.float32), idf, 1.0)

    def sparse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [ngram_counts(t) for t in batch["text"]]
            yield pd.DataFrame({
                "lang": batch["lang"], "doc_id": batch["doc_id"],
                "index": [i for i, _ in found], "value": [model.features(i, c) if len(i) else c for i, c in found],
            })

    def train(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows[rows["index"].map(len) > 0].sort_values(["doc_id", "lang"], kind="stable")
        order = {x: k for k, x in enumerate(languages)}
        data = [(np.asarray(i), np.asarray(v, np.float64), order[x]) for i, v, x in zip(rows["index"], rows["value"], rows["lang"], strict=True)]
        own, apart = [r for k, r in enumerate(data) if k % 5], data[::5]
        if not own:
            own, apart = data, []
        w, b = train_ftrl(own, len(languages), epochs, alpha, beta, l1, l2, seed)
        scores = np.array([w[:, i] @ v + b for i, v, _ in apart]).reshape(-1, len(languages))
        t = calibrate(scores, np.array([c for *_, c in apart], np.int64))
        return pd.DataFrame({"weights": [w.astype(np.float32).tobytes()], "bias": [b.astype(np.float32).tobytes()], "temperature": [t]})

    kind = docs.schema["doc_id"].dataType.simpleString()
    fitted = (
        sample.mapInPandas(sparse, f"lang string, doc_id {kind}, index array<int>, value array<float>")
        .groupBy(F.lit("model").alias("part"))
        .applyInPandas(train, "weights binary, bias binary, temperature double")
        .collect()
    )
    if fitted:
        model.weights = np.frombuffer(fitted[0]["weights"], np.float32).reshape(len(languages), SIZE)
        model.bias = np.frombuffer(fitted[0]["bias"], np.float32)
        model.temperature = fitted[0]["temperature"]
    return model


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``docs`` with lang_pred and score, which replace columns of these names."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # SIZE floats for each language

    @F.pandas_udf("lang_pred string, score double")
    def scored(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shared.value.predict(t) for t in texts], columns=["lang_pred", "score"])

    others = [docs[c] for c in docs.columns if c not in ("lang_pred", "score")]
    return docs.withColumn("_scored", scored(docs["text"])).select(*others, "_scored.lang_pred", "_scored.score")


def identify(docs: DataFrame, folds: int = 5, **options: float) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each row; the fold 0 of ``folds`` is not learned from."""
    model = fit(docs.filter(~held_out(folds)), **options)
    return predict(docs.select("doc_id", "text", held_out(folds).alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")
