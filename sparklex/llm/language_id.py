"""Language identification by nearest centroid.

A text becomes an L2-normalised TF-IDF vector of hashed byte n-grams (2 to 4
bytes of the lower-cased UTF-8, digits and punctuation taken as blanks).  Each
language has several centroids from spherical k-means; the nearest centroid by
cosine names the language.  A text is rejected when it is farther from its language
than ``margin`` allows beyond the farthest hundredth of that language's labelled texts
of about its size (short texts are far from everything).  Sizes go by powers of 2; where
fewer than MIN_ROWS texts of a language are of about a size, those of all languages
count.  Sizes without so many texts take the floor of the next smaller one that has
them; below the smallest the floor halves with the size.  A shorter text's floor is
never the higher one.

Defined results: null, empty and letterless texts are rejected with similarity 0;
repeated rows are judged alike; ties between centroids go to the alphabetically
first language; with no labelled text at all every text is rejected; an empty table gives an empty
result; extra columns pass through, and the added column's name is the caller's choice.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparklex.llm.text import buffers, chunks

DIMS = 4096
SIZES = 40  # classes of n-gram counts, by powers of 2
MIN_ROWS = 50
_SHIFT = np.uint32(32 - 12)
_MUL = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)]
_LETTER = np.full(256, 32, np.uint8)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


def term_counts(texts: pa.Array):
    """Yields (first row, counts of hashed n-grams as a rows x DIMS matrix)."""
    data, offsets = buffers(pc.utf8_lower(texts))
    for lo, hi in chunks(offsets, rows=256):
        own = _LETTER[data[offsets[lo] : offsets[hi]]]
        row = np.repeat(np.arange(hi - lo), np.diff(offsets[lo : hi + 1]))
        blank = own == 32
        code = own.astype(np.uint32) * _MUL[0]
        flat = []
        for n in (2, 3, 4):
            if len(own) < n:
                break
            code = code[: len(own) - n + 1] + own[n - 1 :].astype(np.uint32) * _MUL[n - 1]
            pair = blank[:-1] & blank[1:]
            bad = pair.copy()[: len(code)]
            for j in range(1, n - 1):
                bad |= pair[j : j + len(code)]
            good = ~bad & (row[: len(code)] == row[n - 1 :])
            mixed = (code + np.uint32(n)) * np.uint32(0x2C1B3C6D)
            flat.append(row[: len(code)][good] * DIMS + (mixed[good] >> _SHIFT))
        flat = np.concatenate(flat) if flat else np.zeros(0, np.int64)
        yield lo, np.bincount(flat, minlength=(hi - lo) * DIMS).reshape(hi - lo, DIMS)


@dataclass
class LanguageModel:
    labels: list[str]  # language of each centroid, sorted
    centroids: np.ndarray  # centroids x DIMS, unit rows
    idf: np.ndarray
    floors: np.ndarray  # centroids x SIZES, least similarity accepted

    @classmethod
    def fit(cls, texts: list[str], labels: list[str], clusters: int = 4, quantile: float = 0.01, margin: float = 0.85, rounds: int = 15) -> LanguageModel:
        counts = np.zeros((0, DIMS), np.float32)
        if texts:
            counts = np.concatenate([m.astype(np.float32) for _, m in term_counts(pa.array(texts, pa.string()))])
        sizes = counts.sum(1)
        used = sizes > 0
        counts, sizes, labels = counts[used], sizes[used], np.asarray(labels, object)[used]
        df = (counts > 0).sum(0)
        idf = (np.log((1 + len(counts)) / (1 + df)) + 1).astype(np.float32)
        vectors = _unit(np.log1p(counts) * idf)
        names, rows = [], []
        for language in sorted(set(labels)):
            for c in _spherical_kmeans(vectors[labels == language], clusters, rounds):
                names.append(language)
                rows.append(c)
        centroids = np.array(rows, np.float32).reshape(-1, DIMS)
        own = np.array([[name == x for name in names] for x in labels], bool).reshape(len(labels), len(names))
        near = np.where(own, vectors @ centroids.T, -1).max(1) if names else np.zeros(0)
        by_name = {x: _floors(near, _size_class(sizes), labels == x, quantile, margin) for x in set(names)}
        return cls(names, centroids, idf, np.array([by_name[x] for x in names]).reshape(-1, SIZES))

    def predict(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the nearest centroid, cosine, accepted) of each text."""
        n = len(texts)
        best, cosine, kept = np.zeros(n, np.int64), np.zeros(n), np.zeros(n, bool)
        if not self.labels:
            return best, cosine, kept
        for lo, counts in term_counts(texts):
            hi = lo + len(counts)
            sizes = counts.sum(1)
            weights = np.log1p(counts.astype(np.float32)) * self.idf
            norm = np.maximum(np.sqrt(np.einsum("ij,ij->i", weights, weights)), 1e-12)
            near = (weights @ self.centroids.T) / norm[:, None]
            best[lo:hi] = near.argmax(1)
            cosine[lo:hi] = near.max(1)
            kept[lo:hi] = (sizes > 0) & (near.max(1) >= self.floors[best[lo:hi], _size_class(sizes)])
        cosine[~(cosine > 0)] = 0
        return best, cosine, kept

    def column(self, text: str | Column) -> Column:
        """struct<lang string, similarity double, accepted boolean> of a text column."""
        model, names = self, pa.array(self.labels or [""], pa.string())

        @F.arrow_udf("struct<lang:string,similarity:double,accepted:boolean>")
        def identify(texts: pa.Array) -> pa.Array:
            best, cosine, kept = model.predict(texts)
            lang = names.take(pa.array(best, mask=~kept))
            return pa.StructArray.from_arrays([lang, pa.array(cosine.round(6)), pa.array(kept)], ["lang", "similarity", "accepted"])

        # Two uses of the result must not run the model twice.
        return identify.asNondeterministic()(text)


def _size_class(sizes: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(sizes, 1)).astype(np.int64), SIZES - 1)


def _floors(near: np.ndarray, size: np.ndarray, own: np.ndarray, quantile: float, margin: float) -> np.ndarray:
    """Floor of each size class for one language, from texts of the class and those next to it."""
    out = np.full(SIZES, np.nan)
    for c in range(SIZES):
        close = np.abs(size - c) <= 1
        rows = near[close & own] if (close & own).sum() >= MIN_ROWS else near[close]
        if len(rows) >= MIN_ROWS:
            out[c] = margin * np.quantile(rows, quantile, method="lower")
    known = np.flatnonzero(~np.isnan(out))
    if len(known):
        at = np.searchsorted(known, np.arange(SIZES), "right") - 1
        out = out[known[np.maximum(at, 0)]] / 2.0 ** np.maximum(known[0] - np.arange(SIZES), 0)
        return np.minimum.accumulate(out[::-1])[::-1]
    return np.full(SIZES, near.min(initial=0.0) / 2)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _spherical_kmeans(x: np.ndarray, k: int, rounds: int) -> np.ndarray:
    k = min(k, len(x))
    centres = _unit(x.mean(0, keepdims=True))
    while len(centres) < k:  # farthest point next: no randomness
        centres = np.concatenate([centres, x[[(x @ centres.T).max(1).argmin()]]])
    for _ in range(rounds):
        near = (x @ centres.T).argmax(1)
        centres = _unit(np.array([x[near == j].mean(0) if (near == j).any() else centres[j] for j in range(k)]))
    return centres


def fit_on(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_language: int = 400, clusters: int = 4) -> LanguageModel:
    """Fits on a bounded sample: about ``per_language`` labelled rows of each language.

    Rows are chosen by a hash of their key and text, so the sample is the same in every run.
    The label counts cover all rows.  Only the sample reaches the driver.
    """
    labelled = docs.select(F.col(text).alias("t"), F.col(lang).alias("l"), F.xxhash64(F.col(key), F.col(text)).alias("h")).where("t is not null and l is not null")
    counts = {r["l"]: r["n"] for r in labelled.groupBy("l").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return LanguageModel.fit([], [])
    share = F.create_map(*[F.lit(x) for l, n in counts.items() for x in (l, min(1.0, per_language / n))])
    sample = labelled.where(F.pmod("h", F.lit(1_000_003)) < share[F.col("l")] * 1_000_003).orderBy("h", "l", "t").limit(2 * per_language * len(counts)).toPandas().sort_values(["l", "h", "t"])
    return LanguageModel.fit(list(sample["t"]), list(sample["l"]), clusters)


def identify_languages(docs: DataFrame, text: str = "text", output: str = "language", model: LanguageModel | None = None, **fit) -> DataFrame:
    """docs with one more column ``output``: struct(lang, similarity, accepted).

    A column of that name in docs is replaced.
    """
    model = model or fit_on(docs, text, **fit)
    return docs.withColumn(output, model.column(F.col(text)))
