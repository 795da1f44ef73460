"""Language identification by nearest centroid (operator 6).

A text is the vector of its character n-grams (one to three letters, with word edges), hashed to ``BUCKETS`` places,
weighted by TF-IDF and normalised. Each language has a few centroids, found by spherical k-means; a text gets the language
of the centroid with the largest cosine, and is rejected when it is farther from that centroid than texts of its size are
in that language. A text of one word is far from every centroid, a page is near to one; so each language has a floor for
every size class (the distinct n-grams, by powers of two): a low quantile of the cosines that the texts of the sample and
their beginnings have, of which one odd text moves little.

Document frequencies are counted over all labelled rows. The centroids are fitted on a bounded sample: about
``SAMPLE_PER_LANGUAGE`` rows of each language, drawn row by row, so that no key or text is in or out as a whole.

Edge cases: a null text or one without letters is ``und`` with score 0 and rejected; so is every text when no labelled row
exists; a row with a null key isn't learned from and isn't held out; an empty table has no rows; very long texts are taken
whole; repeated rows give repeated rows, and are learned from as often; ties go to the smaller label, of its centroids to the
first; the columns that are added replace those of their names, other columns are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F, types as T

BUCKETS = 4096
SAMPLE_PER_LANGUAGE = 1500
CLUSTERS = 4
ROUNDS = 8
#: A text is rejected below this part of the low quantile of the cosines that texts of its size have in that language.
MARGIN, QUANTILE = 0.6, 0.01
#: Size classes, the cosines that a quantile is taken of at least, and the lengths of the beginnings that stand for short texts.
CLASSES, LEAST_COSINES = BUCKETS.bit_length() + 1, 100
BEGINNINGS = (1, 2, 4, 8, 16, 32, 64, 128, 256)
UNKNOWN = "und"
#: Texts whose vectors are dense at a time.
ROWS = 12

_SPACE = np.uint64(32)


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Which code points are letters."""
    found = np.zeros(0x110000, bool)
    for m in regex.finditer(r"\p{L}", "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))):
        found[ord(m[0])] = True
    return found


def tf_vectors(texts: list[str]) -> np.ndarray:
    """Counts of hashed n-grams, a row for each text."""
    lower = [f" {t.lower()} " for t in texts]
    size = np.array([len(t) for t in lower])
    c = np.frombuffer("".join(lower).encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.where(letters()[c], c, 32).astype(np.uint64)
    row = np.repeat(np.arange(len(texts)), size)
    shift = np.uint64(64 - (BUCKETS.bit_length() - 1))
    is_letter = c != _SPACE
    total = np.zeros(len(texts) * BUCKETS, np.int64)
    for n in (1, 2, 3):
        m = len(c) - n + 1
        if m <= 0:
            break
        gram = np.full(m, n, np.uint64)
        for j in range(n):
            gram = gram * np.uint64(0x110001) + c[j : j + m]
        keep = is_letter[:m] if n == 1 else is_letter[:m] | is_letter[1 : m + 1] if n == 2 else is_letter[1 : m + 1]
        bucket = ((gram[keep] * np.uint64(0x9E3779B97F4A7C15)) >> shift).astype(np.int64)
        total += np.bincount(row[:m][keep] * BUCKETS + bucket, minlength=len(total))
    return total.reshape(len(texts), BUCKETS)


def groups_of_rows(texts: list[str], rows: int = ROWS, chars: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of a batch that hold few rows and few characters."""
    at, held = 0, 0
    for i, t in enumerate(texts):
        if i > at and (i - at >= rows or held + len(t) > chars):
            yield at, i
            at, held = i, 0
        held += len(t)
    if at < len(texts):
        yield at, len(texts)


def weighted(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(tf.astype(np.float32)) * idf
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.where(norm > 0, norm, 1)


def size_class(tf: np.ndarray) -> np.ndarray:
    """The bit length of the number of distinct n-grams of each row."""
    return np.frexp((tf > 0).sum(1))[1]


@dataclass
class Centroids:
    languages: list[str]  # of each centroid
    vectors: np.ndarray
    floors: np.ndarray  # low quantile of the cosines of the language, by centroid and size class
    idf: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        label, score, out = [UNKNOWN] * len(texts), [0.0] * len(texts), [True] * len(texts)
        if not self.languages:
            return label, score, out
        known = [t or "" for t in texts]
        for a, b in groups_of_rows(known):
            tf = tf_vectors(known[a:b])
            cosine = weighted(tf, self.idf) @ self.vectors.T
            best, size = cosine.argmax(1), size_class(tf)
            for i in np.flatnonzero(tf.any(1)).tolist():
                k = best[i]
                label[a + i], score[a + i] = self.languages[k], float(min(1.0, max(0.0, cosine[i, k])))
                out[a + i] = bool(cosine[i, k] < MARGIN * self.floors[k, size[i]])
        return label, score, out


def k_means(x: np.ndarray, clusters: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Unit centroids, and each row's cluster; starts from the rows that are farthest from those chosen before."""
    centre = x.mean(0)
    chosen = [int((x @ centre).argmax())]
    nearest = x @ x[chosen[0]]
    while len(chosen) < min(clusters, len(x)):
        far = int(nearest.argmin())
        chosen.append(far)
        nearest = np.maximum(nearest, x @ x[far])
    c = x[chosen]
    for _ in range(rounds):
        own = (x @ c.T).argmax(1)
        for k in range(len(c)):
            if (own == k).any():
                mean = x[own == k].mean(0)
                c[k] = mean / max(float(np.sqrt((mean * mean).sum())), 1e-12)
    return c, (x @ c.T).argmax(1)


def fit(labelled: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", sample: int = SAMPLE_PER_LANGUAGE, clusters: int = CLUSTERS) -> Centroids:
    """Learn from all rows with a label (document frequencies) and from about ``sample`` of each language (centroids)."""
    rows = labelled.where(F.col(label).isNotNull() & F.col(key).isNotNull()).select(F.col(label).cast("string").alias("label"), F.col(text).alias("text"))
    sizes = {r[0]: r[1] for r in rows.groupBy("label").count().collect()}
    if not sizes:
        return Centroids([], np.zeros((0, BUCKETS), np.float32), np.zeros((0, CLASSES)), np.ones(BUCKETS))

    def frequencies(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(BUCKETS, np.int64), 0
        for b in it:
            texts = [t or "" for t in b.column(0).to_pylist()]
            n += len(texts)
            for x, y in groups_of_rows(texts):
                total += (tf_vectors(texts[x:y]) > 0).sum(0)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(range(-1, BUCKETS), pa.int32()), "n": pa.array([n, *total.tolist()], pa.int64())})

    counted = {r[0]: r[1] for r in rows.select("text").mapInArrow(frequencies, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n")).collect()}
    n = counted.pop(-1)
    idf = np.array([np.log((1 + n) / (1 + counted.get(i, 0))) + 1 for i in range(BUCKETS)], np.float32)
    chosen = rows.sampleBy("label", {k: min(1.0, sample / v) for k, v in sizes.items()}, 20)

    def vectors(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            texts = [t or "" for t in b.column(1).to_pylist()]
            for x, y in groups_of_rows(texts):
                tf = tf_vectors(texts[x:y])
                some = np.flatnonzero(tf.any(1))
                v = weighted(tf, idf)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(x, y - x).take(pa.array(some)), pa.array([v[i].tobytes() for i in some], pa.binary())], names=["label", "vector"])

    def centroids(group: pd.DataFrame) -> pd.DataFrame:
        x = np.stack([np.frombuffer(v, np.float32) for v in sorted(group["vector"])])
        c, own = k_means(x, clusters)
        return pd.DataFrame([{"label": group["label"].iloc[0], "cluster": k, "vector": c[k].tobytes()} for k in range(len(c)) if (own == k).any()])

    found = chosen.mapInArrow(vectors, "label string, vector binary").groupBy("label").applyInPandas(centroids, "label string, cluster int, vector binary").collect()
    found.sort(key=lambda r: (r["label"], r["cluster"]))
    of = {x: np.stack([np.frombuffer(r["vector"], np.float32) for r in found if r["label"] == x]) for x in {r["label"] for r in found}}

    def cosines(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows = [(x, t.strip()) for x, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if x in of and t]
            parts = [(x, p) for x, t in rows for p in (t, *(t[:m] for m in BEGINNINGS if m < len(t)))]
            for x, y in groups_of_rows([p for _, p in parts]):
                tf = tf_vectors([p for _, p in parts[x:y]])
                v = weighted(tf, idf)
                some, size = np.flatnonzero(tf.any(1)), size_class(tf)
                names = [parts[x + i][0] for i in some]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(size[some], pa.int32()), pa.array([float((of[name] @ v[i]).max()) for name, i in zip(names, some)], pa.float64())], names=["label", "size", "cosine"])

    def quantiles(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{"label": group["label"].iloc[0], "floors": floors_by_size(group["size"].to_numpy(), group["cosine"].to_numpy()).tolist()}])

    floors = {r["label"]: r["floors"] for r in chosen.mapInArrow(cosines, "label string, size int, cosine double").groupBy("label").applyInPandas(quantiles, "label string, floors array<double>").collect()}
    return Centroids([r["label"] for r in found], np.stack([np.frombuffer(r["vector"], np.float32) for r in found]) if found else np.zeros((0, BUCKETS), np.float32), np.array([floors[r["label"]] for r in found]).reshape(-1, CLASSES), idf)


def floors_by_size(size: np.ndarray, cosine: np.ndarray) -> np.ndarray:
    """The low quantile of every size class. A class with few cosines is taken together with those of smaller texts, whose
    cosines are lower; sizes below all that were seen have the floor of the smallest."""
    out = np.empty(CLASSES)
    for k in range(CLASSES):
        low = high = max(k, int(size.min()))
        while low > 0 and ((size >= low) & (size <= high)).sum() < LEAST_COSINES:
            low -= 1
        out[k] = np.quantile(cosine[(size >= low) & (size <= high)], QUANTILE)
    return out


def held_out(key: str = "doc_id") -> Column:
    """Rows that aren't learned from: those with CRC-32 of the key's text 1 more than a multiple of 3."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, model: Centroids, text: str = "text", prefix: str = "lang_") -> DataFrame:
    """``docs`` with the predicted language, the cosine, and whether it is rejected."""
    names = [f"{prefix}pred", f"{prefix}score", f"{prefix}rejected"]
    docs = docs.drop(*names)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            label, score, out = model.predict(b.column(b.schema.get_field_index(text)).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(label, pa.string()), pa.array(score, pa.float64()), pa.array(out, pa.bool_())], names=[*b.schema.names, *names])

    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, k()) for n, k in zip(names, (T.StringType, T.DoubleType, T.BooleanType)))])
    return docs.mapInArrow(batches, schema)
