"""Language identification: TF-IDF character n-grams against several centroids a language."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusframe.llm.common import documents, slices

DIMS = 4096
#: The classifier is fitted on about so many labelled rows in all, dealt evenly to the languages.
TRAINING_ROWS = 2000
CENTROIDS = 4
#: A document is rejected whose cosine is below this share of what its length leads to expect.
REJECT_SHARE = 0.3
UNKNOWN = "und"

_PIECE = 1 << 20
_LETTER = re.compile(r"[^\W\d_]")
_LOW = np.array([c if chr(c).isalpha() else 32 for c in range(0x250)], np.uint32)
_BITS = np.uint32(32 - DIMS.bit_length() + 1)
_M1, _M2, _M3 = (np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D))


def _letters(text: str) -> np.ndarray:
    """Code points of a piece of text; whatever is no letter is a space."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if int(c.max()) < len(_LOW):
        return _LOW[c]
    return np.where(c < len(_LOW), _LOW[np.minimum(c, len(_LOW) - 1)], np.where((c >= 0x2000) & (c < 0x2070) | (c >= 0x3000) & (c < 0x3040), np.uint32(32), c)).astype(np.uint32)


def gram_counts(text: str | None) -> np.ndarray:
    """Counts of 1- to 3-character grams of the whole text, hashed to DIMS places; whatever is no letter is a space, and spaces count as one.

    A text is taken in pieces, each with the two characters before it, so that it counts as if it were in one piece.
    """
    total = np.zeros(DIMS, np.int64)
    low = (text or "").lower()
    before = np.array([32], np.uint32)
    for at in range(0, len(low) + 1, _PIECE):
        piece = low[at : at + _PIECE] + ("" if at + _PIECE <= len(low) else " ")
        c = _letters(piece) if piece else np.zeros(0, np.uint32)
        blank = c == 32
        c = c[~(blank & np.concatenate((before[-1:] == 32, blank[:-1])))] if len(c) else c
        if not len(c):
            continue
        known, c = len(before), np.concatenate((before, c))
        one = c * _M1
        two = (one[:-1] ^ (one[:-1] >> np.uint32(15))) * _M2 + c[1:] * _M3
        three = (two[:-1] ^ (two[:-1] >> np.uint32(13))) * _M1 + c[2:] * _M2
        new = one[known:]
        for h in (new[c[known:] != 32], two[known - 1 :], three[max(0, known - 2) :]):
            total += np.bincount(((h ^ (h >> np.uint32(16))) * _M3) >> _BITS, minlength=DIMS)
        before = c[-2:]
    return total if len(low) else np.zeros(DIMS, np.int64)


def _packed(counts: np.ndarray) -> bytes:
    """The places that have any, then their counts."""
    at = np.flatnonzero(counts)
    return at.astype(np.uint16).tobytes() + counts[at].astype(np.uint32).tobytes()


def _unpacked(rows: list[bytes]) -> np.ndarray:
    out = np.zeros((len(rows), DIMS), np.float32)
    for r, b in zip(out, rows):
        n = len(b) // 6
        r[np.frombuffer(b, np.uint16, n)] = np.frombuffer(b, np.uint32, n, 2 * n)
    return out


@dataclass
class LanguageModel:
    """Unit centroids with their languages, the weights of the grams, and the expected cosine by gram count."""

    languages: list[str]
    centroids: np.ndarray
    idf: np.ndarray
    long_cosine: float
    short_loss: float

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, cosine of the nearest centroid, whether it is rejected as too far from all."""
        if not text or not _LETTER.search(text) or not self.languages:
            return UNKNOWN, 0.0, True
        counts = gram_counts(text)
        v = counts * self.idf
        cosines = self.centroids @ (v / np.sqrt(v @ v))
        best = int(np.argmax(cosines))
        score = float(min(1.0, max(0.0, cosines[best])))
        return self.languages[best], score, score < REJECT_SHARE * self.long_cosine / np.sqrt(1 + self.short_loss / counts.sum())


def _cluster(rows: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means from far-apart rows; unit centroids."""
    picked = [0]
    for _ in range(min(k, len(rows)) - 1):
        picked.append(int(np.argmin((rows @ rows[picked].T).max(axis=1))))
    centres = rows[picked]
    for _ in range(12):
        own = np.argmax(rows @ centres.T, axis=1)
        sums = np.array([rows[own == j].sum(axis=0) if (own == j).any() else centres[j] for j in range(len(centres))])
        centres = sums / np.linalg.norm(sums, axis=1, keepdims=True)
    return centres


def fit(docs: DataFrame, usable=None, max_rows: int = TRAINING_ROWS) -> LanguageModel:
    """Learns from text and lang of the docs that usable admits (all by default).

    The sample is bounded: about max_rows rows in all, the same number for each language as far as it has
    them, chosen by a hash of doc_id. Rows with a null doc_id, lang or text, or no letter, teach nothing; without any
    row the model knows no language and rejects everything.
    """
    rows = docs.where("lang is not null and doc_id is not null and text is not null")
    rows = rows if usable is None else rows.where(usable)
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_rows).collect()
    shares = {r["lang"]: min(1.0, max_rows / len(counts) / r["count"]) for r in counts}
    if not shares:
        return LanguageModel([], np.zeros((0, DIMS)), np.ones(DIMS), 0.0, 0.0)
    table = F.create_map(*[F.lit(x) for pair in shares.items() for x in pair])
    unit = F.xxhash64(F.lit("language sample"), "doc_id").bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))
    sample = rows.where(unit < table[F.col("lang")]).select("lang", "text")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            kept = [(lang, _packed(gram_counts(t))) for lang, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if _LETTER.search(t)]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in kept], pa.string()), pa.array([x[1] for x in kept], pa.binary())], ["lang", "grams"])

    got = sorted((r["lang"], bytes(r["grams"])) for r in sample.mapInArrow(features, "lang string, grams binary").collect())
    if not got:
        return LanguageModel([], np.zeros((0, DIMS)), np.ones(DIMS), 0.0, 0.0)
    langs, rows_ = np.array([x[0] for x in got]), _unpacked([x[1] for x in got])
    del got
    grams, seen = rows_.sum(axis=1, dtype=np.float64), (rows_ > 0).sum(axis=0)
    idf = np.log((1 + len(rows_)) / (1 + seen)) + 1
    rows_ *= idf.astype(np.float32)
    rows_ /= np.linalg.norm(rows_, axis=1, keepdims=True)
    names, centres = [], []
    for lang in sorted(set(langs.tolist())):
        found = _cluster(rows_[langs == lang], CENTROIDS)
        names += [lang] * len(found)
        centres.append(found)
    centroids = np.vstack(centres).astype(np.float64)
    best = (rows_ @ centroids.T.astype(np.float32)).max(axis=1).astype(np.float64)
    long = grams >= np.median(grams)
    top = float(np.median(best[long]))
    loss = float(np.median(grams[~long] * np.maximum(0, (top / np.maximum(best[~long], 1e-6)) ** 2 - 1))) if (~long).any() else 0.0
    return LanguageModel(names, centroids, idf, top, loss)


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """docs (any columns, text among them) with lang_pred, score (0 to 1) and rejected.

    Text that is null, empty or without a letter is `und` with score 0, rejected. Ties go to the language first by
    name. The whole text counts, however long. Columns of docs with these names are replaced.
    """
    kept = docs.drop("lang_pred", "score", "rejected")
    at = kept.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = [shared.value.predict(t.as_py()) for t in b.column(at)]
            new = [pa.array([bool(f[i]) if i == 2 else f[i] for f in found], t) for i, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], [*b.schema.names, "lang_pred", "score", "rejected"])

    return kept.mapInArrow(predict, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), "lang_pred string, score double, rejected boolean"]))


def fold() -> Column:
    """0 to 3 by doc_id as text."""
    return F.crc32(F.col("doc_id").cast("string")) % 4


def keep_identified(docs: DataFrame) -> DataFrame:
    """docs without those that language identification rejects, in docs' own columns."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs))
    at = docs.columns.index("text")

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield b.filter(pa.array([not shared.value.predict(t.as_py())[2] for t in b.column(at)], pa.bool_()))

    return docs.mapInArrow(known, docs.schema)


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(docs.select("doc_id", "text", "lang"), fold() != 2)
    return identify(docs.select("doc_id", "text", F.coalesce(fold() == 2, F.lit(False)).alias("held_out")), model).drop("text")


QUERIES = {"op5_language_id": op5_language_id}
ORACLES: dict[str, str] = {}
