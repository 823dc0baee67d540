"""Toxicity by multiple-instance learning: sentences are scored, documents are labelled.

A document is toxic when one of its sentences is: its score is the noisy-or of its sentences', 1 minus
the product of (1 - p). A sentence's p is logistic in its distinct hashed words. Weights are fitted to
document labels through the noisy-or, on a bounded sample of whole labelled documents, weighted to the
labels' shares among all that may be learnt from; every text is then
scored whole, and sentences() gives the spans that carry a document's score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, lut, pack, row_of, run_hashes, runs, sliced, table, text_bytes, unpack, word_values

#: Labelled documents of each label that the fit may use, always whole.
SAMPLE = 2000
BITS = 20
#: Words count whole and by their first bytes, so that forms of one stem share what is learnt.
PREFIXES = (4, 5, 6, 7, 8)
WORD_BYTES = bytes([*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)])
STOPS = b".!?\n"


def sentences_of(column: pa.Array):
    """Of a text column: word features, their sentence, the sentence's row, and each sentence's byte span in its row."""
    data, offsets = text_bytes(pc.utf8_lower(column))
    starts, ends, rows = runs(lut(WORD_BYTES)[data], offsets)
    tables = word_values(lower=False, seed=1234)
    longer = [np.flatnonzero(ends - starts > k) for k in PREFIXES]
    hashes = [run_hashes(data, starts, ends, *tables), *(run_hashes(data, starts[i], starts[i] + k, *tables) ^ U64(k << 40) for i, k in zip(longer, PREFIXES))]
    feature = (np.concatenate(hashes) >> U64(64 - BITS)).astype(np.int64)
    s0, s1, s_row = runs(~lut(STOPS)[data], offsets)
    sentence = np.searchsorted(s0, np.concatenate([starts, *(starts[i] for i in longer)]), side="right") - 1
    # a word counts once in a sentence
    if len(feature):
        key = np.unique(sentence * (1 << BITS) + feature)
        sentence, feature = key >> BITS, key & ((1 << BITS) - 1)
    return feature, sentence, s_row, np.stack([s0, s1], axis=1) - offsets[s_row][:, None]


def sentence_scores(feature: np.ndarray, sentence: np.ndarray, n: int, weights: np.ndarray) -> np.ndarray:
    """log(1 - p) of each sentence; weights[-1] is the bias."""
    z = np.bincount(sentence, weights[feature], n) + weights[-1]
    return -np.logaddexp(0, z)


def fit(documents: list[tuple[int, np.ndarray, np.ndarray]], rounds: int = 300, rate: float = 0.1, of: dict[int, int] | None = None) -> np.ndarray:
    """Weights from (label, features, sentence of each) documents by projected gradient steps (Adam) on the noisy-or likelihood.

    of: how many documents of each label the given ones stand for; without it, themselves.
    Weights are not negative, so that clean words never excuse a sentence,
    and words in a small share of the toxic documents are left out: too few to tell from chance. Without toxic documents every score is low.
    """
    out = np.zeros((1 << BITS) + 1)
    out[-1] = -6.0
    label = np.array([d[0] for d in documents], float)
    n, n_toxic = len(documents), int(label.sum())
    if not n_toxic:
        return out
    given = np.bincount(label.astype(int), minlength=2)
    stands = np.array([of.get(k, 0) if of else given[k] for k in (0, 1)]) / np.maximum(given, 1)
    part = stands[label.astype(int)] / stands[label.astype(int)].sum()  # of the likelihood
    least, price = max(0.004, 1.5 / n_toxic), 5e-5
    share = np.zeros(1 << BITS)
    for toxic, f, _ in documents:
        if toxic == 1:
            share[np.unique(f)] += 1 / n_toxic
    worth = share > least
    counts = np.array([int(d[2].max()) + 1 if len(d[2]) else 0 for d in documents])
    base, n_sentences = np.cumsum(counts) - counts, int(counts.sum())
    feature = np.concatenate([d[1][worth[d[1]]] for d in documents])
    sentence = np.concatenate([d[2][worth[d[1]]] + np.int32(b) for d, b in zip(documents, base)])
    owner = np.repeat(np.arange(n), counts)
    used, at = np.unique(feature, return_inverse=True)
    w = np.zeros(len(used) + 1)  # and the bias
    w[-1] = -6.0
    mean, square = np.zeros(len(w)), np.zeros(len(w))
    for step in range(1, rounds + 1):
        z = np.bincount(sentence, w[at], n_sentences) + w[-1]
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        clear = np.minimum(np.bincount(owner, -np.logaddexp(0, z), n), -1e-9)  # log of the probability that no sentence is toxic
        # d loss / d z: p for a clean document, -p * (1 - P) / P for a toxic one
        dz = p * (np.where(label == 1, -np.exp(clear) / -np.expm1(clear), 1.0) * part)[owner]
        g = np.append(np.bincount(at, dz[sentence], len(used)) + price, dz.sum())
        mean, square = 0.9 * mean + 0.1 * g, 0.99 * square + 0.01 * g * g
        w -= rate / (1 + step / 150) * mean / (1 - 0.9**step) / (np.sqrt(square / (1 - 0.99**step)) + 1e-4)
        w[:-1] = np.maximum(w[:-1], 0)
    out[used], out[-1] = w[:-1], w[-1]
    return out


FEATURES = "label int, feature binary, sentence binary"


def features(batches):
    """(label, feature, sentence), packed, of each row (text, label)."""
    for batch in sliced(batches, "text"):
        feature, sentence, s_row, _ = sentences_of(batch.column(0))
        row = s_row[sentence] if len(sentence) else sentence
        cuts = np.searchsorted(row, np.arange(batch.num_rows + 1))
        out: list[list] = [[], []]
        for a, b in zip(cuts, cuts[1:]):
            f, s = feature[a:b], sentence[a:b]
            out[0].append(pack(f.astype(np.int32)))
            out[1].append(pack(np.unique(s, return_inverse=True)[1].astype(np.int32)))
        yield pa.RecordBatch.from_arrays([batch.column(1), *(pa.array(x, pa.binary()) for x in out)], names=["label", "feature", "sentence"])


def train(docs: DataFrame, labels: DataFrame, learn: Column, text: str = "text") -> np.ndarray:
    """Weights from labelled documents (joined on doc_id) where learn holds: of each label, the SAMPLE of smallest hash of their id,
    each of them whole; of rows that repeat an id, one. Null ids and labels other than 0 and 1 teach nothing."""
    marked = labels.select("doc_id", F.col("toxic").cast("int").alias("label")).where("label IN (0, 1)")
    rows = docs.select("doc_id", F.col(text).cast("string").alias("text")).where(learn)
    chosen, of = None, {r[0]: r[1] for r in marked.where(learn).distinct().groupBy("label").count().collect()}
    for value in (0, 1):  # a top-k by hash: no task or driver sees more than SAMPLE rows of a label
        part = marked.where(F.col("label") == value).where(learn).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
        chosen = part if chosen is None else chosen.union(part)
    # SAMPLE rows of 12 bytes for each label: a proven bound
    found = rows.join(F.broadcast(chosen), "doc_id")
    # of rows that repeat an id, one
    found = found.groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("of"))
    got = found.select("of.text", "label").mapInArrow(features, FEATURES).toArrow()
    rows = sorted(got.to_pylist(), key=lambda r: (r["label"], r["feature"], r["sentence"]))
    return fit([(r["label"], unpack(r["feature"], np.int32), unpack(r["sentence"], np.int32)) for r in rows], of=of)


def scoring(weights):
    """weights: a broadcast of 2^BITS + 1 numbers."""

    def f(batches):
        w = weights.value
        for batch in sliced(batches, "text"):
            k = batch.num_columns - 1
            feature, sentence, s_row, _ = sentences_of(batch.column(k))
            clear = np.bincount(s_row, sentence_scores(feature, sentence, len(s_row), w), batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:k], pa.array(-np.expm1(clear))], names=[*batch.schema.names[:k], "score"])

    return f


def scored(docs: DataFrame, weights: np.ndarray, text: str = "text") -> DataFrame:
    """docs without the text, as a struct _row, and score. A null or empty text has no sentence and scores 0."""
    w = docs.sparkSession.sparkContext.broadcast(weights)
    rows = docs.select(row_of(docs, text), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(scoring(w), rows.select("_row").schema.add("score", "double"))


def sentences(docs: DataFrame, weights: np.ndarray, at_least: float = 0.3, text: str = "text") -> DataFrame:
    """(doc_id, sentence, score) for each sentence that scores at_least: where a document's score comes from."""
    w = docs.sparkSession.sparkContext.broadcast(weights)

    def f(batches):
        for batch in sliced(batches, "text"):
            feature, sentence, s_row, span = sentences_of(batch.column(1))
            p = -np.expm1(sentence_scores(feature, sentence, len(s_row), w.value))
            hit = np.flatnonzero(p >= at_least)
            ids, texts = batch.column(0).to_pylist(), pc.utf8_lower(batch.column(1)).to_pylist()
            out = [(ids[s_row[i]], texts[s_row[i]].encode()[span[i, 0] : span[i, 1]].decode(), float(p[i])) for i in hit]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.string()), pa.array([x[2] for x in out], pa.float64())], names=["doc_id", "sentence", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(f, "doc_id long, sentence string, score double")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    weights = train(docs, table(spark, sf_dir, "labels"), ~held)
    rows = scored(docs, weights).select(F.col("_row.doc_id").alias("doc_id"), "score")
    return rows.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))
