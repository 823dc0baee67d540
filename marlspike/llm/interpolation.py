"""LM scoring by deleted interpolation: word n-grams of order 2 and 1 and a uniform floor, mixed by
weights that depend on how often the context was seen.

The texts are tokenised once into chunks of packed token streams, a table in the shared folder. Each
chunk asks for the global training counts of its own words and pairs, by 64-bit hash, in sorted packed
blocks; one group for each range of hashes adds them up and answers in the same order. A chunk sends FAN
blocks at most: where more ranges are needed, chunks are added up in groups, range by range, and the sums ask
in finer ranges, so blocks grow in proportion to the corpus and a group is never larger than a chunk or
two. Nothing that grows with the vocabulary is broadcast, and a word or pair counts once for each chunk
that holds it, however common it is. Mixture weights come from expectation-maximisation on held-out counts: each
training document in turn is taken out of the counts that predict it; what the driver gets for that is
a histogram over (context bucket, quantised pair and word probability), bounded by its grid.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_BYTES, U64, discard, lut, mix64, pack, pack_sorted, run_hashes, runs, sliced, table, text_bytes, unpack, unpack_sorted, word_values, written

#: The end of a text as a token, and the context before its first word.
END, START = U64(0x51ED270B0C4F3A91), U64(0x2545F4914F6CDD1D)
#: Tokens in a chunk (a text is never split), tokens for each range of hashes, ranges that a chunk or sum of chunks asks in at most.
CHUNK, RANGE, FAN = 1_000_000, 2_000_000, 8192
#: Steps of the histogram for each power of two; context buckets: 0 for none, else 1 + floor(log2(count)).
STEPS, BUCKETS, NONE = 8, 50, 1 << 20

CHUNKS = "chunk long, doc_ids array<long>, held array<boolean>, sizes array<int>, n_tokens long, n_train long, n_train_docs long, words binary, stream binary"
ASKED = pa.schema([("kind", pa.int32()), ("prefix", pa.int64()), ("who", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
ANSWERED = pa.schema([("who", pa.int64()), ("kind", pa.int32()), ("prefix", pa.int64()), ("counts", pa.binary()), ("n_distinct", pa.int64()), ("n_total", pa.int64())])
ASKED_SQL, ANSWERED_SQL = "kind int, prefix long, who long, keys binary, counts binary", "who long, kind int, prefix long, counts binary, n_distinct long, n_total long"


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of a column (words [^\\x20\\x09-\\x0D]+ with A-Z lower-cased, then one end for each row), tokens of each row."""
    data, offsets = text_bytes(column)
    starts, ends, rows = runs(~lut(SPACE_BYTES)[data], offsets)
    sizes = np.bincount(rows, minlength=len(offsets) - 1) + 1
    last = np.cumsum(sizes) - 1
    out = np.empty(int(sizes.sum()), dtype=U64)
    word = np.ones(len(out), dtype=bool)
    word[last] = False
    out[word] = run_hashes(data, starts, ends, *word_values(lower=True))
    out[last] = END
    return out, sizes.astype(np.int32)


def chunked(batches):
    first, seq, held_over = TaskContext.get().partitionId() << 32, 0, []

    def made():
        keys = np.concatenate([x[0] for x in held_over])
        sizes = np.concatenate([x[1] for x in held_over])
        held = np.concatenate([x[2] for x in held_over])
        words, ids, n = np.unique(keys, return_inverse=True, return_counts=True)
        order = np.argsort(-n, kind="stable")  # frequent words get small numbers, which pack well
        place = np.empty(len(words), np.int32)
        place[order] = np.arange(len(words), dtype=np.int32)
        train = int(sizes[~held].sum())
        row = [first + seq, [y for x in held_over for y in x[3]], held.tolist(), sizes.tolist(), len(keys), train, int((~held).sum()), pack(words[order]), pack(place[ids])]
        types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names=["chunk", "doc_ids", "held", "sizes", "n_tokens", "n_train", "n_train_docs", "words", "stream"])

    for batch in sliced(batches, "text"):
        keys, sizes = tokens(batch.column(1))
        held_over.append((keys, sizes, np.array(batch.column(2).to_pylist(), dtype=bool), batch.column(0).to_pylist()))
        if sum(len(x[0]) for x in held_over) >= CHUNK:
            yield made()
            seq, held_over = seq + 1, []
    if held_over:
        yield made()


class Chunk:
    """A chunk's tokens: ids (word of each), doc (row of each), train (whether its row is), pair (distinct pair of each), pairs (sorted keys)."""

    def __init__(self, row: dict):
        self.words, self.ids = unpack(row["words"], U64), unpack(row["stream"], np.int32)
        self.sizes, self.held = np.array(row["sizes"], np.int64), np.array(row["held"], bool)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.doc = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.train = ~self.held[self.doc]
        key = self.words[self.ids]
        before = np.empty_like(key)
        before[1:] = key[:-1]
        before[self.first] = START
        with np.errstate(over="ignore"):
            self.pairs, self.pair = np.unique(mix64(before * U64(0x9E3779B97F4A7C15) + mix64(key)), return_inverse=True)
        #: the word before, -1 at the start of a text
        self.before = np.empty_like(self.ids)
        self.before[1:] = self.ids[:-1]
        self.before[self.first] = -1

    def asks(self):
        """(kind, sorted keys, training counts here): kind 0 for words, 1 for pairs."""
        order = np.argsort(self.words)
        yield 0, self.words[order], np.bincount(self.ids[self.train], minlength=len(self.words))[order]
        yield 1, self.pairs, np.bincount(self.pair[self.train], minlength=len(self.pairs))

    def learnt(self, answers: list[dict]) -> tuple[np.ndarray, np.ndarray]:
        """Global counts of words and of pairs, from the answers."""
        got = {k: np.concatenate([unpack(a["counts"], U64) for a in sorted(answers, key=lambda a: a["prefix"]) if a["kind"] == k] or [np.zeros(0, U64)]).astype(np.int64) for k in (0, 1)}
        words = np.empty(len(self.words), np.int64)
        words[np.argsort(self.words)] = got[0]
        return words, got[1]


def _within(values: np.ndarray, doc: np.ndarray, n_values: int) -> np.ndarray:
    """For each token, how often its value occurs in its own text."""
    _, at, n = np.unique(doc.astype(np.int64) * n_values + values, return_inverse=True, return_counts=True)
    return n[at]


def context_bucket(count: np.ndarray) -> np.ndarray:
    return np.minimum(np.where(count > 0, 1 + np.floor(np.log2(np.maximum(count, 1))), 0).astype(np.int64), BUCKETS - 1)


def questions(kind: int, who: int, keys: np.ndarray, counts: np.ndarray, ranges: int) -> list[dict]:
    """Sorted keys and their counts as one block for each range of hashes."""
    prefix = ((keys >> U64(32)) * U64(ranges)) >> U64(32)
    at = np.flatnonzero(np.append(True, prefix[1:] != prefix[:-1])) if len(keys) else np.zeros(0, np.int64)
    return [{"kind": kind, "prefix": int(prefix[x]), "who": who, "keys": pack_sorted(keys[x:y]), "counts": pack(counts[x:y].astype(U64))} for x, y in zip(at, np.append(at[1:], len(keys)))]


def asking(ranges: int):
    def f(batches):
        for batch in batches:
            for row in batch.to_pylist():
                out = [q for kind, keys, counts in Chunk(row).asks() for q in questions(kind, row["chunk"], keys, counts, ranges)]
                yield pa.RecordBatch.from_pylist(out, schema=ASKED)

    return f


def summed(rows: list[dict]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Of blocks: the keys of each, all distinct keys, where each block's keys stand among them, and their summed counts."""
    keys = [unpack_sorted(r["keys"]) for r in rows]
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.zeros(len(distinct), U64)
    np.add.at(total, at, np.concatenate([unpack(r["counts"], U64) for r in rows]))
    return keys, distinct, at, total


def merging(ranges: int):
    """The blocks of a range of several askers as blocks of their parent, in finer ranges."""

    def f(asked: pa.Table) -> pa.Table:
        rows = asked.to_pylist()
        _, distinct, _, total = summed(rows)
        return pa.Table.from_pylist(questions(rows[0]["kind"], rows[0]["parent"], distinct, total, ranges), schema=ASKED)

    return f


def answers_to(rows: list[dict], keys: list[np.ndarray], at: np.ndarray, total: np.ndarray) -> list[dict]:
    cuts = np.cumsum([0, *map(len, keys)])
    return [{"who": r["who"], "kind": r["kind"], "prefix": r["prefix"], "counts": pack(total[at[a:b]]), "n_distinct": 0, "n_total": 0} for r, a, b in zip(rows, cuts, cuts[1:])]


def answering(asked: pa.Table) -> pa.Table:
    rows = asked.to_pylist()
    keys, _, at, total = summed(rows)
    out = answers_to(rows, keys, at, total)
    out[0] |= {"n_distinct": int((total > 0).sum()), "n_total": int(total.sum())}
    return pa.Table.from_pylist(out, schema=ANSWERED)


def passing_on(asked: pa.Table, answered: pa.Table) -> pa.Table:
    """The answers that a parent got, to those whose blocks it added up."""
    rows = asked.to_pylist()
    if not rows:
        return ANSWERED.empty_table()
    keys, _, at, _ = summed(rows)
    total = np.concatenate([unpack(r["counts"], U64) for r in sorted(answered.to_pylist(), key=lambda r: r["prefix"])])
    return pa.Table.from_pylist(answers_to(rows, keys, at, total), schema=ANSWERED)


def counted(chunks: DataFrame, n_chunks: int, n_tokens: int) -> tuple[DataFrame, int]:
    """(who, kind, prefix, counts): each chunk's answers; and the number of distinct words in training."""
    ranges, levels = max(1, -(-n_tokens // RANGE)), 1
    while FAN**levels < ranges:
        levels += 1
    fan = 1
    while fan**levels < ranges:
        fan += 1

    def parents(level: int) -> Column:
        return F.pmod(F.xxhash64("who"), F.lit(-(-n_chunks // fan**level))).alias("parent")

    asked = [chunks.mapInArrow(asking(fan), ASKED_SQL)]
    for level in range(1, levels):
        asked[-1] = written(asked[-1], "lm-asked")
        asked.append(asked[-1].select("*", parents(level)).groupBy("kind", "prefix", "parent").applyInArrow(merging(fan ** (level + 1)), ASKED_SQL))
    answers = written(asked.pop().groupBy("kind", "prefix").applyInArrow(answering, ANSWERED_SQL), "lm-counts")
    n_words = answers.where("kind = 0").agg(F.sum("n_distinct")).first()[0] or 0
    while asked:
        below, at = asked.pop(), parents(len(asked) + 1)
        up = answers.select("*", F.floor(F.col("prefix") / fan).cast("long").alias("above"))
        passed = below.select("*", at).groupBy("kind", "prefix", "parent").cogroup(up.groupBy("kind", "above", "who")).applyInArrow(passing_on, ANSWERED_SQL)
        passed = written(passed, "lm-counts")
        discard(answers, below)
        answers = passed
    return answers, n_words


def held_out_histogram(n_train: int, n_docs: int):
    """For training tokens, with the counts of their own text taken out: context bucket, quantised log2 of the pair's and the word's probability (NONE: zero), tokens."""

    def quantised(p: np.ndarray) -> np.ndarray:
        return np.where(p > 0, np.rint(STEPS * np.log2(np.maximum(p, 1e-300))), NONE).astype(np.int64)

    def f(left: pa.Table, right: pa.Table) -> pa.Table:
        bins: dict = {}
        for row in left.to_pylist():
            c = Chunk(row)
            word, pair = c.learnt(right.to_pylist())
            own = _within(c.ids, c.doc, len(c.words))
            # a word is a context as often as it occurs; the count of the one before, less those of the same text
            before, own_before = np.where(c.before >= 0, word[c.before], n_docs), np.empty_like(own)
            own_before[1:] = own[:-1]
            own_before[c.first] = 1
            n_h = (before - own_before)[c.train]
            n_hw = (pair[c.pair] - _within(c.pair, c.doc, len(c.pairs)))[c.train]
            n_w, n = (word[c.ids] - own)[c.train], (n_train - c.sizes[c.doc])[c.train]
            keys, n = np.unique(np.stack([context_bucket(n_h), quantised(n_hw / np.maximum(n_h, 1)), quantised(n_w / np.maximum(n, 1))]), axis=1, return_counts=True)
            for k, v in zip(keys.T.tolist(), n.tolist()):
                bins[tuple(k)] = bins.get(tuple(k), 0) + v
        return pa.table({"b": pa.array([k[0] for k in bins], pa.int64()), "q2": pa.array([k[1] for k in bins], pa.int64()), "q1": pa.array([k[2] for k in bins], pa.int64()), "n": pa.array(list(bins.values()), pa.int64())})

    return f


def weights_by_em(bins: np.ndarray, floor: float, rounds: int = 60) -> np.ndarray:
    """Mixture weights (pair, word, uniform) of each context bucket from rows (bucket, q2, q1, n) of held-out counts.
    One pseudo-count holds sparse buckets near even weights; a context never seen has no pair weight."""
    b = bins[:, 0]
    p = np.stack([np.where(q == NONE, 0.0, np.exp2(np.where(q == NONE, 0, q) / STEPS)) for q in (bins[:, 1], bins[:, 2])] + [np.full(len(bins), floor)], axis=1)
    weights = np.full((BUCKETS, 3), 1 / 3)
    weights[0] = (0, 0.5, 0.5)
    prior = weights.copy()
    for _ in range(rounds):
        mass = weights[b] * p
        mass *= (bins[:, 3] / mass.sum(axis=1))[:, None]
        got = prior + np.stack([np.bincount(b, mass[:, k], BUCKETS) for k in range(3)], axis=1)
        weights = got / got.sum(axis=1, keepdims=True)
    return weights


SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def scoring(weights: np.ndarray, n_train: int, n_docs: int, n_words: int):
    def f(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = []
        for row in left.to_pylist():
            c = Chunk(row)
            word, pair = c.learnt(right.to_pylist())
            n_w, n_h = word[c.ids], np.where(c.before >= 0, word[c.before], n_docs)
            w = weights[context_bucket(n_h)]
            p = w[:, 0] * pair[c.pair] / np.maximum(n_h, 1) + w[:, 1] * n_w / max(n_train, 1) + w[:, 2] / (n_words + 1)
            base = np.log10((n_w + 0.5) / (n_train + 0.5 * (n_words + 1)))
            sums = [np.add.reduceat(x, c.first) for x in ((n_w > 0).astype(np.int64), base, np.log10(p))]
            parts.append(pa.table([pa.array(row["doc_ids"], pa.int64()), pa.array(row["held"], pa.bool_()), pa.array(c.sizes), pa.array(sums[0]), pa.array(np.full(len(c.sizes), n_train)), pa.array(sums[1]), pa.array(sums[2])], schema=SCORED))
        return pa.concat_tables(parts) if parts else SCORED.empty_table()

    return f


def scores(docs: DataFrame, held_out: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (the model's log10 probability) of every row.

    Learns from rows where held_out is not true. A null text is empty, one end token. Rows are taken one
    by one: repeated rows count again and come back again. Other columns are not looked at.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.coalesce(held_out, F.lit(False)).alias("held"))
    chunks = written(rows.mapInArrow(chunked, CHUNKS), "lm-chunks")
    n = chunks.agg(F.sum("n_tokens"), F.sum("n_train"), F.sum("n_train_docs"), F.count("*")).first()
    n_tokens, n_train, n_docs, n_chunks = (x or 0 for x in n)
    answers, n_words = counted(chunks, n_chunks, n_tokens)
    both = chunks.groupBy("chunk").cogroup(answers.groupBy("who"))
    bins = both.applyInArrow(held_out_histogram(n_train, n_docs), "b long, q2 long, q1 long, n long").groupBy("b", "q2", "q1").agg(F.sum("n").alias("n")).toArrow()
    weights = weights_by_em(np.stack([bins[c].to_numpy() for c in ("b", "q2", "q1", "n")], axis=1).astype(np.int64).reshape(-1, 4), 1 / (n_words + 1))
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return both.applyInArrow(scoring(weights, n_train, n_docs, n_words), schema)


def op2_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(5)) == 1
    return scores(table(spark, sf_dir, "documents"), held)
