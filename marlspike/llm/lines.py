"""Line dedup: range-partitioned line hashes, sorted by document and position within a hash.

Every line of at least min_chars code points (its key: stripped, A-Z lower-cased) becomes a row of its
128-bit hash, document and position. The rows are dealt by ranges of (hash, document), so the lines of
a very common key spread over several partitions; within a partition, equal hashes stand together with
the largest document first, and a scan streams first occurrences from the rest. What only the
neighbours know, the documents and the largest one of a hash that crosses a border, is two rows for
each partition. The result is a compressed bitmap of kept lines for each document that loses any.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import row_of, shared_dir, sliced, table

MIN_CHARS, MIN_DOCS = 40, 5
STRIP = b" \t\n\x0b\x0c\r"
#: Stands for a null document id: below all others.
NULL_ID = -(1 << 63)

LINES = "h1 long, h2 long, doc long, text_key long, n_lines int, at int"


def line_hashes(min_chars: int):
    import xxhash

    def f(batches):
        schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc", pa.int64()), ("text_key", pa.int64()), ("n_lines", pa.int32()), ("at", pa.int32())])
        for batch in sliced(batches, "text"):
            cols: list[list] = [[], [], [], [], [], []]
            for doc, text, key in zip(*(batch.column(i).to_pylist() for i in range(3))):
                lines = (text or "").encode().split(b"\n")
                for at, line in enumerate(lines):
                    if len(line) >= min_chars:
                        line = line.strip(STRIP).lower()
                        if len(line) >= min_chars and len(line.decode()) >= min_chars:
                            h = xxhash.xxh3_128_digest(line)
                            for c, v in zip(cols, (int.from_bytes(h[:8], "big", signed=True), int.from_bytes(h[8:], "big", signed=True), NULL_ID if doc is None else doc, key, len(lines), at)):
                                c.append(v)
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, x.type) for c, x in zip(cols, schema)], schema=schema)

    return f


def _groups(batch: pa.RecordBatch):
    """Columns as arrays, and the starts of runs of equal hashes."""
    h1, h2, doc = (batch.column(i).to_numpy() for i in range(3))
    new = np.ones(len(h1), bool)
    new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
    return h1, h2, doc, np.flatnonzero(new)


def borders(batches):
    """(partition, place, h1, h2, documents, largest document) of a partition's first hash (place 0) and last (place 1)."""
    first = last = None  # [h1, h2, documents, largest, document before]
    for batch in batches:
        if not batch.num_rows:
            continue
        h1, h2, doc, starts = _groups(batch)
        for a, b in zip(starts, [*starts[1:], len(h1)]) if first is None or len(starts) < 3 else [(starts[0], starts[1]), (starts[-1], len(h1))]:
            n = 1 + int(np.count_nonzero(np.diff(doc[a:b])))
            if last is not None and (last[0], last[1]) == (h1[a], h2[a]):
                last[2] += n - int(last[4] == doc[a])
            else:
                if last is not None and first is None:
                    first = list(last)
                last = [int(h1[a]), int(h2[a]), n, int(doc[a]), None]
            last[4] = int(doc[b - 1])
    rows = [(i, x) for i, x in ((0, first or last), (1, last)) if x is not None]
    pid = TaskContext.get().partitionId()
    yield pa.RecordBatch.from_arrays([pa.array([pid] * len(rows), pa.int32()), pa.array([i for i, _ in rows], pa.int32()), *(pa.array([x[k] for _, x in rows], pa.int64()) for k in range(4))], names=["pid", "place", "h1", "h2", "docs", "largest"])


def crossing(rows) -> dict[tuple[int, int], tuple[int, int]]:
    """Documents and largest document of each hash that stands at a border, over all partitions. A document never stands in two partitions for one hash."""
    seen, out = set(), {}
    for r in sorted(rows, key=lambda r: (r.pid, r.place)):
        if (r.pid, r.h1, r.h2) not in seen:  # a partition of one hash has it at both places
            seen.add((r.pid, r.h1, r.h2))
            n, m = out.get((r.h1, r.h2), (0, NULL_ID))
            out[r.h1, r.h2] = (n + r.docs, max(m, r.largest))
    return out


def repeated(at_border: dict, min_docs: int):
    """Rows of lines to drop: (doc, text_key, n_lines, at)."""

    def f(batches):
        names, schema = ("doc", "text_key", "n_lines", "at"), pa.schema([("doc", pa.int64()), ("text_key", pa.int64()), ("n_lines", pa.int32()), ("at", pa.int32())])
        open_: list[pa.RecordBatch] = []  # the last hash's rows so far, while its documents are too few to decide
        state = None  # [h1, h2, documents, largest, document before]

        def taken(part: pa.RecordBatch, largest: int) -> pa.RecordBatch:
            part = part.select(names)
            return part.filter(pa.array(part.column(0).to_numpy() != largest))

        for batch in batches:
            if not batch.num_rows:
                continue
            h1, h2, doc, starts = _groups(batch)
            ends = np.append(starts[1:], len(h1))
            change = np.concatenate([[0], np.cumsum(doc[1:] != doc[:-1])])
            docs = change[ends - 1] - change[starts] + 1  # documents of each run
            drop = np.zeros(len(h1), bool)
            # runs that may be decided only with what stands outside this batch: the first and the last
            inner = np.flatnonzero(docs >= min_docs)
            inner = inner[(inner > 0) & (inner < len(starts) - 1)]
            for i in inner:
                drop[starts[i] : ends[i]] = doc[starts[i] : ends[i]] != doc[starts[i]]
            out = []
            for i in sorted({0, len(starts) - 1}):
                a, b, key = starts[i], ends[i], (int(h1[starts[i]]), int(h2[starts[i]]))
                if state is None or (state[0], state[1]) != key:
                    state, open_ = [*key, 0, int(doc[a]), None], []
                n = int(docs[i]) - int(state[4] == doc[a])
                state[2], state[4] = state[2] + n, int(doc[b - 1])
                known, largest = at_border.get(key, (state[2], state[3]))
                if max(known, state[2]) >= min_docs:
                    out += [taken(x, largest) for x in open_]
                    open_ = []
                    drop[a:b] = doc[a:b] != largest
                else:
                    open_.append(batch.slice(a, b - a))
            out.append(batch.select(names).filter(pa.array(drop)))
            yield from (x.cast(schema) for x in out if x.num_rows)

    return f


def bitmaps(batches):
    """(doc, text_key, keep): keep is the deflated bits of the lines that stay, in order, from the lowest bit."""
    for batch in batches:
        keep = []
        for n, at in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            bits = np.ones(n, bool)
            bits[at] = False
            keep.append(zlib.compress(np.packbits(bits, bitorder="little").tobytes()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keep, pa.binary())], names=["doc", "text_key", "keep"])


def keep_bitmaps(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc, text_key, keep) for each document that loses lines.

    A key of at least min_chars code points that is found in at least min_docs documents loses all its
    lines but those in the largest document holding it. Documents are told apart by id: rows of one id
    count once; a null id (doc is NULL_ID) is below all others. text_key is xxhash64 of the text, which
    tells rows of one id apart. Null and empty texts have one empty line.
    """
    shared_dir(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).cast("string").alias("text"), F.xxhash64(F.col(text).cast("string")).alias("text_key"))
    by = (F.col("h1"), F.col("h2"), F.col("doc").desc())
    hashes = rows.mapInArrow(line_hashes(min_chars), LINES).repartitionByRange(*by).sortWithinPartitions(*by, F.col("at")).checkpoint()
    at_border = crossing(hashes.mapInArrow(borders, "pid int, place int, h1 long, h2 long, docs long, largest long").collect())
    dropped = hashes.mapInArrow(repeated(at_border, min_docs), "doc long, text_key long, n_lines int, at int")
    return dropped.groupBy("doc", "text_key").agg(F.first("n_lines").alias("n_lines"), F.collect_set("at").alias("at")).mapInArrow(bitmaps, "doc long, text_key long, keep binary")


def kept_lines(batches):
    """Adds kept_text and n_lines, n_dropped, from the last two columns text and keep."""
    for batch in sliced(batches, "_text"):
        out: list[list] = [[], [], []]
        k = batch.num_columns
        for text, keep in zip(batch.column(k - 2).to_pylist(), batch.column(k - 1).to_pylist()):
            lines = (text or "").split("\n")
            n = len(lines)
            if keep is not None:
                bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=n, bitorder="little")
                lines = [x for x, b in zip(lines, bits.tolist()) if b]
            for c, v in zip(out, ("\n".join(lines), n, n - len(lines))):
                c.append(v)
        yield pa.RecordBatch.from_arrays([*batch.columns[: k - 2], pa.array(out[0], pa.large_string()).cast(pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64())], names=[*batch.schema.names[: k - 2], "_kept_text", "_n_lines", "_n_dropped"])


def applied(docs: DataFrame, keep: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs as a struct _row, with _kept_text, _n_lines (before) and _n_dropped."""
    key = F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_ID))
    left = docs.select(row_of(docs, text), key.alias("doc"), F.xxhash64(F.col(text).cast("string")).alias("text_key"), F.col(text).cast("string").alias("_text"))
    both = left.join(keep, ["doc", "text_key"], "left").select("_row", "_text", "keep")
    return both.mapInArrow(kept_lines, both.select("_row").schema.add("_kept_text", "string").add("_n_lines", "long").add("_n_dropped", "long"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = applied(docs, keep_bitmaps(docs))
    return rows.select("_row.doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2(F.col("_kept_text"), 256).alias("kept_sha256"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the repeated lines taken out of text, n_chars to match; no row goes."""
    rows = applied(docs, keep_bitmaps(docs))
    new = {"text": F.col("_kept_text"), "n_chars": F.length("_kept_text").cast("long")}
    return rows.select(*[new.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT rid, doc_id, i, ls[i] AS line, translate(trim(ls[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
 FROM (SELECT rid, doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM d)),
f AS (SELECT k, max(doc_id) AS m FROM l WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
o AS (SELECT rid, any_value(l.doc_id) AS doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (f.k IS NOT NULL AND l.doc_id <> m)::BIGINT AS n_dropped,
 string_agg(line, chr(10) ORDER BY i) FILTER (f.k IS NULL OR l.doc_id = m) AS t FROM l LEFT JOIN f USING (k) GROUP BY rid)
SELECT doc_id, n_lines, n_dropped, sha256(coalesce(t, '')) AS kept_sha256 FROM o
"""
