"""Near-duplicate detection with Order MinHash and banded alignment.

A text is its words: runs of letters, digits, _ and non-ASCII characters, lower-cased. Its k-mers of
five words carry their occurrence number. Each of TABLES sketches takes the WIDTH k-mers with the
smallest hashes and keeps them in text order, so that two texts share a sketch about as often as they
are close by edits. Texts of equal words are one text from the start. In a bucket of one sketch, few
members are paired with one another and many with four of them (smallest id, fewest words, most words,
smallest hash), so pairs grow with members, not with their square. Pairs are verified by a banded
alignment of words: similarity 1 - edits / longer length >= 0.8. Classes are connected components.

What the sketches leave apart is then searched exactly. An edit changes three of a text's three-word runs
at most, so of the rarest 3/5 of each text's runs and k more, similar texts have k in common (a prefix
filter; k is 1 for short texts and 3 for most; texts of few words meet by word pairs, rarest 2/5, as they
have too few longer runs), and no alignment of few edits moves one of them far. Texts of different classes
that do, close in length and at places that few edits reach, are aligned as well.

Where many texts are nearly similar to one another, these pairs would grow with the square of their number.
Texts that meet many others each, and meet, are drawn together to a crowd instead of being paired, by one
row a text. All texts of a crowd are compared in tiles, by blocks of texts of fitting lengths; a tile gives
the links only, and pairs that its links have connected are passed over.

Pairs are aligned by blocks of pivots: a text travels once for each block that it has pivots in, not once
for each pair.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import U64, discard, lut, mix64, pack, portions, random_u64, row_of, run_hashes, runs, sliced, table, text_bytes, unpack, word_values, written

WORDS, TABLES, WIDTH = 5, 40, 2
#: Buckets of this many texts or fewer are paired in full.
SMALL = 8
#: Pivots of one block of alignments, pairs that one group of a block takes, and words of unpacked pivots that it keeps.
PIVOTS, PAIRS, UNPACKED = 500, 4000, 300_000
#: Bits of a text's bitmap of distinct words.
BITS = 1 << 14
#: Texts of so many words or more meet others of so many by three-word runs.
LONG = 20
#: Counters for runs (of any order of runs the search is exact; with the common ones last it is fast): 2^CELL_BITS,
#: counted over all texts, sent in slices of 2^SLICE_BITS, kept as one byte each. A task sorts COUNTED of its runs at once.
CELL_BITS, SLICE_BITS, COUNTED = 23, 17, 3_000_000
#: Rare runs of one task of the exact search, those that a task holds before it sends them, and pairs of texts likewise.
BUCKET, HELD, MET = 1_000_000, 2_000_000, 500_000
#: Two texts that meet, and meet more than CROWD others each in a task, are of one crowd. Words of a block of a crowd's texts.
CROWD, TILE = 16, 250_000
WORD_BYTES = bytes([*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)])

RARE = "bucket int, gram binary, place binary, owner binary, doc binary, class binary, n binary"
SKETCH = "doc long, k1 long, k2 long, n int, sketch array<long>, words binary"


def kmers(words: np.ndarray, first: np.ndarray, sizes: np.ndarray, width: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Occurrence-labelled k-mers of width words of all rows, in order, and their number in each row (one for 1 to width words)."""
    h, row = plain_kmers(words, first, sizes, width)
    return labelled(h, row)[0], np.bincount(row, minlength=len(sizes))


def labelled(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes with the number of their occurrence in their row mixed in, and whether each is alone there."""
    with np.errstate(over="ignore"):
        key = h + mix64(np.arange(1, row[-1] + 2 if len(row) else 1, dtype=U64))[row]  # of a k-mer in its row
    order = np.argsort(key)
    new = np.ones(len(h), bool)
    new[1:] = key[order][1:] != key[order][:-1]
    at = np.flatnonzero(new)
    times = np.diff(np.append(at, len(h)))
    again = np.repeat(times > 1, times)
    if again.any():  # equal k-mers of a row in text order
        same = order[again]
        order[again] = same[np.lexsort((same, np.cumsum(new)[again]))]
    nth, alone = np.empty(len(h), U64), np.empty(len(h), bool)
    nth[order] = np.arange(len(h)) - np.repeat(at, times)
    alone[order] = np.repeat(times == 1, times)
    with np.errstate(over="ignore"):
        return mix64(h + nth * U64(0x9E3779B97F4A7C15)), alone


def plain_kmers(words: np.ndarray, first: np.ndarray, sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-mers of all rows, in order, and their rows."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(words)) - first[row]
    left = sizes[row] - place
    factors = random_u64(width, 99) | U64(1)
    h = np.zeros(len(words), U64)
    with np.errstate(over="ignore"):
        for j in range(width):
            part = np.zeros(len(words), U64)
            part[: max(len(words) - j, 0)] = words[j:]
            h += np.where(left > j, part * factors[j], U64(0))
        starts = (left >= width) | (place == 0)
        return mix64(h[starts]), row[starts]


def ordered(high: np.ndarray, low: np.ndarray, bits: int) -> np.ndarray:
    """The order by high, then low, of integers; by one key if both fit one."""
    if len(low) and int(low.max()) < 1 << bits and int(high.max()) < 1 << 64 - bits:
        return np.argsort(high.astype(U64) << U64(bits) | low.astype(U64))
    return np.lexsort((low, high))


def order_minhash(marks: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """A key for each table: its WIDTH smallest k-mers, in text order."""
    n, out = len(marks), np.empty(len(factors), U64)
    step = max(1, 1_000_000 // n)
    with np.errstate(over="ignore"):
        for a in range(0, len(factors), step):
            h = marks[None, :] * factors[a : a + step, None]
            rows, places = np.arange(len(h)), []
            for _ in range(min(WIDTH, n)):
                places.append(np.argmin(h, axis=1))
                h[rows, places[-1]] = U64(0xFFFFFFFFFFFFFFFF)
            key = np.arange(a, a + len(h), dtype=U64) * U64(0xC2B2AE3D27D4EB4F)
            for p in np.sort(np.stack(places), axis=0):
                key = mix64(key + marks[p])
            out[a : a + step] = key
    return out


def sketches(batches):
    factors = random_u64(TABLES, 4711) | U64(1)
    fold = random_u64(2, 31) | U64(1)
    for batch in sliced(batches, "text"):
        data, offsets = text_bytes(pc.utf8_lower(batch.column(1)))
        starts, ends, rows = runs(lut(WORD_BYTES)[data], offsets)
        words = run_hashes(data, starts, ends, *word_values(lower=False))
        sizes = np.bincount(rows, minlength=batch.num_rows)
        first = np.cumsum(sizes) - sizes
        marks, n_marks = kmers(words, first, sizes)
        mark_at = np.cumsum(n_marks) - n_marks
        # of the whole word sequence; for a text without words, of its bytes
        place = np.arange(len(words), dtype=U64) - np.repeat(first, sizes).astype(U64)
        key, out = np.zeros((2, batch.num_rows), U64), []
        some = sizes > 0
        with np.errstate(over="ignore"):
            if some.any():
                for i in range(2):
                    key[i, some] = mix64(np.add.reduceat(mix64(words + (place + U64(1)) * fold[i]), first[some]) + U64(i))
        small = (words >> U64(32)).astype(np.uint32)
        for r in range(batch.num_rows):
            if some[r]:
                sketch = order_minhash(marks[mark_at[r] : mark_at[r] + n_marks[r]], factors).view(np.int64)
            else:
                sketch, raw = [], data[offsets[r] : offsets[r + 1]]
                key[:, r] = (U64(len(raw)), run_hashes(raw, np.array([0]), np.array([len(raw)]), *word_values(lower=False, seed=71))[0] if len(raw) else U64(0))
            out.append((sketch, pack(small[first[r] : first[r] + sizes[r]])))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(key[0].view(np.int64)), pa.array(key[1].view(np.int64)), pa.array(sizes, pa.int32()), pa.array([x[0] for x in out], pa.list_(pa.int64())), pa.array([x[1] for x in out], pa.binary())],
            names=["doc", "k1", "k2", "n", "sketch", "words"],
        )


def edits_within(a: list, b: list, limit: int) -> int | None:
    """The edit distance of two sequences if it is limit or less, by an alignment in a band of limit on both sides of the diagonal."""
    if len(a) < len(b):
        a, b = b, a
    n, m = len(a), len(b)
    if n - m > limit:
        return None
    same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), m)
    tail = min(next((i for i, (x, y) in enumerate(zip(reversed(a), reversed(b))) if x != y), m), m - same)
    a, b = a[same : n - tail], b[same : m - tail]
    n, m = len(a), len(b)
    if not m:
        return n
    limit = min(limit, n)
    # Bit-parallel: bit r of a vector stands for the row j - limit + r of column j, so the band moves
    # down one row with each column. Rows above the first are as if they matched nothing and cost nothing.
    width = 2 * limit + 1
    full = (1 << width) - 1
    match: dict = {}
    for i, x in enumerate(a):
        match[x] = match.get(x, 0) | 1 << i + limit
    # up: the cost grows by one from the row above to this one; down: it falls by one
    up, down = full ^ ((1 << limit) - 1), 0
    diagonal, cost = 1 << limit, 0
    for j, x in enumerate(b):
        here = (match.get(x, 0) >> j) & full
        same = ((((here & up) + up) ^ up) | here | down) & full
        right, left = down | (full & ~(same | up)), same & up
        if not same & diagonal:
            cost += 1
            if cost > 2 * limit:
                return None
        shifted = same >> 1
        up, down = left | (full & ~(shifted | right)), shifted & right
        up, down = up & full, down & full
    # cost stands at row m of the last column; go on down to row n
    for r in range(limit + 1, limit + 1 + n - m):
        bit = 1 << r - 1
        cost += bool(up & bit) - bool(down & bit)
    return cost if cost <= limit else None


def similar(a: list, b: list) -> bool:
    """1 - edits / longer length >= 0.8."""
    return edits_within(a, b, max(len(a), len(b)) // 5) is not None


class Read:
    """A text's words, its distinct words, and a bitmap of their hashes."""

    def __init__(self, packed: bytes):
        words = unpack(packed, np.uint32)
        bits = np.zeros(BITS, bool)
        bits[words % BITS] = True
        self.words = words.tolist()
        self.distinct = set(self.words)
        self.bits = int.from_bytes(np.packbits(bits).tobytes())


def may_be_similar(a: Read, b: Read) -> bool:
    """False only if similar() is: an edit changes two distinct words at most; too few words of each may occur in the other."""
    n = max(len(a.words), len(b.words))
    least = n - n // 5
    if min(len(a.words), len(b.words)) < least or (a.bits ^ b.bits).bit_count() > 2 * (n // 5):
        return False
    return sum(map(b.distinct.__contains__, a.words)) >= least and sum(map(a.distinct.__contains__, b.words)) >= least


def aligned(batches):
    """From rows (block, part, doc, pivots, words) sorted so that a block's pivots (pivots null) stand before the texts to align with them:
    the pairs that are similar, without those that a group's earlier pairs connect."""
    held, base, ready, size, above = None, {}, {}, 0, {}

    def root(x: int) -> int:
        while (up := above.get(x, x)) != x:
            above[x] = x = above.get(up, up)
        return x

    def pivot_read(pivot: int, k: int) -> Read:
        nonlocal size
        if (pivot, k) not in ready:
            if size > UNPACKED:
                ready.clear()
                size = 0
            ready[pivot, k] = Read(base[pivot][k])
            size += len(ready[pivot, k].words)
        return ready[pivot, k]

    for batch in batches:
        out: list[tuple] = []
        for block, part, doc, pivots, words in zip(*(batch.column(i).to_pylist() for i in range(5))):
            if held != (block, part):
                held, base, size, above = (block, part), {}, 0, {}
                ready.clear()
            if pivots is None:
                base.setdefault(doc, []).append(words)
                continue
            mine = Read(words)
            for pivot in pivots:
                if root(doc) == root(pivot):
                    continue
                for k, packed in enumerate(base.get(pivot, ())):
                    if packed == words or may_be_similar(x := pivot_read(pivot, k), mine) and similar(x.words, mine.words):
                        out.append((doc, pivot))
                        above[root(doc)] = root(pivot)
                        break
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["a", "b"])


def read_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of packed words: the words of all rows, where each row begins, and how many it has."""
    each = [unpack(x, np.uint32) for x in column.to_pylist()]
    sizes = np.array([len(x) for x in each], np.int64)
    return np.concatenate(each).astype(U64) if len(each) else np.zeros(0, U64), np.cumsum(sizes) - sizes, sizes


def shingles(words: np.ndarray, sizes: np.ndarray):
    """(width, hashes, rows): the three-word runs of texts of LONG words or more, and the word pairs of those that may be similar to a shorter one."""
    for width, some in ((2, sizes < LONG * 5 // 4), (3, sizes >= LONG)):
        n = np.where(some, sizes, 0)
        yield width, *plain_kmers(words[np.repeat(some, sizes)], np.cumsum(n) - n, n, width)


def cells(plain: np.ndarray) -> np.ndarray:
    """The counter of each run."""
    return (plain >> U64(64 - CELL_BITS)).astype(np.int64)


def counting(batches):
    """(slice, counts): how many runs of this task's texts fall in each counter. Those that come once among COUNTED are
    left out: most do, and would only blur the counts of others."""
    count, held = np.zeros(1 << CELL_BITS, np.int32), []

    def add():
        plain = np.concatenate(held)
        held.clear()
        plain.sort()  # in place: nothing else of its size is held
        same = plain[1:] == plain[:-1]
        np.add.at(count, cells(plain[np.append(same, False) | np.append(False, same)]), 1)

    for batch in portions(batches):
        words, _, sizes = read_words(batch.column(0))
        held += [plain for _, plain, _ in shingles(words, sizes)]
        if sum(map(len, held)) > COUNTED:
            add()
    if held:
        add()
    for i, of in enumerate(count.reshape(-1, 1 << SLICE_BITS)):
        if of.any():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([pack(of)], pa.binary())], names=["slice", "counts"])


def summed(batches):
    """From (slice, counts) sorted by slice: for each slice one row of the sums' logarithms, a byte each."""
    held, total = None, np.zeros(0, np.int64)

    def row():
        steps = np.round(8 * np.log2(total + 1)).clip(0, 255).astype(np.uint8)
        return pa.RecordBatch.from_arrays([pa.array([held], pa.int32()), pa.array([pack(steps)], pa.binary())], names=["slice", "counts"])

    for batch in batches:
        for of, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if of != held:
                if held is not None:
                    yield row()
                held, total = of, np.zeros(1 << SLICE_BITS, np.int64)
            total += unpack(counts, np.int32)
    if held is not None:
        yield row()


def needed(n: np.ndarray) -> np.ndarray:
    """How many rare runs a text of n words has in common with a similar one; of two texts the smaller number holds."""
    return np.minimum(1 + n // 20, 3)


def prefix_sizes(n: np.ndarray, width: int) -> np.ndarray:
    """How many of a text's runs of width words, first in any fixed order, hold needed(n) of each similar text's: so many more than that text may lack.

    Texts of n and m >= n words have m - (width - 1) - width * (m // 5) runs in common at least; m = n to n + 4 has the largest gap.
    """
    return np.max([width * ((n + i) // 5) - i for i in range(5)], axis=0) + needed(n)


def rarest(common, n_buckets: int):
    """From rows (doc, class, words): the rarest runs of each text, as blocks for each bucket of runs. Texts under 4 words are similar to none."""

    def f(batches):
        count = common.value
        held: list[tuple] = []  # runs, their places, owners and buckets
        texts: list[tuple] = []  # of the owners: doc, class, words
        owners = waiting = 0

        def blocks():
            gram, place, owner, bucket = (np.concatenate(x) for x in zip(*held))
            doc, class_, n = (np.concatenate(x) for x in zip(*texts))
            held.clear(), texts.clear()
            order = np.argsort(bucket, kind="stable")  # rows of one text stay together
            at = np.flatnonzero(np.diff(bucket[order], prepend=-1))
            out = []
            for a, b in zip(at, np.append(at[1:], len(order))):
                i = order[a:b]
                of = owner[i]
                new = np.diff(of, prepend=-1) != 0
                own = of[new]
                out.append((int(bucket[i[0]]), pack(gram[i]), pack(place[i]), pack(new.astype(np.uint8)), pack(doc[own]), pack(class_[own]), pack(n[own])))
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), *(pa.array([x[k] for x in out], pa.binary()) for k in range(1, 7))], names=["bucket", "gram", "place", "owner", "doc", "class", "n"])

        for batch in portions(batches):
            words, _, sizes = read_words(batch.column(2))
            if not len(words):
                continue
            for width, plain, row in shingles(words, sizes):
                if not len(plain):
                    continue
                grams, alone = labelled(plain, row)
                start = np.searchsorted(row, np.arange(len(sizes)))
                place = np.arange(len(row)) - start[row]
                by, head = row << 8 | count[cells(plain)], grams >> U64(24)
                order = ordered(by, head, 40)  # rows stay where they are
                if ((np.diff(by[order]) == 0) & (np.diff(head[order]) == 0)).any():
                    order = np.lexsort((grams, by))
                grams, place = grams[order], np.where(alone, place, -1)[order].astype(np.int32)
                keep = (np.arange(len(row)) - start[row] < prefix_sizes(sizes, width)[row]) & (sizes[row] >= 4)
                # all occurrences of a run go to one bucket, so that texts which share many of them meet there only
                bucket = (plain[order][keep] % U64(n_buckets)).astype(np.int32)
                # 48 bits: runs that fall together are only aligned in vain
                held.append((grams[keep] & U64((1 << 48) - 1), place[keep], (row[keep] + owners).astype(np.int32), bucket))
                waiting += int(keep.sum())
            texts.append((*(batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1)), sizes.astype(np.int32)))
            owners += len(sizes)
            if waiting > HELD:
                yield blocks()
                owners = waiting = 0
        if waiting:
            yield blocks()

    return f


def drawn(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels, each the smallest member of its group and its own label, with the groups of a and b made one."""
    while True:
        least = np.minimum(label[a], label[b])
        if (label[a] == label[b]).all():
            return label
        label = label.copy()
        np.minimum.at(label, label[a], least)
        np.minimum.at(label, label[b], least)
        while (label[label] != label).any():
            label = label[label]


def meeting(batches):
    """From blocks sorted by bucket: the pairs of texts of two classes that share runs at places that few edits reach, and are
    close in length, how many they share here and need. Of a crowd's texts, one row each with another of the crowd; these need 0."""
    found: list[np.ndarray] = []  # rows of doc, pivot, need, shared, by their numbers in the bucket

    def merged(label: np.ndarray) -> np.ndarray:
        """What was found, each pair once; pairs within a crowd go. The crowds, with those that show up now."""
        found[:] = [np.concatenate(found, axis=1)]
        doc, pivot, need, shared = found[0]
        if not len(doc):
            return label
        order = np.lexsort((pivot, doc))
        at = np.flatnonzero(np.append(True, (np.diff(doc[order]) != 0) | (np.diff(pivot[order]) != 0)))
        first, shared = order[at], np.add.reduceat(shared[order], at)
        doc, pivot, need = doc[first], pivot[first], need[first]
        meets = np.bincount(doc, minlength=len(label)) + np.bincount(pivot, minlength=len(label))
        many = (meets[doc] > CROWD) & (meets[pivot] > CROWD)
        label = drawn(label, doc[many], pivot[many])
        apart = label[doc] != label[pivot]
        found[:] = [np.stack([doc, pivot, need, shared])[:, apart]]
        return label

    def pairs(ids: np.ndarray):
        doc, pivot, need, shared = found.pop() if found else np.zeros((4, 0), np.int64)
        return rows(ids[doc], ids[pivot], shared, need)

    def rows(*columns: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["doc", "pivot", "shared", "need"])

    def bucket(parts):
        gram, place, doc, class_, n = (np.concatenate(x) for x in zip(*parts))
        order = ordered(gram, n, 16)
        gram, place, doc, class_, n = gram[order], place[order].astype(np.int64), doc[order], class_[order], n[order].astype(np.int64)
        ids, doc = np.unique(doc, return_inverse=True)
        label = np.arange(len(ids))
        at = np.flatnonzero(np.append(True, gram[1:] != gram[:-1]))
        size = np.diff(np.append(at, len(gram)))
        mixed = np.minimum.reduceat(class_, at) != np.maximum.reduceat(class_, at)
        end = np.repeat(at + size, size)
        i, step, waiting = np.flatnonzero(np.repeat(mixed, size)), 0, 0
        while len(i):
            step += 1
            i = i[i + step < end[i]]
            j = i + step
            near = n[j] - n[i] <= n[j] // 5  # longer ones come later: none of them is near
            i, j = i[near], j[near]
            moved = np.abs(place[i] - place[j])
            fits = (moved + np.abs(n[i] - n[j] - place[i] + place[j]) <= n[j] // 5) | (place[i] < 0) | (place[j] < 0)
            fits &= (class_[i] != class_[j]) & (label[doc[i]] != label[doc[j]])
            a, b = doc[i[fits]], doc[j[fits]]
            if len(a):
                found.append(np.stack([np.maximum(a, b), np.minimum(a, b), needed(n[i[fits]]), np.ones(len(a), np.int64)]))  # n[i] <= n[j]
                waiting += len(a)
            if waiting > MET:
                label = merged(label)
                waiting = found[0].shape[1]
                if waiting > MET // 2:
                    yield pairs(ids)
                    waiting = 0
        if found:
            label = merged(label)
        yield pairs(ids)
        drawn_in = np.flatnonzero(label != np.arange(len(ids)))
        zeros = np.zeros(len(drawn_in), np.int64)
        yield rows(ids[drawn_in], ids[label[drawn_in]], zeros, zeros)

    held, parts = None, []
    for batch in batches:
        for of, gram, place, owner, *each in zip(*(batch.column(k).to_pylist() for k in range(7))):
            if of != held and parts:
                yield from bucket(parts)
                parts = []
            held, own = of, np.cumsum(unpack(owner, np.uint8), dtype=np.int64) - 1
            parts.append([unpack(gram, U64), unpack(place, np.int32), *(unpack(x, t)[own] for x, t in zip(each, (np.int64, np.int64, np.int32)))])
    if parts:
        yield from bucket(parts)


def unmet(texts: DataFrame) -> DataFrame:
    """(doc, pivot, need): from texts (doc, class, n, words), pairs of different classes, and with need 0 links that hold the texts of
    each crowd together; all pairs that are similar are among the former or within a crowd."""
    spark = texts.sparkSession
    words = texts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    common = np.zeros(1 << CELL_BITS, np.uint8)
    counted = texts.select("words").mapInArrow(counting, "slice int, counts binary").repartition("slice").sortWithinPartitions("slice").mapInArrow(summed, "slice int, counts binary")
    for i, counts in zip(*counted.toArrow().to_pydict().values()):
        common.reshape(-1, 1 << SLICE_BITS)[i] = unpack(counts, np.uint8)
    n_buckets = max(1, -(-int(0.65 * words) // BUCKET))
    blocks = texts.select("doc", "class", "words").mapInArrow(rarest(spark.sparkContext.broadcast(common), n_buckets), RARE)
    met = blocks.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(meeting, "doc long, pivot long, shared long, need long")
    return met.groupBy("doc", "pivot").agg(F.sum("shared").alias("shared"), F.min("need").alias("need")).where("shared >= need").select("doc", "pivot", "need")


def tiles(batches):
    """From rows (crowd, s, i, t, j, side, doc, class, words) sorted by tile (the first five): links (a, b) between similar texts of
    the two sides, or of one side if the tile has one block only. Pairs that classes and earlier links of the tile connect are passed over."""

    def tile(sides: tuple[list, list], alone: bool):
        texts = sides[0] + sides[1]
        ready, size = {}, 0
        bits, n = np.zeros((len(texts), BITS // 64), U64), np.zeros(len(texts), np.int64)
        for k, (_, _, packed) in enumerate(texts):
            words = unpack(packed, np.uint32)
            of = np.zeros(BITS, bool)
            of[words % BITS] = True
            bits[k], n[k] = np.packbits(of).view(U64), len(words)
        label = np.unique([x[1] for x in texts], return_inverse=True)[1]

        def read(k: int) -> Read:
            nonlocal size
            if k not in ready:
                if size > UNPACKED:
                    ready.clear()
                    size = 0
                ready[k] = Read(texts[k][2])
                size += len(ready[k].words)
            return ready[k]

        for i in range(len(sides[0])):
            others = np.arange(i + 1 if alone else len(sides[0]), len(texts))
            longer = np.maximum(n[others], n[i])
            fits = (label[others] != label[i]) & (longer - np.minimum(n[others], n[i]) <= longer // 5)
            others, longer = others[fits], longer[fits]
            apart = np.bitwise_count(bits[others] ^ bits[i]).sum(axis=1, dtype=np.int64)
            near = np.flatnonzero(apart <= 2 * (longer // 5))
            for k in others[near[np.argsort(apart[near], kind="stable")]].tolist():
                if label[k] != label[i] and may_be_similar(a := read(i), b := read(k)) and similar(a.words, b.words):
                    label[label == label[k]] = label[i]
                    yield texts[i][0], texts[k][0]

    def out(pairs: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in pairs], pa.int64()) for i in (0, 1)], names=["a", "b"])

    held, sides = None, ([], [])
    for batch in batches:
        for *key, side, doc, class_, words in zip(*(c.to_pylist() for c in batch.columns)):
            if key != held and held is not None:
                yield out(list(tile(sides, held[1:3] == held[3:5])))
                sides = ([], [])
            held = key
            sides[side].append((doc, class_, words))
    if held is not None:
        yield out(list(tile(sides, held[1:3] == held[3:5])))


def crowded(together: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b): links between the similar texts of each crowd, from links (doc, pivot) that hold crowds together and texts (doc, class, n, words).

    Lengths go by steps so wide that similar texts are of one step or of two in succession. The texts of a step are dealt into blocks, and
    any two blocks that may hold a similar pair are a tile.
    """
    crowds = components(together.select(F.col("doc").alias("a"), F.col("pivot").alias("b")))
    all_ = texts.join(crowds.select("doc", F.col("class").alias("crowd")), "doc").withColumn("s", F.floor(F.log("n") / F.log(F.lit(1.26))).cast("int"))
    sizes = written(all_.groupBy("crowd", "s").agg(F.ceil(F.sum("n") / TILE).cast("int").alias("p")), "steps")
    for name, by in (("before", 1), ("after", -1)):
        all_ = all_.join(sizes.select("crowd", (F.col("s") + by).alias("s"), F.col("p").alias(name)), ["crowd", "s"], "left")
    all_ = all_.join(sizes, ["crowd", "s"]).withColumn("i", F.pmod(F.hash("doc"), F.col("p")).cast("int"))

    def blocks(first, until, tile):
        one = F.transform(F.sequence(first, until - 1), lambda j: F.struct(*[x.cast("int").alias(k) for k, x in zip(("s", "i", "t", "j", "side"), tile(j))]))
        return F.when(until > first, one).otherwise(F.array())

    s, i, p, left, right = F.col("s"), F.col("i"), F.col("p"), F.lit(0), F.lit(1)
    each = F.concat(
        blocks(i, p, lambda j: (s, i, s, j, left)),
        blocks(F.lit(0), i, lambda j: (s, j, s, i, right)),
        blocks(F.lit(0), F.coalesce("after", F.lit(0)), lambda j: (s, i, s + 1, j, left)),
        blocks(F.lit(0), F.coalesce("before", F.lit(0)), lambda j: (s - 1, j, s, i, right)),
    )
    work = all_.select("crowd", F.explode(each).alias("of"), "doc", "class", "words").select("crowd", "of.*", "doc", "class", "words")
    tile = ["crowd", "s", "i", "t", "j"]
    links = written(work.repartition(*tile).sortWithinPartitions(*tile, "side", "doc").mapInArrow(tiles, "a long, b long"), "crowded")
    discard(crowds, sizes)
    return links


def components(links: DataFrame) -> DataFrame:
    """(doc, class): the smallest id of each linked id's connected component.

    In each round every id hooks to the smallest id around it, pointer jumping over the ids finds the
    roots, and links are drawn anew between roots; links within a tree go, so after the first round few are left.
    """

    def between(rows: DataFrame) -> DataFrame:
        return rows.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    found, edges = None, written(between(links), "links")
    while True:
        around = edges.union(edges.select("b", "a")).groupBy(F.col("a").alias("doc")).agg(F.min("b").alias("least"))
        roots = written(around.select("doc", F.least("doc", "least").alias("root")), "hooked")
        while True:
            above = roots.select(F.col("doc").alias("root"), F.col("root").alias("next"))
            jumped = written(roots.join(above, "root").select("doc", F.col("next").alias("root"), F.col("root").alias("was")), "roots")
            done = jumped.where("root != was").isEmpty()
            discard(roots)
            roots = jumped
            if done:
                break
        of = roots.select("doc", "root")
        before = found
        if found is None:
            found = of.select("doc", F.col("root").alias("class"))
        else:
            found = found.join(of.select(F.col("doc").alias("class"), "root"), "class", "left").select("doc", F.coalesce("root", "class").alias("class"))
        found = written(found, "classes")
        drawn = edges.join(of.withColumnRenamed("doc", "a"), "a").select("b", F.col("root").alias("x"))
        drawn = drawn.join(of.withColumnRenamed("doc", "b"), "b").select(F.col("x").alias("a"), F.col("root").alias("b"))
        left = written(between(drawn), "links")
        discard(edges, roots, before)
        edges = left
        if edges.isEmpty():
            discard(edges)
            return found


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, class) for each id that shares a class with another: class is the smallest id in it.

    Rows of one id are one document. Rows with a null id take no part. Null and empty texts are copies
    of one another, as are texts without words that have the same characters; they are near to nothing else.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).where("doc IS NOT NULL")
    all_ = written(rows.mapInArrow(sketches, SKETCH), "sketches")
    # texts of equal words: one stands for all
    first = written(all_.groupBy("k1", "k2").agg(F.min("doc").alias("rep")), "firsts")
    copies = all_.select("doc", "k1", "k2").join(first, ["k1", "k2"]).where("doc != rep").select(F.col("doc").alias("a"), F.col("rep").alias("b"))
    kept = all_.select("doc", "k1", "k2", "n", "sketch").join(first.select(F.col("rep").alias("doc"), "k1", "k2"), ["doc", "k1", "k2"], "left_semi")
    each = kept.select("doc", "n", F.explode("sketch").alias("h"))
    by_size = F.struct("n", "doc")
    buckets = each.groupBy("h").agg(F.count("*").alias("members"), F.min("doc").alias("p0"), F.min(by_size)["doc"].alias("p1"), F.max(by_size)["doc"].alias("p2"), F.min(F.struct(F.xxhash64("doc"), "doc"))["doc"].alias("p3")).where("members > 1")
    buckets = written(buckets, "buckets")
    members = each.select("doc", "h").join(buckets, "h")
    many = members.where(F.col("members") > SMALL).select("doc", F.explode(F.array("p0", "p1", "p2", "p3")).alias("pivot"))
    few = members.where(F.col("members") <= SMALL).groupBy("h").agg(F.sort_array(F.collect_list("doc")).alias("d")).select(F.explode("d").alias("pivot"), "d").select("pivot", F.explode("d").alias("doc")).where("doc > pivot")
    pairs = many.union(few.select("doc", "pivot")).where("doc != pivot").select(F.greatest("doc", "pivot").alias("doc"), F.least("doc", "pivot").alias("pivot")).distinct()
    pairs = written(pairs, "pairs")
    links = linked(pairs, all_)
    found = components(links.union(copies))
    of = first.select(F.col("rep").alias("doc"), "k1", "k2").join(found, "doc", "left").select("doc", "k1", "k2", F.coalesce("class", "doc").alias("class"))
    texts = written(all_.where("n >= 4").select("doc", "k1", "k2", "n", "words").join(of, ["doc", "k1", "k2"]).select("doc", "class", "n", "words"), "texts")
    discard(all_, first, buckets, pairs, links)
    met = written(unmet(texts), "unmet")
    more, together = [linked(met.where("need > 0").select("doc", "pivot"), texts)], met.where("need = 0")
    if not together.isEmpty():
        more.append(crowded(together, texts))
    links = found.select(F.col("doc").alias("a"), F.col("class").alias("b"))
    for x in more:
        links = links.union(x)
    out = components(links)
    discard(texts, met, *more, found)
    return out


def linked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b): those of the pairs (doc, pivot) that are similar, from texts (doc, words)."""
    blocks = max(1, pairs.select("pivot").distinct().count() // PIVOTS)
    each = pairs.groupBy(F.pmod(F.xxhash64("pivot"), F.lit(blocks)).alias("block"), "doc").agg(F.collect_list("pivot").alias("pivots"))  # as many as a block has, at most
    each = written(each, "paired")
    parts = written(each.groupBy("block").agg(F.ceil(F.sum(F.size("pivots")) / PAIRS).cast("int").alias("parts")), "parts")
    others = each.join(parts, "block").select("block", F.pmod(F.hash("doc"), F.col("parts")).cast("int").alias("part"), "doc", "pivots")
    own = pairs.select(F.col("pivot").alias("doc")).distinct().withColumn("block", F.pmod(F.xxhash64("doc"), F.lit(blocks))).join(parts, "block")
    own = own.select("block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "doc", F.lit(None).cast("array<long>").alias("pivots"))
    work = own.unionByName(others).join(texts.select("doc", "words"), "doc").select("block", "part", "doc", "pivots", "words")
    work = work.repartition("block", "part").sortWithinPartitions("block", "part", F.col("pivots").isNotNull(), "doc")
    out = written(work.mapInArrow(aligned, "a long, b long"), "linked")
    discard(each, parts)
    return out


def op9_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and class_id, the smallest doc_id among its near copies, of every row."""
    docs = table(spark, sf_dir, "documents")
    ids = docs.select("doc_id")
    return ids.join(classes(docs).withColumnRenamed("doc", "doc_id"), "doc_id", "left").select("doc_id", F.coalesce("class", "doc_id").alias("class_id"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class, that with the smallest id; of its rows, one of each text. Rows with a null id stay."""
    gone = classes(docs).where("doc != class").select(F.col("doc").alias("_id"))
    rows = docs.select(row_of(docs), F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_key"))
    nth = F.row_number().over(Window.partitionBy("_id", "_key").orderBy(F.lit(0)))
    kept = rows.where("_id IS NOT NULL").join(gone, "_id", "left_anti").withColumn("_nth", nth).where("_nth = 1")
    return kept.select("_row.*").union(rows.where("_id IS NULL").select("_row.*"))
