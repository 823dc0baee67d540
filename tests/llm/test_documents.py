"""The operators on documents, against SQL, brute force or an exact library, on tables with every awkward row."""

import collections
import hashlib
import math
import random
import re
import zlib

import helpers as h
import numpy as np
import pytest
from pyspark.sql import functions as F

from marlspike.llm import bpe, common, interpolation, lines, mixing, neardup, quality, toxicity

STAGES = [quality.stage, lines.stage, neardup.stage, mixing.stage]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    return h.save(h.documents(spark), tmp_path_factory.mktemp("docs"))


@pytest.mark.parametrize("stage", STAGES)
def test_stages_keep_columns_and_bear_clashes_and_empty_tables(spark, sf, stage):
    docs = h.clashing(spark)
    out = stage(spark, docs, sf)
    assert out.columns == docs.columns and 0 < out.count() <= docs.count()
    assert out.where("_row != '_row' OR _slot != '_slot' OR `a.b` != 1").count() == 0
    assert stage(spark, docs.limit(0), sf).count() == 0


def test_quality_equals_sql(spark, sf):
    h.same(quality.op1_quality_rules(spark, sf), quality.SQL, {"documents": sf})


def test_quality_repeat_counts(spark):
    def brute(t):
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t or "") if x]
        n = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        return len({i + j for i in range(len(w) - 2) for j in range(3) if n[tuple(w[i : i + 3])] > 1})

    r = random.Random(3)
    texts = ["a a a a", "a b c a b c", "", None, "a b", "x a b c y a b c z"] + [" ".join(r.choice("abc") for _ in range(r.randint(0, 40))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {x.doc_id: x.n_repeat_words for x in quality.ledger(df).collect()} == {i: brute(t) for i, t in enumerate(texts)}


def test_quality_keeps_columns_named_like_its_own(spark):
    docs = h.clashing(spark).withColumns({n: F.lit(n) for n in ("_words", "_windows", "_starts", "_lines")})
    got = quality.ledger(docs)
    assert set(docs.columns) <= set(got.columns) and got.where("_words != '_words' OR _text != '_text' OR _windows != '_windows' OR _lines != '_lines' OR `a.b` != 1").count() == 0
    want = {(r.doc_id, r.n_words, r.n_repeat_words) for r in quality.ledger(h.documents(spark)).collect()}
    assert {(r.doc_id, r.n_words, r.n_repeat_words) for r in got.collect()} == want


def test_policies_and_ablation(spark, sf):
    rows = quality.ledger(spark.read.parquet(f"{sf}/documents.parquet"))
    bits = [r.fail_bits for r in rows.collect()]
    got = {r.rule: (r.n_failed, r.n_only) for r in quality.ablation(rows, "v1").collect()}
    m = quality.mask("v1")
    for i, rule in enumerate(quality.RULES):
        assert got[rule.name] == (sum(b >> i & 1 for b in bits), sum(b & m == 1 << i for b in bits))
    assert rows.where(quality.verdict("base")).count() == sum(b & 3 == 0 for b in bits)


def test_interpolation_equals_brute_force(spark, sf, tmp_path):
    rows = interpolation.op2_deleted_interpolation(spark, sf).collect()
    docs = [(i, t) for i, t, *_ in h.rows()]
    assert len(rows) == len(docs)
    tok = lambda t: [w.encode().lower() for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w] + [None]
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 1
    train = [tok(t) for i, t in docs if not held(i)]
    c = collections.Counter(w for t in train for w in t)
    pair = collections.Counter(p for t in train for p in zip(["<s>", *t], t))
    context = collections.Counter(x for t in train for x in ["<s>", *t[:-1]])
    n, v = sum(c.values()), len(c)
    # the histogram of held-out counts: each training text out of the counts that predict it
    bins = collections.Counter()
    q = lambda p: round(interpolation.STEPS * math.log2(p)) if p > 0 else interpolation.NONE
    for t in train:
        own, own_pair, own_context = collections.Counter(t), collections.Counter(zip(["<s>", *t], t)), collections.Counter(["<s>", *t[:-1]])
        for x, w in zip(["<s>", *t], t):
            n_h = context[x] - own_context[x]
            b = min(1 + int(math.log2(n_h)), interpolation.BUCKETS - 1) if n_h else 0
            bins[b, q((pair[x, w] - own_pair[x, w]) / max(n_h, 1)), q((c[w] - own[w]) / max(n - len(t), 1))] += 1
    weights = interpolation.weights_by_em(np.array([[*k, m] for k, m in sorted(bins.items())]), 1 / (v + 1))
    want = collections.Counter()
    for i, t in docs:
        t, base, score = tok(t), 0.0, 0.0
        for x, w in zip(["<s>", *t], t):
            a = weights[min(1 + int(math.log2(context[x])), interpolation.BUCKETS - 1) if context[x] else 0]
            score += math.log10(a[0] * pair[x, w] / max(context[x], 1) + a[1] * c[w] / n + a[2] / (v + 1))
            base += math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1)))
        want[i, held(i), len(t), sum(c[w] > 0 for w in t), n, round(base, 5), round(score, 5)] += 1
    assert collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5), round(r.score, 5)) for r in rows) == want
    assert interpolation.op2_deleted_interpolation(spark, h.empty(spark, tmp_path)).count() == 0


@pytest.mark.parametrize("lengths", [(255, 256, 257, 300), (5000,)])
def test_interpolation_knows_a_word_beside_long_ones(spark, tmp_path, lengths):
    r = random.Random(5)
    docs = [(i, " ".join("w%d" % r.randrange(300) for _ in range(r.randint(0, 60)))) for i in range(120)]
    docs += [(1000 + 2 * k + j, f"w1 W2 {x * k} w3") for k in lengths for j, x in enumerate("xX")]
    h.save(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), tmp_path)
    tok = lambda t: [*t.lower().split(), None]
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    c = collections.Counter(w for i, t in docs if not held(i) for w in tok(t))
    n, v = sum(c.values()), len(c)
    want = {(i, held(i), len(tok(t)), sum(c[w] > 0 for w in tok(t)), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tok(t)), 5)) for i, t in docs}
    got = interpolation.op2_deleted_interpolation(spark, str(tmp_path)).collect()
    assert {(x.doc_id, x.held_out, x.n_tokens, x.n_known, x.train_tokens, round(x.base_score, 5)) for x in got} == want and len(got) == len(docs)


def test_a_run_hashes_alike_beside_longer_ones():
    runs = [b"a", b"word", b"x" * 255, b"x" * 256, b"x" * 257, b"y" + b"x" * 299, b"x" * 299 + b"y", b"x" * 5000]
    data = np.frombuffer(b"".join(runs), np.uint8)
    ends = np.cumsum([len(x) for x in runs])
    tables = common.word_values(lower=True)
    together = common.run_hashes(data, ends - [len(x) for x in runs], ends, *tables)
    assert together.tolist() == [int(common.run_hashes(np.frombuffer(x, np.uint8), np.array([0]), np.array([len(x)]), *tables)[0]) for x in runs]
    assert len(set(together.tolist())) == len(runs)


def test_interpolation_in_levels(spark, sf, monkeypatch):
    def run():
        return sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in interpolation.op2_deleted_interpolation(spark, sf).collect()), key=str)

    want = run()
    asked, real = [], interpolation.written

    def spy(df, label, **options):
        out = real(df, label, **options)
        asked.extend([out] if label == "lm-asked" else [])
        return out

    monkeypatch.setattr(interpolation, "written", spy)
    monkeypatch.setattr(interpolation, "discard", lambda *frames: None)
    for name, value in (("CHUNK", 200), ("RANGE", 400), ("FAN", 6)):
        monkeypatch.setattr(interpolation, name, value)
    assert run() == want
    # a chunk asks in FAN ranges of each kind at most, as does a sum of chunks in each of its ranges
    assert len(asked) >= 2 and all(x.groupBy("kind", "who", F.floor(F.col("prefix") / 6)).count().agg(F.max("count")).first()[0] <= 6 for x in asked)


def test_em_finds_the_mixture():
    r = np.random.default_rng(1)
    p = np.array([[-4, -40], [-40, -8], [-16, -16]])
    true = np.array([0.7, 0.2, 0.1])
    mass = np.stack([np.exp2(p[:, 0] / 8), np.exp2(p[:, 1] / 8), np.full(3, 1e-4)], axis=1) @ true
    bins = np.array([[5, *x, int(m * 1e6)] for x, m in zip(p, mass)])
    w = interpolation.weights_by_em(bins, 1e-4, rounds=400)
    assert w.shape[1] == 3 and np.allclose(w.sum(axis=1), 1) and w[5, 0] > w[5, 1] > w[5, 2] and w[0, 0] == 0 and r is not None


def test_mixing_deviates_less_than_a_block(spark, sf):
    for weights in ({"a": 5, "b": 3, "c": 0.37, "d": 1}, {"x": 1}, {f"s{i}": (i + 1) ** 2 for i in range(40)}):
        shares = mixing.periods(weights, 840)
        slots = sum(shares.values())
        plan = mixing.schedule(shares)
        assert sorted(t for ts in plan.values() for t in ts) == list(range(slots))
        for k, ts in plan.items():
            at = np.zeros(slots + 1)
            np.add.at(at, np.array(ts) + 1, 1)
            assert np.abs(np.cumsum(at) - shares[k] * np.arange(slots + 1) / slots).max() < 1
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = mixing.scheduled(docs, {"s": 2, "t": 1}, block=2, period=6).collect()
    assert len(rows) == docs.count()
    of = collections.defaultdict(list)
    for r in rows:
        of[r._source].append((r._block, r._place))
    for at in of.values():
        assert sorted(at) == [(i // 2, i % 2) for i in range(len(at))]
    assert min(r._slot for r in rows if r._source not in ("s", "t")) > max(r._slot for r in rows if r._source in ("s", "t"))


def test_mixing_keeps_true_weights_over_many_periods(spark):
    weights, n = {"a": 50**0.5, "b": 7**0.5, "c": 1.0, "rare": 1e-5}, 60_000
    total = sum(weights.values())
    plan = mixing.slots_of(weights, {k: int(n * v / total) + 2 for k, v in weights.items()})
    taken = np.concatenate([np.array(v) for v in plan.values()])
    assert len(np.unique(taken)) == len(taken)
    for k, v in weights.items():
        had = np.searchsorted(np.array(plan[k]), np.arange(n))
        assert np.abs(had - v / total * np.arange(n)).max() < 1 + 1e-6
    # and the rows follow it: 3000 blocks
    docs = spark.range(6000).selectExpr("id AS doc_id", "IF(id % 6 = 0, 'b', 'a') AS source")
    rows = mixing.scheduled(docs, {"a": 5.0, "b": 1.0 + 1e-3}, block=2, period=7).collect()
    slots = sorted({r._slot for r in rows if r._source == "b"})
    assert len(slots) == 500 and max(abs(i - s * 1.001 / 6.001) for i, s in enumerate(slots)) < 1.001


def edf_by_brute_force(weights, blocks):
    """Slot by slot: of all released blocks, the one that is due first."""
    from fractions import Fraction

    total = sum(map(Fraction, weights.values()))
    had, out, t = dict.fromkeys(weights, 0), {}, 0
    while any(had[k] < blocks[k] for k in weights):
        w = {k: Fraction(weights[k]) / total for k in weights}
        released = [(math.ceil((had[k] + 1) / w[k]), k) for k in weights if had[k] < blocks[k] and math.floor(had[k] / w[k]) <= t]
        if released:
            k = min(released)[1]
            out[k, had[k]] = t
            had[k] += 1
        t += 1
    return out


def test_mixing_equals_brute_force(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE", 7)  # many ranges, each dealt by itself
    docs = spark.range(900).selectExpr("id AS doc_id", "'t' AS text", "'en' AS lang", "CASE WHEN id % 11 = 0 THEN 'b' WHEN id % 3 = 0 THEN NULL ELSE 'a' END AS source", "0L AS n_chars")
    sf = h.save(docs, tmp_path)
    rows = mixing.op3_pfair_mixing(spark, sf).collect()
    n = collections.Counter(r.source or "" for r in rows)
    want = edf_by_brute_force({k: v**0.5 for k, v in n.items()}, {k: -(-v // mixing.BLOCK) for k, v in n.items()})
    assert len(rows) == len({r.doc_id for r in rows}) == 900
    assert {(r.source or "", r.block): r.slot for r in rows} == want
    assert sorted((r.source or "", r.block, r.place) for r in rows) == sorted((k, i // mixing.BLOCK, i % mixing.BLOCK) for k, v in n.items() for i in range(v))


def test_mixing_bears_clashes_and_rows_without_ids(spark):
    docs = h.clashing(spark)
    rows = mixing.scheduled(docs, block=2).collect()
    assert len(rows) == docs.count() and rows[0]._row["a.b"] == 1 and {r._row["_source"] for r in rows} == {"_source"}
    bare = spark.range(5000).selectExpr("CAST(NULL AS LONG) AS doc_id", "'s' AS source")
    got = mixing.scheduled(bare).collect()
    assert sorted((r._block, r._place) for r in got) == [(i // mixing.BLOCK, i % mixing.BLOCK) for i in range(5000)]


def test_bpe_equals_library(spark, sf):
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(bpe.tokenizer_file())
    want = collections.Counter()
    for i, text, *_ in h.rows():
        ids = t.encode(text or "", add_special_tokens=False).ids
        want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert collections.Counter(map(tuple, bpe.op5_bpe(spark, sf).collect())) == want


def test_bpe_words():
    import json

    from tokenizers import Tokenizer

    spec = bpe.tokenizer_file()
    mine, t = bpe.TrieBpe(json.loads(spec)), Tokenizer.from_str(spec)
    r = random.Random(2)
    chunks = list({"".join(r.choice("abcdefghinorstuthe'.!9éßÅΣİ́中😀<|>") for _ in range(r.randint(1, 18))) for _ in range(3000)} | {"a" * 40, "<|endoftext|>x", "don't", "é e"})
    got = mine.encode_chunks(chunks)
    for c, e in zip(chunks, t.encode_batch(chunks, add_special_tokens=False)):
        assert got[c] == np.array(e.ids, "<u4").tobytes(), c


def test_bpe_decodes_any_ids_as_the_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(bpe.tokenizer_file())
    r = random.Random(6)
    ids = [[r.randrange(50_000) for _ in range(r.choice((0, 1, 5, 3000)))] for _ in range(60)] + [[49406, 0, 49407], [2**32 - 1, 5], list(range(2000))]
    rows = [(i, bytearray(np.array(x, "<u4").tobytes()), "x") for i, x in enumerate(ids)] + [(-1, None, "x")]
    out = {x["_row"].doc_id: x.decoded for x in bpe.decoded(spark.createDataFrame(rows, "doc_id long, ids binary, decoded string")).collect()}
    assert out == {i: t.decode(x, skip_special_tokens=False) for i, x in enumerate(ids)} | {-1: ""}


def test_lines_equal_sql(spark, sf, tmp_path):
    h.same(lines.op6_line_dedup(spark, sf), lines.SQL, {"documents": sf})
    assert lines.op6_line_dedup(spark, h.empty(spark, tmp_path)).count() == 0


def test_lines_of_one_key_over_many_partitions(spark):
    line = "x" * 50
    docs = spark.createDataFrame([(i, f"{line}\n{i}\n{line if i % 2 else ''}") for i in range(300)], "doc_id long, text string").repartition(7)
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = {r["_row"].doc_id: r._n_dropped for r in lines.applied(docs, lines.keep_bitmaps(docs)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == {i: (1 + i % 2) * (i != 299) for i in range(300)}


def test_near_duplicates_equal_brute_force(spark, tmp_path):
    base = [h.words(60 + 10 * i, i) for i in range(10)]
    texts = [h.edited(base[i % 10], i % 9, i) if i % 3 else base[i % 10] for i in range(90)] + ["", None, "!!!", "!!!", "a b c", "a b c", "a b d", "A, b; C"]
    ids = list(range(len(texts)))
    df = spark.createDataFrame(list(zip(ids, texts, [""] * len(ids), [""] * len(ids), [0] * len(ids))), h.SCHEMA)
    got = {r.doc_id: r.class_id for r in neardup.op9_order_minhash(spark, h.save(df, tmp_path)).collect()}
    w = [re.findall(r"[0-9A-Za-z_\u0080-\U0010ffff]+", (t or "").lower()) for t in texts]
    parent = list(ids)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in ids:
        for j in range(i):
            if (w[i] or w[j]) and neardup.similar(w[i], w[j]) or not w[i] and not w[j] and (texts[i] or "") == (texts[j] or ""):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    assert got == {i: root(i) for i in ids}
    assert neardup.op9_order_minhash(spark, h.empty(spark, tmp_path / "none")).count() == 0


def classes_by_brute_force(texts):
    """The smallest place of each text's class: all pairs are aligned."""
    w = [t.split(" ") for t in texts]
    of = list(range(len(w)))
    for i in range(len(w)):
        for j in range(i):
            if of[i] != of[j] and neardup.similar(w[i], w[j]):
                a, b = sorted((of[i], of[j]))
                of = [a if x == b else x for x in of]
    return of


def near_classes(spark, texts):
    got = {r.doc: r["class"] for r in neardup.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    return [got.get(i, i) for i in range(len(texts))]


def test_copies_are_found_beside_a_long_word(spark, tmp_path):
    docs = [(2 * i + j, h.words(60, i), j) for i in range(12) for j in range(2)] + [(1000, "x" * 300, 0)]
    h.save(spark.createDataFrame(docs, "doc_id long, text string, part int").repartitionByRange(2, "part").drop("part"), tmp_path)
    c = {x.doc_id: x.class_id for x in neardup.op9_order_minhash(spark, str(tmp_path)).collect()}
    assert len(c) == len(docs) and all(c[2 * i] == c[2 * i + 1] for i in range(12)) and len(set(c.values())) == 13


def test_near_duplicates_that_meet_in_hot_buckets_only(spark):
    passage, texts = h.words(60, 999), []
    for i in range(60):
        own = h.words(24, 1000 + i).split(" ")
        texts.append(f"{passage} {' '.join(own)}")
        # every third own word differs: no five words but those of the passage are the same
        texts.append(f"{passage} {' '.join(f'z{i}z{j}' if j % 3 == 0 else x for j, x in enumerate(own))}")
    assert near_classes(spark, texts) == classes_by_brute_force(texts) == [i - i % 2 for i in range(120)]


def test_near_duplicates_of_all_lengths_down_to_the_threshold(spark):
    texts, pairs = [], []
    for n in (4, 5, 6, 9, 10, 11, 15, 19, 20, 24, 40, 100, 250, 1000):
        for k in range(8):
            base = h.words(n, 5000 + 10 * n + k).split(" ")
            kind, edits = k % 4, max(1, n // 5 if k < 4 else n // 10)
            at = {round((i + 0.5) * n / edits) for i in range(edits)}  # spread over the text
            if kind == 0:
                other = [f"q{n}q{k}q{j}" if j in at else x for j, x in enumerate(base)]
            elif kind == 1:
                other = [x for j, x in enumerate(base) if j not in at]
            elif kind == 2:
                other = [y for j, x in enumerate(base) for y in ([f"q{n}q{k}q{j}", x] if j in at else [x])]
            else:  # one more than the threshold allows
                other = [f"q{n}q{k}q{j}" if j < n // 5 + 1 else x for j, x in enumerate(base)]
            pairs.append((len(texts), neardup.similar(base, other)))
            texts += [" ".join(base), " ".join(other)]
    want = classes_by_brute_force(texts)
    assert sum(near for _, near in pairs) > 70 and all((want[i + 1] == i) == near for i, near in pairs)
    assert near_classes(spark, texts) == want


def crowd(texts, words, edits, seed):
    """Texts of one base of so many words, each with its own edits: most pairs are 70 to 80 % alike, some more."""
    r, base = random.Random(seed), h.words(words, seed).split(" ")
    out = []
    for i in range(texts):
        w = [f"e{i}e{j}" if j in at else x for at in [set(r.sample(range(words), edits))] for j, x in enumerate(base)]
        if i % 3 == 1:
            w = [f"{x} i{i}i{j}" if r.random() < 0.05 else x for j, x in enumerate(w)]
        out.append(" ".join(w if i % 3 < 2 else [x for x in w if r.random() > 0.05]))
    return out


def test_near_duplicates_in_crowds_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neardup, "TILE", 1500)
    compared, real = [], neardup.crowded
    monkeypatch.setattr(neardup, "crowded", lambda *x: compared.append(real(*x)) or compared[0])
    texts = crowd(90, 100, 11, 1) + crowd(60, 40, 4, 2) + crowd(50, 22, 3, 3) + [h.words(60, 70 + i) for i in range(20)]
    want = classes_by_brute_force(texts)
    assert 60 < len(set(want)) < 200
    assert near_classes(spark, texts) == want and compared


def test_texts_of_a_crowd_meet_in_a_row_each_and_repeated_runs_in_one_bucket():
    import types

    import pyarrow as pa

    def met(texts, buckets):
        words = [np.array([zlib.crc32(x.encode()) for x in t.split(" ")], np.uint32) for t in texts]
        rows = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(range(len(texts)), pa.int64()), pa.array([neardup.pack(w) for w in words], pa.binary())], names=["doc", "class", "words"])
        blocks = neardup.rarest(types.SimpleNamespace(value=np.zeros(1 << neardup.CELL_BITS, np.uint8)), buckets)([rows])
        return pa.Table.from_batches(neardup.meeting(pa.Table.from_batches(blocks).sort_by("bucket").to_batches())).to_pylist()

    rows = met(crowd(150, 200, 24, 5), 1)
    assert len(rows) < 300  # of 11175 pairs
    assert not neardup.drawn(np.arange(150), np.array([x["doc"] for x in rows]), np.array([x["pivot"] for x in rows])).any()
    rows = met(["again " * 60 + h.words(20, i) for i in (1, 2)], 50)
    assert len(rows) == 1 and rows[0]["shared"] >= 3


def test_components_of_paths_stars_and_islands(spark):
    r = random.Random(9)
    ids = list(range(40))
    r.shuffle(ids)
    pairs = [(i, i + 1) for i in range(100, 140)] + list(zip(ids, ids[1:])) + [(500, 500 + i) for i in range(1, 20)] + [(7, 7), (900, 901), (901, 900)]
    got = {x[0]: x[1] for x in neardup.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 141)} | {i: 0 for i in range(40)} | {i: 500 for i in range(500, 520)} | {900: 900, 901: 900}


def test_near_duplicates_awkward_rows(spark, sf):
    got = [tuple(r) for r in neardup.op9_order_minhash(spark, sf).collect()]
    assert len(got) == len(h.rows()) and (4, 3) in got and (5, 3) in got and (52, 51) in got and (2, 1) in got and got.count((6, 6)) == 2 and got.count((None, None)) == 2
    kept = [r.doc_id for r in neardup.stage(spark, h.documents(spark), sf).collect()]
    assert kept.count(6) == 1 and kept.count(None) == 2 and 4 not in kept and 5 not in kept and 3 in kept


def test_banded_alignment_equals_table():
    def table(a, b):
        p = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            q = [i]
            for j, y in enumerate(b, 1):
                q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
            p = q
        return p[-1]

    r = random.Random(5)
    for _ in range(1500):
        a = [r.randint(0, 4) for _ in range(r.randint(0, 14))]
        b = [x for x in a if r.random() > 0.15] + [r.randint(0, 4) for _ in range(r.randint(0, 3))]
        d = table(a, b)
        for limit in (0, 1, 3, 6, 14):
            assert neardup.edits_within(a, b, limit) == (d if d <= limit else None)


def test_toxicity_from_document_labels(spark, tmp_path):
    r = random.Random(4)

    def text(toxic):
        s = [h.words(12, r.randrange(10**6)) for _ in range(r.randint(2, 8))]
        if toxic:
            s.insert(r.randrange(len(s)), f"you are such a {r.choice(['vile', 'nasty'])}{r.choice(['ness', 'ling', ''])} one")
        return ". ".join(s) + "."

    marks = [i % 4 == 0 for i in range(600)]
    docs = [(i, text(m), "en", "s", 0) for i, m in enumerate(marks)] + [(9000, None, None, None, None), (9001, "", "en", "s", 0), (None, text(False), "en", "s", 0)]
    sf = h.save(spark.createDataFrame(docs, h.SCHEMA), tmp_path)
    h.save(spark.createDataFrame([(i, 1, int(m)) for i, m in enumerate(marks)], "doc_id long, quality int, toxic int"), tmp_path, "labels")
    rows = toxicity.op10_toxicity(spark, sf).collect()
    assert len(rows) == len(docs) and all(0 <= x.score <= 1 for x in rows)
    held = [x for x in rows if x.held_out and x.doc_id < 9000]
    assert len(held) > 100 and sum(x.predicted == marks[x.doc_id] for x in held) >= 0.95 * len(held)
    df = spark.read.parquet(f"{sf}/documents.parquet")
    found = toxicity.sentences(df, toxicity.train(df, spark.read.parquet(f"{sf}/labels.parquet"), F.lit(True))).collect()
    assert found and sum(bool(re.search("vile|nasty", x.sentence)) for x in found) >= 0.95 * len(found)
    none = tmp_path / "none"
    h.empty(spark, none)
    h.empty(spark, none, "labels", "doc_id long, quality int, toxic int")
    assert toxicity.op10_toxicity(spark, str(none)).count() == 0


def test_toxicity_fit_keeps_the_shares_of_the_labels():
    r = random.Random(8)

    def document(toxic):
        words = [r.randrange(100, 10**6) for _ in range(12)] + [7] * (r.random() < (0.7 if toxic else 0.2))
        return int(toxic), np.array(words, np.int64), np.zeros(len(words), np.int32)

    def score(w, *words):
        return -np.expm1(toxicity.sentence_scores(np.array(words, np.int64), np.zeros(len(words), np.int64), 1, w))[0]

    toxic, clean = [document(True) for _ in range(100)], [document(False) for _ in range(900)]
    every = toxicity.fit(toxic + clean)
    sample = toxicity.fit(toxic + clean[:100], of={0: 900, 1: 100})
    forced = toxicity.fit(toxic + clean[:100])
    assert abs(score(sample, 7) - score(every, 7)) < 0.15 < score(forced, 7) - score(every, 7)


def test_toxicity_fit_reads_long_documents_whole():
    import pyarrow as pa

    texts = [". ".join(h.words(12, i) for i in range(1200)) + ". vile", "short one"]
    got = next(toxicity.features([pa.RecordBatch.from_arrays([pa.array(texts), pa.array([1, 0], pa.int32())], names=["text", "label"])]))
    assert len(np.unique(toxicity.unpack(got.column(2)[0].as_py(), np.int32))) == 1201


def plain_sentences(text):
    """Feature sets of a text's sentences, word by word."""
    out = []
    for x in re.split(r"[.!?\n]", text.lower()):
        words = [w.encode() for w in re.findall(r"[0-9A-Za-z\u0080-\U0010ffff]+", x)]
        tables = toxicity.word_values(lower=False, seed=1234)

        def hashed(w):
            return int(toxicity.run_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]), *tables)[0])

        of = {hashed(w) >> 64 - toxicity.BITS for w in words}
        of |= {(hashed(w[:k]) ^ k << 40) >> 64 - toxicity.BITS for w in words for k in toxicity.PREFIXES if len(w) > k}
        out.append(of)
    return out


def test_toxicity_scores_equal_brute_force(spark):
    r = np.random.default_rng(3)
    weights = np.append(np.maximum(r.normal(size=1 << toxicity.BITS), 0) * 0.2, -4.0)
    texts = ["You are vile. Go away!\nNow?", "one", "a a a b. " * 400, "É é ümlaut-x... ok", "", None, "..!"] + [h.words(60, i).replace(" c", ". c") for i in range(20)]
    rows = toxicity.scored(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), weights).collect()
    exact = {row["_row"].doc_id: row.score for row in rows}
    for i, t in enumerate(texts):
        spans = [x for x in re.split(r"[.!?\n]", (t or "").lower()) if x]
        clear = math.prod(1 - 1 / (1 + math.exp(-sum(weights[f] for f in plain_sentences(x)[0]) - weights[-1])) for x in spans)
        assert abs(exact[i] - (1 - clear)) < 1e-9, (i, t)


def test_toxicity_fit_is_near_the_least_loss():
    r = random.Random(12)
    documents = []
    for i in range(80):
        toxic = i % 4 == 0
        sentences = [[r.randrange(1, 9) for _ in range(4)] for _ in range(3)]
        if toxic:
            sentences[r.randrange(3)].append(r.choice((20, 21)))
        f = np.array([w for s in sentences for w in set(s)], np.int64)
        documents.append((int(toxic), f, np.array([k for k, s in enumerate(sentences) for _ in set(s)], np.int32)))

    def loss(w):
        out = 5e-5 * sum(w[f] for f in range(30))
        for label, f, s in documents:
            clear = 1.0
            for k in range(3):
                clear *= 1 - 1 / (1 + math.exp(-sum(w[x] for x, y in zip(f, s) if y == k) - w[-1]))
            p = min(max(1 - clear, 1e-9), 1 - 1e-12)
            out -= (math.log(p) if label else math.log(1 - p)) / len(documents)
        return out

    w = toxicity.fit(documents)
    found = loss(w)
    assert found < 0.05 and min(w[20], w[21]) > 3 and max(w[1:9]) < 1
    for k in (*range(1, 9), 20, 21, -1):
        for step in (-0.3, 0.3):
            near = w.copy()
            near[k] = near[k] + step if k == -1 else max(0.0, near[k] + step)
            assert loss(near) > found - 0.01, (k, step)


def test_toxicity_with_repeated_ids_and_long_texts(spark):
    r = random.Random(2)
    docs = [(i, ". ".join(h.words(8, r.randrange(10**6)) for _ in range(3)) + (". utterly vile" if i % 3 == 0 else "")) for i in range(90)]
    docs += [(5, docs[5][1])] * 200 + [(900, ". ".join(h.words(9, i) for i in range(4000)) + ". vile"), (901, ". ".join(h.words(9, i) for i in range(4000)))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)] + [(5, 0), (None, 1)], "doc_id long, toxic int")
    weights = toxicity.train(df, labels, F.lit(True))
    alone = toxicity.train(spark.createDataFrame(docs[:90], "doc_id long, text string"), labels, F.lit(True))
    assert np.array_equal(weights, alone)
    got = {x["_row"].doc_id: x.score for x in toxicity.scored(df, weights).collect()}
    assert all((got[i] >= 0.3) == (i % 3 == 0) for i in range(90)) and got[900] > got[901]
