"""BPE encoding and decoding by traversal of a trie of the distinct words.

Byte-pair encoding has a prefix property: whether a token can stand last in the encoding of a prefix
depends only on it and the last token before it (a pair is valid when encoding the two strings joined
gives back the two tokens), and exactly one token can. So each word is read as a path in a trie of
symbols; a depth-first walk gives each node the last token of its prefix, taken from the nodes above,
and words that share a prefix share that work. A word's tokens are read back from its leaf. The trie
is the sorted list of distinct words; an automaton over the vocabulary names the tokens that could end
at a node.
"""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import portions, row_of, sliced, table, worker_cache

#: Distinct chunks of text whose encodings a worker keeps; when full it starts anew.
KEPT = 400_000


class TrieBpe:
    """The encoder of a tokenizers BPE file with a word-end suffix, a lower-casing normaliser and byte-level symbols.

    spec is the parsed file. Normalising and splitting are the file's own patterns; merges are done here.
    """

    def __init__(self, spec: dict):
        import regex

        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.vocab = {k.replace(self.suffix, "\0") if self.suffix and k.endswith(self.suffix) else k: v for k, v in model["vocab"].items()}
        self.names = {v: k for k, v in model["vocab"].items()}
        #: pair of tokens -> (rank, token); token -> its two parts
        self.merged, self.parts, self.rank = {}, {}, {}
        for i, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            t = model["vocab"][a + b]
            x, y = model["vocab"][a], model["vocab"][b]
            self.merged[x, y] = i
            self.parts[t], self.rank[t] = (x, y), i
        self.split = regex.compile(next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"))
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        self.names |= {v: k for k, v in self.special.items()}
        self.is_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pair_ok: dict[tuple[int, int], bool] = {}
        self.whole: dict[int, bool] = {}
        # the printable stand-in of each byte in the vocabulary's alphabet
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = iter(range(256, 512))
        self.of_byte = [chr(b) if b in set(plain) else chr(next(others)) for b in range(256)]
        self.raw = {t: t.to_bytes(4, "little") for t in self.names}
        self.moves: dict[tuple[int, str], int] = {}
        if spec.get("decoder") is not None:
            raise ValueError("only files without a decoder of their own are read: their tokens are joined by blanks")
        #: the name of each id, null where an id has none
        self.table = pa.array([self.names.get(i) for i in range(max(self.names, default=-1) + 1)], pa.string())
        self.is_id = self.table.is_valid().to_numpy(zero_copy_only=False)
        self._automaton()

    def valid(self, a: int, b: int) -> bool:
        """Whether the strings of a and b, joined and encoded, give (a, b): no merge across the border comes before those that made a and b."""
        ok = self.pair_ok.get((a, b))
        if ok is None:
            ok = self.pair_ok[a, b] = self._valid(a, b)
        return ok

    def _valid(self, a: int, b: int) -> bool:
        # Undo the merges of both sides at the border, latest first. The border pair at each step must not
        # merge before the step that was undone; on equal ranks the leftmost pair merges first.
        rank, parts, merged = self.rank, self.parts, self.merged
        never = len(merged)
        until, left_undone = never, False  # the undone merge; whether it was left of the border
        while True:
            r = merged.get((a, b))
            if r is not None and (r < until or (r == until and not left_undone)):
                return False
            ra, rb = rank.get(a, -1), rank.get(b, -1)
            if ra < 0 and rb < 0:
                return True
            # of two equal ranks the right one was merged later
            if ra > rb:
                until, left_undone, a = ra, True, parts[a][1]
            else:
                until, left_undone, b = rb, False, parts[b][0]

    def makes_itself(self, t: int) -> bool:
        """Whether the string of t encodes to t alone."""
        ok = self.whole.get(t)
        if ok is None:
            stack, ok = [t], True
            while stack and ok:
                x = stack.pop()
                if x in self.parts:
                    a, b = self.parts[x]
                    ok = self._joins(a, b, self.rank[x])
                    stack += [a, b]
            self.whole[t] = ok
        return ok

    def _joins(self, a: int, b: int, rank: int) -> bool:
        """Whether a and b stay apart until their own merge."""
        kept = self.merged.pop((a, b))
        try:
            return self._valid(a, b)
        finally:
            self.merged[a, b] = kept

    def _automaton(self) -> None:
        """An automaton over the symbols of tokens: candidates[state] are (token, symbols) of all tokens that end there, longest first."""
        goto: list[dict] = [{}]
        own: list[int | None] = [None]
        for text, t in self.vocab.items():
            at = 0
            for s in self.symbols(text):
                nxt = goto[at].get(s)
                if nxt is None:
                    nxt = goto[at][s] = len(goto)
                    goto.append({})
                    own.append(None)
                at = nxt
            if self.makes_itself(t):
                own[at] = t
        fail, depth, self.candidates = [0] * len(goto), [0] * len(goto), [()] * len(goto)
        queue = [0]
        for at in queue:
            for s, nxt in goto[at].items():
                f = fail[at]
                while f and s not in goto[f]:
                    f = fail[f]
                fail[nxt] = goto[f][s] if at else 0
                depth[nxt] = depth[at] + 1
                self.candidates[nxt] = (((own[nxt], depth[nxt]),) if own[nxt] is not None else ()) + self.candidates[fail[nxt]]
                queue.append(nxt)
        self.goto, self.fail = goto, fail

    def symbols(self, word: str) -> list[str]:
        """Symbols of a token or word: the mark of a word's end is part of the one before it."""
        return [*word[:-2], word[-2:]] if word[-1] == "\0" else list(word)

    def step(self, state: int, s: str) -> int:
        """The automaton's state after one more symbol."""
        key, goto, fail = (state, s), self.goto, self.fail
        nxt = self.moves.get(key)
        if nxt is None:
            while state and s not in goto[state]:
                state = fail[state]
            nxt = self.moves[key] = goto[state].get(s, 0)
        return nxt

    def encode_words(self, words) -> dict[str, tuple[int, ...]]:
        """Tokens of each distinct word (byte-level symbols). Sorted, the words are a trie's leaves in depth-first order, and
        what a word shares with the one before it is the path that the walk stays on: only what branches off is computed."""
        out: dict[str, tuple[int, ...]] = {}
        candidates, moves, step, pair_ok, valid = self.candidates, self.moves, self.step, self.pair_ok, self.valid
        end = "\0" if self.suffix else ""
        n_most = max(map(len, words), default=0) + 1
        #: of each node on the path: the automaton's state, the last token of its prefix, and where that token starts
        state, last, start = [0] * (n_most + 1), [-1] * (n_most + 1), [0] * (n_most + 1)
        before = ""
        for w in sorted(words):
            n = len(w)
            d, most = 0, min(n, len(before)) - 1
            while d < most and w[d] == before[d]:
                d += 1
            before = w
            while d < n:
                s = w[d] if d < n - 1 else w[d] + end
                q = moves.get((state[d], s))
                if q is None:
                    q = step(state[d], s)
                d += 1
                for t, k in candidates[q]:
                    if k == d:
                        break
                    key = (last[d - k], t)
                    ok = pair_ok.get(key)
                    if ok or (ok is None and valid(*key)):
                        break
                else:
                    raise ValueError("a symbol has no token")
                state[d], last[d], start[d] = q, t, d - k
            ids = []
            while d:
                ids.append(last[d])
                d = start[d]
            ids.reverse()
            out[w] = tuple(ids)
        return out

    def pieces(self, chunk: str) -> list:
        """Words, as byte-level symbols, and ids of special tokens of a text that holds no blank."""
        import unicodedata

        if chunk.isascii() and chunk.isalpha():
            return [chunk.lower()]
        parts: list = []
        for i, x in enumerate(self.is_special.split(chunk) if self.is_special else [chunk]):
            if i % 2:
                parts.append(self.special[x])
            elif x:
                if x.isascii():
                    x = x.lower()
                else:
                    x = "".join([y.lower() for y in unicodedata.normalize("NFC", x)])
                for p in self.split.findall(x):  # no alternative crosses white space, so its kind does not matter
                    parts.append(p if p.isascii() and p.isprintable() else "".join([self.of_byte[b] for b in p.encode()]))
        return parts

    def encode_chunks(self, chunks) -> dict[str, bytes]:
        """For texts that hold no blank: their ids as little-endian bytes."""
        parts_of = {c: self.pieces(c) for c in chunks}
        ids_of = self.encode_words({p for parts in parts_of.values() for p in parts if type(p) is str})
        out, raw = {}, self.raw
        for c, parts in parts_of.items():
            ids = ids_of[parts[0]] if len(parts) == 1 and type(parts[0]) is str else [t for p in parts for t in (ids_of[p] if type(p) is str else (p,))]
            out[c] = b"".join([raw[t] for t in ids])
        return out

    def decode(self, ids: list[bytes | None]) -> pa.Array:
        """The text of each row of ids (little-endian unsigned 32-bit integers): their tokens' names, special ones too, joined
        by blanks. Ids without a token give nothing, null gives the empty text."""
        sizes = np.array([len(x or b"") // 4 for x in ids], np.int64)
        flat = np.frombuffer(b"".join([x for x in ids if x]), "<u4").astype(np.int64)
        known = np.flatnonzero(flat < len(self.is_id))
        known = known[self.is_id[flat[known]]]
        ends = np.append(0, np.cumsum(sizes))
        lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(known, ends), pa.int32()), self.table.take(pa.array(flat[known])))
        return pc.binary_join(lists, " ")


def encoder(spec_json: str) -> TrieBpe:
    cache, key = worker_cache(), ("bpe", hashlib.sha256(spec_json.encode()).hexdigest())
    if key not in cache:
        cache[key] = TrieBpe(json.loads(spec_json))
    return cache[key]


def encoding(spec_json):
    """spec_json: a broadcast of the tokenizer file's text, whose size does not depend on the data.
    Adds ids (little-endian unsigned 32-bit integers) and decoded to batches whose last column is text."""

    def f(batches):
        bpe, ids = encoder(spec_json.value), worker_cache().setdefault("bpe-ids", {})
        for batch in sliced(batches, "text", 1_000_000):
            k = batch.num_columns - 1
            # nothing that is encoded together holds a blank, line feed or tab
            texts = [(x or "").replace("\n", " ").replace("\t", " ").split(" ") for x in batch.column(k).to_pylist()]
            every = set().union(*texts)
            new = every.difference(ids)
            if len(ids) + len(new) > KEPT:
                ids.clear()
                new = every
            ids.update(bpe.encode_chunks(new))
            out = [b"".join(map(ids.__getitem__, x)) for x in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns[:k], pa.array(out, pa.binary()), bpe.decode(out)], names=[*batch.schema.names[:k], "ids", "decoded"])

    return f


def decoding(spec_json):
    """Replaces the last column, ids, by the decoded text."""

    def f(batches):
        bpe = encoder(spec_json.value)
        for batch in portions(batches, 4_000_000):
            k = batch.num_columns - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:k], bpe.decode(batch.column(k).to_pylist())], names=[*batch.schema.names[:k], "decoded"])

    return f


def tokenizer_file(path: str | None = None) -> str:
    """The text of a tokenizer file; by default the public word vocabulary, where its package is installed."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def encoded(docs: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """docs as a struct _row without the text, with ids (binary: little-endian unsigned 32-bit) and decoded, over whole texts.

    A null text is empty and has no tokens. Strings of special tokens in a text become those tokens, as
    in the file's own library; decoding gives the names of the tokens joined by blanks.
    """
    spec = docs.sparkSession.sparkContext.broadcast(tokenizer_file(path))
    rows = docs.select(row_of(docs, text), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(encoding(spec), rows.select("_row").schema.add("ids", "binary").add("decoded", "string"))


def decoded(rows: DataFrame, ids: str = "ids", path: str | None = None) -> DataFrame:
    """rows as a struct _row without the ids, with decoded: the text of a column of ids (binary, little-endian unsigned 32-bit).

    Null or no ids give the empty text; ids that the vocabulary lacks give nothing.
    """
    spec = rows.sparkSession.sparkContext.broadcast(tokenizer_file(path))
    of = rows.select(row_of(rows, ids), F.col(ids).cast("binary").alias("ids"))
    return of.mapInArrow(decoding(spec), of.select("_row").schema.add("decoded", "string"))


def digests(rows: DataFrame, *more: str) -> DataFrame:
    n = (F.octet_length("ids") / 4).cast("long")
    return rows.select("_row.doc_id", n.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"), *[f"_row.{c}" for c in more])


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encoded(table(spark, sf_dir, "documents").select("doc_id", "text")))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's tokens as op5_bpe gives them, and its place in the mix as the stage before gave it: doc_id, n_tokens, the digests of ids and decoded text, slot and place."""
    mix = [c for c in ("slot", "place") if c in docs.columns]
    return digests(encoded(docs.select("doc_id", *mix, "text")), *mix)
