"""Language-model scoring with a probabilistic suffix tree over words (operator 1).

The root holds the count of every training word. Below it are contexts of one and two words whose next-word distribution
differs from that of the context's suffix by a likelihood-ratio test: count * KL(context || suffix) >= DIVERGENCE. Contexts
tell all words seen SYMBOL_COUNT times apart and lump the rest as one symbol, which spreads over words as the root does. A
kept count is discounted; the mass freed goes to the suffix's distribution, so that every distribution sums to one. A token
is scored at the longest context that the tree holds. Unknown words are one symbol whose share is estimated from the words
seen once.

All counts are taken over all training rows, and all least counts are absolute: what was seen often enough to be kept in a
small corpus is kept in a large one, so the tree grows with the corpus. Tasks write it to the shared checkpoint folder, as
sorted tables that are mapped into memory where they are looked into: no process holds it, it is neither gathered nor
broadcast. Words seen once are not in it but joined.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import partitions, settled, written
from ._text import U64, Hasher, Tokens, column_bytes, mix, planes, slices, squeeze, tokens, unplanes, unsqueeze

#: Words of less than this share of all tokens are joined even if seen SYMBOL_COUNT times, and lumped in contexts (0: none).
FREQUENT_SHARE = 0.0
#: Least count of the words that contexts tell apart, of a next word in a context, and (discounted) of two words as a context.
SYMBOL_COUNT, PAIR_COUNT, CONTEXT_COUNT = 2, 2, 4
DIVERGENCE, DISCOUNT = 10.0, 0.75
END = U64(0x5851F42D4C957F2D)
_FLUSH = 2_000_000
#: Bytes of text handled at once.
CHUNK = 1_000_000
#: Words or tokens of a bucket, about; buckets grow in number with the corpus.
BUCKET = 1_000_000


def _folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share and must have mounted."""
    if spark.sparkContext.getCheckpointDir() is None:
        settled(spark.range(0))
    at = urlsplit(spark.sparkContext.getCheckpointDir())
    if at.scheme not in ("", "file"):
        raise RuntimeError("the tree's tables are mapped into memory: spark.checkpoint.dir must be a mounted folder")
    path = f"{unquote(at.path)}/kinfold-tree-{uuid.uuid4().hex}"
    os.makedirs(path)
    return path


def _write(path: str, x: np.ndarray) -> None:
    """x as a file, whole or not at all: a task may run twice."""
    part = f"{path}-{uuid.uuid4().hex}"
    np.ascontiguousarray(x).tofile(part)
    os.replace(part, path)


def _join(path: str, buckets: list[int]) -> None:
    """The parts path-bucket one after the other as the file path; the parts go."""
    with open(path, "wb") as out:
        for b in buckets:
            with open(f"{path}-{b}", "rb") as part:
                shutil.copyfileobj(part, out, 1 << 20)
            os.remove(f"{path}-{b}")


def _mapped(path: str, kind, mode: str = "r") -> np.ndarray:
    return np.asarray(np.memmap(path, kind, mode)) if os.path.getsize(path) else np.zeros(0, kind)


def _search(keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Places of x in the sorted keys, looked up in order, so that a table larger than the processor's cache is read along."""
    order = np.argsort(x)
    out = np.empty(len(x), np.int64)
    out[order] = np.searchsorted(keys, x[order])
    return out


class Mapped:
    """Arrays are files of the folder, opened where they are used."""

    def __getstate__(self) -> dict:
        return {k: x for k, x in self.__dict__.items() if not k.startswith("_")}

    def _open(self, name: str, kind) -> np.ndarray:
        if f"_{name}" not in self.__dict__:
            self.__dict__[f"_{name}"] = _mapped(f"{self.folder}/{name}", kind)
        return self.__dict__[f"_{name}"]


@dataclass
class Level(Mapped):
    """Contexts of one length.

    keys: kept (context, symbol) in order; counts: theirs; total: of each context (0: not kept); mass: what the
    discount and the dropped symbols free.
    """

    folder: str
    n_contexts: int
    rare: int
    empty: bool

    @property
    def keys(self) -> np.ndarray:
        return np.full(1, -1, np.int64) if self.empty else self._open("keys", np.int64)

    @property
    def counts(self) -> np.ndarray:
        return np.zeros(1, np.uint32) if self.empty else self._open("counts", np.uint32)

    @property
    def total(self) -> np.ndarray:
        return self._open("total", np.float64)

    @property
    def mass(self) -> np.ndarray:
        return self._open("mass", np.float64)

    def extended(self) -> Iterator[np.ndarray]:
        """Keys (symbol, symbol) of the contexts of one word more: often enough, and closed under suffixes."""
        for i in range(0, 0 if self.empty else len(self.keys), BUCKET):
            key, count = self.keys[i : i + BUCKET], self.counts[i : i + BUCKET]
            key = key[(count - DISCOUNT >= CONTEXT_COUNT) & (key % (self.rare + 1) < self.rare)]
            yield key[self.total[key % (self.rare + 1)] > 0]


@dataclass
class Tree(Mapped):
    n: int  # training tokens
    v: int  # distinct ones
    once: int  # words seen once
    rare: int  # words of the least count; a word's place among them is its symbol, and `rare` stands for all others
    own: int  # tokens of theirs
    folder: str
    levels: list[Level]
    n_pairs: int  # contexts of two words

    @property
    def words(self) -> np.ndarray:
        """Hashes of the words of the least count, in order."""
        return self._open("words", U64)

    @property
    def count(self) -> np.ndarray:
        """Of each of the words."""
        return self._open("count", np.int64)

    @property
    def pairs(self) -> np.ndarray:
        """Keys (symbol, symbol) of the two-word contexts, in order; their place is the context's number."""
        return self._open("pairs", np.int64) if self.n_pairs else np.zeros(0, np.int64)

    @property
    def unknown(self) -> float:
        """Share of unknown words."""
        return (self.once + 0.5) / (self.n + 1) if self.n else 1.0

    @property
    def rest(self) -> float:
        """Probability of all words that are no symbols together, unknown ones included."""
        return max(1 - (1 - self.unknown) * self.own / max(self.n, 1), 1e-12)

    def share(self, s: np.ndarray) -> np.ndarray:
        """The root's probability of each symbol."""
        p = np.full(len(s), self.rest)
        known = s < self.rare
        p[known] = (1 - self.unknown) * self.count[s[known]] / max(self.n, 1)
        return p

    def root(self) -> np.ndarray:
        """Probability of each symbol; the last is all others together."""
        return self.share(np.arange(self.rare + 1))

    def place(self, h: np.ndarray) -> np.ndarray:
        """Place of each hash among the tree's words, or -1."""
        if not len(self.words):
            return np.full(len(h), -1)
        at = np.minimum(_search(self.words, h), len(self.words) - 1)
        return np.where(self.words[at] == h, at, -1)

    def symbols(self, h: np.ndarray) -> np.ndarray:
        at = self.place(h)
        return np.where(at >= 0, at, self.rare)

    def pair(self, before: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Number of the context (before, last), or -1."""
        if not len(self.pairs):
            return np.full(len(last), -1)
        key = before * (self.rare + 1) + last
        at = np.minimum(_search(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, at, -1)

    def contexts(self, s: np.ndarray, doc: np.ndarray) -> list[np.ndarray]:
        """For each token the numbers of its contexts of one and two words, or -1."""
        one, two = np.full(len(s), -1), np.full(len(s), -1)
        same = doc[1:] == doc[:-1]
        one[1:] = np.where(same & (s[:-1] < self.rare), s[:-1], -1)
        if len(s) > 2:
            ok = same[1:] & same[:-1] & (s[1:-1] < self.rare) & (s[:-2] < self.rare)
            two[2:] = np.where(ok, self.pair(s[:-2], s[1:-1]), -1)
        return [one, two]

    def probability(self, s: np.ndarray, contexts: list[np.ndarray], root: np.ndarray | None = None) -> np.ndarray:
        """Of each symbol after its contexts, from the shortest context to the longest one held. root: of all symbols, if at hand."""
        p = self.share(s) if root is None else root[s]
        for level, at in zip(self.levels, contexts, strict=False):
            held = np.flatnonzero((at >= 0) & (level.total[np.maximum(at, 0)] > 0)) if len(level.total) else []
            if not len(held):
                continue
            a = at[held]
            key = a * (self.rare + 1) + s[held]
            k = np.minimum(_search(level.keys, key), len(level.keys) - 1)
            c = np.where(level.keys[k] == key, level.counts[k] - DISCOUNT, 0.0)
            p[held] = (c + level.mass[a] * p[held]) / level.total[a]
        return p


def with_end(t: Tokens, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of all tokens in order, one end after each text's."""
    doc = np.concatenate((t.doc, np.arange(n)))
    order = np.argsort(doc, kind="stable")
    return doc[order], np.concatenate((t.hash, np.full(n, END)))[order]


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, c) over all rows; pre-summed by task."""

    def run(batches):
        held, size = [], 0

        def flush():
            words, at = np.unique(np.concatenate([w for w, _ in held]), return_inverse=True)
            c = np.bincount(at, weights=np.concatenate([c for _, c in held])).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(c)], ["word", "c"])

        for b in slices(batches, text, CHUNK):
            _, h = with_end(tokens(column_bytes(b.column(text))), b.num_rows)
            words, c = np.unique(h, return_counts=True)
            held.append((words, c))
            size += len(words)
            if size > _FLUSH // 4:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return docs.select(text).mapInArrow(run, "word long, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys of all parts in order, and the sums of their counts."""
    keys, of = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(of.reshape(-1), weights=np.concatenate([c for _, c in parts]))


def _grown(docs: DataFrame, tree: Tree, text: str) -> Level:
    """The next level of the tree: counts of (context, symbol) by context, then the divergence test beside the data."""
    depth = len(tree.levels)
    n_contexts = tree.rare if depth == 0 else tree.n_pairs
    folder = f"{tree.folder}/{depth + 1}"
    os.makedirs(folder)
    buckets = max(2 * partitions(docs.sparkSession), tree.n // BUCKET)
    width = max(-(-n_contexts // buckets), 1)

    def count(batches):
        def flush(keys):
            keys, c = np.unique(np.concatenate(keys), return_counts=True)
            bucket = keys // (tree.rare + 1) // width
            cut = np.flatnonzero(np.diff(bucket, prepend=-1))
            ends = np.append(cut[1:], len(keys))
            blobs = [squeeze(np.int64([j - i]).tobytes() + planes(np.diff(keys[i:j], prepend=0)) + planes(c[i:j].astype(np.uint32))) for i, j in zip(cut, ends, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(bucket[cut]), pa.array(blobs, pa.binary())], ["bucket", "pairs"])

        keys, size = [], 0
        for b in slices(batches, text, CHUNK):
            doc, h = with_end(tokens(column_bytes(b.column(text))), b.num_rows)
            s = tree.symbols(h)
            at = tree.contexts(s, doc)
            if depth:
                at[1] = np.where(tree.levels[0].total[np.maximum(at[0], 0)] > 0, at[1], -1)
            ok = at[depth] >= 0
            keys.append(at[depth][ok] * (tree.rare + 1) + s[ok])
            size += int(ok.sum())
            if size > _FLUSH:
                yield flush(keys)
                keys, size = [], 0
        if size:
            yield flush(keys)

    def test(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        got, size = [], 0
        for blob in table.column("pairs"):
            raw = unsqueeze(blob.as_py())
            n = int(raw[:8].view(np.int64)[0])
            got.append((np.cumsum(unplanes(raw[8:], n, np.int64)), unplanes(raw[8 + 8 * n :], n, np.uint32)))
            size += n
            if size > _FLUSH + 2 * len(got[0][0]):  # a frequent word's bucket repeats its pairs
                got = [_merged(got)]
                size = len(got[0][0])
        keys, c = _merged(got)
        ctx, s = keys // (tree.rare + 1), keys % (tree.rare + 1)
        first = np.flatnonzero(np.diff(ctx, prepend=-1))
        total = np.add.reduceat(c, first)
        p = tree.probability(s, [tree.pairs[ctx] % (tree.rare + 1)] if depth else [])
        sizes = np.diff(np.append(first, len(c)))
        gain = np.add.reduceat(c * np.log(c / np.repeat(total, sizes) / np.maximum(p, 1e-300)), first)  # count * KL
        good = gain >= DIVERGENCE
        keep = np.repeat(good, sizes) & (c >= PAIR_COUNT)
        mass = total - np.add.reduceat(np.where(keep, c - DISCOUNT, 0.0), first)
        for name, x in (("keys", keys[keep]), ("counts", c[keep].astype(np.uint32)), ("context", ctx[first][good]), ("good", np.stack([total[good], mass[good]]))):
            _write(f"{folder}/{name}-{bucket}", x)
        return pa.table({"bucket": pa.array([bucket]), "kept": pa.array([int(keep.sum())])})

    done = []
    if n_contexts:
        done = sorted(tuple(r) for r in docs.select(text).mapInArrow(count, "bucket long, pairs binary").groupBy("bucket").applyInArrow(test, "bucket long, kept long").collect())
    for name in ("total", "mass"):
        with open(f"{folder}/{name}", "wb") as f:
            f.truncate(8 * n_contexts)
    total, mass = (_mapped(f"{folder}/{name}", np.float64, "r+") for name in ("total", "mass"))
    for bucket, _ in done:
        context, good = np.fromfile(f"{folder}/context-{bucket}", np.int64), np.fromfile(f"{folder}/good-{bucket}").reshape(2, -1)
        total[context], mass[context] = good
        os.remove(f"{folder}/context-{bucket}")
        os.remove(f"{folder}/good-{bucket}")
    for name in ("keys", "counts"):
        _join(f"{folder}/{name}", [bucket for bucket, _ in done])
    return Level(folder, n_contexts, tree.rare, not any(kept for _, kept in done))


def least_count(n: int) -> float:
    """Least count of the words that the tree holds."""
    return max(SYMBOL_COUNT, FREQUENT_SHARE * n)


def train(docs: DataFrame, text: str = "text", depth: int = 2) -> tuple[Tree, DataFrame]:
    """The tree learnt from docs, and the table (word, c) of all words, of which the tree holds those of the least count."""
    counts = written(word_counts(docs, text))
    n, v, once = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.count(F.when(F.col("c") == 1, 1))).first()
    top = counts.filter(F.col("c") >= least_count(n))
    bits, folder = max((v // BUCKET).bit_length(), 4), _folder(docs.sparkSession)

    def keep(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        words, c = (table.column(x).to_numpy() for x in ("word", "c"))
        words = words.view(U64)
        order = np.argsort(words)
        _write(f"{folder}/words-{bucket}", words[order])
        _write(f"{folder}/count-{bucket}", c[order])
        return pa.table({"bucket": pa.array([bucket]), "n": pa.array([len(c)]), "own": pa.array([int(c.sum())])})

    done = sorted(tuple(r) for r in top.withColumn("bucket", F.shiftrightunsigned("word", 64 - bits)).groupBy("bucket").applyInArrow(keep, "bucket long, n long, own long").collect())
    for name in ("words", "count"):
        _join(f"{folder}/{name}", [r[0] for r in done])
    tree = Tree(n, v, once, sum(r[1] for r in done), sum(r[2] for r in done), folder, [], 0)
    if depth >= 1:
        tree.levels.append(_grown(docs, tree, text))
    if depth >= 2 and tree.rare:
        with open(f"{folder}/pairs", "wb") as f:
            for part in tree.levels[0].extended():
                part.tofile(f)
                tree.n_pairs += len(part)
        tree.levels.append(_grown(docs, tree, text))
    return tree, counts


def score(docs: DataFrame, tree: Tree, counts: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) of each row; rows that repeat an id are scored apart, null and empty texts alike.

    Rows are told apart by id and a hash of the text; those that repeat both have one sum, which is shared among them.
    The tree's words are scored where the text is read; the others go to the table of counts by one join on the word.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in slices(batches, text, CHUNK):
            doc, h = with_end(tokens(column_bytes(b.column(text))), b.num_rows)
            at = tree.place(h)
            here = at >= 0
            s = np.where(here, at, tree.rare)
            value = np.log10(np.maximum(tree.probability(s, tree.contexts(s, doc)), 1e-300))
            value[~here] -= np.log10(tree.rest)  # times the word's own share, by the join
            size = b.num_rows
            n = np.bincount(doc, minlength=size)
            ids = b.column(id_col)
            texts = column_bytes(b.column(text))
            own = pa.array(mix(Hasher(texts.data).ranges(texts.offsets[:-1], texts.offsets[1:])).view(np.int64))
            main = [np.bincount(doc[here], minlength=size), np.bincount(doc[here], weights=np.log10(tree.count[at[here]] + 0.5), minlength=size).astype(float), np.bincount(doc, weights=value, minlength=size).astype(float)]
            far = ~here
            order = np.lexsort((h[far], doc[far]))
            d, w = doc[far][order], h[far][order]
            new = np.flatnonzero(np.concatenate(([True], (d[1:] != d[:-1]) | (w[1:] != w[:-1])))) if len(d) else np.zeros(0, np.int64)
            times = np.diff(np.append(new, len(d)))
            yield pa.RecordBatch.from_arrays([ids, own, pa.array(mix(np.arange(size, dtype=U64) + U64(len(h))).view(np.int64)), pa.array(n), *map(pa.array, (main[0].astype(np.int64), main[1], main[2])), pa.array(np.zeros(size, bool))], names)
            zero = np.zeros(len(new))
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(d[new])), own.take(pa.array(d[new])), pa.array(w[new].view(np.int64)), pa.array(times), pa.array(zero.astype(np.int64)), pa.array(zero), pa.array(zero), pa.array(np.ones(len(new), bool))], names)

    names = ["id", "own", "word", "n", "known", "base", "value", "far"]
    parts = docs.select(F.col(id_col).alias(id_col), text).mapInArrow(run, f"id {kind}, own long, word long, n long, known long, base double, value double, far boolean")
    rare_words = counts.filter(F.col("c") < least_count(tree.n)).select("word", "c")
    joined = parts.join(rare_words, "word", "left")
    n, c = F.col("n"), F.coalesce("c", F.lit(0))
    seen = F.col("far") & F.col("c").isNotNull()
    own = F.when(seen, F.log10(F.lit((1 - tree.unknown) / max(tree.n, 1)) * c)).otherwise(F.lit(float(np.log10(tree.unknown))))
    sums = joined.groupBy("id", "own").agg(
        F.count_if(~F.col("far")).alias("rows"),
        F.sum(F.when(F.col("far"), 0).otherwise(n)).alias("n_tokens"),
        F.sum(F.when(seen, n).otherwise(F.when(F.col("far"), 0).otherwise(F.col("known")))).alias("n_known"),
        F.sum(F.when(F.col("far"), n * F.log10(c + 0.5)).otherwise(F.col("base"))).alias("base"),
        F.sum(F.when(F.col("far"), n * own).otherwise(F.col("value"))).alias("value"),
    )
    whole = float(np.log10(tree.n + 0.5 * (tree.v + 1)))
    sums = sums.select("id", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))), *[(F.col(c) / F.col("rows")).alias(c) for c in ("base", "value")], *[F.expr(f"{c} div rows").alias(c) for c in ("n_tokens", "n_known")])
    return sums.select(F.col("id").alias(id_col), "n_tokens", "n_known", F.lit(tree.n).cast("long").alias("train_tokens"), (F.col("base") - F.col("n_tokens") * whole).alias("base_score"), F.col("value").alias("score"))


def learn_and_score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    tree, counts = train(docs.filter(~held_out), text)
    return score(docs, tree, counts, id_col, text)
