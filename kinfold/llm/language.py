"""Language identification (operator 5): scripts narrow the candidates, Viterbi over words labels the spans.

A word's score for a language is the mean log-likelihood per character of its 1- to 4-grams with word borders. Only
languages whose training text uses the word's script are candidates. The best labelling of a text's words, with a fixed
penalty for each switch, gives the spans; the language of most letters is the text's.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._text import slices

#: Hash places of the n-grams of one language; bounds the model to this many counts for each language.
PLACES = 1 << 16
SWITCH = 6.0
#: First code points of the ranges of scripts told apart; the range before the first is Latin (fixed values).
SCRIPTS = [(0x370, "Greek"), (0x400, "Cyrillic"), (0x530, "Armenian"), (0x590, "Hebrew"), (0x600, "Arabic"), (0x780, "Other"), (0x900, "Devanagari"), (0x980, "Indic"), (0xE00, "Thai"), (0xE80, "Other"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"), (0x3040, "Kana"), (0x3100, "Other"), (0x3400, "Han"), (0xA000, "Other"), (0xAC00, "Hangul"), (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Other"), (0x20000, "Han"), (0x30000, "Other")]
_NAMES = ["Latin", *dict.fromkeys(n for _, n in SCRIPTS if n != "Latin")]
_STARTS = np.array([s for s, _ in SCRIPTS])
_CODES = np.array([0, *(_NAMES.index(n) for _, n in SCRIPTS)])


@cache
def _letters() -> np.ndarray:
    """Whether a code point is a letter, or a mark (inside a word)."""
    return np.array([unicodedata.category(chr(i))[0] in "LM" for i in range(0x110000)])


@cache
def _marks() -> np.ndarray:
    """Whether a code point is a mark: of a word, but no letter."""
    return np.array([unicodedata.category(chr(i))[0] == "M" for i in range(0x110000)])


@dataclass
class Words:
    """Letters of several texts with one 0 after each word; word k is [start[k], end[k]) of them, in text doc[k]."""

    codes: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    script: np.ndarray


def words(texts: list[str | None]) -> Words:
    low = [(t or "").lower() for t in texts]
    codes = np.frombuffer("\n".join([*low, ""]).encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    ends = np.cumsum([len(t) + 1 for t in low])
    inside = _letters()[codes]
    before = np.concatenate(([False], inside[:-1]))
    keep = inside | before
    doc = np.searchsorted(ends, np.flatnonzero(inside & ~before), "right")
    codes = np.where(inside, codes, 0)[keep]
    border = np.flatnonzero(codes == 0)
    start = np.concatenate(([0], border[:-1] + 1)) if len(border) else border
    if len(start):  # a run of marks alone is no word
        real = np.add.reduceat(~_marks()[codes] & (codes != 0), start) > 0
        if not real.all():
            codes = codes[np.repeat(real, border - start + 1)]
            doc = doc[real]
            border = np.flatnonzero(codes == 0)
            start = np.concatenate(([0], border[:-1] + 1)) if len(border) else border
    script = _CODES[np.searchsorted(_STARTS, codes[start], "right")] if len(start) else start
    return Words(codes, start, border, doc, script)


def grams(w: Words) -> tuple[np.ndarray, list[np.ndarray]]:
    """Letter positions, and for each of the orders the place of the gram that ends there (PLACES: none)."""
    at = np.flatnonzero(w.codes)
    c = np.concatenate((np.zeros(3, np.int64), w.codes, np.zeros(1, np.int64)))
    here = at + 3
    a, b, d, e = c[here], c[here - 1], c[here - 2], c[here - 3]
    last = c[here + 1] == 0

    def place(order: int, *parts) -> np.ndarray:
        h = np.full(len(at), order, np.uint64)
        for p in parts:
            h = (h ^ p.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return (h >> np.uint64(20)).astype(np.int64) % PLACES

    three = np.where(b != 0, place(3, d, b, a), PLACES)
    four = np.where((b != 0) & (d != 0), place(4, e, d, b, a), PLACES)
    return at, [place(1, a), place(2, b, a), three, four, np.where(last, place(5, np.where(b != 0, d, 0), b, a), PLACES)]


@dataclass
class Model:
    langs: list[str]
    logs: np.ndarray  # (PLACES + 1, languages)
    scripts: np.ndarray  # (scripts, languages): whether the language uses the script
    fallback: int

    def spans(self, texts: list[str | None]) -> tuple[Words, np.ndarray]:
        """The words and each word's language (-1: no language uses its script)."""
        w = words(texts)
        n = len(w.start)
        if not n or not self.langs:
            return w, np.full(n, -1)
        at, orders = grams(w)
        each = self.logs[orders[0]].copy()
        for o in orders[1:]:
            each += self.logs[o]
        first = np.searchsorted(at, w.start)
        score = np.add.reduceat(each, first, axis=0) / 4
        allowed = self.scripts[w.script]
        none = ~allowed.any(1)
        score[none] = 0
        score = np.where(allowed | none[:, None], score, -1e6)
        label = viterbi(score, w.doc, len(texts))
        label[none] = -1
        return w, label

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        w, label = self.spans(texts)
        size = (w.end - w.start).astype(float)
        k = len(self.langs)
        known = label >= 0
        share = np.bincount(w.doc[known] * max(k, 1) + label[known], weights=size[known], minlength=len(texts) * max(k, 1)).reshape(len(texts), max(k, 1))
        total = np.bincount(w.doc, weights=size, minlength=len(texts))
        best = share.argmax(1)
        top = share[np.arange(len(texts)), best]
        out = ["und" if not total[i] or not k else self.langs[best[i] if top[i] else self.fallback] for i in range(len(texts))]
        return out, np.where(total > 0, top / np.maximum(total, 1), 0.0)


#: Words that one pass of the Viterbi recursion covers. With more languages than MANY, texts are not cut: a table of pairs of
#: labels would cost more than it saves, and one step holds a label for each word and language only.
WINDOW, MANY = 256, 12


def viterbi(score: np.ndarray, doc: np.ndarray, n_docs: int, switch: float = SWITCH, window: int = WINDOW) -> np.ndarray:
    """The labelling of each text's words of the greatest sum of scores less ``switch`` for each change.

    Texts are cut into windows, which all step at once: a window's table holds the best score for each pair of its first
    and its last label. Then the windows of a text are chained by their tables, and the paths within are read back. The
    result is that of one recursion over the whole text.
    """
    n, k = score.shape
    if k > MANY:
        return _uncut(score, doc, n_docs, switch)
    count = np.bincount(doc, minlength=n_docs)
    parts = -(-count // window)
    first_part = np.concatenate(([0], np.cumsum(parts)))
    of = np.repeat(np.arange(n_docs), parts)
    nth = np.arange(len(of)) - first_part[of]
    start = np.concatenate(([0], np.cumsum(count)[:-1]))[of] + nth * window
    length = np.minimum(count[of] - nth * window, window)
    order = np.argsort(-length, kind="stable")
    alive = np.searchsorted(-length[order], -np.arange(1, (length[order[0]] if len(order) else 0) + 1), "right")  # windows of over t words
    begin = start[order]
    came = np.empty((n, k, k), np.int8 if k < 128 else np.int16)
    table = np.full((len(order), k, k), -1e30, np.float32)  # first label, last label
    own = np.arange(k, dtype=came.dtype)
    for t, m in enumerate(alive):
        at, v = begin[:m] + t, table[:m]
        if t == 0:
            v[:, own, own] = 0
            came[at] = own
        else:
            top = v.argmax(2)
            jump = np.take_along_axis(v, top[:, :, None], 2) - switch
            came[at] = np.where(v >= jump, own, top[:, :, None])
            np.maximum(v, jump, out=v)
        v += score[at][:, None, :]
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    value = np.zeros((n_docs, k))
    into = np.zeros((len(order), k), np.int64)  # of each window and last label: the best first label
    left = np.zeros((len(order), k), np.int64)  # of each window and first label: the last label of the window before
    steps = parts.max() if n_docs else 0
    for q in range(steps):
        docs = np.flatnonzero(parts > q)
        w = place[first_part[docs] + q]
        u = value[docs]
        best = u.argmax(1)
        jump = u[np.arange(len(docs)), best][:, None] - (switch if q else 0)
        left[w] = np.where(u >= jump, np.arange(k), best[:, None])
        both = np.maximum(u, jump)[:, :, None] + table[w]
        into[w] = both.argmax(1)
        u = both.max(1)
        value[docs] = u - u.max(1, keepdims=True)
    last = np.zeros(len(order), np.int64)
    head = np.zeros(len(order), np.int64)
    now = value.argmax(1) if n_docs else np.zeros(0, np.int64)
    for q in range(steps - 1, -1, -1):
        docs = np.flatnonzero(parts > q)
        w = place[first_part[docs] + q]
        last[w] = now[docs]
        head[w] = into[w, now[docs]]
        now[docs] = left[w, head[w]]
    label = np.empty(n, np.int64)
    for t in range(len(alive) - 1, -1, -1):
        m = alive[t]
        at = begin[:m] + t
        label[at] = last[:m]
        last[:m] = came[at, head[:m], last[:m]]
    return label


def _uncut(score: np.ndarray, doc: np.ndarray, n_docs: int, switch: float) -> np.ndarray:
    """The same labelling by one recursion over each text, all texts stepping at once; memory is words times languages."""
    n, k = score.shape
    count = np.bincount(doc, minlength=n_docs)
    order = np.argsort(-count, kind="stable")
    begin = np.concatenate(([0], np.cumsum(count)[:-1]))[order]
    alive = np.searchsorted(-count[order], -np.arange(1, (count.max() if n else 0) + 1), "right")
    came = np.empty((n, k), np.int16)
    value = np.zeros((n_docs, k))
    for t, m in enumerate(alive):
        at, v = begin[:m] + t, value[:m]
        top = v.argmax(1)
        jump = v[np.arange(m), top][:, None] - (switch if t else 0)
        came[at] = np.where(v >= jump, np.arange(k), top[:, None])
        np.maximum(v, jump, out=v)
        v += score[at]
        v -= v.max(1, keepdims=True)
    label = np.empty(n, np.int64)
    now = value.argmax(1) if n_docs else np.zeros(0, np.int64)
    for t in range(len(alive) - 1, -1, -1):
        at = begin[: alive[t]] + t
        label[at] = now[: alive[t]]
        now[: alive[t]] = came[at, now[: alive[t]]]
    return label


def _pieces(batches, text: str, langs: int = 4):
    return slices(batches, text, max(1, 1_500_000 * 4 // max(langs, 4)))


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Counts of n-grams and scripts by language over all rows with a language; the model holds PLACES counts for each."""

    def count(batches):
        held: dict[str, np.ndarray] = {}
        for b in _pieces(batches, text):
            w = words(b.column(text).to_pylist())
            if not len(w.start):
                continue
            names, of = np.unique(np.array(b.column(lang).to_pylist()), return_inverse=True)
            at, orders = grams(w)
            size = w.end - w.start
            letter = np.repeat(of[w.doc], size) * (PLACES + 1)
            seen = sum(np.bincount(letter + o, minlength=len(names) * (PLACES + 1)) for o in orders).reshape(len(names), -1)
            used = np.bincount(of[w.doc] * len(_NAMES) + w.script, weights=size, minlength=len(names) * len(_NAMES)).astype(np.int64).reshape(len(names), -1)
            for k, name in enumerate(names):
                held.setdefault(str(name), np.zeros(PLACES + 1 + len(_NAMES), np.int64))[:] += np.concatenate((seen[k], used[k]))
        for name, total in held.items():
            full = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(full), pa.string()), pa.array(full.astype(np.int32)), pa.array(total[full])], ["lang", "place", "n"])

    rows = docs.filter(F.col(lang).isNotNull()).select(F.col(text).alias(text), lang)
    summed = rows.mapInArrow(count, "lang string, place int, n long").groupBy("lang", "place").agg(F.sum("n").alias("n"))
    by_lang = summed.groupBy("lang").agg(F.collect_list("place").alias("place"), F.collect_list("n").alias("n"))  # PLACES at most for each
    totals: dict[str, np.ndarray] = {}
    for r in by_lang.toLocalIterator():
        totals[r["lang"]] = out = np.zeros(PLACES + 1 + len(_NAMES))
        out[np.array(r["place"])] = r["n"]
    langs = sorted(totals)
    if not langs:
        return Model([], np.zeros((PLACES + 1, 1), np.float32), np.zeros((len(_NAMES), 1), bool), 0)
    counts = np.stack([totals[x] for x in langs], 1)
    grams_, scripts = counts[:PLACES], counts[PLACES + 1 :]
    logs = np.log((grams_ + 0.2) / (grams_.sum(0) + 0.2 * PLACES))
    logs = np.vstack([logs, np.zeros((1, len(langs)))]).astype(np.float32)
    uses = scripts >= 0.005 * np.maximum(scripts.sum(0), 1)
    return Model(langs, logs, uses & (scripts > 0), int(grams_.sum(0).argmax()))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, lang_pred, score): `und` and 0 for a text that is null or has no letter; score is the share of its letters in spans of lang_pred."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in _pieces(batches, text, len(held.value.langs)):
            names, share = held.value.predict(b.column(text).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(id_col), pa.array(names, pa.string()), pa.array(share.astype(float))], [id_col, "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text).mapInArrow(run, f"{id_col} {kind}, lang_pred string, score double")


def spans(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, span, lang, first_word, n_words, n_letters) of each run of words of one language; words of no language go with the run before."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in _pieces(batches, text, len(held.value.langs)):
            w, label = held.value.spans(b.column(text).to_pylist())
            if not len(label):
                continue
            new = np.concatenate(([True], w.doc[1:] != w.doc[:-1]))
            known = np.where((label >= 0) | new, np.arange(len(label)), 0)
            label = label[np.maximum.accumulate(known)]
            begin = np.flatnonzero(new | np.concatenate(([True], label[1:] != label[:-1])))
            size = np.add.reduceat(w.end - w.start, begin)
            doc = w.doc[begin]
            first = np.concatenate(([0], np.cumsum(np.bincount(w.doc, minlength=b.num_rows))[:-1]))
            lead = np.maximum.accumulate(np.where(np.concatenate(([True], doc[1:] != doc[:-1])), np.arange(len(doc)), 0))
            names = [held.value.langs[x] if x >= 0 else "und" for x in label[begin]]
            yield pa.RecordBatch.from_arrays([b.column(id_col).take(pa.array(doc)), pa.array(np.arange(len(doc)) - lead), pa.array(names, pa.string()), pa.array(begin - first[doc]), pa.array(np.diff(np.append(begin, len(label)))), pa.array(size)], [id_col, "span", "lang", "first_word", "n_words", "n_letters"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text).mapInArrow(run, f"{id_col} {kind}, span long, lang string, first_word long, n_words long, n_letters long")
