"""Similarities of names and vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def jaro_winkler_similarity(a: str, b: str) -> float:
    """Jaro-Winkler: prefix of up to 4, weight 0.1, boosted only above a Jaro of 0.7; two empty strings are equal."""
    if a == b:
        return 1.0
    n, m = len(a), len(b)
    if not n or not m:
        return 0.0
    reach = max(max(n, m) // 2 - 1, 0)
    taken = [False] * m
    matched_a = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(m, i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                matched_a.append(c)
                break
    k = len(matched_a)
    if not k:
        return 0.0
    matched_b = [c for c, t in zip(b, taken, strict=True) if t]
    swaps = sum(x != y for x, y in zip(matched_a, matched_b, strict=True)) // 2
    jaro = (k / n + k / m + (k - swaps) / k) / 3
    if jaro <= 0.7:
        return jaro
    prefix = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        prefix += 1
    return jaro + 0.1 * prefix * (1 - jaro)


def _codes(texts: list[str], width: int) -> np.ndarray:
    """Code points of each text, padded to ``width`` by zeros."""
    raw = "".join(t.ljust(width, "\0") for t in texts).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(raw, np.uint32).reshape(len(texts), width)


def jaro_winkler_many(left: list[str], right: list[str]) -> np.ndarray:
    """jaro_winkler_similarity of each pair; pairs of like length step through their letters together."""
    size = np.array([[len(a), len(b)] for a, b in zip(left, right, strict=True)], np.int64).reshape(-1, 2)
    out = np.zeros(len(left))
    order = np.argsort(size.max(1), kind="stable") if len(left) else np.zeros(0, np.int64)
    at = 0
    while at < len(order):
        # A table of pairs by letters; some hundred thousand cells at a time stay in the processor's cache.
        rows = max(1, 200_000 // max(1, int(size[order[min(at + 4000, len(order) - 1)]].max())))
        some = order[at : at + min(rows, 4000)]
        at += len(some)
        out[some] = _jaro_winkler([left[i] for i in some], [right[i] for i in some], size[some, 0], size[some, 1])
    return out


def _jaro_winkler(left: list[str], right: list[str], n: np.ndarray, m: np.ndarray) -> np.ndarray:
    a, b = _codes(left, max(int(n.max()), 1)), _codes(right, max(int(m.max()), 1))
    reach = np.maximum(np.maximum(n, m) // 2 - 1, 0)
    free = np.arange(b.shape[1])[None, :] < m[:, None]
    hit_a = np.zeros(a.shape, bool)
    every = np.arange(len(n))
    widest = int(reach.max())
    for i in range(a.shape[1]):
        low, high = max(0, i - widest), min(b.shape[1], i + widest + 1)
        if low >= high:
            break
        near = np.abs(np.arange(low, high) - i)[None, :] <= reach[:, None]
        same = (b[:, low:high] == a[:, i : i + 1]) & free[:, low:high] & near & (i < n)[:, None]
        first = same.argmax(1)
        found = same[every, first]
        hit_a[found, i] = True
        free[every[found], low + first[found]] = False
    hit_b = ~free & (np.arange(b.shape[1])[None, :] < m[:, None])
    k = hit_a.sum(1)
    row = np.nonzero(hit_a)[0]
    swaps = np.bincount(row, weights=a[hit_a] != b[hit_b], minlength=len(n)) // 2  # both in order of row and place
    with np.errstate(divide="ignore", invalid="ignore"):
        jaro = np.where(k > 0, (k / n + k / m + (k - swaps) / k) / 3, 0.0)
    width = min(4, a.shape[1], b.shape[1])
    same = (a[:, :width] == b[:, :width]) & (np.arange(width)[None, :] < np.minimum(n, m)[:, None])
    prefix = np.cumprod(same, 1).sum(1)
    out = np.where(jaro > 0.7, jaro + 0.1 * prefix * (1 - jaro), jaro)
    return np.where([x == y for x, y in zip(left, right, strict=True)], 1.0, out)


def jaro_winkler_most(left: list[str], right: list[str]) -> np.ndarray:
    """At least jaro_winkler_similarity of each pair: as if all letters that both hold met in order."""
    out = np.ones(len(left))
    order = np.argsort(np.array([max(len(a), len(b)) for a, b in zip(left, right, strict=True)], np.int64), kind="stable") if len(left) else []
    for at in range(0, len(left), 4000):
        some = order[at : at + 4000]
        ones, others = [left[i] for i in some], [right[i] for i in some]
        n, m = (np.fromiter(map(len, x), np.int64, len(some)) for x in (ones, others))
        a, b = _codes(ones, max(int(n.max()), 4)), _codes(others, max(int(m.max()), 4))
        shared = np.minimum(_letters(a, n), _letters(b, m)).sum(1)
        same = (a[:, :4] == b[:, :4]) & (np.arange(4)[None, :] < np.minimum(n, m)[:, None])
        with np.errstate(divide="ignore", invalid="ignore"):
            jaro = (shared / n + shared / m + 1) / 3
        most = jaro + 0.1 * np.cumprod(same, 1).sum(1) * (1 - jaro)
        out[some] = np.where((n > 0) & (m > 0), most, 1.0)
    return out


def _letters(codes: np.ndarray, length: np.ndarray) -> np.ndarray:
    """How often each letter, by the low six bits of its code, occurs in each row."""
    row, place = np.nonzero(np.arange(codes.shape[1])[None, :] < length[:, None])
    return np.bincount(row * 64 + (codes[row, place] & 63), minlength=64 * len(codes)).reshape(-1, 64)


def jaro_winkler_from(least: float):
    """As jaro_winkler, but null for pairs whose letters and lengths tell that they stay below ``least``."""

    @F.pandas_udf(T.DoubleType())
    def similarity(left: pd.Series, right: pd.Series) -> pd.Series:
        ok = np.flatnonzero(left.notna().to_numpy() & right.notna().to_numpy())
        ok = ok[jaro_winkler_most(left.iloc[ok].tolist(), right.iloc[ok].tolist()) >= least - 1e-9]
        out = np.full(len(left), np.nan)
        out[ok] = jaro_winkler_many(left.iloc[ok].tolist(), right.iloc[ok].tolist())
        return pd.Series(out)

    return similarity


@F.pandas_udf(T.DoubleType())
def jaro_winkler(left: pd.Series, right: pd.Series) -> pd.Series:
    ok = np.flatnonzero(left.notna().to_numpy() & right.notna().to_numpy())
    out = np.full(len(left), np.nan)
    out[ok] = jaro_winkler_many(left.iloc[ok].tolist(), right.iloc[ok].tolist())
    return pd.Series(out)  # not a number becomes null


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(vector: Column) -> Column:
    """The vector at length 1, as doubles."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(vector, lambda x: x.cast("double") / norm)


def cosine(a: Column, b: Column) -> Column:
    return dot(unit(a), unit(b))
