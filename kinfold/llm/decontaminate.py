"""Benchmark decontamination by template canonicalisation (operator 10).

Tokens are canonicalised: numbers, units and names (capitalised words inside a sentence) become typed placeholders, other
words their lower-case form without punctuation around them. Windows of WINDOW canonical tokens of the benchmark items are
hash-joined with those of the documents, so a question whose figures were exchanged still meets its item. A match is a run
of windows on one diagonal (document position - item position) and the neighbouring ones up to GAP words on; it counts only
where its slots are consistent: one value of the item stands for one value of the document throughout. A document is
contaminated by an item if consistent windows cover COVERAGE of the item's. Windows of too few plain words to prove
anything as a template are matched by their values instead, so that a copy of them is still found; COVERAGE is then of all
windows, while without them it is of the template windows alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._text import U64, Hasher, column_bytes, combine, lowered, mix, slices, spans
from .parity_join import _membership

WINDOW, COVERAGE = 8, 0.5
#: Least number of plain words in a template window; placeholders alone prove nothing. For shorter items, half of the window.
PLAIN = 5
#: Words put in or left out within an item move what follows to another diagonal; so many are bridged.
GAP = 4
_EXACT = U64(0x9E3779B97F4A7C15)
#: Units that count as such after a number (fixed values).
UNITS = "mm cm m km in ft yd mi mg g kg lb oz t ml l s sec min h hr hrs hour hours minute minutes second seconds day days week weeks month months year years % percent $ € £ usd eur dollars euros cents mph kmh kph c f k w kw kwh v a hz mhz ghz kb mb gb tb meters metres miles kilometers kilometres grams kilograms pounds liters litres degrees".split()
_NUM, _NAME, _UNIT = U64(0x1001), U64(0x2002), U64(0x3003)
_SPACE = np.isin(np.arange(256), [0x20, 9, 10, 11, 12, 13])
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True
_WORD[[ord(c) for c in "%$"]] = True
_STOP = np.isin(np.arange(256), [ord(c) for c in ".!?:\""])


def _unit_hashes() -> np.ndarray:
    column = column_bytes(pa.array(UNITS))
    return np.sort(Hasher(column.data).ranges(column.offsets[:-1], column.offsets[1:]))


def canonical(batch: pa.RecordBatch, text: str):
    """Of each token: text, canonical hash, whether a slot, and the slot's value; tokens of punctuation only are left out."""
    texts = column_bytes(batch.column(text))
    raw = texts.data
    start, end, doc = spans(~_SPACE[raw], texts.offsets)
    if not len(start):
        return doc, np.zeros(0, U64), np.zeros(0, bool), np.zeros(0, U64)
    count = lambda mask: np.concatenate(([0], np.cumsum(mask)))
    inner, digits = count(_WORD[raw]), count((raw >= 48) & (raw < 58))
    letters = count(((raw | 32) >= 97) & ((raw | 32) < 123) | (raw >= 128))
    # The stripped token: from its first to its last word byte.
    at = np.flatnonzero(_WORD[raw])
    low, high = at[np.minimum(inner[start], len(at) - 1)] if len(at) else start, at[np.maximum(inner[end] - 1, 0)] + 1 if len(at) else end
    ok = inner[end] > inner[start]
    stop = _STOP[raw[end - 1]] | (raw[np.minimum(end, len(raw) - 1)] == 10)  # the token ends a sentence or a line
    first = np.concatenate(([True], (doc[1:] != doc[:-1]) | stop[:-1]))
    start, end, doc, low, high, first = (x[ok] for x in (start, end, doc, low, high, first))
    h = Hasher(lowered(raw)).ranges(low, high)
    number = (digits[high] > digits[low]) & (letters[high] - letters[low] == 0)
    after_number = np.concatenate(([False], number[:-1] & (doc[1:] == doc[:-1]))) if len(doc) else number
    unit = after_number & np.isin(h, _UNIT_HASHES)
    name = ~first & (raw[low] >= 65) & (raw[low] <= 90) & ~number & ~unit if len(doc) else number
    form = np.where(number, _NUM, np.where(unit, _UNIT, np.where(name, _NAME, h)))
    return doc, form, number | unit | name, h


_UNIT_HASHES = _unit_hashes()


def windows(batch: pa.RecordBatch, text: str, length: int, item: bool):
    """(text, position, hash, exact, place, slot, value) of the windows; exact: hashed by the tokens' values, not as a template.

    An item has its exact windows where template windows would be short of plain words, and windows under WINDOW only if it
    has that many tokens; a document has both kinds everywhere.
    """
    doc, form, slot, value = canonical(batch, text)
    n = np.bincount(doc, minlength=batch.num_rows)
    at = np.arange(max(len(doc) - length + 1, 0))
    at = at[doc[at] == doc[at + length - 1]]
    if item and length < WINDOW:
        at = at[n[doc[at]] == length]
    plain = np.concatenate(([0], np.cumsum(~slot)))
    enough = plain[at + length] - plain[at] >= (PLAIN if length == WINDOW else -(-length // 2))
    first = np.concatenate(([0], np.cumsum(n)[:-1]))
    template, exact = at[enough], at[~enough] if item else at
    h = [combine([of[where + k] for k in range(length)]) ^ U64(length) ^ salt if len(where) else np.zeros(0, U64) for of, where, salt in ((form, template, U64(0)), (value, exact, _EXACT))]
    at = np.concatenate((template, exact))
    return doc[at], at - first[doc[at]], np.concatenate(h), np.arange(len(at)) >= len(template), at, slot, value


def _rows(ids, doc, position, h, exact, at, slot, value, length, names):
    """slots: for each token its value, 0 for a plain word of a template window."""
    chosen = np.stack([np.where(slot[at + k] | exact, value[at + k], U64(0)) for k in range(length)], 1).view(np.int64) if len(at) else np.zeros((0, length), np.int64)
    ends = np.arange(len(at) + 1, dtype=np.int32) * length
    return pa.RecordBatch.from_arrays([ids.take(pa.array(doc)), pa.array(position), pa.array(h.view(np.int64)), pa.array(exact), pa.ListArray.from_arrays(pa.array(ends), pa.array(chosen.reshape(-1)))], names)


def _item_windows(items: DataFrame) -> DataFrame:
    names = ["item", "at", "h", "exact", "slots"]

    def run(batches):
        for b in slices(batches, "text"):
            for length in range(1, WINDOW + 1):
                yield _rows(b.column("item"), *windows(b, "text", length, True), length, names)

    return items.mapInArrow(run, f"item {dict(items.dtypes)['item']}, at long, h long, exact boolean, slots array<long>")


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, rid, item_id, coverage, exact) of each document and item it holds; exact: every slot has the item's own value.

    Null, empty and wordless texts match nothing. Rows that repeat an id are judged apart and give one row if any matches.
    Only document windows that a bounded filter of the benchmark's lets pass are shuffled.
    """
    items = benchmark.select(F.col(item_col).alias("item"), F.coalesce(F.col(item_text), F.lit("")).alias("text"))
    keyed = _item_windows(items).distinct()
    sizes = keyed.groupBy("item").agg(F.count_distinct("at").alias("n_windows"), F.count_distinct(F.when(~F.col("exact"), F.col("at"))).alias("n_templates"))
    hashes = keyed.select("h").distinct()
    holds = _membership(hashes, hashes.count())
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    names = ["id", "at", "h", "exact", "slots", "rid"]
    # Lengths other than WINDOW occur only if the benchmark has items as short; texts are searched for those alone.
    lengths = sorted(r[0] for r in keyed.select(F.size("slots")).distinct().collect())

    def run(batches):
        for b in slices(batches, "text"):
            for length in lengths:
                doc, position, h, whole, at, slot, value = windows(b, "text", length, False)
                hit = holds(h) if len(h) else np.zeros(0, bool)
                if hit.any():
                    out = _rows(b.column("id"), doc[hit], position[hit], h[hit], whole[hit], at[hit], slot, value, length, names[:5])
                    texts = column_bytes(b.column("text"))
                    key = mix(Hasher(texts.data).ranges(texts.offsets[:-1], texts.offsets[1:]))
                    yield pa.RecordBatch.from_arrays([*out.columns, pa.array(key[doc[hit]].view(np.int64))], names)

    found = rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, at long, h long, exact boolean, slots array<long>, rid long")
    met = found.drop("exact").join(keyed.select("item", F.col("at").alias("item_at"), F.col("slots").alias("item_slots"), "h", "exact"), "h")
    pairs = F.filter(F.zip_with("item_slots", "slots", lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda x: x.a != 0)
    place = F.struct(F.col("item_at").alias("at"), "exact")
    groups = met.groupBy("id", "rid", "item", (F.col("at") - F.col("item_at")).alias("diagonal")).agg(F.collect_set(place).alias("places"), F.array_distinct(F.flatten(F.collect_set(pairs))).alias("pairs"))
    consistent = lambda pairs: F.size(F.array_distinct(F.transform(pairs, lambda x: x.a))) == F.size(pairs)
    # A diagonal takes in those up to GAP on either side, the nearest first, whose slots agree with what it has.
    near = Window.partitionBy("id", "rid", "item").orderBy("diagonal").rangeBetween(-GAP, GAP)
    others = F.array_sort(F.transform("near", lambda x: F.struct(F.abs(x.diagonal - F.col("diagonal")).alias("far"), x.diagonal.alias("diagonal"), x.places.alias("places"), x.pairs.alias("pairs"))))

    def taken_in(held, x):
        union = F.array_union(held.pairs, x.pairs)
        return F.when(consistent(union), F.struct(F.array_union(held.places, x.places).alias("places"), union.alias("pairs"))).otherwise(held)

    agreed = groups.filter(consistent(F.col("pairs"))).withColumn("near", F.collect_list(F.struct("diagonal", "places", "pairs")).over(near))
    agreed = agreed.withColumn("all", F.aggregate(others, F.struct("places", "pairs"), taken_in)).select("id", "rid", "item", "all.places", "all.pairs").join(sizes, "item")
    of = lambda places, n: F.when(n > 0, F.size(F.array_distinct(F.transform(places, lambda x: x.at))) / n)
    coverage = F.greatest(of(F.col("places"), F.col("n_windows")), of(F.filter("places", lambda x: ~x.exact), F.col("n_templates")))
    judged = agreed.withColumn("coverage", coverage).withColumn("exact", F.forall("pairs", lambda x: x.a == x.b))
    return judged.filter(F.col("coverage") >= COVERAGE).groupBy("id", "rid", "item").agg(F.max("coverage").alias("coverage"), F.max("exact").alias("exact")).select(F.col("id").alias(id_col), "rid", F.col("item").alias(item_col), "coverage", "exact")


def decontaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs whose id no match names (rows of null id: that match nothing stay, since null equals no id)."""
    bad = contaminated(docs, benchmark, id_col, text).select(F.col(id_col).alias("_bad")).distinct()
    return docs.join(bad, F.col(id_col) == F.col("_bad"), "left_anti")
