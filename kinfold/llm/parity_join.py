"""N-gram Jaccard join by parity sketches (operator 6).

A text's set holds the hashes of its distinct word shingles. Two sets with |A & B| >= 0.8 |A | B| differ in at most
``(|A| + |B|) / 9`` elements. Pairs are banded by |A| + |B|; in a band that allows ``d`` differences every set is dealt
into P > d parts by hash, and each part keeps the XOR of its elements: a sketch of P parity words. The number of words in
which two sketches differ never exceeds their Hamming distance, which never exceeds the symmetric difference, so at least
P - d words of a linked pair agree (pigeonhole), and at least U - d of them are words of non-empty parts, U being the
number of a set's non-empty parts. Joining on (band, part, word) therefore finds every link; sets whose U <= d (tiny ones
whose few elements fell together) also meet under one extra key of their band. Pairs that share fewer than U - d words
are no links; the rest is verified on whole sets.

Hot words. A word that more than ``hot`` sets share gives a star of candidates around its least set, not all pairs. A set
with fewer hot words than U - d is sure to meet each partner under a word that isn't hot. The others (in practice members
of large near-copy groups) are first merged by what the stars proved. Where sets under one hot word still lie in different
components, the sets of such a cluster outside its largest component are compared with all sets of the cluster, in tiles of
bounded size that return links only: nothing is capped, no link between components is lost, and no pairs are written.

Equal sets collapse before any of this into one node, so exact copies cost nothing. Nodes are 64-bit set hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from ._spark import partitions, settled
from ._text import U64, column_bytes, distinct, mix, planes, shingles, slices, squeeze, tokens, unplanes, unsqueeze

#: Pair-size bands are [GROWTH**b, GROWTH**(b + 1)).
GROWTH = 1.5
_KEY, _BAND = U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F)


def sets(batch: pa.RecordBatch, text: str, width: int):
    """Of each text: size and node; and (text, hash) of all elements, in order."""
    t = tokens(column_bytes(batch.column(text)))
    doc, hashed = distinct(*shingles(t, width))
    n = np.bincount(doc, minlength=batch.num_rows)
    total = np.zeros(batch.num_rows, U64)
    first = np.concatenate(([0], np.cumsum(n)[:-1]))
    if len(hashed):
        full = np.flatnonzero(n)
        total[full] = np.add.reduceat(mix(hashed), first[full])
    return n, mix(total ^ (n.astype(U64) * _KEY)), doc, hashed, first


def set_sizes(docs: DataFrame, id_col: str, text: str = "text", width: int = 5) -> DataFrame:
    """(id, n_shingles, node) of each row; node is null for an empty set."""

    def run(batches):
        for b in slices(batches, text):
            n, node, *_ = sets(b, text, width)
            yield pa.RecordBatch.from_arrays([b.column(id_col), pa.array(n, pa.int64()), pa.array(node.view(np.int64), pa.int64(), mask=n == 0)], [id_col, "n_shingles", "node"])

    return docs.select(id_col, text).mapInArrow(run, f"{id_col} {dict(docs.dtypes)[id_col]}, n_shingles long, node long")


def _band(size: np.ndarray) -> np.ndarray:
    return np.floor(np.log(np.maximum(size, 1)) / np.log(GROWTH) + 1e-9).astype(np.int64)


def _differences(band: np.ndarray) -> np.ndarray:
    """Most differences of a linked pair of the band or, at its border, of the next."""
    return np.floor((GROWTH ** (band + 1.0) + 1) / 9 + 1e-6).astype(np.int64)


def _words(n, node, doc, hashed):
    """(key, node, band, slack) of every parity word of every distinct non-empty set; slack: U - d."""
    _, first = np.unique(node, return_index=True)
    use = np.zeros(len(n), bool)
    use[first] = True
    use &= n > 0
    low, high = _band(np.ceil(1.8 * n - 1e-9)), _band(np.floor(2.25 * n + 1e-9))
    out = []
    for which in (low, np.where(high > low, high, -1)):
        ok = use & (which >= 0)
        if not ok.any():
            continue
        d = _differences(which)
        parts = np.where(ok, np.ceil(1.3 * d).astype(np.int64) + 6, 0)
        base = np.concatenate(([0], np.cumsum(parts)))
        mine = ok[doc]
        h, owner = hashed[mine], doc[mine]
        part = ((h >> U64(33)) % parts[owner].astype(U64)).astype(np.int64)
        word, filled = np.zeros(base[-1], U64), np.zeros(base[-1], bool)
        np.bitwise_xor.at(word, base[owner] + part, mix(h ^ _KEY))
        filled[base[owner] + part] = True
        at = np.flatnonzero(filled)
        of = np.searchsorted(base, at, "right") - 1
        slack = np.bincount(of, minlength=len(n)) - d
        key = mix(word[at] ^ mix((at - base[of]).astype(U64) * _KEY + which[of].astype(U64) * _BAND))
        out.append((key, node[of], which[of], slack[of]))
        sparse = np.flatnonzero(ok & (slack <= 0))
        if len(sparse):
            out.append((mix(which[sparse].astype(U64) * _BAND + U64(1)), node[sparse], which[sparse], slack[sparse]))
    return [np.concatenate(x) for x in zip(*out, strict=True)] if out else None


def _pack(key, node, band, slack) -> bytes:
    """key is sorted and kept to 56 bits; nodes, bands and slacks go to a table of the distinct ones."""
    member = np.stack([node.view(np.int64), band.astype(np.int64) * (1 << 32) + np.maximum(slack, 0)], 1)
    table, at = np.unique(member, axis=0, return_inverse=True)
    raw = np.int64([len(key), len(table)]).tobytes() + planes(np.diff(key >> U64(8), prepend=U64(0))) + planes(at.reshape(-1).astype(np.uint32)) + planes(np.ascontiguousarray(table).reshape(-1))
    return squeeze(raw)


def _unpack(blob: bytes):
    raw = unsqueeze(blob)
    n, m = (int(x) for x in raw[:16].view(np.int64))
    key = np.cumsum(unplanes(raw[16:], n, U64), dtype=U64)
    at = unplanes(raw[16 + 8 * n :], n, np.uint32)
    table = unplanes(raw[16 + 12 * n :], 2 * m, np.int64).reshape(m, 2)
    return key, table[at, 0], table[at, 1]


#: Parity words that a task holds before it packs them: fewer, larger packs say the same in fewer bytes.
HELD = 3_000_000


def _packed(docs: DataFrame, text: str, width: int, buckets: int) -> DataFrame:
    """Parity words by range of the key, packed to a few bytes each: what the pigeonhole join shuffles."""

    def run(batches):
        held, size = [], 0

        def flush():
            key, node, band, slack = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(key, kind="stable")
            key, node, band, slack = key[order], node[order], band[order], slack[order]
            # The bucket is the key's place among `buckets` equal ranges, so each bucket is one slice.
            bucket = ((key >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int64)
            cut = np.flatnonzero(np.diff(bucket, prepend=-1))
            ends = np.append(cut[1:], len(key))
            return pa.RecordBatch.from_arrays([pa.array(bucket[cut], pa.int64()), pa.array([_pack(key[i:j], node[i:j], band[i:j], slack[i:j]) for i, j in zip(cut, ends, strict=True)], pa.binary())], ["bucket", "words"])

        for b in slices(batches, text, 4_000_000):
            n, node, doc, hashed, _ = sets(b, text, width)
            if (w := _words(n, node, doc, hashed)) is None:
                continue
            held.append((w[0], w[1], w[2].astype(np.int32), w[3].astype(np.int32)))
            size += len(w[0])
            if size > HELD:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    return docs.select(text).mapInArrow(run, "bucket long, words binary")


def _meet(hot: int):
    """Of a bucket: kind 0: candidates (a, b) and how many words they share, hot ones left out; kind 1: (word, node) of the hot words. info: band and slack, of a pair the greater."""

    def run(table: pa.Table) -> pa.Table:
        got = [_unpack(x.as_py()) for x in table.column("words")]
        key, node, info = (np.concatenate(x) for x in zip(*got, strict=True))
        del got
        key, node, info = _shared(key, node, info)
        order = np.lexsort((node, key))
        key, node, info = key[order], node[order], info[order]
        keep = np.ones(len(key), bool)
        keep[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
        key, node, info = key[keep], node[keep], info[keep]
        start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
        size = np.diff(np.append(start, len(key)))
        run_of = np.repeat(np.arange(len(start)), size)
        many = size[run_of] > hot
        star = np.flatnonzero(many)
        star = star[star != start[run_of[star]]]
        left, right, n = [start[run_of[star]]], [star], [np.zeros(len(star), np.int64)]
        few = np.flatnonzero(~many)
        for gap in range(1, hot):
            i = few[few + gap < len(key)]
            i = i[key[i] == key[i + gap]]
            if not len(i):
                break
            left.append(i)
            right.append(i + gap)
            n.append(np.ones(len(i), np.int64))
        left, right, n = np.concatenate(left), np.concatenate(right), np.concatenate(n)
        row = np.stack([node[left], node[right], np.maximum(info[left], info[right])], 1)
        row, of = np.unique(row, axis=0, return_inverse=True)
        shared = np.bincount(of.reshape(-1), weights=n, minlength=len(row)).astype(np.int64)
        kind = np.repeat([0, 1], [len(row), int(many.sum())])
        return pa.table({"kind": pa.array(kind, pa.int32()), "a": np.concatenate([row[:, 0], key[many].view(np.int64)]), "b": np.concatenate([row[:, 1], node[many]]), "info": np.concatenate([row[:, 2], info[many]]), "n": np.concatenate([shared, np.ones(int(many.sum()), np.int64)])})

    return run


def _shared(key, node, info):
    """Only words that occur at least twice."""
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    same = np.zeros(len(key), bool)
    same[1:] = sorted_key[1:] == sorted_key[:-1]
    same[:-1] |= same[1:]
    order = order[same]
    return key[order], node[order], info[order]


#: The filter that keeps unneeded sets out of the shuffle has at most so many bits, however many nodes are asked for.
FILTER_BITS = 1 << 27
_SEGMENT = 1 << 15


def _membership(nodes: DataFrame, count: int):
    """A Bloom filter of nodes as a broadcast array of bytes of bounded size; false hits only cost work."""
    bits = int(min(max(1 << (16 * max(count, 1)).bit_length(), _SEGMENT), FILTER_BITS))

    def places(x: np.ndarray) -> np.ndarray:
        h = mix(x.view(U64) if x.dtype != U64 else x)
        return np.stack([h % U64(bits), (h >> U64(20)) * U64(0x9E3779B97F4A7C15) >> U64(30)], 1) % U64(bits)

    def positions(batches):
        for b in batches:
            p = places(np.asarray(b.column(0)).astype(np.int64)).reshape(-1).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(p // _SEGMENT), pa.array(p % _SEGMENT)], ["segment", "bit"])

    marked = nodes.mapInArrow(positions, "segment long, bit long").groupBy("segment").agg(F.collect_set("bit").alias("bits")).toLocalIterator()
    out = np.zeros(bits // 8, np.uint8)
    for row in marked:
        p = row["segment"] * _SEGMENT + np.array(row["bits"], np.int64)
        np.bitwise_or.at(out, p // 8, np.left_shift(np.uint8(1), (p % 8).astype(np.uint8)))
    held = nodes.sparkSession.sparkContext.broadcast(out)

    def holds(x: np.ndarray) -> np.ndarray:
        p = places(x).astype(np.int64)
        return (held.value[p // 8] >> (p % 8).astype(np.uint8) & 1).all(1)

    return holds


def _elements(docs: DataFrame, nodes: DataFrame, count: int, text: str, width: int) -> DataFrame:
    """(node, elements) of the nodes asked for, and of some more."""
    holds = _membership(nodes, count)

    def run(batches):
        seen: set[int] = set()
        for b in slices(batches, text):
            n, node, doc, hashed, first = sets(b, text, width)
            at = []
            for i in np.flatnonzero((n > 0) & holds(node)):
                if int(node[i]) not in seen:
                    seen.add(int(node[i]))
                    at.append(i)
            if at:
                ends = np.concatenate(([0], np.cumsum(n[at]))).astype(np.int32)
                every = np.concatenate([hashed[first[i] : first[i] + n[i]] for i in at]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(node[at].view(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(every))], ["node", "elements"])

    # Exchanged once by node; both sides of a join on it share the exchange.
    return docs.select(text).mapInArrow(run, "node long, elements array<long>").dropDuplicates(["node"])


def _verified(docs: DataFrame, pairs: DataFrame, text: str, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets have 100 * intersection >= percent * union."""
    nodes = pairs.select("a").union(pairs.select("b")).distinct()
    count = nodes.count()
    if not count:
        return pairs.select("a", "b")
    found = _elements(docs, nodes, count, text, width)
    both = pairs.select("a", "b").join(found.toDF("a", "in_a"), "a").join(found.toDF("b", "in_b"), "b")
    common = F.size(F.array_intersect("in_a", "in_b"))
    return both.select("a", "b", common.alias("common"), (F.size("in_a") + F.size("in_b")).alias("sizes")).filter(100 * F.col("common") >= percent * (F.col("sizes") - F.col("common"))).select("a", "b")


#: Elements of the sets on either side of a tile; bounds its memory.
TILE = (1_000_000, 2_000_000)


def _tile(percent: int):
    """Links between the sets of role 0 and those of role 1 of other components, one for each set and component."""

    def run(table: pa.Table) -> pa.Table:
        role, node, component = (np.asarray(table.column(x)) for x in ("role", "node", "component"))
        column = table.column("elements").combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
        ends, every = np.asarray(column.offsets), np.asarray(column.values)
        size = np.diff(ends)
        right, left = np.flatnonzero(role == 1), np.flatnonzero(role == 0)
        out: list[tuple[int, int]] = []
        if len(left) and len(right):
            held = np.concatenate([every[ends[i] : ends[i + 1]] for i in right])
            known, code = np.unique(held, return_inverse=True)
            start = np.concatenate(([0], np.cumsum(size[right])[:-1]))
            for i in left:
                own = every[ends[i] : ends[i + 1]]
                at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                mark = np.zeros(len(known), np.int32)
                mark[at[known[at] == own]] = 1
                common = np.add.reduceat(mark[code], start)
                hit = np.flatnonzero((100 * common >= percent * (size[i] + size[right] - common)) & (component[right] != component[i]))
                _, one = np.unique(component[right[hit]], return_index=True)
                out += [(int(node[i]), int(node[right[k]])) for k in hit[one]]
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return run


def _across(docs: DataFrame, members: DataFrame, text: str, width: int, percent: int) -> DataFrame | None:
    """Links between components whose sets (word, node, band, component) still share a hot word."""
    least = members.groupBy("word").agg(F.min("node").alias("m"))
    clusters = connected_components(members.join(least, "word").select("node", "m").distinct(), "node", "m").withColumnRenamed("component", "cluster")
    bound = F.ceil(F.pow(F.lit(GROWTH), F.col("band") + 1) / 1.8)
    nodes = members.groupBy("node").agg(F.min("component").alias("component"), F.max(bound).alias("size")).join(clusters, "node")
    nodes = settled(nodes)
    if not (count := nodes.count()):
        return None
    parts = nodes.groupBy("cluster", "component").agg(F.sum("size").alias("size"))
    shape = parts.groupBy("cluster").agg(F.max_by("component", F.struct("size", "component")).alias("main"), F.sum("size").alias("all"), F.max("size").alias("most"))
    shape = shape.select("cluster", "main", F.ceil((F.col("all") - F.col("most")) / TILE[0]).cast("int").alias("n_left"), F.ceil(F.col("all") / TILE[1]).cast("int").alias("n_right"))
    placed = nodes.join(shape, "cluster")
    cut = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = placed.filter("component != main").select("cluster", "node", "component", F.lit(0).alias("role"), cut("n_left").alias("i"), every("n_right").alias("j"))
    right = placed.filter("n_left > 0").select("cluster", "node", "component", F.lit(1).alias("role"), cut("n_right").alias("j"), every("n_left").alias("i"))
    rows = left.unionByName(right).join(_elements(docs, nodes.select("node"), count, text, width), "node")
    return rows.groupBy("cluster", "i", "j").applyInArrow(_tile(percent), "a long, b long")


def links(docs: DataFrame, text: str = "text", width: int = 5, hot: int = 8) -> DataFrame:
    """Links (a, b) between nodes whose components are those of all links with Jaccard >= 0.8."""
    percent = 80
    buckets = partitions(docs.sparkSession)
    met = settled(_packed(docs, text, width, buckets).groupBy("bucket").applyInArrow(_meet(hot), "kind int, a long, b long, info long, n long").groupBy("kind", "a", "b", "info").agg(F.sum("n").alias("n")))
    band, slack = F.shiftright("info", 32), F.col("info").bitwiseAND(F.lit((1 << 32) - 1))
    members = met.filter("kind = 1").select(F.col("a").alias("word"), F.col("b").alias("node"), band.alias("band"), slack.alias("slack"))
    heat = settled(members.groupBy("node", "band").agg(F.count("*").alias("n_hot"), F.min("slack").alias("slack")))
    # A linked pair shares U - d words at least, of which as many may be hot as either has.
    pairs = met.filter("kind = 0").select("a", "b", "n", band.alias("band"), slack.alias("slack"))
    for side in ("a", "b"):
        pairs = pairs.join(heat.select(F.col("node").alias(side), "band", F.col("n_hot").alias(f"hot_{side}")), [side, "band"], "left")
    enough = F.col("n") + F.least(F.coalesce("hot_a", F.lit(0)), F.coalesce("hot_b", F.lit(0))) >= F.col("slack")
    pairs = settled(pairs.filter(enough).select("a", "b").distinct())
    found = settled(_verified(docs, pairs, text, width, percent))
    bound = heat.filter("n_hot >= slack").select("node", "band")
    members = members.join(bound, ["node", "band"], "left_semi").select("word", "node", "band")
    of = connected_components(found, "a", "b")
    members = members.join(of, "node", "left").select("word", "node", "band", F.coalesce("component", "node").alias("component"))
    split = members.groupBy("word").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("word")
    more = _across(docs, settled(members.join(split, "word", "left_semi")), text, width, percent)
    return found if more is None else found.union(more)


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 5) -> DataFrame:
    """One row for each row of docs: id, n_shingles, component_id (least id reachable by links, its own included).

    Null and empty texts, and texts of blanks only, have n_shingles 0 and their own id as component. Texts of under
    ``width`` words count as one element. Repeated rows are equal sets, hence linked. Further columns are ignored.
    A null id stays a row of its own; it never names a component while its class has another id.
    """
    # Read by fixed names: further columns of docs can't clash.
    docs = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    sizes = settled(set_sizes(docs, "id", "text", width))
    least = sizes.filter("node is not null").groupBy("node").agg(F.min("id").alias("id_min"))
    of = connected_components(links(docs, "text", width), "a", "b").withColumnRenamed("component", "root")
    rooted = least.join(of, "node", "left").select("node", "id_min", F.coalesce("root", "node").alias("root"))
    roots = rooted.groupBy("root").agg(F.min("id_min").alias("component_id"))
    named = rooted.join(roots, "root").select("node", "component_id")
    return sizes.join(named, "node", "left").select(F.col("id").alias(id_col), "n_shingles", F.coalesce("component_id", "id").alias("component_id"))
