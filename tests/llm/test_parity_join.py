import random
import re

from kinfold.llm import parity_join

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def elements(text):
    words = SPLIT.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    if len(words) < 5:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def brute(rows):
    sets = [(i, elements(t)) for i, t in rows]
    root = {k: k for k in range(len(sets))}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        least[find(k)] = min(i, least.get(find(k), i))
    return sorted((i, len(s), least[find(k)]) for k, (i, s) in enumerate(sets))


def result(spark, rows, schema="doc_id long, text string"):
    df = spark.createDataFrame(rows, schema)
    return sorted(tuple(r) for r in parity_join.jaccard_components(df).collect())


def noisy(rng, words, share):
    return [w if rng.random() > share else f"x{rng.randrange(999)}" for w in words]


def test_matches_brute_force_with_groups_of_copies(spark):
    rng = random.Random(5)
    rows = []
    for g in range(40):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([1, 3, 5, 8, 9, 14, 30, 90, 300]))]
        for _ in range(rng.choice([1, 2, 3, 12])):
            rows.append((len(rows), " ".join(noisy(rng, base, rng.choice([0, 0.005, 0.02, 0.05])))))
    # A large near-copy group (hot words) whose members differ by a few words each, and a passage that many share.
    base, passage = [f"v{i}" for i in range(200)], " ".join(f"p{i}" for i in range(60))
    for i in range(60):
        near = list(base)
        for _ in range(rng.randrange(7)):
            near[rng.randrange(200)] = f"q{rng.randrange(9)}"
        rows.append((len(rows), " ".join(near)))
        rows.append((len(rows), passage + " " + " ".join(f"o{rng.randrange(9999)}" for _ in range(60))))
    assert result(spark, rows) == brute(rows)


def test_nulls_empty_ties_and_long_texts(spark):
    long = " ".join(f"t{i}" for i in range(50_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "one  TWO"), (5, "one two"), (6, long), (7, long + " end"), (8, "é ß"), (9, "É ß")]
    assert result(spark, rows) == brute(rows)


def test_empty_table_and_clashing_columns(spark):
    assert result(spark, []) == []
    df = spark.createDataFrame([(1, "a b c d e f", 7, 8), (2, "a b c d e f", 7, 8)], "doc_id long, text string, node long, component long")
    assert sorted(tuple(r) for r in parity_join.jaccard_components(df).collect()) == [(1, 2, 1), (2, 2, 1)]


def test_small_tables_of_the_driver(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert sorted(tuple(r) for r in parity_join.jaccard_components(docs).collect()) == brute([tuple(r) for r in docs.select("doc_id", "text").collect()])
