import random
import re

from kinfold.llm import line_dedup

CUT = re.compile(r"(?<=\n)|(?<=[.!?][ \t])")


def cut(text):
    return [p for p in CUT.split(text or "") if p]


def sentence(rng, n=9):
    return " ".join(f"w{rng.randrange(10**6)}" for _ in range(n)) + ". "


def run(spark, rows, schema="doc_id long, text string"):
    return sorted((tuple(r) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, schema).repartition(3)).collect()), key=lambda r: (r[0] is not None, r[0] or 0))


def test_planted_passages_go_and_the_rest_stays(spark):
    rng = random.Random(2)
    passages = ["".join(sentence(rng) for _ in range(7)).strip() for _ in range(4)]
    rows, want = [], []
    for i in range(120):
        own = [sentence(rng) for _ in range(rng.randrange(3, 30))]
        k = i % 9
        text = "".join(own[:3]).strip() + "\n" + (passages[k] + "\n" if k < 4 else "") + "".join(own[3:])
        rows.append((i, text))
        want.append((i, text if i < 9 or k >= 4 else text.replace(passages[k] + "\n", "")))
    assert [(r[0], r[1]) for r in run(spark, rows)] == want


def test_repeat_inside_a_line_and_short_repeats(spark):
    rng = random.Random(3)
    passage = "".join(sentence(rng, 12) for _ in range(6)).strip()
    a = "left part " + passage + " right part " + sentence(rng)
    b = "other start " + passage + " other end " + sentence(rng)
    short = "All rights reserved.\nA second line here.\n"
    out = run(spark, [(1, a + "\n" + short), (2, b + "\n" + short), (3, short)])
    assert out[0][1] == a + "\n" + short and out[2][1] == short
    assert passage not in out[1][1] and out[1][1].startswith("other start ") and out[1][1].endswith(short) and out[1][2] >= 48


def test_copies_ties_nulls_and_long_texts(spark):
    rng = random.Random(4)
    text = "".join(sentence(rng) for _ in range(10))
    line = "one line that a junk page repeats again and again without end\n"
    rows = [(1, text), (2, text), (3, None), (4, ""), (5, " \n\n"), (6, text), (6, text), (7, line * 20_000), (8, "x " * 50_000), (None, "y. z")]
    out = run(spark, rows)
    assert len(out) == len(rows)
    got = {}
    for r in out:
        got.setdefault(r[0], []).append(r[1])
    assert got[1] == [text] and got[2] == [""] and got[3] == [None] and got[4] == [""] and got[5] == [" \n\n"] and got[6] == ["", ""]
    assert len(got[7][0]) < 5 * len(line) and got[7][0].startswith(line) and got[8] == ["x " * 50_000] and got[None] == ["y. z"]


def test_empty_and_clashing_columns(spark):
    assert run(spark, []) == []
    df = spark.createDataFrame([(1, "a b", 5, "q")], "doc_id long, text string, g int, rid string")
    assert [tuple(r) for r in line_dedup.dedup_lines(df).collect()] == [(1, "a b", 5, "q", 0, 0)]


def test_native(spark, sf_dir):
    df = line_dedup.dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    before = {r[0]: r[1] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    seen = set()
    for r in sorted(df.select("doc_id", "text", "removed_words").collect()):
        p = [x.strip() for x in cut(before[r[0]])]
        if not r[2]:
            assert r[1] == before[r[0]]
        else:  # what goes was there before
            left = cut(r[1])
            gone = list(p)
            for x in left:
                gone.remove(x.strip())
            own = {}
            for x in p:
                own[x] = own.get(x, 0) + 1
            assert all(x in seen or own[x] > 1 for x in gone)
        seen.update(p)


def brute(rows, min_words):
    """Deletes from each text the runs of pieces, maximal by alignment, that an earlier text holds or the same one before, if long enough."""
    texts = [(i, [p for p in CUT.split(t or "")]) for i, t in rows]
    bare = [[p.strip(" \t\r\n\x0b\f") for p in ps] for _, ps in texts]
    out = []
    for k, (_, pieces) in enumerate(texts):
        gone = [False] * len(pieces)
        for j in range(k + 1):
            for far in range(-len(bare[j]) + 1, len(pieces)):
                if j == k and far <= 0:
                    continue
                i = max(far, 0)
                while i < len(pieces) and i - far < len(bare[j]):
                    n = i
                    while n < len(pieces) and n - far < len(bare[j]) and bare[k][n] == bare[j][n - far]:
                        n += 1
                    if n > i and sum(len(x.split()) for x in bare[k][i:n]) >= min_words and any(bare[k][i:n]):
                        gone[i:n] = [True] * (n - i)
                    i = max(n, i + 1)
        out.append("".join(p for p, g in zip(pieces, gone, strict=True) if not g))
    return out


def test_runs_equal_brute_force_and_stay_aligned(spark):
    rng = random.Random(6)
    a, b, c, d = (sentence(rng, 9) for _ in range(4))
    # No earlier text has the run ABCD, and its pairs are short of 25 words each: nothing goes.
    rows = [(1, a + b), (2, b + c), (3, c + d), (4, a + b + c + d)]
    assert [r[1] for r in run(spark, rows)] == [t for _, t in rows]
    # Passages of fresh sentences, each planted whole in several texts, between own ones of any length.
    passages = ["".join(sentence(rng, rng.choice((3, 9, 14, 30))) for _ in range(rng.randrange(1, 8))) for _ in range(8)]
    rows = []
    for i in range(60):
        parts = [sentence(rng, rng.randrange(1, 25)) for _ in range(rng.randrange(0, 6))] + rng.sample(passages, rng.randrange(0, 3))
        rng.shuffle(parts)
        rows.append((i, "".join(parts).strip() or None))
    assert [r[1] or "" for r in run(spark, rows)] == brute(rows, 25)


def test_every_repeated_line_goes_without_a_least_length(spark):
    rows = [(1, "One here.\nAll rights reserved.\n"), (2, "Two there.\nAll rights reserved.\n"), (3, "All rights reserved.\nno\nno\n\n")]
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), min_words=0)
    assert sorted((r[0], r[1]) for r in out.collect()) == [(1, rows[0][1]), (2, "Two there.\n"), (3, "no\n\n")]


def test_hot_route_gives_the_same(spark, monkeypatch):
    rng = random.Random(7)
    passage = "".join(sentence(rng) for _ in range(5))
    rows = [(i, sentence(rng, 7) + passage * (1 + i % 2) + sentence(rng, 4)) for i in range(40)]
    plain = run(spark, rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    every = [r["g"] for r in line_dedup.fingerprints(df, "doc_id", "text").select("g").distinct().collect()]
    monkeypatch.setattr(line_dedup, "_hot", lambda *a: every[::2])
    assert run(spark, rows) == plain
