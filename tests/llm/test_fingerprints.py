import hashlib

import numpy as np
import pyarrow as pa

from kinfold.llm import fingerprints as fp
from kinfold.llm._text import column_bytes

from .test_parity_join import elements


def bins(*texts):
    return fp.bins(column_bytes(pa.array(texts, pa.string())))


def test_estimate_is_close_and_equal_texts_agree():
    rng = np.random.default_rng(3)
    for share in (0.0, 0.02, 0.1, 0.5):
        a = [f"w{i}" for i in rng.integers(0, 9999, 900)]
        b = [w if rng.random() > share else "z" + w for w in a]
        values, has = bins(" ".join(a), " ".join(b))
        x, y = elements(" ".join(a)), elements(" ".join(b))
        assert abs(fp.likeness(values[:1], has[:1], values[1:], has[1:])[0] - len(x & y) / len(x | y)) < 0.09
    values, has = bins("one two", "one two", "", None, "three")
    assert list(has) == [True, True, False, False, True]
    assert (values[0] == values[1]).all() and fp.likeness(values[:1], has[:1], values[4:], has[4:])[0] < 0.3
    assert fp.likeness(values[2:3], has[2:3], values[3:4], has[3:4])[0] == 1
    text = fp.packed(values, has)
    assert text[2] == "" and (fp.unpacked(text[0]) == values[0]).all()


def expected(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    out = []
    for k, (i, t) in enumerate(rows):
        cut = len(t) // 4
        out.append((i, len(t), hashlib.sha256((t[: len(t) - cut] + rows[(k + 1) % len(rows)][1][:cut]).encode()).hexdigest()))
    return out


def test_next_document_over_many_ranges(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i), "".join(rng.choice(list("aé b\nß漢"), rng.integers(0, 60)))) for i in rng.permutation(300)]
    rows += [(7, "tie"), (7, "tie"), (None, "none"), (400, None), (500, "long " * 20_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7).withColumnRenamed("x", "bucket")
    got = [tuple(r)[:3] for r in fp.edited_fingerprints(df).collect()]
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])
    assert sorted(got, key=key) == sorted(expected(rows), key=key)


def test_one_row_and_no_row(spark):
    one = spark.createDataFrame([(1, "a b c d e f g h", 1)], "doc_id long, text string, last int")
    r = fp.edited_fingerprints(one).collect()
    assert len(r) == 1 and r[0]["near_next"] == 1 and (r[0]["doc_id"], r[0]["n_chars"], r[0]["edited_sha256"]) == expected([(1, "a b c d e f g h")])[0]
    assert fp.edited_fingerprints(one.limit(0)).count() == 0 and fp.fingerprints(one.limit(0)).count() == 0
