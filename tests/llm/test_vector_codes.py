"""Product codes against a plain version in unbounded integers."""

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from raterscope.llm import vector_codes as v

SCHEMA = "vec_id long, embedding array<float>, label int, id string, vector int, code string, error string, of int"


def plain(rows, parts=8, entries=16, rounds=6):
    """{(place): (code, error)} of the kept rows and the codebooks' digest."""
    kept = [(i, [float(x) for x in e], label) for i, e, label in rows if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    first = sorted((r for r in kept if r[1] and len(r[1]) % parts == 0), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not first:
        return [(r[0], None, None, None) for r in kept], hashlib.sha256(b"").hexdigest()
    size = len(first[0][1])
    width = size // parts
    whole = lambda e: [math.floor(x * 4096) if abs(x) < 2**53 else int(x) * 4096 for x in e]
    cut = lambda e, p: whole(e)[p * width : (p + 1) * width]
    fits = [r for r in kept if len(r[1]) == size]
    books = [[cut(e, p) for _, e, _ in [r for r in first if len(r[1]) == size][:entries]] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(book))
    for _ in range(rounds):
        new = []
        for p, book in enumerate(books):
            members = defaultdict(list)
            for _, e, _ in fits:
                members[near(cut(e, p), book)[1]].append(cut(e, p))
            new.append([[sum(c) // len(members[i]) for c in zip(*members[i])] if i in members else b for i, b in enumerate(book)])
        books = new
    found, by_label = [], defaultdict(int)
    for i, e, label in kept:
        if len(e) != size:
            found.append((i, None, None, label))
            continue
        best = [near(cut(e, p), books[p]) for p in range(parts)]
        error = sum(d for d, _ in best)
        by_label[label] += error
        found.append((i, "".join(f"{j:02x}" for _, j in best), error, label))
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(i, c, e, by_label.get(label)) for i, c, e, label in found], digest


def same(spark, rows):
    table = spark.createDataFrame([(*r, "x", 1, "y", "z", 2) for r in rows], SCHEMA).repartition(3)
    found = v.compress(table).collect()
    rows = [(i, None if e is None else np.array([math.nan if x is None else x for x in e], np.float32).tolist(), label) for i, e, label in rows]
    wanted, digest = plain(rows)
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in found), key=key) == sorted(wanted, key=key)
    assert {r["codebooks_sha256"] for r in found} <= {digest}


@pytest.mark.parametrize("seed", range(3))
def test_same_as_plain(spark, seed):
    draw = random.Random(seed)
    rows = [(i, [draw.choice([-1.0, -0.5, 0.25, draw.gauss(0, 1)]) for _ in range(16)], draw.choice([0, 1, None])) for i in range(60)]
    rows += [(i, rows[0][1], 0) for i in range(60, 90)] + rows[5:8]
    same(spark, rows)


def test_awkward_rows(spark):
    rows = [(i, [float((i * j) % 7) - 3 for j in range(8)], i % 2) for i in range(20)]
    rows += [(3, None, 1), (4, [1.0] * 7 + [None], 1), (5, [math.nan] * 8, 0), (6, [math.inf] * 8, 0), (7, [], 0), (8, [1.0] * 7, 1)]
    rows += [(None, [0.5] * 8, None), (None, [0.5] * 8, None), (9, [1e5] * 8, 1), (9, [-70000.25] * 8, 1), (2, [0.1] * 16, 0)]
    same(spark, rows)


def test_few_and_no_rows(spark):
    same(spark, [(1, [1.0, 2.0] * 4, None), (2, [1.0, 2.0] * 4, 1)])
    same(spark, [(1, [1.0], 1)])
    assert v.compress(spark.createDataFrame([], SCHEMA)).count() == 0


def test_an_error_beyond_64_bits_is_null(spark):
    rows = [(i, [float(i)] * 8, 0) for i in range(16)] + [(99, [3e30] + [0.0] * 7, 1), (100, [2.9e30] + [0.0] * 7, 1)]
    table = spark.createDataFrame([(*r, "x", 1, "y", "z", 2) for r in rows], SCHEMA)
    found = {r["vec_id"]: r["error"] for r in v.compress(table).collect()}
    assert found[99] is None and found[100] is None and found[3] is not None


@pytest.mark.parametrize("top", [3, 1 << 26, 1 << 60])
def test_search_finds_the_nearest_and_the_lower_index(top):
    rng = random.Random(top)
    for _ in range(30):
        entries = [[rng.randint(-top, top) for _ in range(3)] for _ in range(rng.randint(1, 16))]
        entries += entries[:2]
        parts = [[rng.randint(-top, top) for _ in range(3)] for _ in range(40)] + entries
        index, distance = v.EqualAverageSearch(entries).nearest(np.array(parts, object if top > 1 << 40 else np.int64))
        for part, i, d in zip(parts, index.tolist(), distance.tolist(), strict=True):
            assert (d, i) == min((sum((a - b) ** 2 for a, b in zip(part, e)), j) for j, e in enumerate(entries))


def test_decode_is_near(spark):
    rng = random.Random(1)
    table = spark.createDataFrame([(i, [rng.random() for _ in range(8)], 0) for i in range(50)], "vec_id long, embedding array<float>, label int")
    books = v.fit_codebooks(table)
    for row in v.encode(table, books).join(table.withColumnRenamed("vec_id", "id"), "id").collect():
        apart = [a - b for a, b in zip(v.decode(row["code"], books), row["embedding"], strict=True)]
        assert abs(sum(x * x for x in apart) * 4096**2 - row["error"]) < 5 * 4096
