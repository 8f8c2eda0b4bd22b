"""Prefix-free parsing, VA-file clustering and the filter audit against plain Python."""

import hashlib
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import audit, parsing, vafile

DOCS = "doc_id long, text string, lang string, tid string, key long, part string, mask int, ord long"


def docs_of(spark, rows):
    """(doc_id, text, lang) rows with columns whose names clash with inner ones."""
    return spark.createDataFrame([(i, t, g, "x", 1, "p", 7, 3) for i, t, g in rows], DOCS)


def plain_repeats(rows, window):
    """doc_id and text of one row each: (n_bytes, n_removed, n_spans, sha) by id."""
    seen, out = set(), {}
    for doc_id, text in sorted(rows, key=lambda r: r[0]):
        data = (text or "").encode()
        gone = np.zeros(len(data) + 1, dtype=bool)
        for i in range(len(data) - window + 1):
            s = data[i : i + window]
            if s in seen:
                gone[i : i + window] = True
            seen.add(s)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
        out[doc_id] = (len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def repetitive(seed, n):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    common = " ".join(word() for _ in range(30))
    texts = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.1:
            texts.append(rng.choice(["", "a", "x" * 150, "xy" * 90, "\0" * 70]))
        elif kind < 0.25 and texts:
            texts.append(rng.choice(texts))
        elif kind < 0.7:
            texts.append(" ".join(word() for _ in range(rng.randint(0, 9))) + common[rng.randint(0, 20) :] + word() * rng.randint(0, 5))
        else:
            texts.append(" ".join(word() for _ in range(60)))
    return list(enumerate(texts))


@pytest.mark.parametrize("window,group", [(20, 4_000), (20, 2), (7, 3), (100, 1)])
def test_parse_equals_plain_search(spark, window, group):
    rows = repetitive(window + group, 120)
    got = parsing.remove_repeated_bytes(docs_of(spark, [(i, t, "en") for i, t in rows]), window, group).collect()
    expected = plain_repeats(rows, window)
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == expected
    by_id = dict(rows)
    for r in got:  # the spans are those of the kept text
        data, at, kept = by_id[r["doc_id"]].encode(), 0, b""
        for s in r["removed"]:
            kept, at = kept + data[at : s["first"]], s["last"]
        assert hashlib.sha256(kept + data[at:]).hexdigest() == r["kept_sha256"]


def test_parse_of_long_texts_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(parsing, "PIECE", 1 << 10)
    rng = random.Random(3)
    long = "".join(rng.choice("abcdefgh") for _ in range(9_000))
    texts = [long.encode(), long[4_000:].encode(), b"q" * 5_000, b""]
    for text, (key, place, first, count) in zip(texts, parsing.phrases_of(texts, 50)):
        assert count.sum() == max(0, len(text) - 49)
        assert (np.diff(np.concatenate([[0], np.cumsum(count)]))[:] == count).all() and (first == np.cumsum(count) - count).all()
        assert ((place >= first + count - 1) & (place <= first + 50 - 20)).all()


def test_parse_nulls_ties_and_empty(spark):
    shared = "the same words stand here in every one of the texts"
    rows = [(None, shared, None), (None, None, None), (None, shared, None), (5, shared + " more", "x"), (5, shared + " less", "x"), (7, None, "y"), (7, None, "y")]
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"]) for r in parsing.remove_repeated_bytes(docs_of(spark, rows), 20).collect()]
    n = len(shared)
    assert sorted(g[1:] for g in got if g[0] is None) == [(0, 0), (n, n), (n, n)]
    assert sorted(g[2] for g in got if g[0] == 5) == [0, n + 1]  # one of the two follows the other
    assert [g for g in got if g[0] == 7] == [(7, 0, 0)] * 2
    assert parsing.remove_repeated_bytes(docs_of(spark, []), 20).count() == 0


def test_suffix_array_is_sorted():
    raw = [b"banana-banana", b"bananarama", b"cabanana"]
    phrase, offset, cls = parsing.suffix_array(raw, np.zeros(3, dtype=int), 5)
    strings = [raw[p][o : o + 5] for p, o in zip(phrase, offset)]
    assert strings == sorted(strings) and len(strings) == sum(len(r) - 4 for r in raw)
    assert [a == b for a, b in zip(strings, strings[1:])] == [a == b for a, b in zip(cls, cls[1:])]


def plain_kmeans(rows, k, rounds):
    vectors = [(i, tuple(math.floor(256 * float(x)) for x in v)) for i, v in rows]
    start = sorted(vectors, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in start[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    nearest = lambda v: min(range(len(centroids)), key=lambda c: (far(v, centroids[c]), c))
    for _ in range(rounds):
        groups = {}
        for _, v in vectors:
            groups.setdefault(nearest(v), []).append(v)
        for c, members in groups.items():
            centroids[c] = tuple(sum(x) // len(members) for x in zip(*members))
    return sorted(((str(i), nearest(v), far(v, centroids[nearest(v)])) for i, v in vectors)), centroids


@pytest.mark.parametrize("dimensions,k", [(64, 40), (3, 5)])
def test_va_file_equals_plain_kmeans(spark, dimensions, k):
    rng = random.Random(dimensions)
    rows = [(i, [rng.gauss(0, 0.2) + (i % 3) for _ in range(dimensions)]) for i in range(150)]
    rows += [rows[3], rows[3], (None, [0.25] * dimensions), (None, rows[5][1]), (900, [0.0] * dimensions), (901, [3.5] * dimensions)]
    bad = [(1000, None), (1001, []), (1002, [0.1] * (dimensions + 1)), (1003, [float("nan")] * dimensions), (1004, [float("inf")] + [0.0] * (dimensions - 1)), (1005, [None] + [0.1] * (dimensions - 1)), (1006, [1e30] * dimensions)]
    df = spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows + bad], "vec_id long, embedding array<double>, cluster int, v string, n long").repartition(5)
    got = vafile.cluster(df, k=k, dimensions=dimensions).collect()
    expected, centroids = plain_kmeans(rows, k, vafile.ROUNDS)
    assert sorted((str(r["vec_id"]), r["cluster"], r["distance"]) for r in got) == expected
    for r in got:
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, centroids[r["cluster"]])).encode()).hexdigest()
        assert r["cluster_inertia"] == sum(e[2] for e in expected if e[1] == r["cluster"]) and r["inertia"] == sum(e[2] for e in expected)
    assert vafile.cluster(df.filter("vec_id >= 1000"), k=k, dimensions=dimensions).count() == 0


def test_va_file_reads_few_full_vectors(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(i % 8, 0.05) for _ in range(16)]) for i in range(400)]
    found = vafile.kmeans(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), k=8, dimensions=16)
    assert found.fetched[0] == 1.0 and len(found.fetched) == vafile.ROUNDS + 1
    assert found.fetched[-1] < 0.5


def test_bounds_hold(spark):
    rng = np.random.default_rng(0)
    full = rng.integers(-50, 50, (300, 6))
    edges = np.sort(rng.integers(-50, 50, (6, 15)), axis=1)
    centroids = rng.integers(-60, 60, (7, 6))
    cells = np.stack([np.searchsorted(edges[j], full[:, j], side="right") for j in range(6)], axis=1)
    near, far = vafile.tables(centroids, edges, full.min(axis=0), full.max(axis=0))
    lower, upper = vafile.bounds(cells, near, far)
    exact = vafile.distances(full, centroids)
    assert (lower <= exact).all() and (exact <= upper).all()


def plain_audit(rows, labels):
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    docs = []
    for i, t, lang in rows:
        t = t or ""
        words, head = t.encode().split(), first.get(t)
        fails = "A" * (len(words) < 200) + "B" * (100 * len(set(words)) < 50 * len(words)) + "C" * (100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t))
        fails += "D" * any(c in "#$%&*|" for c in t) + "E" * (head is not None and (i is None or i > head))
        mine = [x for x in labels if x[0] is not None and x[0] == i]
        docs.append((lang or "", fails, any(x[1] == 1 for x in mine), any(x[2] == 1 for x in mine)))
    out = {}
    for part in {d[0] for d in docs}:
        here = [d for d in docs if d[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in map("".join, itertools.permutations("ABCDE")):
            for step in range(1, 6):
                f, before = order[step - 1], set(order[: step - 1])
                gone = lambda d: bool(before & set(d[1]))  # noqa: E731, B023
                removed = [d for d in here if not gone(d) and f in d[1]]
                shapley[f] += len(removed)
                out[part, order, step] = [
                    sum(not gone(d) and f not in d[1] for d in here), len(removed), sum(gone(d) and f in d[1] for d in here),
                    sum(d[1] == f for d in here), sum(d[2] for d in removed), sum(d[3] for d in removed),
                ]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return out


def test_audit_equals_plain_count(spark):
    rng = random.Random(4)
    texts = [None, "", "a b " * 150, "X" * 9, "long words " + " ".join(map(str, range(250))), "a # b", " ".join(map(str, range(201))) + " $", "Ä é ü" * 70]
    rows = [(rng.choice([None, *range(40)]), rng.choice(texts), rng.choice(["en", "de", None, ""])) for _ in range(90)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in [None, *range(0, 40, 2), 2, 4]]
    marks = spark.createDataFrame([(*x, "p", 3) for x in labels], "doc_id long, quality int, toxic int, part string, mask int")
    got = audit.audit(docs_of(spark, rows), marks).collect()
    assert len(got) == 600 * len({r[2] or "" for r in rows})
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    assert {(r["part"], r["filter_order"], r["step"]): [r[n] for n in names] for r in got} == plain_audit(rows, labels)
    assert audit.audit(docs_of(spark, []), marks).count() == 0
    nobody = audit.audit(docs_of(spark, rows), marks.limit(0))
    assert nobody.agg(F.max("good_lost"), F.max("toxic_lost")).first()[:] == (0, 0)


def test_packed_fields_do_not_overflow(spark):
    outcomes, removals = audit.packed(0b10101)
    n = (1 << 62) + 12_345
    fields = audit.unpack(n * outcomes, 600 * 3)
    assert set(fields.tolist()) == {0, n} and len(audit.steps()) == 600
    assert (audit.unpack(n * removals, 600) == fields.reshape(-1, 3)[:, 1]).all()
