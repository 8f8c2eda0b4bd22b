"""Queries without SQL, row by row against plain Python on the smallest tables."""

import zlib
from collections import Counter, defaultdict

import pyarrow.parquet as pq

from tidemark.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_shards_of_whole_documents(spark):
    docs = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    got = {r["doc_id"]: r for r in QUERIES["op7_histogram_sort"](spark, SF).collect()}
    assert set(got) == {d["doc_id"] for d in docs} and len(got) == len(docs)
    held, by_text, slots = Counter(), defaultdict(set), defaultdict(list)
    for d in docs:
        raw, r = (d["text"] or "").encode(), got[d["doc_id"]]
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        held[r["shard"]] += r["size"]
        by_text[raw].add(r["shard"])
        slots[r["shard"]].append(r["slot"])
    assert set(held) == set(range(8)) and all(len(s) == 1 for s in by_text.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    # no shard is further from the mean than the largest group of equal texts
    largest = max(sum(len(raw) + 1 for d in docs if (d["text"] or "").encode() == raw) for raw in by_text)
    mean = sum(held.values()) / 8
    assert all(abs(b - mean) <= largest for b in held.values())


def test_scores_learn_from_the_other_folds_only(spark):
    docs = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{SF}/labels.parquet").to_pylist()}
    got = {r["doc_id"]: r for r in QUERIES["op8_nb_svm"](spark, SF).collect()}
    assert set(got) == {d["doc_id"] for d in docs}
    right = n = 0
    for d in docs:
        r = got[d["doc_id"]]
        assert r["held_out"] == (zlib.crc32(str(d["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
        if r["held_out"] and d["doc_id"] in labels:
            n, right = n + 1, right + (r["predicted"] == labels[d["doc_id"]])
    assert n >= 10 and right / n >= 0.9
