"""The corpus operators on small tables with nulls, ties, repeated rows and clashing names, against brute force."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tidemark.llm import arrow_ids, bagminhash, components, decontaminate, exact, linejoin, packing, quality, shard, suffix, warc
from tidemark.llm.queries import VOCABULARY
from tidemark.llm.wordbpe import Encoder
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _text_key string, ord string, id string, rank string, shard string"


def _corpus():
    r = random.Random(5)
    word = lambda: "".join(r.choice(["ab", "ra", "ka", "lo", "mi", "su"]) for _ in range(r.randint(1, 4)))
    base = [word() for _ in range(120)]
    near = base[:]
    near[60] = "changed"
    passage = " ".join(word() for _ in range(70))
    texts = [
        " ".join(base), " ".join(base), "  ".join(near), None, "", " \n\t ", "one", "a b c d", "a b c d\na b c d e\na b c d",
        f"start {passage} end", f"other {passage}\tmore words here", " ".join(word() for _ in range(9000)), "ÄÖ ß naïve <|endoftext|> x́ 你好",
        "for " * 300, " ".join(reversed(base)),
    ]
    rows = [(i, t, "en", "s", len(t or ""), "x", "x", "x", "x", "x") for i, t in enumerate(texts)]
    return rows + [rows[0], (None, " ".join(base), None, None, None, None, None, None, None, None), (None, None, *[None] * 8)]


@pytest.fixture(scope="module")
def rows():
    return _corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


LAST = 1 << 62


def test_encoder_equals_library(rows):
    library, mine = Tokenizer.from_file(VOCABULARY), Encoder(VOCABULARY)
    texts = [r[1] or "" for r in rows] + ["It's 12½ o'clock!'s\x0b\x85\xa0Ünï \x1c…", "!!'LL'd #$%&", "İstanbul Σ"]
    expected = [np.array(library.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
    assert list(mine.encode(texts)) == expected
    assert mine.plain


def test_substring_dedup(docs, empty, rows):
    got = suffix.remove_repeats(docs).collect()
    words = [((LAST if r[0] is None else r[0]), (r[1] or "").encode().split()) for r in rows]
    first = {}
    for i, w in words:
        for k in range(len(w) - 49):
            key = tuple(w[k : k + 50])
            first[key] = min(first.get(key, i), i)
    expected = []
    for (i, w), r in zip(words, rows):
        gone = {k + j for k in range(len(w) - 49) if first[tuple(w[k : k + 50])] < i for j in range(50)}
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        expected.append((r[0], len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    key = lambda t: tuple(str(x) for x in t)
    assert sorted(((r[0], r[1], r[2], r[3]) for r in got), key=key) == sorted(expected, key=key)
    assert suffix.remove_repeats(empty).count() == 0


def test_hot_prefixes_give_the_same(docs, monkeypatch):
    once = sorted(map(str, suffix.remove_repeats(docs).collect()))
    monkeypatch.setattr(suffix, "GROUP", 1)
    assert sorted(map(str, suffix.remove_repeats(docs).collect())) == once


def test_warc_salvage(spark, tmp_path):
    page = lambda i, html: (i, f"http://a/{i} b", html, "extra")
    rows = [page(3, "x" * 200), page(1, "x" * 200), page(2, "short"), page(4, "short"), page(5, None), page(None, "x" * 200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string").repartition(1)
    manifest = warc.write_archives(pages, str(tmp_path))
    got = {r["page_id"]: r for r in warc.read_archives(spark, manifest).collect()}
    assert got[1]["record_type"] == "response" and got[3]["refers_to"] == 1 and got[None]["refers_to"] == 1
    assert got[2]["record_type"] == got[4]["record_type"] == "response" and got[5]["payload_bytes"] == 0
    assert got[3]["payload_bytes"] == 200 and got[3]["payload_digest"] == hashlib.sha256(b"x" * 200).hexdigest()
    path = max((r["n_records"], r["path"]) for r in manifest.collect())[1]
    raw = bytearray(open(path.removeprefix("file:"), "rb").read())
    plain = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"
    starts = [r["offset"] for r in warc.read_archives(spark, spark.createDataFrame([(path,)], "path string")).orderBy("offset").collect()]
    raw[starts[1] + 20] ^= 0xFF  # a damaged member
    broken = tmp_path / "broken.warc.gz"
    broken.write_bytes(b"junk" + bytes(raw) + plain + b"\x1f\x8b\x08tail")
    found = warc.read_archives(spark, spark.createDataFrame([(str(broken),)], "path string")).orderBy("offset").collect()
    gaps = [(r["offset"], r["length"]) for r in found if r["kind"] == "gap"]
    assert gaps[0] == (0, 4) and gaps[1][0] == starts[1] + 4 and gaps[-1] == (4 + len(raw) + len(plain), 7)
    assert sum(r["kind"] == "record" for r in found) == len(starts) and 99 in {r["page_id"] for r in found}
    assert sum(r["length"] for r in found) == broken.stat().st_size
    assert warc.read_archives(spark, warc.write_archives(pages.limit(0))).count() == 0


def test_line_dedup(docs, empty, rows):
    got = linejoin.repeated_lines(docs).collect()
    distinct = {(LAST if r[0] is None else r[0], r[1] or "") for r in rows}
    by_text = {(LAST if r["doc_id"] is None else r["doc_id"], r["n_lines"]): set(r["removed_lines"]) for r in got if r["doc_id"] is not None}
    lines = [(i, k, frozenset(line.encode().split())) for i, t in distinct for k, line in enumerate(t.split("\n"))]
    for i, t in distinct:
        if i == LAST:
            continue
        gone = {
            k for j, k, s in lines if j == i and s and any((a, b) < (i, k) and u and len(u & s) * 5 >= len(u | s) * 4 for a, b, u in lines)
        }
        assert by_text[i, t.count("\n") + 1] == gone
    assert len(got) == len(rows) and linejoin.repeated_lines(empty).count() == 0
    cleaned = linejoin.without_repeated_lines(docs)
    assert cleaned.columns == docs.columns and cleaned.count() == len(rows)
    assert {r["text"] for r in cleaned.filter("doc_id = 8").collect()} == {""}


def test_line_groups_make_no_pairs(spark, monkeypatch):
    # 60 similar lines whose rarest shared tokens lead to an earlier line that is not similar
    size, common, others = 60, [f"a{i}" for i in range(16)], [f"h{i}" for i in range(17)]
    texts = [(0, " ".join(["r1", "r2", "r3", *others]))]
    texts += [(1 + i, " ".join(["r1", "r2", "r3", *common, f"u{i}"])) for i in range(size)]
    texts += [(1000 + i, "\n".join(" ".join((common + others)[j : j + 3]) for j in range(0, 33, 3))) for i in range(size)]
    written, settle = [], linejoin.settle

    def counted(df, label):
        out = settle(df, label)
        written.append(out.count())
        return out

    monkeypatch.setattr(linejoin, "settle", counted)
    got = {r["doc_id"]: r["removed_lines"] for r in linejoin.repeated_lines(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got[0] == got[1] == got[1000] == [] and all(got[i] == [0] for i in range(2, 1 + size))
    assert all(got[1000 + i] == list(range(11)) for i in range(1, size))
    assert max(written) <= 1000  # a pair of each two would be 1,770


def test_line_joins_shuffle_their_rows_once(spark, monkeypatch):
    plans, settle = [], linejoin.settle

    def planned(df, label):
        if label in ("similar-lines", "shared-tokens"):
            df.collect()
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return settle(df, label)

    monkeypatch.setattr(linejoin, "settle", planned)
    texts = [(i, " ".join(f"w{(i // 2 * 7 + k) % 90}" for k in range(12 + i % 3)) + "\na b c") for i in range(40)]
    with linejoin._set(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        linejoin.repeated_lines(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    joins = [plan.split("== Initial Plan ==")[0] for plan in plans if "LeftSemi" in plan]
    assert len(joins) > 2 and all("ReusedExchange" in plan for plan in joins)


def test_line_sets_are_in_the_next_class_only_if_a_set_there_can_be_similar(spark):
    rows = [(i, n, 0, 0, list(range(n - -(-4 * n // 5) + 1))) for i, n in enumerate((10, 12, 13, 15))]
    filed = linejoin._filed(spark.createDataFrame(rows, "id long, n int, parity_0 long, parity_1 long, prefix array<int>"))
    own = {i: len(r) for i, *_, r in rows}
    got = {r["id"]: r["count"] for r in filed.groupBy("id").count().collect()}
    assert got[0] > own[0] and got[1] > own[1] and got[2] == own[2] and got[3] > own[3]  # 13 to 16 are one class


def test_line_dedup_near_the_threshold(spark):
    draw, lines = random.Random(11), []
    for _ in range(30):
        base = [f"t{draw.randrange(400)}" for _ in range(draw.randrange(4, 60))]
        for _ in range(draw.randrange(1, 9)):
            kept = [w for w in base if draw.random() > 0.08] + [f"t{draw.randrange(400)}" for _ in range(draw.randrange(0, 1 + len(base) // 6))]
            lines.append(draw.choice([" ", "\t", "  ", "\r "]).join(draw.sample(kept, len(kept))))
    draw.shuffle(lines)
    sets = [frozenset(line.split()) for line in lines]
    texts = [(i // 4, "\n".join(lines[i : i + 4])) for i in range(0, len(lines), 4)]
    gone = {i for i, s in enumerate(sets) if s and any(u and len(u & s) * 5 >= len(u | s) * 4 for u in sets[:i])}
    got = linejoin.repeated_lines(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert {4 * r["doc_id"] + i for r in got for i in r["removed_lines"]} == gone and len(gone) > 20


def test_near_duplicates(docs, empty, rows):
    got = bagminhash.near_duplicates(docs).collect()
    bags = []
    for r in rows:
        w = (r[1] or "").encode().split()
        bags.append(Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else ["none"]))
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (bags[i] & bags[j]).total() >= 0.8 * (bags[i] | bags[j]).total():
                root = [root[j] if x == root[i] else x for x in root]
    ids = [LAST if r[0] is None else r[0] for r in rows]
    heads = Counter((r[0], min(i for i, x in zip(ids, root) if x == k), sum(x == k for x in root)) for r, k in zip(rows, root))
    assert Counter((r["doc_id"], r["class_id"], r["class_size"]) for r in got) == heads
    assert bagminhash.near_duplicates(empty).count() == 0
    kept = bagminhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted({h for _, h, _ in heads})


def test_register_agreement_is_unbiased():
    draw = np.random.default_rng(1)
    close = []
    for _ in range(20):
        items = draw.integers(0, 1 << 62, 200).astype(np.uint64)
        a, b = draw.integers(0, 9, 200), draw.integers(0, 9, 200)
        owner = np.concatenate([np.zeros((a > 0).sum(), int), np.ones((b > 0).sum(), int)])
        found = bagminhash.signatures(owner, np.concatenate([items[a > 0], items[b > 0]]), np.concatenate([a[a > 0], b[b > 0]]), 2)
        close.append((found[0] == found[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(close)) < 0.03


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 101)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({got[i] for i in range(41)}) == 1 and got[100] == got[101] == got[200] != got[0]


def test_decontamination(spark, docs, empty):
    r = random.Random(3)
    item = [f"w{r.randint(0, 400)}" for _ in range(36)]
    paraphrase = [w if i % 4 or i > 30 else "other" for i, w in enumerate(item)]
    fill = lambda n: " ".join(f"f{r.randint(0, 900)}" for _ in range(n))
    texts = [(1, f"{fill(50)} {' '.join(item).upper()}, {fill(20)}"), (2, f"{fill(9)} {' '.join(paraphrase)} {fill(70)}"), (3, fill(300)), (4, None), (5, "")]
    # a latent space needs a corpus: background in which the item's words occur as well
    mixed = lambda: " ".join(r.choice([f"f{r.randint(0, 900)}", f"w{r.randint(0, 400)}"]) for _ in range(150))
    texts += [(100 + i, mixed()) for i in range(300)]
    corpus = spark.createDataFrame(texts, "doc_id long, text string")
    bench = spark.createDataFrame([(9, " ".join(item), "x"), (10, None, "x"), (None, "q", "x"), (11, "f1 f2 f3", "x")], "item_id long, text string, doc_id string")
    hits = {(h["doc_id"], h["item_id"]): h for h in decontaminate.contaminated(corpus, bench).collect()}
    assert hits[1, 9]["common"] == 1.0 and (2, 9) in hits and {d for d, i in hits if i == 9} == {1, 2}
    assert decontaminate.contaminated(empty, bench).count() == 0 and decontaminate.contaminated(corpus, bench.limit(0)).count() == 0
    left = decontaminate.clean(docs, bench)
    assert left.columns == docs.columns and left.count() == docs.count()


def _longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        row_, row = row, [0]
        for j, y in enumerate(b):
            row.append(row_[j] + 1 if x == y else max(row_[j + 1], row[j]))
    return row[-1]


def test_decontamination_of_long_items_equals_brute_force(spark):
    r = random.Random(8)
    names = [f"w{i}" for i in range(3000)]
    odds = [1 / (i + 5) for i in range(3000)]
    text = lambda n: r.choices(names, odds, k=n)
    swapped = lambda ws: [w if i % 4 or i > len(ws) - 8 else "other" for i, w in enumerate(ws)]  # noqa: E731  three in four words, and the answer
    longer = lambda ws: [x for i, w in enumerate(ws) for x in ([w, "well"] if i % 3 == 0 else [w])]
    items = {k: text(n) for k, n in enumerate([40, 59, 100] + [150, 180, 250, 400] * 3)}
    planted = [(k, how(item)) for k, item in items.items() for how in (list, swapped, longer)]
    texts = {i: text(r.randint(0, 90)) + part + text(r.randint(0, 90)) for i, (_, part) in enumerate(planted)}
    texts |= {1000 + i: text(150) for i in range(300)}
    texts |= {2000 + k: item[: len(item) // 3] + text(60) for k, item in items.items()}  # too little of an item
    expected = {}
    for d, ws in texts.items():
        for k, item in items.items():
            masks = decontaminate.Item._masks(item)
            if decontaminate.common_subsequence(masks, len(item), ws) >= 0.55 * len(item):
                share = _longest_common(item, ws) / len(item)
                if share >= 0.8 or share >= 0.6 and _longest_common(item[-5:], ws) >= 4:
                    expected[d, k] = share
    assert {(i, k) for i, (k, _) in enumerate(planted)} <= set(expected)
    corpus = spark.createDataFrame([(d, " ".join(ws)) for d, ws in texts.items()], "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame([(k, " ".join(ws)) for k, ws in items.items()], "item_id long, text string")
    hits = {(h["doc_id"], h["item_id"]): h["common"] for h in decontaminate.contaminated(corpus, bench).collect()}
    assert hits.keys() == expected.keys() and all(hits[p] <= expected[p] for p in hits)
    assert all(hits[i, k] == 1.0 for i, (k, part) in enumerate(planted) if part == items[k])


def test_exact_dedup(docs, empty, rows):
    got = exact.deduplicate(docs.filter("doc_id < 3"), docs.filter("doc_id >= 3 or doc_id is null")).collect()
    norm = lambda t: bytes(b for b in (t or "").encode() if b not in b" \t\n\v\f\r")
    groups = {}
    for r in rows:
        groups.setdefault(hashlib.sha256(norm(r[1])).hexdigest(), []).append((-len(r[1] or ""), LAST if r[0] is None else r[0]))
    assert len(got) == len(rows)
    for h, members in groups.items():
        mine = [g for g in got if g["text_sha256"] == h]
        assert {(g["keep_id"], g["group_size"]) for g in mine} == {(min(members)[1] if min(members)[1] != LAST else None, len(members))}
        assert sum(g["kept"] for g in mine) == 1
    assert exact.deduplicate(empty, empty).count() == 0 and exact.deduplicate(empty, docs).count() == len(rows)


@pytest.mark.parametrize("n", [0, 1, 2, 5, 100, 5000])
def test_fuse_filter(n):
    keys = np.random.default_rng(n).integers(0, 1 << 62, n).astype(np.uint64)
    built = exact.build_filter(keys)
    assert exact.passes(keys, *built).all()
    other = np.random.default_rng(n + 1).integers(0, 1 << 62, 20_000).astype(np.uint64)
    assert exact.passes(other, *built).mean() < 0.02


def test_histogram_sort(spark, empty):
    r = random.Random(2)
    rows = [(i, r.choice([7, r.randint(-(1 << 62), 1 << 62)]), r.randint(1, 50), "x") for i in range(3000)] + [(None, None, None, "x")] * 2
    df = spark.createDataFrame(rows, "i long, k long, n long, _part string").drop("_part")
    got = shard.histogram_sort(df, F.col("k"), F.col("i"), F.col("n"), shards=8, parts=3).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for g in got:
        sizes[g["shard"]] += g["n"] or 0
    assert len(sizes) == 8 and max(sizes.values()) - min(sizes.values()) <= 0.05 * sum(sizes.values()) / 8
    for s in range(8):
        assert sorted(g["slot"] for g in got if g["shard"] == s) == list(range(sum(g["shard"] == s for g in got)))
    order = sorted(got, key=lambda g: (g["shard"], g["slot"]))
    keys = [(-(1 << 63) if g["k"] is None else g["k"], -1 if g["i"] is None else g["i"]) for g in order]
    assert keys == sorted(keys)
    assert shard.histogram_sort(df.limit(0), F.col("k"), F.col("i"), F.col("n"), shards=8).count() == 0


@pytest.mark.parametrize("found", [[], [0], [254, 255, 256, 511, 32767], [32767], list(range(300))])
def test_packed_indicators(found):
    assert quality.unpack(quality.pack(np.array(found, dtype=np.uint16))).tolist() == found


def test_quality(spark, docs, empty):
    r = random.Random(1)
    good = lambda: " ".join(r.choice(["the", "house", "of", "green", "river"]) for _ in range(40))
    bad = lambda: " ".join(r.choice(["###", "x|y", "$$$", "%%"]) for _ in range(40))
    rows = [(i, good() if i % 3 else bad()) for i in range(400)] + [(None, good()), (999, None), (998, "")]
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), None) for i in range(400)] + [(1, 1, None), (None, 0, None), (5, None, None)], "doc_id long, quality int, toxic int")
    got = {x["doc_id"]: x for x in quality.classify(texts, labels).collect()}
    assert len(got) == len(rows) and got[None]["held_out"] is False
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in range(400))
    assert sum(got[i]["predicted"] == int(i % 3 > 0) for i in range(400) if got[i]["held_out"]) >= 0.97 * sum(got[i]["held_out"] for i in range(400))
    assert quality.classify(empty, labels).count() == 0
    assert {x["score"] for x in quality.classify(texts, labels.limit(0)).collect()} == {0.5}
    assert quality.keep_good(docs, labels).columns == docs.columns


def test_packing(docs, empty, rows):
    got = packing.pack(docs, VOCABULARY, capacity=64, groups=8).collect()
    library = Tokenizer.from_file(VOCABULARY)
    pieces = Counter()
    for r in rows:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids + [1]
        for n, at in enumerate(range(0, len(ids), 64)):
            part = ids[at : at + 64]
            pieces[r[0], n, at, len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes())] += 1
    assert Counter(tuple(g[:5]) for g in got) == pieces
    held = {}
    for g in got:
        held.setdefault(g["sequence_id"], []).append((g["offset"], g["length"]))
    for spans in held.values():
        spans.sort()
        assert [o for o, _ in spans] == [sum(n for _, n in spans[:i]) for i in range(len(spans))] and sum(n for _, n in spans) <= 64
    assert len(held) <= math.ceil(sum(g["length"] for g in got) / 64) + 3
    assert packing.pack(empty, VOCABULARY).count() == 0


def test_configurations_cover_the_demand():
    sizes, demand = np.array([70, 51, 34, 20]), np.array([13, 40, 77, 5])
    found = packing.configurations(sizes, demand, 100)
    assert all((p * sizes).sum() <= 100 for p, _ in found) and (sum(p * n for p, n in found) >= demand).all()
    assert sum(n for _, n in found) <= math.ceil((sizes * demand).sum() / 100) + 20


def test_arrow_ids(spark, docs, empty, rows):
    manifest = arrow_ids.write_ids(docs, VOCABULARY, seq_len=32, batch_rows=2)
    got = arrow_ids.read_documents(spark, manifest).collect()
    library, expected, start = Tokenizer.from_file(VOCABULARY), [], 0
    for i, t in sorted((LAST if r[0] is None else r[0], r[1] or "") for r in rows):
        ids = library.encode(t, add_special_tokens=False).ids + [1]
        expected.append((None if i == LAST else i, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    assert sorted((tuple(g[:4]) for g in got), key=lambda g: g[1]) == expected
    shard_ = manifest.first()
    reader = arrow_ids.IdReader(shard_["ids_path"])
    ids, mask = reader.sequence(0)
    assert len(ids) == 32 and ids.dtype == np.uint16 and not ids.flags.owndata and mask[0]
    assert arrow_ids.read_documents(spark, arrow_ids.write_ids(empty, VOCABULARY)).count() == 0


def test_pipeline_keeps_columns(spark):
    sf, docs = "/root/testdata/sf0.001", spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert len(corpus_pipeline.STAGES) == 5
    quality_ = corpus_pipeline.STAGES[0][1](spark, docs, sf)
    predicted = quality.classify(docs, spark.read.parquet(f"{sf}/labels.parquet")).filter("predicted = 1")
    assert sorted(r[0] for r in quality_.select("doc_id").collect()) == sorted(r[0] for r in predicted.select("doc_id").collect())
    packed = corpus_pipeline.run(spark, sf)
    assert packed.select("doc_id").distinct().count() <= quality_.count() and packed.columns[0] == "doc_id"
