"""Near-duplicates, lines and long repeats against brute force."""

import collections
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from framekit.llm import line_dedup as ld
from framekit.llm import simhash as sh
from framekit.llm import suffix as sx
from framekit.llm import suffix_dedup as sd
from framekit.llm.components import components
from framekit.llm.similar import similar
from tests.llm.fixtures import SPACE, documents, frame, sentence


def plain_simhash(t, n=3):
    w = [x.decode() for x in (t or "").encode().lower().split()]
    grams = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] if len(w) >= n else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


def plain_components(fps):
    ids, parent = list(fps), {i: i for i in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[:k]:
            if bin(fps[a] ^ fps[b]).count("1") <= 2:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_simhash_of_documents(spark):
    rows = [r for r in documents() if r[0] is not None]
    got = {r["doc_id"]: (r["fp"] % (1 << 64), r["component_id"]) for r in sh.near_duplicates(frame(spark)).where("doc_id is not null").collect()}
    fps = {i: plain_simhash(t) for i, t in rows}
    want = plain_components(fps)
    assert got == {i: (fps[i], want[i]) for i in fps}


def test_every_link_within_two_bits_is_found(spark):
    r = random.Random(7)
    fps = {}
    for i in range(0, 1200, 4):
        f = r.getrandbits(64)
        fps |= {i: f, i + 1: f ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)), i + 2: f ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)), i + 3: r.getrandbits(64)}
    for bits in range(3):  # every pair of bits differs somewhere
        for k in range(64):
            fps[10000 + 64 * bits + k] = (0xABCDEF0123456789 ^ 1 << k) ^ (bits and 1 << (k + 7 * bits) % 64)
    df = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in fps.items()], "rep long, fp long")
    distinct = df.groupBy("fp").agg(F.min("rep").alias("rep"))
    roots = {r["id"]: r["root"] for r in components(sh.links(sh.candidates(distinct))).collect()}
    want = plain_components(fps)
    first = {f: min(i for i in fps if fps[i] == f) for f in set(fps.values())}
    assert {i: roots.get(first[f], first[f]) for i, f in fps.items()} == want


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 2000), (7, 7)], "a long, b long")
    got = {r["id"]: r["root"] for r in components(edges).collect()}
    assert all(got[i] == 0 for i in range(301)) and got[2000] == 1000 and len(got) == 303
    assert components(edges.limit(0)).count() == 0


def test_one_of_each_group_stays(spark):
    docs = frame(spark)
    out = sh.deduplicate(docs)
    ids = [r["doc_id"] for r in out.collect()]
    assert out.columns == docs.columns and 3 in ids and not any(100 + i in ids for i in range(6)) and ids.count(None) == 2
    assert sh.deduplicate(frame(spark, [])).count() == 0


def test_all_documents_of_similarity_four_fifths_are_linked(spark):
    r = random.Random(11)
    rows, passage = documents(), sentence(r, 60)
    for i in range(40):  # from one word to a third of the words replaced, in one run or all over
        w = sentence(r, r.randint(5, 120)).split()
        v, k = list(w), r.randint(1, max(1, len(w) // 3))
        for at in range(0, k) if i % 2 else r.sample(range(len(w)), max(1, k // 5)):
            v[at] = "new"
        rows += [(1000 + 2 * i, " ".join(w)), (1001 + 2 * i, " ".join(v))]
    rows += [(1200 + i, f"{sentence(r, 25)} {passage}") for i in range(12)]
    sets = collections.defaultdict(list)
    for i, t in rows:
        w = (t or "").encode().lower().split()
        if i is not None and w:
            sets[i].append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))})
    close = lambda a, b: any(5 * len(x & y) >= 4 * len(x | y) for x in sets[a] for y in sets[b])
    want = {(a, b) for a in sets for b in sets if a < b and close(a, b)}
    copies = {(a, b) for a, b in want if any(x == y for x in sets[a] for y in sets[b])}
    for hot in (3, 1000):
        got = {tuple(sorted(e)) for e in similar(frame(spark, rows), hot_docs=hot).collect()}
        assert got <= want and len(want - copies) > 10
        assert {r["id"]: r["root"] for r in components(spark.createDataFrame(list(got), "a long, b long")).collect()} == {r["id"]: r["root"] for r in components(spark.createDataFrame(list(want), "a long, b long")).collect()}
    ids = {x["doc_id"] for x in corpus_pipeline.dedup_documents(spark, frame(spark, rows), "").collect()}
    assert not ids & {b for _, b in want}
    assert similar(frame(spark, [])).count() == 0


def plain_lines(rows, least=10):
    key = lambda x: x.strip(SPACE).translate({i: i + 32 for i in range(65, 91)})
    n = collections.Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")})
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if not (key(x) and n[key(x)] >= least)]
        out.append((i, "\n".join(stay), len(lines), len(lines) - len(stay)))
    return collections.Counter(out)


@pytest.mark.parametrize("rows, least", [(20_000, 10), (20_000, 2), (3, 10)])
def test_lines(spark, monkeypatch, rows, least):
    monkeypatch.setattr(ld, "PROBE_ROWS", rows)
    docs = frame(spark)
    out = ld.dedup_lines(docs, min_docs=least, dropped="gone")
    assert collections.Counter(map(tuple, out.select("doc_id", "text", "n_lines", "gone").collect())) == plain_lines(documents(), least)
    assert {(r["n_chars"], r["source"]) for r in out.collect()} <= {(len(t), s) for (_, t, _, _) in plain_lines(documents(), least) for s in (None, "a", "b", "é")}
    assert ld.dedup_lines(frame(spark, [])).count() == 0


def test_lines_of_rows_whose_hash_is_shared(spark):
    rows = documents() + [(500, "x\ny")] * 40  # repeated rows have one hash of id and text
    out = ld.dedup_lines(frame(spark, rows))
    assert collections.Counter(map(tuple, out.select("doc_id", "text", "n_lines", "n_dropped").collect())) == plain_lines(rows)


def test_empty_lines_stay(spark):
    out = ld.dedup_lines(frame(spark, [(i, f"a\n\n \n{i}") for i in range(12)] + [(20, None), (21, "")]))
    assert {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in out.collect()} == {i: (f"\n \n{i}", 4, 1) for i in range(12)} | {20: ("", 1, 0), 21: ("", 1, 0)}


def test_counts_are_reversible(spark):
    rows = documents()
    docs, more = frame(spark, rows), frame(spark, rows[40:60])
    before = ld.reference_counts(docs)
    after = ld.change(before, inserted=more)
    key = lambda df: {(r["high"], r["low"]): r["n_docs"] for r in df.collect()}
    assert key(ld.change(after, deleted=more)) == key(before)
    assert key(after) == key(ld.reference_counts(docs.unionByName(more)))
    assert key(ld.change(before, deleted=docs)) == {}


def test_filters_follow_changes(spark):
    rows = documents()
    before, bits = ld.reference_counts(frame(spark, rows)), 0
    filters, bits = ld.build_filters(before, 3)
    after = ld.change(before, inserted=frame(spark, rows[45:50]), deleted=frame(spark, rows[46:56]))
    fresh = ld.refresh(filters, bits, before, after, 3)
    hot = {(r["high"], r["low"]): r["n_docs"] >= 3 for r in after.collect()}
    shards = {r["shard"]: (r["filter"], r["wrong"]) for r in fresh.collect()}
    for k in sorted({k for _, t in rows for k in ld.keys_of((t or "").encode()) if k}):
        d = ld.digests([k])
        high, low = (int(x) for x in d.view(np.int64)[0])
        own = shards.get(int(d[0, 0]) >> (64 - bits))
        assert bool(own and ld.reported(*map(bytes, own), d)[0]) == hot.get((high, low), False)


def test_cuckoo_filter():
    r = np.random.default_rng(0)
    h = r.integers(0, 1 << 63, (5000, 2)).astype(np.uint64)
    f = ld.CuckooFilter.of(h[:3000])
    assert f.contains(h[:3000]).all() and f.contains(h[3000:]).mean() < 0.01
    for a, b in h[:1000]:
        assert f.delete(int(a), int(b))
    assert f.contains(h[1000:3000]).all() and f.contains(h[:1000]).mean() < 0.01
    assert ld.CuckooFilter.of(h[:0]).contains(h).sum() == 0


@pytest.mark.parametrize("seed", range(30))
def test_suffix_arrays(seed):
    r = np.random.default_rng(seed)
    d = r.integers(97, 98 + r.integers(1, 4), r.integers(0, 250)).astype(np.uint8)
    if len(d) > 100:
        d[50:90] = d[:40]
    b, n = d.tobytes(), len(d)
    sa = sx.suffix_array(sx.eight_bytes(d), 8, 64)
    assert [b[i : i + 64] for i in sa] == sorted(b[i : i + 64] for i in range(n))
    lcp = sx.common_prefixes(d, sa, 64, lanes=int(r.integers(1, 9)))
    same = lambda x, y: next((k for k in range(64) if max(x, y) + k >= n or b[x + k] != b[y + k]), 64)
    assert list(lcp) == [same(sa[i - 1], sa[i]) if i else 0 for i in range(n)]


def plain_repeats(rows, length):
    data = [(i, (t or "").encode()) for i, t in rows]
    n = collections.Counter(b[s : s + length] for _, b in data for s in range(len(b) - length + 1))
    out = []
    for i, b in data:
        gone = np.zeros(len(b) + 1, bool)
        for s in range(len(b) - length + 1):
            if n[b[s : s + length]] > 1:
                gone[s : s + length] = True
        gone = gone[:-1]
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(b) else 0
        out.append((i, len(b), int(gone.sum()), spans, bytes(np.frombuffer(b, np.uint8)[~gone])))
    return collections.Counter(out)


@pytest.mark.parametrize("limits", [{}, {"split": 2, "shard_bytes": 3000}])
def test_long_repeats(spark, limits):
    r = random.Random(5)
    passage = sentence(r, 60)
    rows = documents() + [(600 + i, sentence(r, 10) + passage[i : 200 + i] + sentence(r, 10)) for i in range(9)] + [(700, "xyz" * 300), (701, passage * 3)]
    docs = frame(spark, rows)
    texts = sd.remove_repeats(docs, length=100, gram=32, **limits)
    joined = docs.select("doc_id", sd.text_digest(F.col("text")).alias("d")).join(texts, F.col("d") == texts["digest"])
    got = collections.Counter((x["doc_id"], len(x["bytes"]), sum(s["to"] - s["from"] for s in x["spans"]), len(x["spans"]), bytes(x["kept"])) for x in joined.collect())
    assert got == plain_repeats(rows, 100)
    assert sd.remove_repeats(frame(spark, [])).count() == 0


def test_runs_of_other_shards_are_searched():
    r = random.Random(8)
    strings = [bytes([r.randrange(3)]) + bytes(30) + bytes([r.randrange(40)]) for _ in range(300)]
    rows = sorted({(r.randrange(5), s) for s in strings})
    n = collections.Counter(s for _, s in rows)
    r.shuffle(rows)
    got = sd.merge_runs(np.array([s for _, s in rows], "S32"), np.array([k for k, _ in rows]))
    assert got.tolist() == [n[s] > 1 for _, s in rows] and 0 < got.sum() < len(rows)
    assert len(sd.merge_runs(np.array([], "S32"), np.array([], np.int64))) == 0


@pytest.mark.parametrize("seed", range(20))
def test_repeats_of_more_than_512_bytes_in_a_shard(seed):
    r = random.Random(seed)
    rand = lambda n: bytes(r.choice(b"abcdefgh ") for _ in range(n))
    spans = []
    for _ in range(12):  # copies go on in different ways, so that their order shows only beyond 512 bytes
        passage = rand(r.randint(520, 660))
        spans += [rand(r.randint(0, 30)) + passage + rand(r.randint(0, 300)) for _ in range(3)]
    spans += [passage[:450] + rand(200) for _ in range(2)] + [rand(700) for _ in range(12)]
    r.shuffle(spans)
    n = collections.Counter(s[o : o + 400] for s in spans for o in range(len(s) - 399))
    span, offset, repeated, own = sd.shard_repeats(spans, np.array([len(s) - 399 for s in spans]), np.ones(len(spans)))
    strings = [spans[s][o : o + 400] for s, o in zip(span, offset, strict=True)]
    assert [n[x] > 1 for x in strings] == repeated.tolist()
    assert len(set(zip(strings, own.tolist(), strict=True))) == len(n) == len(set(own.tolist()))


def test_cells_of_long_texts_in_segments(monkeypatch):
    r = random.Random(6)
    texts = [sentence(r, 3000).encode(), b"ab" * 3000]
    monkeypatch.setattr(sd, "SEGMENT", 1000)
    hashes = collections.defaultdict(set)
    for i, first, n, h, _, _ in sd.cells(texts, 100, 32):
        for a, k, x in zip(first.tolist(), n.tolist(), h.tolist(), strict=True):
            for s in range(a, a + k):
                hashes[texts[i][s : s + 100]].add(x)
    assert sum(len(t) - 99 for t in texts) and all(len(v) == 1 for v in hashes.values())
    assert set(hashes) == {t[s : s + 100] for t in texts for s in range(len(t) - 99)}
