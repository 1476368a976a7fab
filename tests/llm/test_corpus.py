"""Main text, mixing, packing and the pipeline."""

import collections
import random
import sys
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from framekit.llm import html_text as ht
from framekit.llm import mixing as mx
from framekit.llm import packing as pk
from framekit.llm.common import table, tokenizer_path
from framekit.llm.queries import QUERIES
from tests.conftest import SF
from tests.llm.fixtures import documents, frame, sentence

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var a="</p>";</script></head><body>
<header class="site">Top of site</header><nav><ul><li>Home<li>News</ul></nav><div class="cookie-notice">We use cookies</div>{body}
<aside>More of it</aside><form><p>Search</p></form><section id="comments"><p>First!</p></section><footer>&copy; all</footer></body></html>"""


@pytest.mark.parametrize(
    "body, text",
    [
        ("<article><h1>A &amp; B</h1><p>one  two\n three</p><p>x<b>y</b> z</article>", "A & B\none two three\nxy z"),
        ("<article><p><b>un<i>closed<br><p>next &#233;&nbsp;&eacute;</article>", "unclosed\nnext é é"),
        ("<main><div>a</div><div class='ad'>buy</div><aside>side</aside>b<script>no()</script></main>", "a\nb"),
        ("<article><ul><li>1<li>2</ul><table><tr><td>3<td>4</table></article>", "1\n2\n3\n4"),
        ("<article><p>kept</p><div class='comments'><p>I say</p></div></article>", "kept"),
        ("<article></article>", ""),
        ("<nav><ul><li>never closed<article><p>found</p></article>", "found"),
        ("<article><p>kept</p></article><div id='comments'><article><p>not me</p></article></div>", "kept"),
        ("<article><p>broken <em>off", "broken off"),
    ],
)
def test_blocks(body, text):
    found = [t for z, t in ht.blocks_of(PAGE.format(body=body)) if z == ht.MAIN]
    assert "\n".join(found).replace("\xa0", " ").split("\n")[: text.count("\n") + 1] == text.split("\n") if "broken" in body else "\n".join(found) == text


@pytest.mark.parametrize(
    "body, text",
    [
        ("<div class='widget-area'><article><p>text of it</p></article></div>", "text of it"),
        ("<div class='sidebar'><article><p>a card</p></article></div>", ""),
        (f"<article><p>one</p><div class='search-results'><p>{'many words ' * 30}</p></div></article>", "one\n" + ("many words " * 30).strip()),
        (f"<article><p>one</p><div class='search-menu'><a href='x'>{'many words ' * 30}</a></div></article>", "one"),
        ("<article><p>one</p><div class='share-buttons'>Share this</div><p>two</p></article>", "one\ntwo"),
        ("<article><header><h1>Title <i>of</i> it</h1><p>by someone, today</p></header><p>text</p></article>", "Title of it\ntext"),
        ("<article><header><nav><h2>Menu</h2></nav><h1>Title</h1></header><p>text</p></article>", "Title\ntext"),
        ("<article><p>one <span class='ad'>buy</span> two</p></article>", "one\ntwo"),
    ],
)
def test_marks_of_noise(body, text):
    assert "\n".join(t for z, t in ht.blocks_of(PAGE.format(body=body)) if z == ht.MAIN) == text


def test_strings_and_their_classes():
    r = random.Random(3)
    blocks = [" ".join(r.choice("ab") for _ in range(r.randint(1, 9))) for _ in range(60)]
    s = ht.Strings(blocks, tokens=3, every=2)
    words = [x.split() for x in blocks]
    strings = [tuple(words[b][at : at + 3]) for b, at in zip(s.block, s.start - s.begin[s.block], strict=True)]
    for b, w in enumerate(words):  # at both ends, wherever the block has room
        own = (s.start - s.begin[s.block])[s.block == b].tolist()
        assert own[0] == 0 and (len(w) < 3 or own[-1] == len(w) - 3)
    by = lambda key: [[k for k, x in enumerate(key) if x == y] for y in dict.fromkeys(key)]
    assert sorted(by(strings)) == sorted(by(s.classes().tolist())) == sorted(by(s.digest.tolist()))
    page = np.arange(60) % 7
    got = dict(zip(*(x.tolist() for x in s.counts(page)), strict=True))
    assert got == {d: len({int(page[b]) for b, e in zip(s.block, s.digest.tolist(), strict=True) if e == d}) for d in s.digest.tolist()}
    assert len(ht.Strings([]).classes()) == 0


@pytest.mark.parametrize("shard_pages", [1000, 7])
def test_hosts_without_articles(spark, shard_pages):
    """Fifty pages and more over two hosts: what the host repeats goes, whatever the shards; what pages share by chance stays."""
    r = random.Random(1)
    menu, note, phrase = "Home About us Contact", sentence(r, 20), sentence(r, 5)
    rows, want = [], {}
    for i in range(70):
        own = [f"{sentence(r, 15)} {phrase} {sentence(r, 15)}", sentence(r, 40)]
        notes = i < 40 or i % 10 == 0  # the second host has the note in three pages
        parts = [menu, own[0], f"{own[1]} {note}" if notes and i % 2 else own[1], *([note] if notes and i % 2 == 0 else [])]
        rows.append((i, f"http://{'big' if i < 40 else 'small'}.example/{i}", "<body>" + "".join(f"<div>{p}</div>" for p in parts)))
        want[i] = own
    copy = sentence(r, 50)
    rows += [(100 + i, f"http://big.example/copy{i}", f"<body><p>{copy}</p><p>{sentence(r, 12)}") for i in range(2)] + [(110 + i, "http://small.example/same", f"<p>{copy}") for i in range(9)]
    line = sentence(r, 14)
    rows += [(200 + i, f"http://third.example/{i}", f"<article><p>{sentence(r, 30)}</p><p>{line}</p><p>more {i}</p></article>") for i in range(8)]
    got = {x["page_id"]: x["text"] for x in ht.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), shard_pages=shard_pages).collect()}
    for i in range(70):
        text = got[i].split("\n")
        assert menu not in text and text[0] == want[i][0]
        assert text[1].startswith(want[i][1]) and len(text) == 2
        assert note.split()[-12:] != text[1].split()[-12:]
    assert all(got[110 + i] == copy for i in range(9)) and all(got[100 + i].startswith(copy) for i in range(2))
    assert all(line not in got[200 + i] and got[200 + i].endswith(f"more {i}") for i in range(8))


@pytest.mark.parametrize("shard_pages", [1024, 4])
def test_repeats_go_to_their_last_token(spark, shard_pages):
    """Passages of any length at either end of blocks, counted wherever they lie: what is left are the words around them."""
    r = random.Random(7)
    notes = [sentence(r, n) for n in (12, 13, 25, 60)]
    rows, want = [], {}
    for i in range(24):
        a, b, c, note = sentence(r, 30), sentence(r, 30), sentence(r, 30), notes[i % 4]
        # the second note of some pages lies in the middle of a block and stays, but counts
        parts, left = ([f"{note} {a}", f"{b} {note}", c], [a, b, c]) if i < 8 else ([f"{a} {note} {b}", c], [f"{a} {note} {b}", c])
        rows.append((i, f"http://h.example/{i}", "".join(f"<div>{p}</div>" for p in parts)))
        want[i] = "\n".join(left)
    got = {x["page_id"]: x["text"] for x in ht.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), shard_pages=shard_pages).collect()}
    assert got == want


@pytest.mark.parametrize("seed", range(10))
def test_strings_from_every_token(seed):
    r = random.Random(seed)
    pages = [[" ".join(r.choice("abé") for _ in range(r.randint(1, 30))) for _ in range(r.randint(0, 4))] for _ in range(12)]
    s = ht.Strings([x for p in pages for x in p], 6)
    seen = collections.defaultdict(set)
    for i, p in enumerate(pages):
        for words in map(str.split, p):
            for a in range(max(1, len(words) - 5)):
                seen[tuple(words[a : a + 6])].add(i)
    for least in (1, 3):
        digest, n = s.counts(np.repeat(np.arange(len(pages)), [len(p) for p in pages]), least)
        assert sorted(n.tolist()) == sorted(len(x) for x in seen.values() if len(x) >= least) and len(set(digest.tolist())) == len(digest)
    d = np.sort(s.digest)
    assert (ht._unpacked(ht._packed(d)) == d).all()


def test_copies_of_articles_stay_whole(spark):
    r = random.Random(2)
    text = [sentence(r, 30) for _ in range(6)]
    rows = [(i, f"http://h.example/{i}", "<article>" + "".join(f"<p>{x}</p>" for x in text) + f"<p>{sentence(r, 3)}</p></article>") for i in range(9)]
    for x in ht.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        assert x["text"].split("\n")[:6] == text


def test_pages_without_article(spark):
    r = random.Random(0)
    own = [sentence(r, 30) for _ in range(8)]
    rows = [(i, f"http://h.example/{i}", f"<body><div><p>Shared words on every single page</p></div><p>{own[i]}</p></body>") for i in range(8)]
    rows += [(100, None, None), (101, "x", ""), (102, "http://h.example/q", "<p>short"), (103, "http://other.example/", "<article><p>Shared words on every single page</p></article>"), (None, "u", "<article>no id</article>")]
    got = {(x["page_id"], x["text"]) for x in ht.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {(i, own[i]) for i in range(8)} | {(100, ""), (101, ""), (102, "short"), (103, "Shared words on every single page"), (None, "no id")}
    assert ht.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_articles_of_pages_stay_whole(spark):
    import html
    import re

    want = {}
    for p in table(spark, SF, "pages").collect():
        inner = re.search(r"<article>(.*?)</article>", p["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"</?b>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)>", inner)]
        want[p["page_id"]] = "\n".join(b for b in blocks if b)
    got = {r["page_id"]: r["text"] for r in QUERIES["op3_html_text"](spark, SF).collect()}
    assert got == want


def test_targets():
    assert mx.targets([]) == [] and mx.targets([0, 0]) == [0, 0]
    got = mx.targets([10, 100, 1000, 5])
    assert sum(got) == pytest.approx(1115) and all(t <= 3 * s + 1e-9 for t, s in zip(got, [10, 100, 1000, 5], strict=True))
    assert got[0] == 30 and got[1] == 300 and got[3] == 15 and got[2] == pytest.approx(770)
    assert mx.targets([800, 800, 800]) == pytest.approx([1500, 600, 300])


def test_splitting_tree():
    q = np.array([100, 40, 0, 7])
    got = mx.split_tree(q, 8)
    assert (got.sum(axis=0) == q).all() and (got >= 0).all() and got.sum(axis=1).max() - got.sum(axis=1).min() <= 2
    assert (got == mx.split_tree(q, 8)).all() and mx.split_tree(np.zeros(0, np.int64), 4).shape == (4, 0)


@pytest.mark.parametrize("block", [200, 100_000])
def test_mix(spark, block):
    docs = frame(spark)
    out = mx.mix(docs, block_words=block, shards=4).collect()
    assert len(out) == len(documents())
    sizes = collections.Counter()
    taken, target = collections.Counter(), {}
    for r in out:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["epochs"] * r["size"]
        target[r["source"]] = r["target"]
        assert 0 <= r["epochs"] <= 3 and len(r["placed"]) == r["epochs"]
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    assert [target[s] for s in order] == pytest.approx(mx.targets([sizes[s] for s in order]))
    for s in order:
        largest = max(r["size"] for r in out if r["source"] == s)
        assert target[s] - largest <= taken[s] <= target[s] + 1e-6
    again = {(r["doc_id"], r["size"], r["epochs"], str(r["placed"])) for r in mx.mix(docs.repartition(5), block_words=block, shards=4, range_blocks=2).collect()}
    assert again == {(r["doc_id"], r["size"], r["epochs"], str(r["placed"])) for r in out}
    assert mx.mix(frame(spark, [])).count() == 0 and mx.mixed(frame(spark, [])).count() == 0


def test_mixed_rows_lie_in_their_shards_by_place(spark):
    docs = frame(spark, [(i, t) for i, t in documents() if i not in (None, 410)])
    want = collections.defaultdict(list)
    for r in mx.mix(docs).collect():
        for p in r["placed"]:
            want[p["shard"]].append((p["place"], r["doc_id"]))
    out = mx.mixed(docs).select("doc_id", F.spark_partition_id().alias("part")).collect()
    runs = collections.defaultdict(list)
    for r in out:
        runs[r["part"]].append(r["doc_id"])
    shards = {s: [i for _, i in sorted(v)] for s, v in want.items()}
    assert sorted(i for v in runs.values() for i in v) == sorted(i for v in shards.values() for i in v) and len(shards) > 4
    for v in runs.values():  # a partition is whole shards, one after the other
        while v:
            s = next(s for s in sorted(shards) if v[: len(shards[s])] == shards[s])
            v = v[len(shards.pop(s)) :]
    assert not shards


def plain_sums(window):
    """The online rule by its definition."""
    count = collections.Counter()

    def place(size):
        best = None
        for level in [0, *range(1, window)]:
            if level and not count[level] or level + size > window:
                continue
            now = count.copy()
            if level:
                now[level] -= 1
            if level + size < window:
                now[level + size] += 1
            key = (sum(v * v for v in now.values()), -level)
            if best is None or key < best[0]:
                best = (key, level, now)
        count.clear()
        count.update(best[2])
        return best[1]

    return place


def test_levels_follow_the_definition():
    r = random.Random(3)
    levels, place = pk.Levels(16), plain_sums(16)
    for _ in range(500):
        size = r.randint(1, 15)
        got = levels.place(size)
        assert got == place(size)
        levels.add((b"\0" * 4 * size, size, 0, 0, False))


@pytest.mark.parametrize("hold", [1 << 23, 40])
def test_packing_loses_nothing(hold):
    r = random.Random(1)
    docs = [(i, np.arange(r.choice([1, 3, 7, 16, 17, 50]), dtype="<u4").tobytes()) for i in range(300)]
    pieces, padding = collections.defaultdict(list), 0
    for seq in pk.pack(iter(docs), 16, hold):
        n = sum(p[1] for p in seq)
        assert 0 < n <= 16 and all(len(p[0]) == 4 * p[1] for p in seq)
        padding += 16 - n if n & (n - 1) else 0
        for ids, size, doc, start, _ in seq:
            pieces[doc].append((start, size, ids))
    assert padding == 0
    for i, ids in docs:
        assert b"".join(p[2] for p in sorted(pieces[i])) == ids


def test_placement_decides_most():
    r = random.Random(4)
    for n, least in ((4_000, 0.6), (40_000, 0.9)):
        docs = [(i, b"\0" * 4 * min(20_000, int(r.lognormvariate(5.5, 1)) + 1)) for i in range(n)]
        pieces = [p for seq in pk.pack(iter(docs)) for p in seq]
        total = sum(len(ids) // 4 for _, ids in docs)
        assert sum(p[1] for p in pieces) == total and sum(p[1] for p in pieces if not p[4]) >= least * total


def test_word_cache_is_bounded():
    path = tokenizer_path("word_bpe_49k.json")
    r = random.Random(9)
    texts = [" ".join(f"w{r.randrange(3000)}x{r.choice('abc')}" for _ in range(50)).encode() for _ in range(900)]
    want = list(pk.word_encoder(path)(texts))
    kept = sys.modules["_framekit_worker"].encoders[path]
    kept.keep_within(0)
    assert not kept and list(pk.word_encoder(path, cache=50_000)(texts)) == want
    assert kept.size <= 60_000 and len(kept) > 100


def test_packed_documents(spark):
    from tokenizers import Tokenizer

    rows = [r for r in documents() if r[0] is not None and r[0] != 410]
    tokenizer = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    out = pk.pack_documents(frame(spark, rows)).collect()
    by = collections.defaultdict(list)
    for p in out:
        by[p["doc_id"]].append(p)
    assert set(by) == {i for i, _ in rows}
    for i, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        at = 0
        for p in sorted(by[i], key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids) and p["ids_crc32"] == zlib.crc32(np.array(ids[at : at + p["length"]], "<u4").tobytes())
            at += p["length"]
        assert at == len(ids)
    assert pk.pack_documents(frame(spark, [])).count() == 0 and pk.pack_documents(frame(spark)).where("doc_id is null").count() >= 2


def test_words_alone_encode_as_in_texts():
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    tokenizer, encode, r = Tokenizer.from_file(path), pk.word_encoder(path), random.Random(2)
    parts = ["a", "T", "é", "̈", "ẗ", "İ", "Σ", "ς", ".", ",", " ", "\n", "\t", "\0", "7", "²", "'s", "’", "<|endoftext|>", "<|EndOfText|>", "€", "日本", "🙂", " ", " ", "word", "\x1c", "'S", "ﬁ", "!", "K", "ß", "÷", "ÿ", "É", "***", "&;", "|>", "<", "'", "x%%%. ", "\u0130", "ñ#"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(30))) for _ in range(4000)]
    for t, got in zip(texts, encode([t.encode() for t in texts]), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


def test_stops_are_set_apart():
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    tokenizer, r = Tokenizer.from_file(path), random.Random(5)
    parts = ["a", "T", "é", "É", ".", ",", ". ", ", ", ".\n", " ", "\n", "\t", "7", "'s", "’", "×", "÷", "»", "“", "ä", "İ", "日", "!", ")", "\x1c", "\x85", "_", "²", "\u0338", "·", "õ"]
    texts = [". a", "word. Word, word.\nÉté, été.", "a.. b", "a!, b", "×. ÷, a. ×", *("".join(r.choice(parts) for _ in range(r.randrange(20))) for _ in range(6000))]
    for t, got in zip(texts, pk.word_encoder(path)([t.encode() for t in texts]), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids, repr(t)
    assert pk.stops_apart("one. été, 7. 7,\nend.\n".encode()).split() == "one . été , 7 . 7, end .".encode().split()
    for t in ("one.. two. ", "a!. b", "×. b", "” a, ”. b", "\x1c. b"):
        assert pk.stops_apart(t.encode()) == t.encode()


def test_pipeline_stages(spark, tmp_path):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, SF)
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == columns, name
        if name == "quality classifier":
            judged = before.join(table(spark, SF, "labels"), "doc_id").select("doc_id", "quality")
            kept = {r[0] for r in docs.select("doc_id").collect()}
            good = [r["doc_id"] for r in judged.collect() if r["quality"]]
            assert sum(i in kept for i in good) >= 0.97 * len(good) and len(kept) < before.count()
        if name == "near-duplicates":
            assert docs.count() < before.count() and docs.count() == docs.select("text").distinct().count()
        if name == "mixing":
            assert docs.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.where("start = 0").count() == docs.count()
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").count() == 0


def test_pipeline_of_awkward_rows(spark):
    docs = frame(spark, extra=False).withColumns({"lang": F.lit("en"), "source": F.when(F.col("doc_id") % 2 == 0, "a"), "n_chars": F.length("text").cast("long")})
    for _, stage in corpus_pipeline.STAGES[1:]:
        docs = stage(spark, docs, SF)
    assert docs.count() > 0
