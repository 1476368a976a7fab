"""Rules, fingerprints, token counts and the classifier against plain versions."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from framekit.llm import fingerprints as fp
from framekit.llm import quality_classifier as qc
from framekit.llm import quality_rules as qr
from framekit.llm import token_counts as tc
from framekit.llm.common import table, tokenizer_path
from framekit.llm.queries import QUERIES, middle_edit
from tests.conftest import SF
from tests.llm.fixtures import documents, frame, labels, sentence

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(t):
    t = t or ""
    w = WORD.findall(t)
    n = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if n[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w)


def rows_of(df, *names):
    return collections.Counter(tuple(r) for r in df.select(*names).collect())


def test_rule_counts(spark):
    rows = [*documents(), (500, "a b c d e f " * 9), (501, "# a | b\n# a | b\nx"), (502, "w " * 5), (503, "q r s t u v w x y z " * 2)]
    got = rows_of(qr.features(frame(spark, rows)), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert got == collections.Counter((i, *plain_counts(t)) for i, t in rows)


def test_binomial_bound(spark):
    cases = [(0, 100, 0.01, 0.4), (0, 1000, 0.005, 0.01), (3, 1000, 0.01, 0.011), (40, 10000, 0.005, 0.1), (7, 9, 0.02, 0.1), (2000, 500000, 0.005, 0.001), (2400, 500000, 0.005, 0.05)]
    for k, n, p, d in cases:
        exact = sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1))
        got = spark.range(1).select(qr.binomial_tail_at_most(F.lit(k), F.lit(n), p, F.lit(d))).first()[0]
        assert got == (exact <= d), (k, n, p, d, exact)


def test_cutoffs_keep_the_promise(spark):
    r = random.Random(1)
    rows = [(i, "clean", 0.0 if i % 50 else 0.2) for i in range(20000)] + [(i, "few", 0.0) for i in range(20000, 20040)]
    feats = spark.createDataFrame([(i, s, 100, 400, int(400 * x), 0, 0, 10, False) for i, s, x in rows], "doc_id long, stratum string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, base_failed boolean")
    good = spark.createDataFrame([(i, 1) for i, _, _ in rows], "doc_id long, quality int")
    found = {x["stratum"]: x["cutoffs"] for x in qr.calibrate(feats, good).collect()}
    assert "few" not in found  # too few labels for any cutoff
    assert found["clean"]["symbols"] >= 0.2  # 2 % of the good lie at 0.2: nothing below is allowed
    kept = qr.apply_rules(feats, qr.calibrate(feats, good))
    assert kept.where("not kept").count() <= 0.02 * len(rows)


def test_rules_reject_what_is_far_off(spark):
    rows = [(i, sentence(random.Random(i), 30)) for i in range(3000)] + [(5000 + i, sentence(random.Random(i), 30).replace(" ", " ### ")) for i in range(50)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, lang string")
    good = spark.createDataFrame([(i, 1) for i in range(3000)], "doc_id long, quality int")
    out = {r["doc_id"]: r["kept"] for r in qr.quality_rules(docs, good).collect()}
    assert all(out[i] for i in range(3000)) and not any(out[5000 + i] for i in range(50))


@pytest.mark.parametrize("docs", ["none", "no labels"])
def test_rules_of_nothing(spark, docs):
    out = qr.quality_rules(frame(spark, [] if docs == "none" else None), labels(spark).limit(0))
    assert out.count() == (0 if docs == "none" else len(documents()))
    assert out.where("not kept and not base_failed").count() == 0


def test_fingerprint_algebra(spark):
    df = spark.createDataFrame([("x\nyy\n" + "z" * 200, "z" * 200 + "\n\nyy\nx", "yy", "x\n" + "z" * 200)], "a string, b string, p string, c string")
    a, b, p, c = (fp.vector(F.col(x)) for x in "abpc")
    got = df.select((a == b).alias("order"), (fp.insert(c, p) == a).alias("insert"), (fp.delete(a, p) == c).alias("delete"), (a == c).alias("differs"), fp.likeness(a, b).alias("one"), fp.likeness(a, c).alias("near"), fp.likeness(fp.vector(F.lit(None).cast("string")), fp.vector(F.lit(""))).alias("empty"), fp.likeness(a, p).alias("far")).first()
    assert got["order"] and got["insert"] and got["delete"] and not got["differs"] and got["one"] == 1 and got["empty"] == 1 and 0.5 < got["near"] < 1 and got["far"] < 0.6


def test_edited_fingerprints(spark):
    rows = [(i, t) for i, t in documents() if i is not None and i != 410] + [(None, "last of all")]
    out = {r["doc_id"]: r for r in fp.edited(frame(spark, rows)).select("doc_id", "n_chars", "edited", "edited_fingerprint", fp.vector(F.col("edited")).alias("fresh")).collect()}
    ranked = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    for k, (i, t) in enumerate(ranked):
        t, n = t or "", ranked[(k + 1) % len(ranked)][1] or ""
        third = len(t) // 3
        assert out[i]["edited"] == t[: len(t) - third] + n[:third] and out[i]["n_chars"] == len(t)
        assert out[i]["edited_fingerprint"] == out[i]["fresh"]


def test_fingerprints_of_repeated_rows_and_none(spark):
    assert fp.edited(frame(spark)).count() == len(documents())
    assert fp.edited(frame(spark, [])).count() == 0


def test_likeness_follows_the_shared_share(spark):
    out = QUERIES["op6_fingerprints"](spark, SF).agg(F.avg("near_edited"), F.avg("near_next")).first()
    assert 0.45 < out[0] < 0.75 and out[1] < 0.15


def test_token_tree_equals_counting_anew():
    count = tc.unit_counter(tokenizer_path("byte_bpe_50k.tiktoken"))
    import base64

    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(tokenizer_path("byte_bpe_50k.tiktoken"), "rb"))}
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(4)
    for _, t in documents():
        tree = tc.TokenTree(t or "", count, leaf=r.choice([1, 8, 64]))
        assert tree.total == len(plain.encode_ordinary(t or ""))
        now = t or ""
        for _ in range(6):
            at, gone, new = r.randint(-3, len(now) + 3), r.randint(0, 40), r.choice(["", " ", "x", "\n\n y", sentence(r, 5), "é's ", " " * 9])
            tree.edit(at, gone, new)
            at = min(max(0, at), len(now))
            now = now[:at] + new + now[at + gone :]
            assert tree.text == now and tree.total == len(plain.encode_ordinary(now)) and (not now or tree.chars[1] == len(now))


def test_edits_encode_little(spark):
    count = tc.unit_counter(tokenizer_path("byte_bpe_50k.tiktoken"))
    tree = tc.TokenTree(sentence(random.Random(2), 20000), count)
    tree.encoded = 0
    tree.edit(50000, 10, "other words")
    assert tree.encoded < 2000
    out = tc.counts(frame(spark), edits=middle_edit)
    assert out.count() == len(documents()) and tc.counts(frame(spark, [])).count() == 0


def test_units_meet_the_vocabulary_on_odd_white_space():
    count = tc.unit_counter(tokenizer_path("byte_bpe_50k.tiktoken"))
    import base64

    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(tokenizer_path("byte_bpe_50k.tiktoken"), "rb"))}
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(9)
    for _ in range(4000):
        t = "".join(r.choice([" ", "\n", "\t", "\x0b", "\x1c", "\x85", "\xa0", " ", "a", "B1", "'s", "é", ".", "🙂"]) for _ in range(r.randint(0, 14)))
        assert count(t) == len(plain.encode_ordinary(t)), repr(t)


def test_marginals_equal_enumeration():
    r = np.random.default_rng(3)
    scores, sizes, t = r.normal(size=9), np.array([4, 1, 4]), r.normal(size=(2, 2))
    got, pairs, log_z = qc.marginals(scores, sizes, t)
    at, want, want_pairs, z_sum = 0, [], np.zeros((2, 2)), 0.0
    for n in sizes:
        weights = {}
        for labels_ in np.ndindex(*[2] * n):
            weights[labels_] = math.exp(sum(scores[at + i] for i in range(n) if labels_[i]) + sum(t[labels_[i - 1], labels_[i]] for i in range(1, n)))
        z = sum(weights.values())
        z_sum += math.log(z)
        want += [sum(v for k, v in weights.items() if k[i]) / z for i in range(n)]
        for k, v in weights.items():
            for i in range(1, n):
                want_pairs[k[i - 1], k[i]] += v / z
        at += n
    assert np.allclose(got, want) and np.allclose(pairs, want_pairs) and math.isclose(log_z, z_sum)


def test_classifier_on_held_out_documents(spark):
    sf = SF.replace("0.001", "0.01")
    out = qc.classify(table(spark, sf, "documents"), table(spark, sf, "labels")).join(table(spark, sf, "labels"), "doc_id").collect()
    held = [r for r in out if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out)
    assert len(held) > 40 and np.mean([r["predicted"] == r["quality"] for r in held]) >= 0.95
    assert np.mean([r["predicted"] for r in held if r["quality"]]) >= 0.97


def test_classifier_cases(spark):
    out = qc.classify(frame(spark), labels(spark)).collect()
    assert len(out) == len(documents()) and all(0 <= r["score"] <= 1 for r in out)
    assert qc.classify(frame(spark, []), labels(spark)).count() == 0
    assert {r["score"] for r in qc.classify(frame(spark), labels(spark).limit(0)).collect()} == {1.0}


