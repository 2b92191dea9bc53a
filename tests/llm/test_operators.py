"""Operators against brute force, and each one's defined cases: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import base64
import hashlib
import os
import random
import re
import subprocess
import sys
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from loomtab.llm import bpe, decontaminate, language, licenses, quality_classifier, quality_rules, sharding, simhash, simhash_texts, token_files, urls

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: A column named like those that operators make.
CLASHES = ("score", "kept", "fp", "ids", "key", "mark", "y", "w", "all", "at", "n", "size", "part", "shard", "doc")
BPE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def prose(rng, n, lang="en"):
    parts = {"en": "the er on an re he in ed nd ha at en es of or", "de": "ein sch der ung ich über tz heit keit und", "fr": "eau eux é è que tion ment le ç la"}[lang].split()
    return " ".join("".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    made = [prose(rng, rng.randint(25, 120), "en de fr".split()[i % 3]) for i in range(60)]
    for i in range(20, 30):  # near copies
        words = made[i - 20].split()
        words[len(words) // 2] = "other"
        made[i] = " ".join(words)
    made[30] = made[31] = made[32]  # copies
    for i in range(40, 52):  # junk
        made[i] = " ".join(w + rng.choice(["***", "$$$", "%%%"]) for w in made[i].split())
    made += [None, "", "   \n\t ", "one", "two words", "x" * 50_000, prose(rng, 6000), "a b c d e f g h " * 40, "é́ 中文 🙂\x1c\x85 don't", "<|endoftext|> THE The the", "line\nline\nother\n\nline"]
    return made


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, None if i % 17 == 5 else "en de fr".split()[i % 3], f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)]
    rows.append(rows[3])  # a repeated row
    df = spark.createDataFrame(rows, SCHEMA)
    return df.select("*", *[F.lit(1).alias(c) for c in CLASHES]).repartition(3).cache()


@pytest.fixture(scope="module")
def labels(spark, texts):
    return spark.createDataFrame([(i, 0 if 40 <= i < 52 else 1, 0) for i in range(60)] + [(7, None, 0), (None, 1, 0), (3, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def encoding():
    import tiktoken

    with open(BPE, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


# 1


def brute_counts(text):
    words = WORD.findall(text or "")
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_base_counts(texts):
    for t in texts:
        assert quality_rules.base_counts(t) == brute_counts(t)


def test_rules_learn_and_keep(spark, docs, labels, texts):
    model = quality_rules.fit(docs, labels)
    rows = quality_rules.judge(docs, model).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        counts = brute_counts(texts[r.doc_id])
        assert r.base_failed == (counts[0] < 20 or 100 * counts[4] > 30 * counts[0]) and 0 <= r.score <= 1
        if r.doc_id < 60:
            assert r.kept == (not 40 <= r.doc_id < 52)
    kept = quality_rules.keep(docs, model)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in rows if r.kept)


def test_rules_without_labels_or_rows(docs, labels, none):
    model = quality_rules.fit(docs, labels.where("false"))
    assert all(r.kept == (not r.base_failed) and r.score == 1 for r in quality_rules.judge(docs, model).collect())
    assert quality_rules.judge(none, model).count() == 0 and quality_rules.keep(none, model).count() == 0


def brute_buckets(text):
    """All n-grams' buckets in plain integers."""
    mix = lambda code, salt: ((code + salt) % 2**64 * 0x9E3779B97F4A7C15 % 2**64) >> (65 - quality_rules.BUCKETS.bit_length())
    chars = [32 if re.match(r"[\x20\x09-\x0D]", c) else ord(c) for c in f" {text} "]
    out = [mix(a | b << 21 | c << 42, 1) for a, b, c in zip(chars, chars[1:], chars[2:])]
    words = [sum(ord(c) * 0x100000001B3**k for k, c in enumerate(w)) % 2**64 for w in WORD.findall(text)]
    return out + [mix(w, 2) for w in words] + [mix((a * 31 + b) % 2**64, 3) for a, b in zip(words, words[1:])]


def test_rules_score_by_brute_force(texts):
    rng = np.random.default_rng(4)
    model = quality_rules.Model(rng.normal(0, 1, quality_rules.BUCKETS), 0.7, -0.2)
    for text in texts:
        text = (text or "")[:3000]
        at = brute_buckets(text)
        assert quality_rules.buckets(text).tolist() == at
        margin = quality_rules._SCALE * sum(model.weights[at]) / len(at) if at else 0.0
        assert model.score(text) == pytest.approx(1 / (1 + np.exp(-np.clip(0.7 * margin - 0.2, -40, 40))), rel=1e-9)


def test_rules_weights_minimise_the_loss():
    """The fit's gradient, worked out row by row, is nil."""
    rng = random.Random(7)
    rows = []
    for i in range(60):
        each = Counter(brute_buckets(prose(rng, 30) + (" ***" * 8 if i % 3 == 0 else "")))
        rows.append((np.array(sorted(each)), np.array([float(each[k]) for k in sorted(each)]), float(i % 3 > 0), i % 5 == 1))
    model = quality_rules.train(rows)
    slope = quality_rules.L2 * model.weights
    fitted = [r for r in rows if not r[3]]
    ones = sum(r[2] for r in fitted)
    for at, n, y, _ in fitted:
        share = quality_rules._SCALE * n / n.sum()
        p = 1 / (1 + np.exp(-(share @ model.weights[at])))
        slope[at] += 0.5 / (ones if y else len(fitted) - ones) * (p - y) * share
    assert np.abs(slope).max() < 2e-3 and model.slope > 0


# 2


def test_bpe_matches_the_library(docs, texts, encoding):
    ids = {r.doc_id: r.ids for r in bpe.encode(docs, BPE, public_tokenizers.PATTERN).collect()}
    assert all(ids[i] == encoding.encode_ordinary(t or "") for i, t in enumerate(texts))
    raw = {r.doc_id: r.bytes for r in bpe.decode(bpe.encode(docs, BPE, public_tokenizers.PATTERN), BPE).collect()}
    assert all(bytes(raw[i]) == (t or "").encode() for i, t in enumerate(texts))


def test_bpe_digests(docs, texts, encoding, none):
    for r in bpe.round_trip(docs, BPE, public_tokenizers.PATTERN).collect():
        text = texts[r.doc_id] or ""
        ids = encoding.encode_ordinary(text)
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.round_trip(none, BPE, public_tokenizers.PATTERN).count() == 0


def test_bpe_random_texts(encoding):
    codec, rng = bpe.ByteBpe(bpe.read_ranks(BPE), public_tokenizers.PATTERN), random.Random(3)
    signs = ["a", "b", " ", "  ", "\n", "\t", "é", "ß", "1", ".", "!", "\x1c", "\x85", "the", "'s", "中", "🙂", "\u0301", "A"]
    made = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 30))) for _ in range(1500)]
    assert codec.encode_many(made) == [encoding.encode_ordinary(t) for t in made]
    for piece in ("abcabcabc" * 50, "z" * 200, "ñandú"):  # one tree, and many in step
        raw = piece.encode()
        assert list(codec.merge(raw)) == encoding.encode_ordinary(piece) == codec.merge_many([raw[:30], raw])[0][-len(codec.merge(raw)) :].tolist()


def test_bpe_forgets(encoding, monkeypatch, spark, none):
    monkeypatch.setattr(bpe, "MEMORY", 20_000)
    codec, rng = bpe.ByteBpe(bpe.read_ranks(BPE), public_tokenizers.PATTERN), random.Random(8)
    assert codec.by_word and not bpe.ByteBpe(bpe.read_ranks(BPE), r"[^.]+|\.").by_word
    for _ in range(20):
        made = [prose(rng, 12) + rng.choice(["", " " + "long" * 30, "\n\nnext", "\nline, \tend"]) for _ in range(5)]
        assert codec.encode_many(made) == [encoding.encode_ordinary(t) for t in made]
        assert codec.rows.held <= 20_000 and not any(len(w) > codec.rows.LONG for w in codec.rows.words)
    codec.rows.forget()
    assert not codec.rows.words and not codec.rows.held and codec.encode_many([None, "", "a"]) == [[], [], encoding.encode_ordinary("a")]
    assert codec.decode([]) == b"" and bpe.decode(none.selectExpr("doc_id", "array(1) AS ids"), BPE).count() == 0
    odd = spark.createDataFrame([(None, None), (1, [72, 73])], "doc_id long, ids array<int>")
    assert {r.doc_id: bytes(r.bytes) for r in bpe.decode(odd, BPE).collect()} == {None: b"", 1: encoding.decode_bytes([72, 73])}


# 3


def test_hilbert_neighbours():
    cells = sorted(range(4096), key=lambda c: sharding.curve(3, 4)[c])
    points = [(c >> 8, c >> 4 & 15, c & 15) for c in cells]
    assert sorted(sharding.curve(3, 4)) == list(range(4096))
    assert all(sum(abs(a - b) for a, b in zip(p, q)) == 1 for p, q in zip(points, points[1:]))


def test_shards_are_even_and_gapless(spark, docs, texts, none, tmp_path, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 3)
    clashing = docs.select("*", F.lit(1).alias("slot"), F.lit(2).alias("curve_shard"), F.lit(3).alias("crc"), F.lit(4).alias("row"))
    lost = spark.createDataFrame([(None, "no id", "en", "s0", 5), (None, None, None, None, 0), (None, None, None, None, 0)], SCHEMA)
    every = clashing.unionByName(lost, allowMissingColumns=True)
    dims = {"lang": sharding.ordered(every, "lang"), "source": sharding.ordered(every, "source")}
    rows = sharding.shards(every, dims, count=7).collect()
    sizes = Counter(r.shard for r in rows)
    assert len(rows) == len(texts) + 4 and len(sizes) == 7 and max(sizes.values()) - min(sizes.values()) <= 1
    for s in sizes:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))
    for r in rows:
        if r.doc_id is not None:
            raw = (texts[r.doc_id] or "").encode()
            assert r.size == len(raw) + 16 and r.text_crc32 == zlib.crc32(raw)
    assert sharding.shards(none, {"lang": sharding.ordered(none, "lang")}).count() == 0
    manifest = sharding.write(every, dims, str(tmp_path / "shards"), count=7)
    written = spark.read.parquet(str(tmp_path / "shards"))
    held = written.collect()
    assert len(held) == len(rows) and sum(r.doc_id is None for r in held) == 3 and set(written.columns) == {*every.columns, "curve_shard_"}
    assert {r.shard: r.rows for r in manifest.collect()} == Counter(r.curve_shard_ for r in held) == sizes
    # the shards that hold a language are among those that the manifest gives, and others are left out
    step = every.where("lang = 'fr'").select(dims["lang"]).first()[0]
    picked = {r.shard for r in sharding.needed(manifest, lang={step}).collect()}
    assert {r.curve_shard_ for r in held if r.lang == "fr"} <= picked < set(sizes)


def test_ordered_steps(spark):
    df = spark.createDataFrame([(f"source {i:03}",) for i in range(100) for _ in range(1 + 50 * (i == 3))] + [(None,)], "s string")
    steps = {r.s: r.step for r in df.select("s", sharding.ordered(df, "s").alias("step")).collect()}
    in_order = [steps[s] for s in sorted(s for s in steps if s)]
    assert in_order == sorted(in_order) and set(in_order) <= set(range(16)) and steps[None] == 0
    few = df.where("s < 'source 016'")
    assert len({r.step for r in few.select("s", sharding.ordered(few, "s").alias("step")).collect()}) == 16
    assert [r[0] for r in spark.range(1).select(sharding.magnitude(F.lit(16)), sharding.magnitude(F.lit(2**31))).collect()[0:1]] == [2]


# 4


def test_licenses(spark, none):
    mit = re.sub(r"(.{60}\S*) ", r"\1\n  ", licenses.MIT.upper()).replace('"', "'")
    rows = [(1, "Copyright (c) 2020 A. Body\n\n" + mit), (2, "Released under the MIT Licence!\nother text"), (3, None), (4, "Licensed under the Apache License, Version 2.0.\nLicensed under CC BY-NC 4.0."), (5, licenses.TEXTS["BSD-3-Clause"]), (5, licenses.TEXTS["BSD-3-Clause"]), (6, licenses.MIT + " and more")]
    got = sorted((r.doc_id, r.license, r.notices) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string").withColumn("digest", F.lit(1))).collect())
    assert got == [(1, "MIT", ""), (2, None, "MIT"), (3, None, ""), (4, None, "Apache-2.0,CC-BY-NC-4.0"), (5, "BSD-3-Clause", ""), (5, "BSD-3-Clause", ""), (6, None, "")]
    assert licenses.scan(none).count() == 0 and len(licenses.digests(licenses.TEXTS)) == len(licenses.TEXTS)
    more = [(1, "MIT License\n\nCopyright A. Body, 2020\n\n" + mit), (2, "The ISC License\nCopyright (c) 2004-2010 by B. Body\n" + licenses.ISC), (3, f"{' ' * 400}| Licensed under CC BY 4.0. |{'*' * 5000}"), (4, "Licence\n" + mit), (5, "Released under the MIT License, " + "and so on " * 30)]
    got = sorted((r.doc_id, r.license, r.notices) for r in licenses.scan(spark.createDataFrame(more, "doc_id long, text string")).collect())
    assert got == [(1, "MIT", ""), (2, "ISC", ""), (3, None, "CC-BY-4.0"), (4, None, ""), (5, None, "")]
    assert len(licenses.titled(licenses.TEXTS, licenses.TITLES)) == len(licenses.TEXTS) + sum(map(len, licenses.TITLES.values()))


# 5


def test_classifier(docs, labels, texts, none):
    rows = quality_classifier.classify(docs, labels).collect()
    assert len(rows) == len(texts) + 1 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    right = sum(r.predicted == (not 40 <= r.doc_id < 52) for r in rows if r.doc_id < 60)
    assert right >= 55
    model = quality_classifier.train(docs, labels)
    assert quality_classifier.keep(docs, model).columns == docs.columns and quality_classifier.keep(none, model).count() == 0
    bare = quality_classifier.classify(docs, labels.where("false")).select("score").distinct().collect()
    assert [r.score for r in bare] == [0.5] and quality_classifier.classify(none, labels).count() == 0


def test_classifier_by_brute_force(spark):
    """Normal equations and calibration against plain least squares and all block means."""
    rng = np.random.default_rng(5)
    stats = rng.normal(0, 1, (300, len(quality_classifier.STATISTICS))).astype(np.float32)
    y = (stats[:, 0] + 0.5 * stats[:, 1] ** 2 + rng.normal(0, 0.5, 300) > 0.3).astype(float)
    measured = spark.createDataFrame([(i, s.tolist()) for i, s in enumerate(stats)], "doc_id long, stats array<float>")
    labels = spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)], "doc_id long, quality int")
    fold = np.array([zlib.crc32(str(i).encode()) % 5 for i in range(300)])
    model = quality_classifier.fit(measured, quality_classifier.training_rows(labels))
    used, s = fold > 0, stats.astype(float)
    assert np.allclose(model.mean, s[used].mean(0)) and np.allclose(model.spread, s[used].std(0))
    z, at = model.features(s), fold > 1
    ones, count = y[used].sum(), used.sum()
    weight = np.where(y[at] > 0, count - ones, ones) / count
    root = np.sqrt(weight)[:, None]
    stacked = np.vstack([z[at] * root, np.sqrt(quality_classifier.RIDGE) * np.eye(z.shape[1])])
    expected = np.linalg.lstsq(stacked, np.concatenate([y[at] * root[:, 0], np.zeros(z.shape[1])]), rcond=None)[0]
    assert np.allclose(model.weights, expected, atol=1e-6)
    held = fold == 1
    x, v = model.raw(s[held]), y[held]
    order = np.argsort(x)
    v = v[order]
    plain = [max(min(v[i : k + 1].mean() for k in range(j, len(v))) for i in range(j + 1)) for j in range(len(v))]
    assert np.allclose(model.score(s[held][order]), (np.array(plain) * len(v) + 0.5) / (len(v) + 1))
    other = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert np.array_equal(quality_classifier.fit(measured, quality_classifier.training_rows(other)).weights, model.weights)


def test_isotonic_rises():
    x, y = np.array([1.0, 2.0, 3.0, 3.0, 4.0]), np.array([0.0, 1.0, 0.0, 0.0, 1.0])
    corners, values = quality_classifier.isotonic(x, y)
    assert np.all(np.diff(values) >= 0) and np.all(np.diff(corners) > 0) and values[-1] == 1


# 6


@pytest.mark.parametrize("top", [1, 2, 1000, 50_000, 2**40, 2**60, 2**64 - 1])
def test_simple8b_round_trip(top):
    rng = np.random.default_rng(top % 97)
    for n in (0, 1, 5, 700, 5000):
        ids = rng.integers(0, top, n, dtype=np.uint64, endpoint=top > 2**60)
        ids[: n // 3] %= np.uint64(5)
        assert (token_files.unpack(token_files.pack(ids)) == ids).all()


def test_token_files(spark, docs, texts, none):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORDS)
    path = token_files.scratch(spark)
    token_files.write(docs, path, WORDS, 2)
    rows = sorted(token_files.read_digests(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted([*range(len(texts)), 3])
    start = 0
    for r in rows:
        ids = [*tokenizer.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    held = {r.doc_id: r.ids for r in token_files.read(spark, path).collect()}
    assert held[4][-1] == 2 and len(held) == len(texts)
    token_files.write(none, path + "-none", WORDS, 2)
    assert token_files.read(spark, path + "-none").count() == 0


def test_token_files_random_texts(monkeypatch):
    """Ids of whole texts as the untouched library gives them, special tokens' literals included."""
    from tokenizers import Tokenizer

    tokenizer, rng = Tokenizer.from_file(WORDS), random.Random(6)
    signs = ["a", "B", " ", "  ", "\n", "\t", "é", "É", "ß", "ª", "µ", "İ", "ſ", "1", ".", "...", "!", "$$", "\x1c", "\x85", "the ", "'s", "'S", "don't", "中", "🙂", "e\u0301", "<|endoftext|>", "<|startoftext|>", "<|", "|>", "\xa0", "\u2028"]
    made = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 25))) for _ in range(3000)] + ["ab <|endoftext|> cd", "x<|endoftext|>y.", "", "w" * 3000, "an" * 40 + "!" * 90]
    for memory in (64 << 20, 4000):
        monkeypatch.setattr(token_files, "MEMORY", memory)
        with open(WORDS, "rb") as f:
            codec = token_files.WordCodec(f.read())
        assert codec.by_word
        for i in range(0, len(made), 500):
            flat, cuts = codec.encode_flat([*made[i : i + 500], None])
            assert [flat[a:b].tolist() for a, b in zip(cuts, cuts[1:])] == [x.ids for x in tokenizer.encode_batch([*made[i : i + 500], ""], add_special_tokens=False)]
    assert tokenizer.encode("ab <|endoftext|> cd", add_special_tokens=False).ids == [3937, 49407, 4480]


def test_token_files_of_another_tokenizer(spark, none, tmp_path):
    """A file that looks across white space is left to the library; literals as text; null ids first."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    rows = [(None, "no id"), (2, "two  words <|endoftext|>"), (1, None), (None, None), (1, "again")]
    token_files.write(spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path / "ids"), path, 7, special_as_text=True)
    held = sorted(token_files.read_digests(spark, str(tmp_path / "ids")).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in held] == [None, None, 1, 1, 2]
    found = {(r.doc_id, tuple(r.ids)) for r in token_files.read(spark, str(tmp_path / "ids")).collect()}
    assert found == {(k, (*tokenizer.encode(t or "", add_special_tokens=False).ids, 7)) for k, t in rows}


def test_blocks_hold_whole_documents(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_IDS", 12)
    rng = random.Random(3)
    rows = [(i, prose(rng, rng.choice([0, 1, 2, 30]))) for i in range(40)]
    token_files.write(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), str(tmp_path / "ids"), WORDS, 2)
    for r in spark.read.parquet(str(tmp_path / "ids")).collect():
        assert len(r.docs) == len(r.lengths) and (sum(r.lengths) <= 12 or len(r.docs) == 1)
    assert token_files.read(spark, str(tmp_path / "ids")).count() == 40


# 7


def brute_contaminated(rows, items, threshold=0.8):
    out = {}
    cut = lambda t: WORD.findall((t or "").lower())
    grams = lambda w, k: Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    for d, text in rows:
        words = cut(text)
        for i, item in items:
            own = cut(item)
            n, k = len(own), min(5, len(own))
            if not n:
                continue
            asked = grams(own, k)
            if not asked.keys() & grams(words, k).keys():
                continue
            for s in range(len(words) - n + 1):
                window = grams(words[s : s + n], k)
                both = sum((window & asked).values())
                value = both / sum((window | asked).values())
                if value >= threshold and value > out.get((d, i), (0, 0))[0]:
                    out[d, i] = (value, s)
    return out


@pytest.mark.parametrize("at_once", [500_000, 200])
def test_decontamination(spark, none, monkeypatch, at_once):
    monkeypatch.setattr(decontaminate, "SHINGLES", at_once)
    rng = random.Random(9)
    items = [(i, prose(rng, rng.randint(12, 40))) for i in range(12)] + [(20, None), (21, "  "), (22, "four words stand here"), (23, "tick tock " * 12)]
    rows = []
    for d in range(40):
        words = prose(rng, 80).split()
        if d < 12:
            own = items[d][1].split()
            if d % 3 == 1:
                own[0] = own[0].upper()
            if d % 3 == 2:
                own[-1] = "changed"
            words[10:10] = own
        elif d < 16:
            own = items[d - 12][1].split()
            words[5:5] = own[: len(own) // 2]  # half an item is none
        elif d == 16:
            words[3:3] = "Four\nwords\tstand here".split(" ")
        elif d == 17:
            words = ("tick tock " * 30).split()
        rows.append((d, " ".join(words)))
    rows += [(40, None), (41, ""), (42, rows[0][1]), (0, rows[0][1]), (43, "long " * 3000 + items[3][1] + " end" * 3000), (None, "before " + items[5][1])]
    items.append((5, items[6][1]))  # an id with two texts
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit(1).alias(c) for c in CLASHES])
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("n", F.lit(1))
    got = {(r.doc_id, r.item_id): (r.similarity, r.word) for r in decontaminate.contaminated(df, bench).collect()}
    assert got == brute_contaminated(rows, items)
    left = decontaminate.clean(df, bench)
    assert left.columns == df.columns and {r.doc_id for r in left.collect()} == {d for d, _ in rows} - {d for d, _ in got}
    assert decontaminate.contaminated(none, bench).count() == 0 and decontaminate.contaminated(df, bench.where("false")).count() == 0


def test_documents_shorter_than_an_item(spark):
    rng = random.Random(4)
    items = [(i, prose(rng, n)) for i, n in enumerate((59, 15, 30))] + [(3, "tick tock " * 12)]
    rows = []
    for i, text in items:
        own = text.split()
        for cut in (1, 2, 3, len(own) // 6, len(own) // 4, len(own) // 2):
            rows += [(len(rows), " ".join(own[:-cut])), (len(rows) + 1, " ".join(own[cut:])), (len(rows) + 2, " ".join([*own[cut:-1], "other"]))]
    expected = {}
    for d, text in rows:
        for i, item in items:
            a, b = (Counter(zip(*(t.lower().split()[k:] for k in range(5)))) for t in (text, item))
            value = sum((a & b).values()) / max(1, sum((a | b).values()))
            if value >= 0.8:
                expected[d, i] = (value, 0)
    df, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.similarity, r.word) for r in decontaminate.contaminated(df, bench).collect()}
    assert got == expected and len(got) > 12


# 8


def test_language(docs, texts, none):
    learned = language.learn(docs.where(~language.held_out(F.col("doc_id"))))
    rows = language.identify(docs, learned).collect()
    for r in rows:
        text = texts[r.doc_id]
        if not text or not any(c.isalpha() for c in text):
            assert (r.lang_pred, r.score) == ("und", 0)
        elif r.doc_id < 40:
            assert r.lang_pred == "en de fr".split()[r.doc_id % 3] or 20 <= r.doc_id < 33
        assert 0 <= r.score <= 1
    assert all(r.lang_pred == "und" for r in language.identify(docs, language.learn(none)).collect()) and language.identify(none, learned).count() == 0


def test_profiles_by_brute_force():
    text = "Ab ab, b1c"
    marked = "_ab_ab_b_c_"
    expected = Counter(c for c in marked if c != "_") + Counter(marked[i : i + 2] for i in range(10)) + Counter(marked[i : i + 3] for i in range(9) if marked[i + 1] != "_")
    codes, counts = language.tally(language.grams(text))
    assert sorted(counts) == sorted(expected.values()) and len(codes) == len(expected)


# 9


def brute_fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words)] if len(words) < 3 else [" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, radius=3):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_simhash_groups(docs, texts, none):
    prints = [brute_fingerprint(t) for t in texts]
    groups = brute_components(prints)
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        assert r.fp % 2**64 == prints[r.doc_id] and r.component_id == groups[r.doc_id]
    assert simhash.near_duplicates(none).count() == 0


def test_links_of_a_crowd_connect_it(spark):
    """Chains and crowds of close fingerprints: the same components as all pairs give."""
    rng = random.Random(4)
    prints = [rng.getrandbits(64) for _ in range(40)]
    centre = rng.getrandbits(64)
    prints += [centre ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64) for _ in range(120)]
    at = rng.getrandbits(64)
    for _ in range(60):  # a chain, three bits a step
        for _ in range(3):
            at ^= 1 << rng.randrange(64)
        prints.append(at)
    prints = sorted({p - 2**64 if p >> 63 else p for p in prints})
    nodes = spark.createDataFrame([(p,) for p in prints], "fp long")
    labels = {r.node: r.root for r in simhash.components(simhash.links(nodes)).collect()}
    groups = brute_components([p % 2**64 for p in prints])
    ours = [labels.get(p, p) for p in prints]
    assert len(set(ours)) == len(set(groups)) and len(set(zip(ours, groups))) == len(set(groups))


def test_manhattan_is_a_lower_bound():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 2**64, 4000, dtype=np.uint64)
    b = a ^ (np.uint64(1) << rng.integers(0, 64, 4000, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 4000, dtype=np.uint64))
    counts = lambda x: np.array([[bin(int(v) >> 2 * i & 3).count("1") for i in range(32)] for v in x])
    assert (simhash.manhattan(a, b) == np.abs(counts(a) - counts(b)).sum(1)).all() and (simhash.manhattan(a, b) <= np.bitwise_count(a ^ b)).all()


@pytest.mark.parametrize("huge", [8192, 10])
@pytest.mark.parametrize("half", [0, 1])
def test_large_cells(monkeypatch, huge, half):
    """Members of one cell agree in a half; cut by the other half's bytes they are linked all the same, and each guest to a member near it."""
    monkeypatch.setattr(simhash, "HUGE", huge)
    rng = random.Random(1)
    fp = np.unique(np.array([rng.getrandbits(10) << (32 if half == 0 else 0) for _ in range(60)], np.uint64))
    for guests in (0, 9):
        guest = np.arange(len(fp)) < guests
        forest = simhash.Forest(len(fp))
        for x, y in simhash.cell_links(fp, guest, 3, half):
            assert bin(int(fp[x] ^ fp[y])).count("1") <= 3
            assert forest.join(x, y) or len(fp) > huge
        own = [int(x) for x, g in zip(fp, guest) if not g]
        ours = [forest.find(i) for i in range(guests, len(fp))]
        groups = brute_components(own)
        assert all(ours[i] == ours[g] for i, g in enumerate(groups))


def brute_texts(texts, similarity=0.8, shingle=5):
    """The smallest place in each text's group by the overlap of all pairs' shingle sets."""
    sets = []
    for t in texts:
        words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        n = min(shingle, len(words))
        sets.append({tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] == sets[j] or len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]) > 0:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))]


def near_copies(rng, text, changes):
    words = text.split()
    for _ in range(changes):
        words[rng.randrange(len(words))] = "new" + str(rng.randrange(10**6))
    return " ".join(words)


def test_text_groups(spark, docs, texts, none):
    groups = brute_texts(texts)
    clashing = docs.select("*", *[F.lit(1).alias(c) for c in ("row", "node", "k", "m", "__mark", "least", "root", "cell")])
    kept = simhash_texts.one_of_each(clashing)
    assert kept.columns == clashing.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(groups))
    assert simhash_texts.one_of_each(none).count() == 0
    odd = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (4, "a b c d e F"), (None, None), (None, "other words")], "doc_id long, text string")
    assert {(r.doc_id, r.text) for r in simhash_texts.one_of_each(odd).collect()} == {(4, "a b c d e F"), (None, None), (None, "other words")}
    assert simhash_texts.one_of_each(odd).count() == 3


def test_text_groups_find_what_all_pairs_find(spark, monkeypatch):
    """A crowd of near copies, pairs at all similarities about the threshold, and strangers; in small parts too."""
    rng = random.Random(2)
    base = prose(rng, 150)
    made = [near_copies(rng, base, rng.randint(0, 3)) for _ in range(150)]
    for changes in (1, 2, 3, 4, 5, 6, 8, 12):
        for _ in range(12):
            made.append(prose(rng, 150))
            made.append(near_copies(rng, made[-1], changes))
    made += [prose(rng, 150) for _ in range(50)]
    groups = brute_texts(made)
    df = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string").repartition(4)
    for many, huge in ((64, 4096), (4, 16)):
        monkeypatch.setattr(simhash_texts, "MANY", many)
        monkeypatch.setattr(simhash_texts, "HUGE", huge)
        kept = {r.doc_id for r in simhash_texts.one_of_each(df).collect()}
        assert set(groups) <= kept and len(kept - set(groups)) <= 2  # exact in what is linked; nearly all links


def test_cut_cells_and_forests_lose_no_pair(spark, monkeypatch):
    """With one cell that is cut in parts of two, and with forests whose links all fail, every pair of the grid's is found all the same."""
    rng = random.Random(6)
    made = []
    for _ in range(12):
        made.append(prose(rng, 120))
        made.append(near_copies(rng, made[-1], 2))
    groups = brute_texts(made)
    assert len(set(groups)) < len(made)
    df = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string").repartition(2)
    monkeypatch.setattr(simhash_texts, "HUGE", 2)
    monkeypatch.setattr(simhash_texts, "TABLES", 2)
    monkeypatch.setattr(simhash_texts, "FIRST", 1)
    monkeypatch.setattr(simhash_texts, "cells", lambda prints, start, stop: (np.tile(np.arange(start, stop), (len(prints), 1)), np.tile((prints[:, :1] % np.uint64(1000)).astype(np.int32), (1, stop - start))))
    assert {r.doc_id for r in simhash_texts.one_of_each(df).collect()} == set(groups)
    monkeypatch.setattr(simhash_texts, "BLOCK", 5)
    assert {r.doc_id for r in simhash_texts.one_of_each(df).collect()} == set(groups)


def test_few_edges_are_grouped_as_many_are(spark, monkeypatch):
    rng = random.Random(9)
    edges = spark.createDataFrame([sorted(rng.sample(range(-300, 300), 2)) for _ in range(250)], "a long, b long").repartition(3)
    few = sorted(map(tuple, simhash_texts.grouped(edges).collect()))
    monkeypatch.setattr(simhash_texts, "FEW", 0)
    assert few == sorted(map(tuple, simhash_texts.grouped(edges).collect())) and simhash_texts.grouped(edges.where("false")).count() == 0


def test_long_texts_are_cut_without_a_trace(monkeypatch):
    """The buckets of a text in slices are those of the whole, also with words longer than a slice; and a slice bounds what is made at once."""
    rng = random.Random(8)
    texts = ["", " ", "a", "ab" * 60, "x" * 40 + " \u00e9\U0001f600 " + "y" * 33 + "\n", *("".join(rng.choices("ab \n\u00e9", k=n)) for n in (17, 100, 500))]
    for size in (3, 16, 64):
        monkeypatch.setattr(quality_rules, "SLICE", size)
        for t in texts:
            parts = list(quality_rules.bucket_parts(t))
            assert sorted(np.concatenate(parts).tolist()) == sorted(quality_rules.buckets(t).tolist()), (size, t)
            assert max(map(len, parts)) <= size or len(t) <= size


def test_sets_are_not_sorted_where_texts_are_read(spark):
    """Sets fill a sort's memory beside the reader's, so none is made there; repeated rows count once all the same."""
    texts = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, None)], "node long, text string")
    plan = simhash_texts.sets(texts)
    assert "Sort" not in plan._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.node, len(r.held)) for r in plan.collect()) == [(1, 2), (1, 2), (2, 0)]


def test_parities_never_hide_a_pair():
    """Pairs of sets of all sizes and overlaps, the empty one too: none at the similarity is held to be below it, most far below are."""
    rng = np.random.default_rng(4)
    hashes = rng.integers(0, 2**64, 4000, dtype=np.uint64)
    sets = [hashes[:0], *(hashes[start : start + n] for n in (1, 2, 5, 30, 146, 1000) for start in range(0, n + 1, max(1, n // 40)))]
    size, odd = np.array([len(x) for x in sets]), np.array([simhash_texts.parities(x) for x in sets])
    hidden = far = 0
    for i, x in enumerate(sets):
        below = simhash_texts._below(size, odd, np.arange(len(sets)), i, 0.8)
        for j, y in enumerate(sets):
            shared = len(np.intersect1d(x, y))
            if shared >= 0.8 * (len(x) + len(y) - shared):
                assert not below[j]
            elif len(x) == len(y) == 146 and shared < 0.6 * (len(x) + len(y) - shared):
                hidden, far = hidden + int(below[j]), far + 1
    assert hidden > 0.8 * far > 0


def test_forest_is_minimal(monkeypatch):
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 2**63, simhash_texts.LANES, dtype=np.uint64)
    near = np.array([centre ^ (np.uint64(1) << rng.integers(0, 64, simhash_texts.LANES, dtype=np.uint64)) for _ in range(40)])
    words = np.concatenate([near, rng.integers(0, 2**63, (30, simhash_texts.LANES), dtype=np.uint64)])
    cell, alone = np.zeros(64, np.int64), np.arange(64)
    more = simhash_texts.forest(cell, words[:64], alone)
    halves = np.where(alone < 40, alone % 2, alone)  # two trees that are known
    small, joined = simhash_texts.forest(cell, words[:64], alone, 0), simhash_texts.forest(cell, words[:64], halves, 0)
    monkeypatch.setattr(simhash_texts, "MANY", 2)
    large, again = simhash_texts.forest(cell, words[:64], alone, 0), simhash_texts.forest(cell, words[:64], halves, 0)
    assert len(small) == len(large) == 39 and sum(d for *_, d in small) == sum(d for *_, d in large)
    assert set(small) <= set(more) and len(more) <= 39 + 4 * 40
    assert len(joined) == 1 and again and all(halves[x] != halves[y] for x, y, _ in joined + again)


# 10


def test_urls(spark):
    rules = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
    cases = {
        "http://A.Example.NET/en/x?y=/de/": ("a.example.net", "/en/x", "example.net/en/", "allow"),
        "https://example.net?q#f": ("example.net", "", None, None),
        "https://example.net/": ("example.net", "/", "net/", "block"),
        "https://net/en/": ("net", "/en/", "net/", "block"),
        "https://notexample.com/de/": ("notexample.com", "/de/", None, None),
        "https://x.example.com/de/1#t": ("x.example.com", "/de/1", "example.com/de/", "block"),
        "https://x.example.com/DE/1": ("x.example.com", "/DE/1", None, None),
        "http://b.org/fr/?x": ("b.org", "/fr/", "org/fr/", "allow"),
        "no scheme": ("", "", None, None),
        "a://b://c/d": ("b:", "//c/d", None, None),
        "": ("", "", None, None),
    }
    rows = [(i, u) for i, u in enumerate(cases)] + [(98, None), (0, next(iter(cases)))]
    df = spark.createDataFrame(rows, "page_id long, url string").select("*", *[F.lit("z").alias(c) for c in ("host", "path", "verdict", "y", "last", "key")])
    got = {r.page_id: r for r in urls.judge(df, rules).collect()}
    for i, (u, (host, path, rule, verdict)) in enumerate(cases.items()):
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), u
        assert got[i].verdict == verdict or rule is None and got[i].verdict in ("allow", "block")
    assert got[98].host == "" and urls.judge(df, rules).count() == len(rows) and urls.judge(df.where("false"), rules).count() == 0
    assert {r.verdict for r in urls.judge(df, ()).collect()} == {"allow"}


def test_every_suffix_counts(spark):
    suffixes = [f"t{i:03d}" for i in range(250)]
    known = [(f"http://a.{t}/p{j}", "block" if i % 2 else "allow") for i, t in enumerate(suffixes) for j in range(6 if i < 200 else 4)]
    labelled = spark.createDataFrame(known, "url string, verdict string")
    pages = spark.createDataFrame([(i, f"http://a.{t}/p9") for i, t in enumerate(suffixes)], "page_id long, url string")
    got = {r.page_id: r.verdict for r in urls.judge(pages, (), labelled).collect()}
    assert got == {i: "block" if i % 2 else "allow" for i in range(250)}


def test_long_texts_in_a_small_heap(spark, tmp_path):
    # 4096 of these texts are 65 MB, which four tasks read at once
    rows = spark.range(4 * 4096).select(F.col("id").alias("doc_id"), F.concat(F.repeat(F.lit("x"), 16_000), F.col("id").cast("string")).alias("text"))
    rows.repartition(4).write.parquet(f"{tmp_path}/documents")
    run = f"""
from pyspark.sql import SparkSession
from loomtab.llm import simhash_texts
conf = {{"spark.driver.memory": "512m", "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "4", "spark.checkpoint.dir": "{tmp_path}/checkpoint"}}
spark = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
print("kept", simhash_texts.one_of_each(spark.read.parquet("{tmp_path}/documents")).count())
"""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    done = subprocess.run([sys.executable, "-c", run], env=os.environ | {"PYTHONPATH": root}, capture_output=True, text=True, timeout=600)
    assert f"kept {4 * 4096}" in done.stdout, done.stderr[-2000:]
