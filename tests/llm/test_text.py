"""Licenses, languages, quality, near-duplicates."""

import glob
import math
import os
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from murmura.llm import hamming_dedup, kn_quality, language_id, license_scan
from murmura.llm.shingles import MinHash, shingle_sets


def test_licenses_are_the_sqls(spark, data):
    from murmura.llm import queries

    con = duckdb.connect()
    for path in glob.glob(f"{data}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    for name, sql in queries.oracle_sql().items():
        got = queries.queries()[name](spark, data).toPandas()
        expected = con.execute(sql).fetchdf()[list(got.columns)]
        plain = lambda f: sorted((tuple(None if pd.isna(x) else x for x in r) for r in f.itertuples(index=False)), key=repr)
        assert plain(got) == plain(expected), name


def test_license_edges(spark, edge_docs, no_docs):
    got = license_scan.scan(edge_docs).collect()
    assert [(r["doc_id"], r["license"], r["containment"]) for r in got] == [(3, "MIT", 1.0)]
    assert license_scan.scan(no_docs).count() == 0 and license_scan.scan(edge_docs, {}).count() == 0
    text = "x " * 3000 + "This work is licensed under the GNU General Public License, version 3. " + "y " * 3000
    odd = spark.createDataFrame([(None, text), (7, text), (7, text), (8, "licensed under the gnu general public")], "doc_id long, text string")
    got = sorted(((r["doc_id"] is None, r["license"], r["found"]) for r in license_scan.scan(odd).collect()))
    assert got == [(False, "GPL-3.0", 7)] * 2 + [(True, "GPL-3.0", 7)]
    again = spark.createDataFrame([(7, text), (7, "released under the mit license"), (7, "nothing"), (None, "nothing")], "doc_id long, text string")
    assert sorted(r["license"] for r in license_scan.scan(again).collect()) == ["GPL-3.0", "MIT"]


def test_licenses_beyond_the_tables(spark):
    header = "you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
    cases = {
        "All-Rights-Reserved": "Copyright 2020 A. Writer.\nAll rights reserved.\n",
        "GPL-3.0": "This program is free software: " + header.format("", "3"),
        "GPL-2.0": "This program is free software; " + header.format("", "2"),
        "LGPL-2.1": "This library is free software; " + header.format("Lesser ", "2.1"),
        "LGPL-3.0": "This library is free software: " + header.format("Lesser ", "3"),
        "AGPL-3.0": "This program is free software: " + header.format("Affero ", "3"),
        "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "Unlicense": "This is free and unencumbered software released into the public domain.",
        "MIT": "// SPDX-License-Identifier: MIT",
        "MPL-2.0": '"Contributor" means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software.',
        "Apache-2.0": '"License" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document.',
    }
    words = " ".join(f"w{i}" for i in range(997))
    names = [*cases] * 8
    df = spark.createDataFrame([(i, " ".join(words.split()[: 31 * i % 97]) + " . " + cases[n] + " . " + words) for i, n in enumerate(names)], "doc_id long, text string")
    assert sorted((r["doc_id"], r["license"]) for r in license_scan.scan(df).collect()) == list(enumerate(names))


def test_license_version_matters(spark):
    df = spark.createDataFrame([(1, "licensed under the GNU General Public License, version 2"), (2, "licensed under the GNU General Public License, version 2 and also licensed under the GNU General Public License, version 3")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["license"]) for r in license_scan.scan(df).collect()) == [(1, "GPL-2.0"), (2, "GPL-2.0"), (2, "GPL-3.0")]


def test_band_probability(spark):
    """Windows of similarity s share a band with probability 1 - (1 - s) ** 16, whatever s."""
    rng = np.random.default_rng(3)
    rows, n = [], 1500
    for same in (1, 2, 4):
        for k in range(n):
            x = rng.integers(-(1 << 62), 1 << 62, 16).tolist()
            rows += [(same, k, x[:8]), (same, k, x[:same] + x[8 : 16 - same])]
    df = spark.createDataFrame(rows, "same int, k int, w array<bigint>").select("same", "k", *license_scan._items())
    met = license_scan._keys(df, False).groupBy("same", "k", "key").count().where("count > 1").select("same", "k").distinct()
    got = {r["same"]: r["count"] / n for r in met.groupBy("same").count().collect()}
    for same in (1, 2, 4):
        assert got[same] == pytest.approx(1 - (1 - same / (16 - same)) ** 16, abs=0.04)


def test_templates_of_whole_texts(spark):
    """A template of 2,000 shingles, in a table, is found in texts that hold three quarters of it, among many others."""
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in rng.integers(0, 5000, 2002)]
    table = spark.createDataFrame([("Long-1.0", " ".join(words)), (None, "no name at all")] + [(f"Other-{i}", " ".join(f"o{x}" for x in rng.integers(0, 5000, 300))) for i in range(200)], "license string, text string")
    part = lambda share: " ".join("changed" if rng.random() < share else w for w in words)
    texts = ["intro " * 50 + part(0.0) + " end" * 50, part(0.06), part(0.5), " ".join(words[:1700]), " ".join(words[:900]), "nothing of it"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["license"], r["shingles"]) for r in license_scan.scan(df, table).collect()}
    assert got.keys() == {0, 1, 3} and {x[0] for x in got.values()} == {"Long-1.0"} and got[0][1] > 1950


def test_language_held_out(spark, data, docs):
    from murmura.llm.queries import op2_language

    got = {r["doc_id"]: r for r in op2_language(spark, data).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    assert all(got[r["doc_id"]]["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    tried = [r for r in rows if got[r["doc_id"]]["held_out"]]
    assert sum(got[r["doc_id"]]["lang_pred"] == r["lang"] for r in tried) >= 0.95 * len(tried)


def test_language_edges(spark, edge_docs, no_docs, docs):
    model = language_id.learn(docs)
    got = language_id.predict(edge_docs, model).collect()
    assert len(got) == edge_docs.count() and all(0 <= r["score"] <= 1 for r in got)
    named = {r["doc_id"]: r["lang_pred"] for r in got}
    assert named[0] == named[1] == named[2] == "und" and named[7] != "und"
    assert language_id.identify(no_docs).count() == 0
    assert {r["lang_pred"] for r in language_id.identify(docs.withColumn("lang", docs.lang.substr(9, 1)).where("false")).collect()} == set()
    nothing = spark.createDataFrame([(2, "abc", None)], "doc_id long, text string, lang string")
    assert language_id.identify(nothing).first()["lang_pred"] == "und"


def test_language_sample(spark):
    rows = [(i, "xy"[i % 7 == 0]) for i in range(9000)] + [(5, "z")] * 9000 + [(i, "z") for i in range(6, 8)]
    ids = spark.createDataFrame(rows, "doc_id long, lang string").repartition(7)
    h = {r["doc_id"]: r["h"] for r in ids.select("doc_id", F.xxhash64("doc_id").alias("h")).distinct().collect()}
    for langs in ("xy", "xyz"):  # z repeats an id: too few rows may hash below its limit
        of = {x: [d for d, lang in rows if lang == x] for x in langs}
        expected = {d for x in langs for d in sorted(of[x], key=h.get)[:40]}
        assert language_id.lowest_ids(ids, {x: len(of[x]) for x in langs}, 40) == expected


def test_presence_kernel():
    a, b = language_id.presence("abc, ABD"), language_id.presence(" abc abd ")
    assert (a == b).all() and language_id.presence("12 !") is None and language_id.presence("\U00010400") is not None


def plain_grams(text):
    """Character 1- to 3-grams of the lower-cased letters, all else being one space, with one at both ends."""
    letters = " " + " ".join(re.findall(r"[^\W\d_]+", text.lower())) + " "
    return {letters[i : i + n] for n in (1, 2, 3) for i in range(len(letters) - n + 1)}


def test_kernel_landmarks_and_ridge_against_a_plain_computation(docs):
    rows = docs.where("lang IS NOT NULL AND length(text) BETWEEN 50 AND 3000").orderBy("doc_id").limit(120).collect()
    assert len(rows) >= 100
    langs = [r["lang"] for r in rows]
    bits = np.array([language_id.presence(r["text"]) for r in rows])
    model = language_id.fit(bits[:80], langs[:80], landmarks=12)
    names, grams = model.languages, [plain_grams(r["text"]) for r in rows]
    kernel = lambda a, b: len(a & b) / math.sqrt(len(a) * len(b))
    marks = [i for x in names for i in [j for j in range(80) if langs[j] == x][: max(1, 12 // len(names))]]
    full = np.array([[kernel(a, grams[i]) for i in marks] for a in grams])
    assert np.abs(model.kernels(bits) - full).max() < 0.07  # hashed n-grams share a bit now and then
    full = model.kernels(bits).astype(float)
    # the map: full times the inverse square root of the landmarks' own kernel; then weighted least squares with a penalty
    u, s, _ = np.linalg.svd(full[marks])
    mapped = full @ (u / np.sqrt(s)) @ u.T
    weight = np.sqrt([1 / langs[:80].count(x) for x in langs[:80]])[:, None]
    penalty = 1e-3 * ((mapped[:80] * weight) ** 2).sum() / len(marks)
    a = np.vstack([mapped[:80] * weight, math.sqrt(penalty) * np.eye(len(marks))])
    y = np.vstack([np.array([[float(x == n) for n in names] for x in langs[:80]]) * weight, np.zeros((len(marks), len(names)))])
    assert np.abs(mapped @ np.linalg.lstsq(a, y)[0] - model.scores(bits)).max() < 1e-3


def test_language_sample_is_bounded_by_row(spark, docs):
    many = docs.where("lang IS NOT NULL").limit(40).unionByName(spark.range(3000).selectExpr("4L AS doc_id", "concat('palabra ', id) AS text", "'es' AS lang"), allowMissingColumns=True)
    model = language_id.learn(many, per_language=20, landmarks=1000)
    assert len(model.landmarks) <= 20 * len(model.languages)


def kneser_ney(train, text, order=5):
    """Plain interpolated modified Kneser-Ney by its recursion."""
    counts = {n: Counter() for n in range(1, order + 1)}
    pad = lambda t: b"\x02" * (order - 1) + t + b"\x03"
    for t in train:
        p = pad(t)
        for i in range(order - 1, len(p)):
            counts[order][p[i - order + 1 : i + 1]] += 1
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    cut = {n: [0.0, *kn_quality.discounts([sum(c == k for c in counts[n].values()) for k in range(1, 5)])] for n in counts}

    def p(gram):
        if not gram:
            return 1 / 256
        n = len(gram)
        same = {g: c for g, c in counts[n].items() if g[:-1] == gram[:-1]}
        total = sum(same.values())
        if not total:
            return p(gram[1:])
        c = counts[n][gram]
        free = sum(cut[n][min(x, 3)] for x in same.values()) / total
        return (c - cut[n][min(c, 3)]) / total + free * p(gram[1:])

    q = pad(text)
    return math.exp(-sum(math.log(p(q[i - order + 1 : i + 1])) for i in range(order - 1, len(q))) / (len(text) + 1))


def test_perplexity_is_kneser_neys(spark):
    train = ["the cat sat on the mat", "the dog sat on the log", "a cat and a dog", "this and that and the other"]
    counts = spark.createDataFrame([(t,) for t in train], "text string")
    from murmura.llm.common import save

    saved = save(kn_quality.count_grams(counts), "counts")
    texts = ["the cat sat", "zebra!", "", "the  other\ndog", "été"]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["perplexity"] for r in kn_quality.perplexity(docs, saved).collect()}
    clean = [kn_quality.canonical(t) for t in texts]
    for i, t in enumerate(clean):
        assert got[i] == pytest.approx(kneser_ney([kn_quality.canonical(x) for x in train], t), rel=1e-4)


def test_quality_query(spark, data):
    from murmura.llm.queries import op5_quality

    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    got = {r["doc_id"]: r["accepted"] for r in op5_quality(spark, data).collect()}
    assert len(got) == spark.read.parquet(f"{data}/documents.parquet").count()
    good, bad = [d for d, q in labels.items() if q == 1], [d for d, q in labels.items() if q == 0]
    assert sum(got[d] for d in good) >= 0.98 * len(good) and sum(got[d] for d in bad) <= 0.1 * len(bad)


def test_quality_edges(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(4, 1, 0), (5, 1, 0), (7, 1, None), (7, 0, None), (None, 1, 0), (9, None, 0)], "doc_id long, quality int, toxic int")
    got = kn_quality.judge(edge_docs, labels).collect()
    assert len(got) == edge_docs.count()
    by = {r["doc_id"]: r for r in got}
    assert by[0]["accepted"] and by[1]["accepted"] and by[4]["accepted"]
    assert kn_quality.judge(no_docs, labels).count() == 0
    untrained = kn_quality.judge(edge_docs, labels.where("false"))
    assert untrained.count() == edge_docs.count() and untrained.where("NOT accepted").isEmpty()


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_shingles(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def test_shingles():
    texts = ["a b c d e f", "A  b\tc d e\nf", "x", "", "  ", "x y z", "é É b c d é É b c d", "x y", "q\x0bq\x1cq q\xa0q", "a b c d a b c d a b c d"]
    sets = shingle_sets(texts)
    for i, a in enumerate(texts):
        assert len(sets[i]) == len(plain_shingles(a))
        for j, b in enumerate(texts):
            assert len(np.intersect1d(sets[i], sets[j])) == len(plain_shingles(a) & plain_shingles(b))


def test_signature_agreement():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 1 << 63, 4000, dtype=np.uint64) * np.uint64(2)
    minhash = MinHash(2000)
    assert (minhash(x[:3000]) == minhash(x[1000:])).mean() == pytest.approx(0.5, abs=0.05)


def brute_components(ids, texts, percent=75):
    sets = [plain_shingles(t) for t in texts]
    label = list(ids)
    changed = True
    links = [(i, j) for i in range(len(ids)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    while changed:
        changed = False
        for i, j in links:
            low = min(label[i], label[j])
            if label[i] != low or label[j] != low:
                label[i] = label[j] = low
                changed = True
    return dict(zip(ids, label)), {i: len(s) for i, s in zip(ids, sets)}


def check_components(got, ids, texts):
    comp, n = brute_components(ids, texts)
    assert {r["doc_id"]: r["component_id"] for r in got} == comp
    assert {r["doc_id"]: r["n_shingles"] for r in got} == n
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_duplicates_query(spark, data, docs):
    from murmura.llm.queries import op8_near_duplicates

    rows = docs.collect()
    check_components(op8_near_duplicates(spark, data).collect(), [r["doc_id"] for r in rows], [r["text"] for r in rows])


def test_near_duplicate_groups(spark):
    """A group whose copies are each near some, not all; chains; pairs just at and just under the limit."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for k in range(60):
        words = list(base)
        for at in rng.choice(120, int(rng.integers(0, 9)), replace=False):
            words[at] = f"v{k}_{at}"
        texts.append(" ".join(words))
    texts += [" ".join(f"c{j}" for j in range(s, s + 104)) for s in range(0, 150, 15)]  # a chain: 85 of 115 shared, each with the next
    texts += [" ".join(f"d{j}" for j in range(s, s + 104)) for s in range(0, 150, 14)]  # 86 of 114
    texts += ["few words", "Few  words", "few words here", ""]
    order = rng.permutation(len(texts))
    ids = [int(i) * 3 + 1 for i in order]
    df = spark.createDataFrame([(i, t) for i, t in zip(ids, texts)], "doc_id long, text string")
    check_components(hamming_dedup.near_duplicates(df).collect(), ids, texts)


def test_near_duplicates_in_blocks(spark, monkeypatch):
    """Keys larger than a block give the same."""
    monkeypatch.setattr(hamming_dedup, "BLOCK", 7)
    rng = np.random.default_rng(6)
    texts = []
    for k in range(50):
        words = [f"w{i}" for i in range(80)]
        for at in rng.choice(80, 4, replace=False):
            words[at] = f"v{k}_{at}"
        texts.append(" ".join(words))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    check_components(hamming_dedup.near_duplicates(df).collect(), list(range(50)), texts)


def test_all_signatures_within_the_distance_share_a_key(spark):
    """Planted pairs that differ in exactly the threshold, in errors spread evenly and at random; one more may be missed."""
    chunks, width, near = hamming_dedup.CHUNKS, hamming_dedup.WIDTH, hamming_dedup.NEAR
    rng = np.random.default_rng(12)
    size, rows, expected = chunks * width, [], []
    for k in range(60):
        one = rng.integers(0, 1 << 16, size).astype("<u2")
        other = one.copy()
        if k % 3 == 0:
            wrong = rng.choice(size, near, replace=False)
        else:  # two a chunk but for one that has one; and one beyond the threshold
            wrong = np.concatenate([c * width + rng.choice(width, 2, replace=False) for c in range(chunks)])
            wrong = rng.permutation(wrong)[: near + (k % 3 == 2)]
        other[wrong] ^= 1
        rows += [(2 * k, 2 * k, bytearray(one.tobytes())), (2 * k + 1, 2 * k + 1, bytearray(other.tobytes()))]
        expected.append(k % 3 < 2)
    keys = hamming_dedup.index_keys(spark.createDataFrame(rows, "id long, comp long, sig binary"))
    met = {r["a"] for r in keys.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b").collect()}
    assert [2 * k in met for k in range(60)] == expected


def test_components(spark):
    links = [(5, 4), (4, 3), (3, 2), (2, 1), (10, 9), (9, 8), (8, 10), (20, 20)] + [(100, i) for i in range(101, 140)]
    got = {r["id"]: r["comp"] for r in hamming_dedup.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {k: v for k, v in got.items() if k <= 5} == {2: 1, 3: 1, 4: 1, 5: 1} and got[10] == got[9] == 8 and all(got[i] == 100 for i in range(101, 140))


def test_near_duplicate_edges(spark, edge_docs, no_docs):
    got = hamming_dedup.near_duplicates(edge_docs).collect()
    assert len(got) == edge_docs.count()
    by = {r["doc_id"]: r for r in got}
    assert by[0]["n_shingles"] == by[1]["n_shingles"] == by[2]["n_shingles"] == 0
    assert by[5]["component_id"] == 4 and not by[5]["kept"] and by[6]["n_shingles"] == 1
    assert by[None]["component_id"] is None and by[None]["kept"]
    assert hamming_dedup.near_duplicates(no_docs).count() == 0


def test_quality_keeps_good_and_catches_junk(spark):
    folder = "/root/testdata/sf0.1"
    if not os.path.isdir(folder):
        pytest.skip("no driver tables")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    judged = kn_quality.judge(spark.read.parquet(f"{folder}/documents.parquet"), labels).select("doc_id", "accepted")
    share = {r["quality"]: r["share"] for r in judged.join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("accepted").cast("int")).alias("share")).collect()}
    assert share[0] <= 0.05 and share[1] >= 0.995
