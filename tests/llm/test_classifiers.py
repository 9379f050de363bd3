import random
import re
import textwrap
import zlib

import pytest
from pyspark.sql import functions as F

from recollect.llm import langid, license, queries, toxicity
from recollect.llm.license_texts import OTHER_HELD_OUT

BIG = "/root/testdata/sf0.01"


def test_language_query(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{BIG}/documents.parquet").collect()}
    rows = queries.op8_language(spark, BIG).collect()
    assert len(rows) == len(docs)
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in rows)
    assert sum(r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in held) / len(held) >= 0.97


def test_language_sees_text_only(spark):
    docs = spark.read.parquet(f"{BIG}/documents.parquet").limit(50)
    model = langid.fit(docs)
    a = langid.identify(docs, ["doc_id"], model).collect()
    b = langid.identify(docs.withColumn("lang", F.lit("zz")).withColumn("source", F.lit("q")), ["doc_id"], model).collect()
    assert a == b


def test_language_keeps_rare_ones(spark, monkeypatch):
    """A language of four rows in a thousand stays in a sample of sixty, and its words keep their vowel signs."""
    monkeypatch.setattr(langid, "LEAST", 4)
    rng = random.Random(8)
    make = lambda letters: " ".join("".join(rng.choices(letters, k=5)) for _ in range(20))
    rows = [(i, make("abcde"), "aa") for i in range(600)] + [(i, make("vwxyz"), "vv") for i in range(600, 1195)] + [(i, make("कखगाीु"), "hi") for i in range(1195, 1205)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs, 60)
    assert model.classes == ["aa", "hi", "vv"]
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs, ["doc_id"], model).collect()}
    assert sum(got[i] == lang for i, _, lang in rows) >= 1200 and all(got[i] == "hi" for i, _, lang in rows if lang == "hi")
    assert langid._other.sub(" ", "कि की, x") == "कि की x"


def test_language_odd(spark, odd):
    rows = {(r["doc_id"], r["text"]): (r["lang_pred"], r["score"]) for r in langid.identify(odd("lang_pred"), ["doc_id", "text", "lang_pred"]).collect()}
    assert rows[3, None] == rows[2, ""] == rows[5, "\n\n \t\n"] == ("und", 0.0)
    assert langid.identify(odd(rows=[]), ["doc_id"]).count() == 0
    one = [(1, "only one language here", "en", "a", 1, "x"), (2, "123 !!", "en", "a", 1, "x")]
    assert {r["doc_id"]: r["lang_pred"] for r in langid.identify(odd(rows=one), ["doc_id"]).collect()} == {1: "en", 2: "und"}


def test_toxicity_query(spark):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{BIG}/labels.parquet").collect()}
    rows = queries.op6_toxicity(spark, BIG).collect()
    assert len(rows) == 1000 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    good = [r["score"] for r in held if labels[r["doc_id"]]]
    bad = [r["score"] for r in held if not labels[r["doc_id"]]]
    auc = sum((x > y) + 0.5 * (x == y) for x in good for y in bad) / (len(good) * len(bad))
    assert auc >= 0.8


def test_toxicity_finds_sentences():
    rng = random.Random(6)
    words = [f"w{i}" for i in range(60)]
    texts, labels = [], []
    for i in range(400):
        s = [" ".join(rng.choices(words, k=8)) for _ in range(6)]
        if i % 4 == 0:
            s[rng.randrange(6)] += " you nastyword" + rng.choice(["a", "b", "cd"])
        texts.append(". ".join(s) + ".")
        labels.append(int(i % 4 == 0))
    model = toxicity.train(texts[:300], labels[:300], 0.25)
    for t, y in zip(texts[300:], labels[300:]):
        score, parts = model.scored(t)
        assert (score >= 0.5) == bool(y)
        if y:
            s, e, _ = max(parts, key=lambda p: p[2])
            assert "nastyword" in t[s:e]


def test_toxicity_odd(spark, odd):
    labels = spark.createDataFrame([(1, 0), (4, 1), (4, 0), (6, 0), (None, 1), (2, None), (99, 1)], "doc_id long, toxic int")
    rows = toxicity.score_toxicity(odd("spans"), labels).collect()
    assert len(rows) == 9 and all(r["score"] == 0 for r in rows if r["doc_id"] in (2, 3, 5))
    assert toxicity.score_toxicity(odd(), labels.limit(0)).count() == 9
    assert toxicity.score_toxicity(odd(rows=[]), labels).count() == 0


@pytest.fixture(scope="module")
def scanner():
    return license.train()


def found(spark, texts, scanner):
    rows = license.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), scanner).collect()
    return {(r["doc_id"], r["paragraph"]): r for r in rows}


def test_license_families(scanner):
    for family, texts in license.TEMPLATES.items():
        for t in texts:
            for form in (t, t.upper(), "Note: " + t + " Thanks."):
                p = scanner.probabilities(form)
                assert scanner.classes[p.index(max(p))] == family, (family, form)
    best = lambda p: scanner.classes[p.index(max(p))]
    for t in ["He lost his driving license in May.", "The public was released under the general rule.", "", "foundation of the work"]:
        assert best(scanner.probabilities(t)) == license.UNKNOWN, t
    # of texts that the weights never saw some licences of other families pass for one; the templates don't confirm them (see below)
    assert sum(best(scanner.probabilities(t)) == license.UNKNOWN for t in OTHER_HELD_OUT) >= 0.85 * len(OTHER_HELD_OUT)


def test_license_texts_wrapped_as_in_files(spark, scanner):
    """Whole licence texts, wrapped at several widths, plain and as comments: every paragraph that holds a notice is confirmed."""
    texts, families = [], []
    for family in ("mit", "apache-2.0", "bsd", "isc", "gpl", "lgpl", "mpl-2.0", "epl", "zlib", "boost", "unlicense"):
        for width, mark in ((72, ""), (50, "# "), (60, " * "), (79, "// ")):
            # a blank comment line ends a paragraph as a blank line does
            texts.append(("\n" + mark.rstrip() + "\n").join("\n".join(textwrap.wrap(t, width, initial_indent=mark, subsequent_indent=mark)) for t in license.TEMPLATES[family]))
            families.append(family)
    got = found(spark, texts, scanner)
    for i, family in enumerate(families):
        mine = [r for (d, _), r in got.items() if d == i]
        assert {r["family"] for r in mine if r["confirmed"]} == {family}, (family, texts[i], mine)
        assert len([r for r in mine if r["confirmed"]]) >= len(license.TEMPLATES[family]) - 1, (family, texts[i][:300])


def test_license_terms_and_identifiers(spark, scanner):
    """Words that tell licences apart, and declared identifiers."""
    texts = {
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.": set(), "Licensed under CC BY-NC-SA 4.0.": set(), "Licensed under CC BY-NC-ND 4.0.": set(),
        "Licensed under CC BY-SA 4.0.": {"cc-by-sa"}, "Licensed under CC BY-NC 4.0.": {"cc-by-nc"}, "This work is licensed under a Creative Commons Attribution 4.0 International License.": {"cc-by"},
        "// SPDX-License-Identifier: (MIT OR Apache-2.0)": {"mit", "apache-2.0"}, "SPDX-License-Identifier: Artistic-2.0": set(), "License: GPL-2.0+": {"gpl"}, "license = \"BSD-3-Clause\"": {"bsd"},
        "SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0 AND (ISC OR CC-BY-NC-ND-4.0)": {"gpl", "isc"}, "License: see the file": set(),
        "SPDX-License-Identifier: MIT\nPermission is hereby granted, free of charge, to any person": {"mit"}, "This work is licensed under the GNU General Public License, version 3.": {"gpl"},
        "Licensed under the GNU Lesser General Public License, version 2.1.": {"lgpl"},
    }
    rows = license.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), scanner).collect()
    got = {i: {r["family"] for r in rows if r["doc_id"] == i and r["confirmed"]} for i in range(len(texts))}
    assert {t: got[i] for i, t in enumerate(texts)} == texts
    assert all(r["probability"] == r["coverage"] == 1.0 for r in rows if r["doc_id"] == 6)


def test_license_foreign_and_short(spark, scanner):
    short = {"Licensed under the BSD license": "bsd", "SPDX-License-Identifier: MIT": "mit", "// SPDX-License-Identifier: Apache-2.0": "apache-2.0", "All rights reserved.": "proprietary", "This is free and unencumbered software released into the public domain.": "unlicense"}
    got = found(spark, [*short, *OTHER_HELD_OUT, *license.OTHER], scanner)
    assert [(got[i, 0]["family"], got[i, 0]["confirmed"]) for i in range(len(short))] == [(f, True) for f in short.values()]
    assert not [r for (d, _), r in got.items() if d >= len(short) and r["confirmed"]]


def test_license_query(spark):
    """Every licence line of the tables is found and confirmed, and nothing else is."""
    notice = {
        "Released under the MIT License.": "mit", "Licensed under the Apache License, Version 2.0.": "apache-2.0", "Licensed under CC BY-NC 4.0.": "cc-by-nc",
        "This work is licensed under the GNU General Public License, version 3.": "gpl", "All rights reserved.": "proprietary",
    }
    want = []
    for r in spark.read.parquet(f"{BIG}/documents.parquet").collect():
        for line in re.split("\n", r["text"] or ""):
            want += [(r["doc_id"], f) for n, f in notice.items() if n in line]
    rows = queries.op10_license_scan(spark, BIG).collect()
    assert want and {(r["doc_id"], r["family"]) for r in rows if r["confirmed"]} == set(want)
    assert all(r["probability"] > 0.5 for r in rows) and len(rows) <= len(want) * 1.1


def test_license_model_and_rows_do_not_depend_on_partitions(spark, scanner):
    license.train.cache_clear()
    assert license.train() == scanner
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert sorted(license.scan(docs).collect(), key=repr) == sorted(license.scan(docs.repartition(17)).collect(), key=repr)


def plain_scan(text, model):
    """The operator in Python."""
    out = {}
    for i, p in enumerate(re.split(r"\r?\n", re.sub(license.WRAP, " ", text))):
        if not re.search(license.ANCHOR, text) or not re.search(license.ANCHOR, p):
            continue
        score = model.probabilities(p)
        best = model.classes[score.index(max(score))]
        have = license.ngrams(license.words(license.anchored(p)))
        if best != license.UNKNOWN and have & {g for _, t in license.template_sentences() for g in t}:
            out[i] = (best, max(score), max(len(have & set(t)) / len(t) for f, t in license.template_sentences() if f == best))
    return out


def test_license_matches_plain(spark, scanner):
    texts = ["\n".join(t for ts in license.TEMPLATES.values() for t in ts), "plain prose of the license of work\nVersion 2.0 of MIT", "\n".join([*license.OTHER, *OTHER_HELD_OUT])]
    texts += [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = found(spark, texts, scanner)
    want = {(i, p): v for i, t in enumerate(texts) for p, v in plain_scan(t or "", scanner).items()}
    assert got.keys() == want.keys() and len(want) > 60
    for k, (family, p, coverage) in want.items():
        assert got[k]["family"] == family and got[k]["probability"] == pytest.approx(p, abs=1e-5) and got[k]["coverage"] == pytest.approx(coverage, abs=1e-5)


def test_license_odd(spark, odd, scanner):
    rows = [(None, "Released under the MIT License.", "en", "a", 1, "x"), (1, "Released under the MIT License.", "en", "a", 1, "x"), (1, "Released under the MIT License.", "en", "a", 1, "x"), (2, None, None, None, None, None), (3, "", "en", "a", 0, "x")]
    rows += [(4, "word " * 40000 + "\nReleased under the MIT License.", "en", "a", 0, "x")]
    got = license.scan(odd("family", rows), scanner).collect()
    assert sorted((r["doc_id"] or 0, r["family"]) for r in got) == [(0, "mit"), (1, "mit"), (4, "mit")]
    assert license.scan(odd(rows=[]), scanner).count() == 0
    assert license.scan(odd(), scanner).count() == 0
