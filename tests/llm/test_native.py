"""Fingerprints, licence scans, benchmark decontamination."""

import hashlib
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from gaugeloom.llm import decontaminate, fingerprint, licenses


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_sketches_estimate_and_merge(spark):
    random.seed(2)
    words = [f"w{i}" for i in range(3000)]
    texts = [" ".join(words[:1500]), " ".join(words[500:2000]), " ".join(words[:40]), "few words", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    s = fingerprint.add_sketch(df, "text", "s")
    pairs = s.crossJoin(s.select(F.col("id").alias("j"), F.col("s").alias("t")))
    got = {(r.id, r.j): r for r in pairs.select("id", "j", fingerprint.resemblance(F.col("s"), F.col("t")).alias("r"), fingerprint.containment(F.col("s"), F.col("t")).alias("c"), fingerprint.distinct_shingles(F.col("s")).alias("n")).collect()}
    for (i, j), r in got.items():
        a, b = shingles(texts[i]), shingles(texts[j])
        assert r.r == pytest.approx(len(a & b) / len(a | b) if a | b else 1, abs=0.1)
        assert r.n == pytest.approx(len(a), rel=0.2)
        assert r.c == pytest.approx(len(a & b) / len(a) if a else 1, abs=0.12)
    whole = fingerprint.add_sketch(spark.createDataFrame([(" ".join(words[:1500]),)], "text string"), "text", "s").first().s
    parts = spark.createDataFrame([(1, " ".join(words[i : i + 104])) for i in range(0, 1500, 100)] * 3, "g int, text string")
    merged = fingerprint.merge(fingerprint.add_sketch(parts, "text", "s"), "g", "s", fan=2).first().s
    made = {h for t in parts.collect() for h in shingles(t.text)}
    assert len(merged) == fingerprint.K and set(merged) & set(whole)
    assert fingerprint.K / len(made) < 1


def test_next_texts(spark):
    rows = [(i * 7 % 101, f"text {i}") for i in range(101)] + [(None, "no id")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for parts in (1, 2, 9, 300):
        got = fingerprint.with_next(df, "doc_id", "text", "next", parts).collect()
        order = [t for _, t in sorted(rows[:-1], reverse=True)] + ["no id"]
        assert sorted((r.text, r.next) for r in got) == sorted(zip(order, order[1:] + order[:1]))


def test_fingerprints_of_hard_rows(spark, hard, empty, tmp_path):
    for df, n in ((hard, 10), (empty, 0)):
        path = str(tmp_path / f"sf{n}")
        df.drop("_gone").write.parquet(f"{path}/documents.parquet")
        got = fingerprint.op1_fingerprint(spark, path).collect()
        assert len(got) == n
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)


def test_equal_texts_have_equal_fingerprints(spark, hard, tmp_path):
    hard.drop("_gone").write.parquet(f"{tmp_path}/documents.parquet")
    got = [r for r in fingerprint.op1_fingerprint(spark, str(tmp_path)).collect() if r.doc_id == 1]
    assert len({r.fingerprint for r in got}) == 1
    assert all(0 <= r.near_edited <= 1 for r in got)


def brute(docs, items, n=10):
    def words(t):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)

    windows = {}
    for k, t in items:
        w = words(t)
        for i in range(max(1, len(w) - n + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(str(k))
    out = []
    for k, t in docs:
        w, hit, ids = words(t), set(), set()
        for i in range(len(w)):
            for m in range(1, n + 1):
                if tuple(w[i : i + m]) in windows and i + m <= len(w):
                    hit |= set(range(i, i + m))
                    ids |= windows[tuple(w[i : i + m])]
        out.append((k, len(w), len(hit), ",".join(sorted(ids))))
    return sorted(out, key=str)


def test_decontamination_is_brute_force(spark, hard):
    random.seed(4)
    pool = "alpha beta Gamma DELTA été über 12 x-y".split()
    items = [(i, " ".join(random.choices(pool, k=k))) for i, k in enumerate([3, 1, 10, 12, 25, 0, 4])] + [(7, None), (8, "alpha beta gamma"), (9, "alpha beta gamma")]
    docs = [(i, " ".join(random.choices(pool, k=random.randint(0, 60)))) for i in range(40)] + [(100, "zz " + items[4][1].upper() + " zz"), (101, items[3][1]), (102, None), (102, ""), (103, items[4][1]), (103, items[4][1])]
    d, b = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    for limit in (1_000_000, 5):
        got = decontaminate.scan(d, b, broadcast_windows=limit).collect()
        assert sorted([(r.doc_id, r.n_words, r.n_hit, ",".join(r["items"])) for r in got], key=str) == brute(docs, items)
    assert decontaminate.scan(hard, b).count() == 10
    assert {r.n_hit for r in decontaminate.scan(hard, b.limit(0)).collect()} == {0}
    assert decontaminate.scan(hard.limit(0), b).count() == 0
    stay = decontaminate.drop_documents(hard, spark.createDataFrame([(1, "quick brown fox")], "item_id bigint, text string"))
    assert stay.count() == 8 and stay.columns == hard.columns


def test_licenses(spark, hard, empty):
    mit = "\n\n".join(t for i, t in licenses.SENTENCES if i in ("mit-grant", "mit-notice", "mit-warranty"))
    rows = [
        (1, "Some prose. Licensed under the Apache License, Version 2.0.", ["Apache-2.0"]),
        (2, f"MIT License\n\nCopyright (c) 2020 X\n\n{mit}.\n", ["MIT"]),
        (3, "SPDX-License-Identifier: GPL-3.0-or-later\ncode", ["GPL-3.0-or-later"]),
        (4, "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", ["GPL-2.0-or-later"]),
        (5, "you may not use this file except in compliance with the License", []),
        (6, "RELEASED   under the   mit license!", ["MIT"]),
        (7, "Licensed under CC BY-NC 4.0.\nReleased under the MIT License.", ["CC-BY-NC-4.0", "MIT"]),
    ]
    got = {r.doc_id: r for r in licenses.find(spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")).collect()}
    assert {k: got[k].licenses for k, _, _ in rows} == {k: v for k, _, v in rows}
    assert got[2].rules == [1]
    assert licenses.find(hard).count() == 10 and licenses.find(empty).count() == 0
    each = licenses.find(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(licenses.SENTENCES)], "doc_id bigint, text string")).collect()
    assert all(r.n_sentences == 1 and len(r.identifiers) == 1 for r in each)


def test_native_plans_run_no_python(spark, tmp_path, hard):
    hard.drop("_gone").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "quick brown fox")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for query in (fingerprint.op1_fingerprint, licenses.op5_licenses, decontaminate.op8_decontaminate):
        plan = query(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)
    got = fingerprint.op1_fingerprint(spark, str(tmp_path)).where("doc_id = 7").collect()
    assert {len(r.edited_sha256) for r in got} == {64}
    assert hashlib.sha256(b"").hexdigest()[:4] == "e3b0"


def test_decontamination_of_a_long_text(spark):
    words = [f"v{i}" for i in range(200_000)]
    item = words[150_000:150_030]
    docs = spark.createDataFrame([(1, " ".join(words)), (None, " ".join(item)), (None, "clean text of another row")], "doc_id bigint, text string")
    items = spark.createDataFrame([(7, " ".join(item))], "item_id bigint, text string")
    begin = time.monotonic()
    got = {(r.doc_id, r.n_words): r.n_hit for r in decontaminate.scan(docs, items).collect()}
    assert time.monotonic() - begin < 60  # words carried by every place would make this quadratic
    assert got == {(1, 200_000): 30, (None, 30): 30, (None, 5): 0}
    assert [r.text for r in decontaminate.drop_documents(docs, items).collect()] == ["clean text of another row"]


def plain_identifiers(text):
    """Known sentences in order: whole passages, else their lines, by plain string work."""
    squeeze = lambda x: " ".join(re.findall(r"[^\W_]+", x.lower()))
    known = {squeeze(s): i for i, s in sorted(licenses.SENTENCES, reverse=True)}
    begins = {" ".join(k.split()[:2]) for k in known}
    out = []
    for piece in re.split(r"[.!?;:]+(?=\s)|[.!?;:]+$", text):
        passages, own = [], []
        for line in map(squeeze, piece.split("\n")):
            if not line or " ".join(line.split()[:2]) in begins:
                passages.append(own)
                own = []
            own = own + [line] if line else own
        for p in [*passages, own]:
            if p:
                out += [known[" ".join(p)]] if " ".join(p) in known else [known[x] for x in p if x in known]
    return out


def test_wrapped_and_commented_licenses(spark):
    import textwrap

    of = lambda *ids: [next(s for i, s in licenses.SENTENCES if i == x) for x in ids]
    mit = "MIT License\n\nCopyright (c) 2021 A. Nyone\n\n" + "\n\n".join(x + "." for x in of("mit-grant", "mit-notice", "mit-warranty"))
    bsd = "Copyright (c) 2021, A. Nyone\nAll rights reserved.\n\n" + of("bsd-use")[0] + ":\n\n1. " + of("bsd-source")[0] + ".\n\n2. " + of("bsd-binary")[0] + ".\n\n3. " + of("bsd-endorse")[0] + "."
    apache = "Copyright 2021 A. Nyone\n\n" + of("apache-grant")[0] + "; " + of("apache-comply")[0] + ".\nYou may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\n" + of("apache-basis")[0] + "."
    gpl3 = of("gpl-free")[0] + ": " + of("gpl3-grant")[0] + ".\n\n" + of("gpl-hope")[0] + "; without even the implied warranty."
    gpl2 = of("gpl-free")[0] + "; " + of("gpl-terms")[0] + "; " + of("gpl2-version")[0] + ".\n\n" + of("gpl-hope")[0] + ";"
    lgpl = of("lgpl-free")[0] + "; " + of("lgpl-terms")[0] + "; " + of("lgpl21-version")[0] + "."
    want = {"MIT": mit, "BSD-3-Clause": bsd, "Apache-2.0": apache, "GPL-3.0-or-later": gpl3, "GPL-2.0-or-later": gpl2, "LGPL-2.1-or-later": lgpl}
    rows, names = [], {}
    for name, text in want.items():
        for width in (0, 40, 72, 100):
            filled = "\n".join(textwrap.fill(p, width) if width else p for p in text.split("\n"))
            for before, mark, after in (("", "", ""), ("", "# ", ""), ("/*\n", " * ", "\n */\nint main() { return 0; }"), ("Some words of prose without an end\n", "", "\nmore words")):
                names[len(rows)] = name
                rows.append((len(rows), before + "\n".join(mark + line for line in filled.split("\n")) + after))
    found = {r.doc_id: r for r in licenses.find(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    for i, text in rows:
        assert found[i].identifiers == plain_identifiers(text), text
        assert [x for x in found[i].licenses if x != "proprietary"] == [names[i]], text


def test_identifiers_of_whole_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = {r.doc_id: r.identifiers for r in licenses.find(docs).collect()}
    want = {r.doc_id: plain_identifiers(r.text) for r in docs.select("doc_id", "text").collect()}
    assert found == want and any(want.values())
