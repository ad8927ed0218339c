"""Notices that are wrapped over lines."""

import random
import re
import textwrap

import pytest

from quillspark.llm import licenses

NOTICES = {
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice appears.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3",
    "mit-notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the License)",
}


def wrapped(notice, width, mark=""):
    return "\n".join(mark + x for x in textwrap.wrap(notice, width))


def test_wrapped_notices(spark):
    rows = [(label, before + wrapped(notice, width, mark)) for label, notice in NOTICES.items() for width in (15, 30, 70) for mark in ("", " * ", "# ") for before in ("", "words before\n\n" * 40)]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.license_scan(docs).collect()}
    for i, (label, text) in enumerate(rows):
        assert label in got[i].labels.split(","), text
        assert got[i].score >= licenses.THRESHOLD


def test_words_far_apart_are_no_notice(spark):
    far = "\n".join(w + " and so on" * 4 for w in NOTICES["bsd"].lower().replace(",", "").split())
    docs = spark.createDataFrame([(1, far), (2, "redistribution\nand use"), (3, "\n\n"), (4, None)], "doc_id long, text string")
    assert [r.labels for r in licenses.license_scan(docs).collect()] == [""] * 4


def test_a_word_of_another_sentence_makes_no_notice(spark):
    docs = spark.createDataFrame([(1, "It was released in the spring of the year\nbefore last. This one is\nlicensed under the Apache License, Version 2.0")], "doc_id long, text string")
    assert [r.labels for r in licenses.license_scan(docs).collect()] == ["apache-2.0"]


def brute(text):
    """Labels and score by trying every line, and every run of words of a text with several lines."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = words(t)
    base = {label for phrase, label in licenses.PHRASES if any(w[i:i + len(phrase.split())] == phrase.split() for i in range(len(w)))}
    shares = {}
    for label, notice in licenses.TEMPLATES:
        some, span = set(notice.split()), licenses.SPAN * len(notice.split())
        blocks = [set(words(line)) for line in t.split("\n")] + ([set(w[i:i + span]) for i in range(len(w)) if w[i] in some] if "\n" in t else [])
        best = max(len(b & some) / len(some) for b in blocks) if blocks else 0
        if best >= licenses.THRESHOLD - 1e-9:
            shares[label] = best
    return ",".join(sorted(base | set(shares))), 1.0 if base else max(shares.values(), default=0.0)


@pytest.fixture(scope="module")
def odd_texts():
    r, every = random.Random(3), sorted({w for _, n in licenses.TEMPLATES for w in n.split()})
    out = [None, "", "\n", "This wor\u212a is licensed under the GNU General Public License version 3", "LICENSED UNDER CC BY 4.0", "x " * 20_000 + NOTICES["bsd"], "x\n" * 5000 + wrapped(NOTICES["isc"], 20)]
    for label, notice in licenses.TEMPLATES:
        words = notice.split()
        need = licenses._needs(len(set(words)), licenses.THRESHOLD)
        for keep in (need - 1, need, need + 1, len(words)):  # at the edge of the threshold
            some = r.sample(sorted(set(words)), min(keep, len(set(words))))
            out += [" ".join(some), "\n".join(some), " and\n".join(some), f"{' '.join(some[:3])}\n{' filler' * 30}\n{' '.join(some[3:])}"]
    return out + ["".join(w + r.choice([" ", " ", "\n", ", "]) for w in r.choices(every, k=r.randint(1, 40))) for _ in range(120)]


def test_against_brute_force(spark, odd_texts):
    rows = [(i, t, "x", 1.0) for i, t in enumerate(odd_texts)] + [(5000, odd_texts[20], "y", 2.0)] * 2
    got = licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string, labels string, score double")).collect()
    assert len(got) == len(rows) and [r.labels for r in got if r.doc_id == 5000] == [brute(odd_texts[20])[0]] * 2
    for r in got:
        if r.doc_id < 5000:
            labels, score = brute(odd_texts[r.doc_id])
            assert r.labels == labels and abs(r.score - score) < 1e-9, odd_texts[r.doc_id]


def test_filters_lose_nothing_and_the_position_counts(spark, odd_texts):
    words = {label: sorted(set(notice.split())) for label, notice in licenses.TEMPLATES}
    order = sorted({w for s in words.values() for w in s})
    prefix = licenses.prefix_table(words, order, licenses.THRESHOLD)
    blocks = [(i, sorted(set(re.findall("[0-9a-z]+", t.lower())) & set(order), key=order.index)) for i, t in enumerate(odd_texts) if t]
    df = spark.createDataFrame(blocks, "doc_id long, block array<string>")
    table = spark.createDataFrame(prefix, "label string, word string, size int, need int, notice array<string>")
    least = min(r[3] for r in prefix)
    pairs = [{(r.doc_id, r.label) for r in licenses.candidates(df, table, least, by_place).select("doc_id", "label").distinct().collect()} for by_place in (True, False)]
    want = {(i, label) for i, b in blocks for label, s in words.items() if len(set(b) & set(s)) >= licenses._needs(len(s), licenses.THRESHOLD)}
    assert want <= pairs[0] < pairs[1]
