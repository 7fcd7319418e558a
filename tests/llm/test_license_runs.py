"""Notices that are wrapped over lines, Creative Commons notices, and runs against brute force."""

import random

from boleflow.llm import license_scan

WRAPPED = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated files",
    "gpl": "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published",
    "bsd": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that",
    "apache": "distributed on an \"AS IS\" BASIS,\nWITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express",
    "cc_by_nc": "Text.\nLicensed under CC BY-NC 4.0.",
    "cc_by_sa": "Licensed under\nCC BY-SA 4.0",
}


def test_wrapped_notices(spark):
    docs = spark.createDataFrame(list(enumerate(WRAPPED.values())), "doc_id long, text string")
    got = {r["doc_id"]: r for r in license_scan.scan(docs).collect()}
    for i, label in enumerate(WRAPPED):
        assert label in got[i]["labels"].split(","), label
        assert got[i]["score"] >= 0.9


def test_scattered_words_are_no_notice(spark):
    text = " ".join("\n".join([w, *["other"] * 9]) for w in "released under the mit all rights reserved".split())
    assert license_scan.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["labels"] == ""


def test_runs_as_brute_force():
    rng = random.Random(4)
    texts = [t.split() for ts in license_scan.TEMPLATES.values() for t in ts]
    vocabulary = sorted({w for t in texts for w in t})
    matcher = license_scan.Matcher({w.encode(): rng.randrange(9) for w in vocabulary})
    for _ in range(300):
        words = []
        for _ in range(rng.randrange(4)):
            words += rng.choices([*vocabulary, "x"], k=rng.randrange(6)) + [w for w in rng.choice(texts) if rng.random() < 0.95]
        want = {}
        for label, ts in license_scan.TEMPLATES.items():
            for t in map(str.split, ts):
                for i in range(max(1, len(words) - len(t) + 1)):
                    c = len(set(t) & set(words[i : i + len(t)])) / len(set(t))
                    if c >= 0.9:
                        want[label] = max(c, want.get(label, 0))
        got = {}
        for label, c in matcher.match_runs([w.encode() for w in words]):
            got[label] = max(c, got.get(label, 0))
        assert got == want
