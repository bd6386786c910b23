import functools
import random
import re

from lorekiln.llm import licenses

PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))


@functools.cache
def compiled():
    return [(re.compile(f"(?<= )(?:{expression})(?= )"), label, prio) for _, expression, label, prio in licenses.rules()]


def brute(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low.replace("(c)", " © "))
    starts, base = [], set()
    for phrase, label in PHRASES:
        p = phrase.split()
        at = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        starts += at
        base |= {label} if at else set()
    norm = f" {' '.join(words)} "
    found = []
    for order, (expression, label, prio) in enumerate(compiled()):
        for m in expression.finditer(norm):
            first = norm[: m.start()].count(" ") - 1
            found.append((first, first + m[0].count(" "), prio, order, label))
    covers = lambda e, d: e[0] <= d[0] and e[1] >= d[1] and (e[2] > d[2] or (e[2] == d[2] and ((e[1] - e[0] > d[1] - d[0]) or e[3] < d[3])))
    kept = [d for d in found if not any(covers(e, d) for e in found if e is not d) and d[4] != "negated"]
    labels = base | {d[4] for d in kept}
    score = max([d[2] / 50 for d in kept] + [0.2 if base else 0.0])
    spans = {x: (min(d[0] for d in kept if d[4] == x), max(d[0] for d in kept if d[4] == x), sum(d[4] == x for d in kept)) for x in {d[4] for d in kept}}
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), round(score, 9), spans


def test_against_brute_force(spark):
    rnd = random.Random(2)
    said = [
        "Licensed under the Apache License, Version 2.0.", "CC BY-NC 4.0", "CC  BY", "cc-by-sa 3.0", "GNU General Public License, version 3", "general public license", "All rights reserved.", "All Rights",
        "Released under the MIT License.", "SPDX-License-Identifier: MPL-2.0", "SPDX-License-Identifier: Apache-2.0", "LGPL 2.1 or later", "in the public domain", "Copyright (c) 2020 Some One", "BSD 3-Clause License", "GPLv2", "cc by cc by cc by",
        "the Lesser General Public License version 2.1", "Creative Commons Attribution ShareAlike 4.0", "Distributed under the terms of the GNU GPL v2 or any later version", "Boost Software License 1.0", "proprietary and confidential",
    ]
    fill = ["of", "the", "Éa", "ñ", "x1", "\n", "—", "cc", "by", "CC", "license", "0", "2"]
    texts = [None, "", "  ", "K cc by", "cc\tby", "éccby cc byé"]
    for _ in range(150):
        texts.append(" ".join(rnd.choice(said) if rnd.random() < 0.3 else rnd.choice(fill) for _ in range(rnd.randint(1, 30))))
    texts.append("word " * 3000 + "Licensed under CC BY-NC 4.0. " * 400)
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, norm string, score string")
    seen = 0
    for r in licenses.scanned(df).collect():
        spans = {d.label: (d.first, d.last, d.n) for d in r.detections}
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9), spans) == brute(texts[r.doc_id]), texts[r.doc_id][:300]
        seen += len(spans)
    assert seen > 200


def test_the_gate_lets_through_whatever_a_rule_or_base_phrase_can_match(spark):
    assert len(licenses.rules()) > 600 and len(licenses.SIGNATURES) > 100
    texts = []
    for _, expression, _, _ in licenses.rules():
        text = expression
        for _ in range(9):  # the first alternative of each group, with and without what is optional
            text = re.sub(r"\(\?:([^()|]*)(?:\|[^()]*)?\)\??", r"\1", text)
        text = text.replace("(c )?", "c ").replace("[cs]", "c").replace("[0-9]{2}", "20").replace("[a-z]+", "one").replace("{1,3}", "")
        texts.append(re.sub(r"(.)\?", r"\1", text))
    texts = [t for t in texts if not set(t) & set("()[]{}|?*+")]
    assert len(texts) > 200
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    out = {r.doc_id: r.labels for r in licenses.scanned(df).collect()}
    for i, t in enumerate(texts):
        assert out[i] == brute(t)[5], t
    assert spark.createDataFrame([], "doc_id long, text string").transform(licenses.scanned).count() == 0


def spelled(tree):
    """Every alternative of an expression, optional parts both with and without: at most one part is varied at a time."""
    from re import _constants as C

    def of(seq):
        parts = [one(op, x) for op, x in seq]
        plain = [p[0] for p in parts]
        yield "".join(plain)
        for k, p in enumerate(parts):
            for other in p[1:]:
                yield "".join([*plain[:k], other, *plain[k + 1 :]])

    def one(op, x):
        if op is C.LITERAL:
            return [chr(x)]
        if op is C.IN and x[0][0] is C.NEGATE:
            return ["one"]
        if op is C.IN:
            return [chr(v) if o is C.LITERAL else chr(v[0]) for o, v in x]
        if op is C.BRANCH:
            return [t for b in x[1] for t in of(b)]
        if op is C.SUBPATTERN:
            return list(of(x[3]))
        least, most, body = x
        assert op is C.MAX_REPEAT
        return [t * n for n in sorted({least, min(most, 3)}) for t in of(body)]

    return of(tree)


def test_no_keyword_stops_a_rule_whatever_its_alternative(spark):
    from re import _parser

    texts = sorted({t for _, e, _, _ in licenses.rules() for t in spelled(_parser.parse(e))} | {"zero clause bsd", "the FreeBSD license", "University of Illinois Open Source License", "released under the University of Illinois license"})
    assert len(texts) > 1500
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    out = {r.doc_id: r.labels for r in licenses.scanned(df).collect()}
    wrong = [(t, out[i], brute(t)[5]) for i, t in enumerate(texts) if out[i] != brute(t)[5]]
    assert not wrong
    assert {out[texts.index(t)] for t in ("the FreeBSD license", "zero clause bsd", "University of Illinois Open Source License")} == {"bsd-2-clause", "0bsd", "ncsa"}


BODIES = {
    "GPLv2+": "gpl-2.0",
    "LGPLv2.1": "lgpl-2.1",
    "(AGPLv3 or later)": "agpl-3.0",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the “Software”)": "mit",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:": "bsd",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "Copyright © 2021 Acme GmbH": "copyright",
    "(c) Jane Doe 2020": "copyright",
    "Copyright (C) 1999-2004, 2007 The Authors": "copyright",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License": "agpl,gpl",
    "vitamin c levels in 2020": "",
    "the open software of a common public": "",
}


def test_bodies_glued_names_and_copyright_lines(spark):
    texts = list(BODIES)
    df = spark.createDataFrame([(i, t.replace("“", '"').replace("”", '"')) for i, t in enumerate(texts)], "doc_id long, text string")
    out = {texts[r.doc_id]: r.labels for r in licenses.scanned(df).collect()}
    assert out == BODIES


PROSE = (
    "EPL season", "FreeBSD on all servers", "published by the FreeBSD project", "MPL is a lab", "Al2 O3 crystals", "Apache 2 helicopters", "in the public domain debate", "MIT", "the apache tribe", "EPL 2 nil", "mpl 2 go",
    "not released under the GPL", "It is not licensed under the Apache License, Version 2.0", "never distributed under the GPL v3 or later", "isn't available under the MIT License", "no longer covered by the LGPL 2.1",
)
MEANT = {
    "Apache 2.0": "apache-2.0", "Apache License 2": "apache-2.0", "apache version 2": "apache-2.0", "Apache v2": "apache-2.0", "licensed under Apache 2": "apache,apache-2.0", "MPL 2.0": "mpl-2.0", "MPLv2": "mpl-2.0", "EPL-1.0": "epl-1.0", "under the MPL license": "mpl",
    "released under the EPL": "epl", "the work is in the public domain": "public-domain", "the FreeBSD License": "bsd-2-clause", "not released under the GPL but licensed under the MIT License": "mit", "SPDX-License-Identifier: EPL-2.0": "epl-2.0",
}


def test_prose_has_no_labels_and_names_that_are_meant_have(spark):
    texts = [*PROSE, *MEANT]
    out = {texts[r.doc_id]: (r.labels, r.score) for r in licenses.scanned(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert {t: out[t] for t in PROSE if out[t] != ("", 0.0)} == {}
    assert {t: out[t][0] for t in MEANT if set(out[t][0].split(",")) - set(MEANT[t].split(",")) or not out[t][0]} == {}
    assert all(out[t][0] == brute(t)[5] for t in texts)


def test_words_between_long_runs_of_what_parts_them(spark):
    texts = [" " * n + "a" + "-\t" * n + "\0cc" + "\n" * n + "by" for n in (1, 2, 3, 5, 17, 64, 129, 1000)] + ["", "\0", " \n" * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in licenses.scanned(df).collect():
        assert (r.n_words, r.n_base, r.first_word) == brute(texts[r.doc_id])[:3]
