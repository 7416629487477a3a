import math
import re

import pytest

from corvida.llm import licenses

SPLIT = re.compile("[\x00-\x2f\x3a-\x60\x7b-\x7f]+")
NOTICE = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def words(text):
    return [w for w in SPLIT.split(lowered(text)) if w]


def brute(text):
    ws = words(text or "")
    places = [(i, label) for label, p in licenses.PHRASES for i in range(len(ws)) if ws[i : i + len(p.split())] == p.split()]
    best, own = 0.0, set()
    for label, t in licenses.NOTICES:
        want = set(t.split())
        n = len(t.split())
        lines = [b for b in (words(line) for line in (text or "").split("\n")) if len(b) <= 2 * n]
        for block in lines + [ws[i : i + 2 * n] for i in range(0, len(ws), n)]:
            shared = len(want & set(block))
            if shared >= math.ceil(0.8 * len(want) - 1e-9):
                own.add(label)
                best = max(best, shared / len(want))
    at = [i for i, _ in places]
    base = {label for _, label in places}
    return (len(ws), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | own)), 1.0 if at else best)


def test_against_brute_force(spark):
    texts = [
        None,
        "",
        "\n\n",
        "Under the MIT license",
        "x under  the\nMIT -- License, and again UNDER THE MIT LICENSE.",
        "sunder the mit licenses",
        "under the mit the license",
        "cc by ncé",
        "CC-BY-NC cc by nc",
        "éunder the mit license",
        "under the mit license under the mit license",
        "Licensed under the Apache License, Version 2.0.",
        "This work is licensed under the GNU General Public License, version 3.",
        "licensed under the gnu general public",
        NOTICE,
        NOTICE.replace("copy", "cop\ny"),
        NOTICE.replace(" of charge", "").replace("hereby", "so"),
        NOTICE.replace("\n", " ").upper() + "\nAll rights\nreserved",
        "All rights reserved.",
        "\n".join(NOTICE.split()),
        "intro words here " * 40 + NOTICE.replace("free of charge, to", "free of charge,\nto").replace("copy of", "copy\n * of") + " more" * 50,
        "all of it, the rights of others being what they are, is reserved",
        # ten words to a line
        "// " + "\n// ".join(" ".join(licenses.NOTICES[2][1].split()[i : i + 10]) for i in range(0, 30, 10)),
        "reserved are all the rights",
        # words of a notice scattered over one long line say nothing; a notice within one does
        "all " + "x " * 400 + "rights " + "y " * 400 + "reserved",
        ("z " * 60).join(licenses.NOTICES[2][1].split()),
        "lead " * 500 + NOTICE + " trail" * 500,
        "all a b c rights reserved",
        "all a b c d rights reserved",
        "Klicense under the mit license İ",
        "\x00under\x00the\x7fmit\x01license",
        "long " * 30000 + "cc by nc " + "tail " * 30000,
        "apache license version 2\ncc by nc\nunder the mit license\n" + NOTICE,
    ]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, tkey string, met int")
    got = {r.doc_id: tuple(r)[1:] for r in licenses.license_scan(docs).collect()}
    for i, t in enumerate(texts):
        assert got[i] == brute(t), (t or "")[:80]


def test_repeats_null_ids_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "cc by nc"), (1, "cc by nc"), (None, "cc by nc"), (1, "other")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_base) for r in licenses.license_scan(docs).collect()) == [(0, 1), (1, 0), (1, 1), (1, 1)]
    assert licenses.license_scan(docs.limit(0)).count() == 0


def test_wrapped_notices_are_found(spark):
    wrapped = [(i, "code();\n" * i + "\n".join(" ".join(text.split()[k : k + 4 + i]) for k in range(0, 40, 4 + i))) for i, (_, text) in enumerate(licenses.NOTICES)]
    docs = spark.createDataFrame(wrapped, "doc_id long, text string")
    got = {r.doc_id: (r.labels.split(","), r.score) for r in licenses.license_scan(docs).collect()}
    assert all(label in got[i][0] and got[i][1] == 1.0 for i, (label, _) in enumerate(licenses.NOTICES))


def test_templates_of_a_table(spark):
    table = spark.createDataFrame([("own", "Do whatever you like, with this!", False), ("own", "do whatever you like with this", False), ("short", "As-Is", True)], "label string, text string, whole_text boolean")
    wanted = licenses.templates_of(table)
    assert [(t.label, t.words) for t in wanted] == [("short", ("as", "is")), ("own", ("do", "whatever", "you", "like", "with", "this")), ("own", ("do", "whatever", "you", "like", "with", "this"))]
    docs = spark.createDataFrame([(1, "you may do\nwhatever you like\nwith it as is"), (2, "as it is")], "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.base_labels, r.n_base) for r in licenses.license_scan(docs, wanted=wanted).collect()}
    assert got == {1: ("own,short", "short", 1), 2: ("", "", 0)}
    for bad in ([("x", "", False)], [(None, "a", False)]):
        with pytest.raises(ValueError):
            licenses.templates_of(spark.createDataFrame(bad, table.schema))


def test_trie_matches_exactly_its_words():
    pattern = re.compile(licenses._trie(["a", "ab", "abc", "b", "bcd"]))
    for w in ("a", "ab", "abc", "b", "bcd"):
        assert pattern.fullmatch(w)
    for w in ("", "bc", "abcd", "ac"):
        assert not pattern.fullmatch(w)


def test_scattered_words_of_a_long_line_are_no_notice(spark):
    texts = ["all " + "x " * 400 + "rights " + "y " * 400 + "reserved", ("z " * 60).join(dict(licenses.NOTICES)["gpl"].split())]
    got = licenses.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert [(r.labels, r.score) for r in got] == [("", 0.0)] * 2
