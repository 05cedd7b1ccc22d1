"""License scans: planted wordings, and every template aligned with every block without compression."""

import random

import duckdb
import pytest

from lattica.llm.license_scan import ADDED, MISSING, TEMPLATES, Scanner, aligned, license_findings, scanner, words_of

OWN = scanner(TEMPLATES)


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b, 1):
            new.append(row[j - 1] + 1 if x == y else max(row[j], new[-1]))
        row = new
    return row[-1]


def test_aligned():
    rnd = random.Random(1)
    for _ in range(500):
        t, w = ([rnd.choice("abc") for _ in range(rnd.randrange(1, 8))] for _ in range(2))
        start, end, missing, added = aligned(t, w)
        common = plain_lcs(t, w)
        assert len(t) - len(missing) == common and end - start - len(added) == common
        assert common == 0 or plain_lcs(t, w[start:end]) == common and plain_lcs(t, w[start : end - 1]) < common and plain_lcs(t, w[start + 1 :]) < common


def test_every_template_finds_itself_inside_prose():
    rnd = random.Random(2)
    prose = lambda n: " ".join(rnd.choice(["on", "thes", "erand", "the", "of", "heion"]) for _ in range(n))
    for k, (name, text) in enumerate(TEMPLATES):
        for shape in ("line", "inline", "wrapped", "upper"):
            own = text.upper() if shape == "upper" else text
            if shape == "wrapped":
                words = own.split()
                own = "\n".join(" * " + " ".join(words[i : i + 9]) for i in range(0, len(words), 9))
            body = prose(300) + " " + own + " " + prose(300) if shape == "inline" else "\n".join([prose(60), prose(200), own, prose(80)])
            got = OWN.scan(body)
            assert [(f.license, f.missing, f.added) for f in got] == [(name, (), ())], (k, shape, got)


def test_edited_wordings_are_listed():
    text = TEMPLATES[2][1].replace("free of charge", "free of any charge").replace(" hereby", "")
    (got,) = OWN.scan("x y\n" + text + "\nz")
    assert (got.license, got.missing, got.added) == ("MIT", ("hereby",), ("any",))
    assert OWN.scan("The license of this is unknown. All permission was redistributed.") == []
    assert OWN.scan("Released under the BIT License.") == []


def uncompressed(text):
    """Licenses that some line confirms by wording alone."""
    out = set()
    for line in (text or "").split("\n"):
        words = words_of(line)
        for name, t in TEMPLATES:
            t = words_of(t)
            for at in range(len(words)):
                _, _, missing, added = aligned(t, words[at : at + len(t) + int(ADDED * len(t))])
                if len(missing) <= MISSING * len(t) and len(added) <= ADDED * len(t):
                    out.add(name)
                    break
    return out


def test_documents_against_wording_alone():
    texts = [r[0] for r in duckdb.sql("SELECT text FROM '/root/testdata/sf0.01/documents.parquet' WHERE regexp_matches(text, '(?i)licen|copyright|permission|rights reserved') OR doc_id % 50 = 0").fetchall()]
    found = 0
    for text in texts:
        near = "\n".join(x for x in text.split("\n") if len(x) < 400)  # the plain way is slow
        got = {f.license for f in OWN.scan(near)}
        assert got == uncompressed(near), near
        found += bool(got)
    assert found > 5


def test_rows(spark):
    two = "All rights reserved.\n" + "x " * 50 + "\nReleased under the MIT License. Licensed under CC BY-NC 4.0."
    df = spark.createDataFrame([(1, two, "MIT"), (None, "ALL RIGHTS RESERVED", "x"), (2, None, "x"), (3, "", "x"), (4, "no cue", "x"), (1, two, "MIT")], "doc_id bigint, text string, license string")
    got = sorted((str(r["doc_id"]), r["license"], r["first_line"], r["last_line"], r["exact"]) for r in license_findings(df).collect())
    one = [("1", "CC-BY-NC-4.0", 2, 2, True), ("1", "MIT", 2, 2, True), ("1", "proprietary", 0, 0, True)]
    assert got == sorted([*one, *one, ("None", "proprietary", 0, 0, True)])
    assert license_findings(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        Scanner([("x", "nothing here")])
