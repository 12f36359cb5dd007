"""License notices: exact and reworded ones, and texts that only mention a license."""

from __future__ import annotations

import random

import brute
import pytest

from stayrate.llm.licenses import TEMPLATES, Scanner, plain, scan_licenses

FOLDER = "/root/testdata/sf0.001"
PROSE = "Some words of prose that have nothing to do with it stand here. "


def test_each_template_is_found_as_itself():
    scanner = Scanner(TEMPLATES, 0.15)
    for name, wording in TEMPLATES.items():
        text = f"{PROSE * 3}\n{wording}\n{PROSE}"
        found = scanner.scan(text)
        assert [(f[0], f[4], f[5], f[6]) for f in found] == [(name, 0, [], [])], name
        assert text[found[0][1] : found[0][2]] == wording


def test_case_does_not_matter():
    scanner = Scanner(TEMPLATES, 0.15)
    for name, wording in TEMPLATES.items():
        for form in (wording.upper(), wording.lower(), wording.title(), wording.swapcase()):
            found = scanner.scan(f"{PROSE * 3}\n{form}\n{PROSE}")
            assert [(f[0], f[4], f[5], f[6]) for f in found] == [(name, 0, [], [])], form


def test_a_template_fits_at_any_rank():
    versions = {f"CC {v}.0": f"Licensed under CC BY {v}.0." for v in range(1, 10)}
    scanner = Scanner(versions, 0.15)
    for name, wording in versions.items():
        assert [f[0] for f in scanner.scan(f"{PROSE}{wording.title()} {PROSE}")] == [name]


def test_any_white_space_parts_words(spark):
    rows = [(i, f"{PROSE}\n{w}\n{PROSE}") for i, w in enumerate(TEMPLATES.values())]
    rows = [(10 * i + k, t.replace(" ", gap)) for i, t in rows for k, gap in enumerate(("\n", "  ", "\t\r\n"))]
    got = scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"))
    names = list(TEMPLATES)
    want = [(i, names[i // 10], 0) for i, _ in rows]
    assert sorted((r["doc_id"], r["license"], r["edits"]) for r in got.collect()) == sorted(want)


@pytest.mark.parametrize("max_difference", [0.15, 0.3])
def test_edits_anywhere_within_the_limit(max_difference):
    rng = random.Random(7)
    scanner = Scanner(TEMPLATES, max_difference)
    for name, wording in TEMPLATES.items():
        most = int(max_difference * len(wording.split()))
        for _ in range(60):
            words = wording.split()
            for _ in range(most):
                spot, kind = rng.randrange(len(words)), rng.randrange(3)
                words[spot : spot + (kind != 1)] = [] if kind == 2 else ["zz"]
            found = scanner.scan(f"{PROSE}{' '.join(words)} {PROSE}")
            assert len(found) == 1 and found[0][4] <= most, words
            if most < 2:
                assert found[0][0][:3] == name[:3]


def test_edited_trigger_phrases():
    scanner = Scanner(TEMPLATES, 0.15)
    for name, old, new in [
        ("BSD", "Redistribution and use", "Redistribution or use"),
        ("MIT grant", "hereby granted", "hereby freely granted"),
        ("Apache-2.0 header", "Licensed under the", "Provided under"),
    ]:
        text = PROSE + TEMPLATES[name].replace(old, new) + "\n" + PROSE
        assert [f[0] for f in scanner.scan(text)] == [name]


def test_the_ranking_decides():
    """Both wordings are within the limit; the one with more edits saves more bytes."""
    own = {
        "few": "may be given on to all who ask for it and read in every unspoiled copy",
        "long": "must be given on to any who ask for it and read in every counterrevolutionary copy",
    }
    scanner = Scanner(own, 0.2)
    text = "may be given on to all who ask for it and read in every counterrevolutionary copy"
    ((best, templates), *_) = scanner.ranked(text.split())
    edits = {n: scanner.confirm(own[n].split(), text.split())[2] for n in own}
    assert edits == {"few": 1, "long": 2}
    assert [scanner.templates[t].name for t in templates] == ["long"]
    ((name, _, _, saved, found, *_),) = scanner.scan(f"{PROSE}{text} {PROSE}")
    assert (name, found) == ("long", 2) and saved > 0


def test_all_templates_are_ranked():
    scanner = Scanner(TEMPLATES, 0.15)
    for name, wording in TEMPLATES.items():
        ranked = scanner.ranked([plain(w) for w in wording.split()])
        assert sorted(t for _, ts in ranked for t in ts) == list(range(len(TEMPLATES)))
        # The longer Apache wording begins with the shorter one and saves as much of it.
        assert name in [scanner.templates[t].name for t in ranked[0][1]]


def test_own_templates(spark):
    own = {"house": "No copy without a written leave of the house.", "empty": " "}
    df = spark.createDataFrame([(1, f"{PROSE}{own['house']}")], "doc_id long, text string")
    assert [r["license"] for r in scan_licenses(df, own).collect()] == ["house"]


def test_all_that_brute_force_finds():
    rng = random.Random(3)
    own = {"x": "a b c d e f g", "y": "c d e f g h i j", "z": "a a b"}
    for limit in (0.0, 0.2, 0.5, 1.0):
        scanner = Scanner(own, limit)
        for _ in range(300):
            words = [rng.choice("abcdefghij") for _ in range(rng.randrange(25))]
            found = scanner.scan(" ".join(words))
            gone = [False] * len(words)
            for name, a, b, _, edits, _, _ in found:
                stretch = words[a // 2 : b // 2 + 1]
                assert edits == brute.edit_distance(own[name].split(), stretch)
                assert edits <= int(limit * len(own[name].split()))
                assert not any(gone[a // 2 : b // 2 + 1])
                gone[a // 2 : b // 2 + 1] = [True] * len(stretch)
            # Nothing within the limit is left between the notices.
            free = "".join("|" if g else w for g, w in zip(gone, words)).split("|")
            for wording in own.values():
                wording = wording.split()
                for part in free:
                    edits = brute.edit_distance(wording, list(part))
                    assert edits > int(limit * len(wording)) or edits == len(wording)


def test_wording_differences():
    scanner = Scanner(TEMPLATES, 0.15)
    text = PROSE + "this work is licensed under the GNU General public license version 4 okay"
    ((name, _, _, saved, edits, missing, added),) = scanner.scan(text)
    assert (name[:3], edits, len(missing)) == ("GPL", 1, 1) and added in ([], ["4"]) and saved > 0
    assert scanner.scan(PROSE + "He lost his driving license on the way to the lake.") == []


def test_several_notices():
    text = "\n".join([PROSE, TEMPLATES["MIT"], PROSE, TEMPLATES["CC-BY-4.0"], TEMPLATES["MIT"]])
    found = [f[0] for f in Scanner(TEMPLATES, 0.15).scan(text)]
    assert found == ["MIT", "CC-BY-4.0", "MIT"]


def test_documents_hold_the_lines_that_a_search_finds(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    got = {(r["doc_id"], r["license"]) for r in scan_licenses(docs).filter("edits = 0").collect()}
    want = set()
    for r in docs.collect():
        for name, wording in TEMPLATES.items():
            if wording in r["text"]:
                want.add((r["doc_id"], name))
    assert want and want <= got


def test_odd_rows(spark):
    mit = TEMPLATES["MIT"]
    rows = [(1, None), (2, ""), (None, mit), (3, mit), (3, mit), (4, "license"), (5, PROSE * 3000 + mit)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS license")
    got = [r["doc_id"] for r in scan_licenses(df).collect()]
    assert sorted(got, key=str) == [3, 3, 5, None]
    assert scan_licenses(df.limit(0)).collect() == []
