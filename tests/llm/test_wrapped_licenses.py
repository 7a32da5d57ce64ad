"""License statements that are wrapped over lines, against all runs of words."""

import random
import re
import textwrap

import pytest

from graphloom.llm import license_scan

TOKEN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def test_wrapped_statements(spark):
    rng = random.Random(2)
    say = lambda n: " ".join(f"w{rng.randrange(999)}" for _ in range(n))
    rows, named = [], []
    for width in (24, 75):
        for text, label in license_scan.TEMPLATES:
            lines = textwrap.wrap(f"{say(rng.randrange(9))} {text.capitalize()}, {say(6)}", width)
            rows.append((len(rows), f"{say(rng.randrange(80))}\n" + "\n".join(f" * {x}" for x in lines) + f"\n{say(30)}"))
            named.append(label)
    words = license_scan.TEMPLATES[6][0].split()
    rows.append((len(rows), "\n".join(say(40).join(["", " "]) + w for w in words)))  # the words are there, but far apart
    got = {r.doc_id: r for r in license_scan.license_report(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    for i, t in rows:
        w, labels, best = TOKEN.findall(t.lower()), set(), 0.0
        for text, label in license_scan.TEMPLATES:
            want, n = set(text.split()), len(text.split())
            for b in (set(w[j : j + n]) for j in range(max(1, len(w) - n + 1))):
                share = len(b & want) / len(want)
                if share >= license_scan.CONTAINMENT - 1e-9:
                    labels, best = labels | {label}, max(best, share)
        places = [label for phrase, label in license_scan.PHRASES.items() if f" {phrase} " in f" {' '.join(w)} "]
        assert got[i].labels == ",".join(sorted(labels | set(places))) and got[i].score == pytest.approx(1.0 if places else best)
    assert all(label in got[i].labels.split(",") for i, label in enumerate(named)) and got[len(rows) - 1].labels == ""


def test_prose_that_holds_a_statements_words_names_no_license(spark):
    rows = [
        (1, "a prose with by far 4 people 0 licensed drivers under water and cc marks"),
        (2, "the ship was released under pressure to the crew of mit sailors who had lost their license plate on the way"),
        (3, "released under the MIT\nlicense"),
        (4, "Licensed, under CC-BY 4.0"),
        (5, "some words before it is licensed under cc by sa 4 0 and some after it"),
    ]
    got = {r.doc_id: r.labels for r in license_scan.license_report(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[1] == got[2] == "" and got[3] == "mit" and "cc-by" in got[4].split(",") and "cc-by-sa" in got[5].split(",")
