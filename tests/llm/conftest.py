"""Small awkward tables shared by the tests of the text operators."""

import random

import pytest

WORDS = ("the of and to in is it was for on are with as his they at be this from have or by one had not but what all were when we "
         "there can an your which their said if do will each about how up out them then she many some so these would other into").split()


def prose(rng, n, per_line=12):
    words = [rng.choice(WORDS) + rng.choice(["", "", "s", "ed", "ing"]) for _ in range(n)]
    lines = [" ".join(words[i:i + per_line]) + "." for i in range(0, n, per_line)]
    return "\n".join(lines)


@pytest.fixture(scope="session")
def awkward_rows():
    """(doc_id, text, lang, source, n_chars, kept, size): copies, near copies, nulls, empties, junk, and clashing names."""
    rng = random.Random(7)
    base = [prose(rng, n) for n in (80, 120, 200, 60, 400)]
    texts = base + [base[0], base[0], base[1].replace(" the ", " a ", 2), base[2] + "\none more line of text here."]
    passage = prose(rng, 55, 60)
    texts += [prose(rng, 40) + "\n" + passage + "\n" + prose(rng, 30) for _ in range(3)]
    texts += [None, "", "   \n\t\n", "one", "One", "a b c d e", "x " * 30, "é" * 50 + " ñ words", "menu | home | about | login | search"]
    texts += ["### this&&& is*** not$$$ a### text&&& at*** all$$$ really### but&&& noise*** only$$$",
              "Licensed under the Apache License, Version 2.0.\n" + prose(rng, 30), prose(rng, 3000, 3000)]
    texts += ["same line here with words\n" * 12, "\n".join(["A line that comes back again and again."] * 3 + [prose(rng, 40)])]
    rows = [(i, t, "en", [None, "a", "b", "Z", "é"][i % 5], len(t or ""), "kept", i) for i, t in enumerate(texts)]
    return rows + [rows[3], rows[12], (None, base[0], None, None, None, None, None), (900, base[4][:200], None, "a", None, None, None)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, size int"


@pytest.fixture(scope="session")
def awkward(spark, awkward_rows):
    return spark.createDataFrame(awkward_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
