"""Long runs of line ends and blanks in licence texts; signs that look like letters in language identification."""

import itertools
import random
import time

from pyspark.sql import functions as F

from strandlight.llm import lang_cnn, license_rules


def _brute(text: str) -> list[str]:
    """The sentences of a text cut and joined run by run, without one pattern over a whole run."""
    import re

    t = text.replace("\1", " ").replace("\2", " ")
    t = re.sub(r"(?m)^([ \t]*)(?:[Rr][Ee][Mm]|dnl)[ \t]", r"\1 ", t)
    t = re.sub(r"([^.!?\s])[ \t]*\r?\n[ \t]*([a-z])", r"\1 \2", t)
    t = re.sub(r"[.!?](?:[ \t]+|[ \t]*\r?\n)", "\1", t)
    t = re.sub(r"\r?\n", "\2", t)
    t = re.sub("[^a-z0-9\1\2]+", " ", t.translate({c: c + 32 for c in range(65, 91)}))
    out = ""
    for blank, run in itertools.groupby(t, lambda c: c in " \1\2"):
        run = "".join(run)
        out += run if not blank else "\1" if "\1" in run else "\2" if "\2" in run else run
    out, table = out.strip(" "), dict(license_rules.known())
    longest = sorted(table, key=lambda k: (-len(k), k))
    rx = "(?:^|[\1\2])(" + "|".join(k.replace(" ", "[ \2]") for k in longest) + ")(?=[\1\2]|\\Z)"
    return [table[s.replace("\2", " ")] for s in re.findall(rx, out)]


def test_runs_of_marks_give_the_sentences_of_a_plain_walk(spark):
    r = random.Random(4)
    bits = ["\n", "\n\n", " ", "\t", ". ", ".", "! \n", " \r\n", "#", "x", "Foo bar", "\1", "\2", "rem ", "\n * "] + list(license_rules.SENTENCES.values())
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 25))) for _ in range(800)]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", license_rules.sentence_ids(F.col("t")).alias("ids"))
    got = {x["i"]: list(x["ids"]) for x in df.collect()}
    assert sum(map(len, got.values())) > 500
    for i, t in enumerate(texts):
        assert got[i] == _brute(t), repr(t)


def test_half_a_million_line_ends(spark):
    s = next(iter(license_rules.SENTENCES.values()))
    name = next(iter(license_rules.SENTENCES))
    n = 500_000
    rows = [(1, "a" + "\n" * n + "b"), (2, "a" + " \n" * n + s), (3, s + "\n" + "\n " * n + "."), (4, ". " * n + "\n" + s), (5, "a" + " " * n + "b")]
    df = spark.createDataFrame(rows, "i long, t string").select("i", license_rules.sentence_ids(F.col("t")).alias("ids"))
    start = time.time()
    got = {x["i"]: list(x["ids"]) for x in df.collect()}
    assert time.time() - start < 50  # five texts
    assert got == {1: [], 2: [name], 3: [name], 4: [name], 5: []}


def test_numbers_that_look_like_letters_are_none():
    assert not any(map(lang_cnn.has_letter, ["", "12 _-", "²³ ½ ① Ⅷ ۵", "😀"]))
    assert all(map(lang_cnn.has_letter, ["a", "①ß", "12 日", "ª", "½é"]))
    net = lang_cnn.ByteCnn(["de", "en"])
    lang, score = lang_cnn.languages(["² ½ ① Ⅷ", None, "word"], net)
    assert lang[:2] == ["und", "und"] and score[:2] == [0.0, 0.0] and lang[2] in ("de", "en")
