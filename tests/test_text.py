import random
import re

import pytest
from pyspark.sql import functions as F

from wishloom.functions import language as lg
from wishloom.functions import text as tx

CUE = re.compile(r"\b(no|not|without|don['’]?t)\s+([\w\s]{1,80}?)(?=(?:,|;|\.|\band\b|\bbut\b|$))", re.IGNORECASE)


def column(spark, rows, expr):
    return [r[0] for r in spark.createDataFrame(list(enumerate(rows)), "i int, text string").orderBy("i").select(expr).collect()]


def test_normalise_and_ngrams(spark):
    t = F.col("text")
    assert column(spark, ["Wi-Fi in all rooms", "été, WI_FI!", "?!"], tx.normalize_label(t)) == ["wi fi in all rooms", "été wi_fi", ""]
    grams = column(spark, ["Wi-Fi in all rooms", "one", "?!"], tx.ngrams(tx.tokens(t)))
    assert grams[0][:5] == ["wi", "fi", "in", "all", "rooms"] and grams[0][-1] == "in all rooms" and len(grams[0]) == 12
    assert grams[1] == ["one"] and grams[2] == []


@pytest.mark.parametrize("max_n", [1, 2, 4])
def test_ngrams_by_size_then_position(spark, max_n):
    words = "a b c d e".split()
    want = [" ".join(words[i:i + n]) for n in range(1, max_n + 1) for i in range(len(words) - n + 1)]
    assert column(spark, ["a b c d e"], tx.ngrams(tx.tokens(F.col("text")), max_n)) == [want]


def random_text(rng):
    words = ["no", "Not", "without", "don't", "dont", "and", "but", "wifi", "pool", "catering", "é", ",", ";", ".", "-", "\n", "x" * 30]
    return "".join(rng.choice(words) + rng.choice([" ", " ", "  ", ""]) for _ in range(rng.randint(0, 25)))


def test_negation_equals_brute_force(spark):
    rng = random.Random(5)
    texts = ["no catering but scuba required", "no wi-fi", "No pool."] + [random_text(rng) for _ in range(3000)]
    t = F.col("text")
    phrases = column(spark, texts, tx.negation_phrases(t))
    rewritten = column(spark, texts, tx.rewrite_negations(t))
    for text, got, new in zip(texts, phrases, rewritten):
        assert got == [m.group(2).strip() for m in CUE.finditer(text)], text

        def swap(m):
            phrase = m.group(2).strip()
            kept = "room only" if "catering" in phrase.lower() else phrase
            return kept + (" " if m.group(0).endswith(" ") else "")
        assert new == CUE.sub(swap, text), text
    assert column(spark, texts[:1], tx.normalize_label(tx.rewrite_negations(t))) == ["room only but scuba required"]


def test_language_choice_gate_and_fallback(spark):
    rows = [("the trip to de zee",), ("je cherche des vacances",), ("zzz qqq",), ("!!!",), ("жжж aa",)]
    df = spark.createDataFrame(rows, "text string")
    got = {r["text"]: (r["language"], r["language_error"]) for r in lg.detect_language(df, allowed=("en", "nl")).collect()}
    assert got["the trip to de zee"] == ("en", None)
    assert got["je cherche des vacances"] == (None, "Detected language 'fr' is not permitted")
    assert got["zzz qqq"] == ("en", None)
    assert got["!!!"] == (None, lg.NO_DETECTION)
    assert got["жжж aa"] == (None, lg.NO_DETECTION)
