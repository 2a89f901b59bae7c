"""Texts in more languages than four."""

import random

import pytest

from tallyspan.llm import language


def test_a_text_in_six_languages(spark):
    pick = random.Random(0)
    letters = ["abcd", "efgh", "ijkl", "mnop", "qrst", "uvwx"]
    text = lambda own, n: " ".join("".join(pick.choice(own) for _ in range(6)) for _ in range(n))
    training = spark.createDataFrame([(text(own, 200), f"l{i}") for i, own in enumerate(letters)], "text string, lang string")
    docs = spark.createDataFrame([(1, " ".join(text(own, 40) for own in letters))], "doc_id bigint, text string")
    row = language.identify(docs, training).first()
    assert len(row["proportions"]) == 6 and row["score"] == pytest.approx(1 / 6, abs=0.02)
