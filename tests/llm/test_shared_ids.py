"""Different texts under one id, all rows under one id, and ids that are all null."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import language_id, line_quality, sentence_dedup

PASSAGE = "One passage that many texts share goes on for more than twenty words here. It has a second sentence with enough words to count as a run of two."
OTHER = "Nothing of this text is anywhere else at all, not one of its words in this order. And its second sentence stands alone as well, as does its third one. So it must stay."


def test_different_texts_under_one_id_keep_what_is_not_repeated(spark):
    rows = [(1, PASSAGE), (7, PASSAGE + " More follows that is only here."), (7, OTHER), (7, None), (7, "")]
    got = [(r.doc_id, r.text, r.n_removed) for r in sentence_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=repr) == sorted([(1, PASSAGE, 0), (7, "More follows that is only here.", 2), (7, OTHER, 0), (7, None, 0), (7, "", 0)], key=repr)


def test_texts_under_one_id_repeat_each_other(spark):
    rows = [(7, PASSAGE), (7, "Begins otherwise. " + PASSAGE), (7, PASSAGE)]
    got = [(r.text, r.n_removed) for r in sentence_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    # equal rows are one document; of the two different ones the second loses the passage
    assert sorted(n for _, n in got) in ([0, 0, 2], [0, 2, 2]) and ("Begins otherwise. ", 2) in got or (("", 2) in got and got.count(("", 2)) == 2)


LANGUAGES = {"aa": "alpha beta gamma delta", "bb": "uno dos tres cuatro"}


@pytest.mark.parametrize("ids", [8, 5, None])
def test_languages_are_learned_where_ids_repeat_or_are_null(spark, ids):
    r = random.Random(4)
    rows = []
    for i in range(600):
        lang = ("aa", "bb")[i % 2]
        rows.append((ids, " ".join(r.choices(LANGUAGES[lang].split(), k=30)), lang))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language_id.identify(docs, F.lit(False), max_train=100).join(docs.limit(0).select("doc_id"), "doc_id", "left").collect()
    assert len(got) == 600
    found = language_id.predict(docs, language_id.fit(docs.select("text", "lang", F.col("doc_id").alias("h")), 100), ("lang",)).collect()
    assert sum(r.lang == r.lang_pred for r in found) >= 590


def test_copies_of_one_row_leave_no_language_out(spark):
    rows = [(1, "alpha beta gamma", "aa")] * 500 + [(i, "uno dos tres", "bb") for i in range(2, 40)]
    docs = spark.createDataFrame(rows, "h long, text string, lang string")
    model = language_id.fit(docs, 20)
    assert sorted(model.labels) == ["aa", "bb"]
    found = language_id.predict(docs, model, ("lang",)).collect()
    assert all(r.lang == r.lang_pred for r in found)
