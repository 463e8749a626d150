"""Toxicity does not fall with the length of a text, and holds the bars of its first version."""
import numpy as np
import pytest

from volforge.llm import toxicity
from volforge.llm.common import table

SF_LARGE = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def docs(spark):
    from pyspark.sql import functions as F
    rows = table(spark, SF_LARGE, "documents").join(table(spark, SF_LARGE, "labels").select("doc_id", "toxic"), "doc_id")
    return rows.where(toxicity.held_out(F.col("doc_id"))).orderBy("doc_id").select("toxic", "text").collect()


@pytest.fixture(scope="module")
def score(spark):
    model = toxicity.fit(table(spark, SF_LARGE, "documents"), table(spark, SF_LARGE, "labels"))
    return lambda texts: model.probability(toxicity.Scorer(model).features(texts))


def test_an_insult_shows_in_a_long_clean_text(docs, score):
    clean = [r.text for r in docs if r.toxic == 0 and r.text]
    words = " ".join(t for t, p in zip(clean, score(clean)) if p < 0.05).split()[:20_000]
    assert len(words) == 20_000
    insult = "the reed of stupid thandst ones"
    alone, *planted, clean = score([insult] + [" ".join([*words[:k], insult, *words[k:]]) for k in (0, 10_000, 20_000)] + [" ".join(words)])
    assert clean < toxicity.THRESHOLD < 0.9 < alone
    assert min(planted) >= alone - 1e-9
    repeated = score(["the reed of stupid ones " * n for n in (1, 2, 5, 50)])
    assert (np.diff(repeated) >= -1e-9).all() and repeated[1] > repeated[0]


def test_held_out_bars(docs, score):
    toxic, found = np.array([r.toxic for r in docs]), score([r.text for r in docs]) >= toxicity.THRESHOLD
    assert found[toxic == 1].mean() >= 0.95 and (toxic == 1).sum() > 20
    assert found[toxic == 0].mean() <= 0.01


def test_no_feature_lowers_the_score():
    x = np.array([[0.0, 3.0], [1.0, 2.0], [2.0, 1.0], [3.0, 0.5]] * 5)
    slopes, _ = toxicity.rising_scale(x, np.array([0, 0, 1, 1] * 5))
    assert min(slopes) >= 0 and max(slopes) > 0
