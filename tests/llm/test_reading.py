import numpy as np
import pytest

from lorekiln.llm.reading import ReadingScale, fit_scale, isotonic, reading_levels, words_of

EASY = "the cat sat on the mat and the dog ran to the red hut in the sun "
HARD = "notwithstanding institutional heterogeneity the epistemology circumscribes an indeterminate historiography thereby "
MID = "although the merchant seemed cautious the village followed another letter beside the quiet harbour "


def test_isotonic_pools_violators():
    x, v = isotonic(np.array([1.0, 2, 3, 4]), np.array([1, 3, 2, 4]))
    assert v.tolist() == [1, 2.5, 2.5, 4] and x.tolist() == [1, 2, 3, 4]


def test_words_skip_dirt():
    assert words_of("The  so­ft (cf. b. 3) FOX’s ﬁre") == ["the", "soft", "fox's", "fire"]


def passages(spark):
    rows = [(i, 1 + i % 3, (EASY, MID, HARD)[i % 3] * (2 + i % 4)) for i in range(30)] + [(99, None, EASY), (98, 2, None)]
    return spark.createDataFrame(rows, "passage_id long, reading_level int, text string")


def test_levels_of_documents(spark):
    scale = fit_scale(passages(spark))
    long = 20_000
    docs = [(1, EASY * 5), (2, MID * 5), (3, HARD * 5), (4, None), (5, ""), (6, "too short"), (7, EASY * long), (1, EASY * 5), (8, "1 2 3 " * 30)]
    df = spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, text string, score string")
    got = sorted((r.doc_id, r.reading_level) for r in reading_levels(df, scale).collect())
    assert got[:5] == [(1, 1), (1, 1), (2, 2), (3, 3), (7, 1)]
    assert got[5][0] == 8 and 1 <= got[5][1] <= 3  # no words but numbers: graded as the easiest
    assert reading_levels(df.limit(0), scale).collect() == []


def test_no_passages(spark):
    with pytest.raises(ValueError):
        fit_scale(passages(spark).limit(0))


def test_held_out_accuracy():
    s = ReadingScale([(EASY, MID, HARD)[i % 3] * 3 for i in range(24)], [1 + i % 3 for i in range(24)])
    assert (s.level(s.held_out) == [1 + i % 3 for i in range(24)]).mean() > 0.9


def test_no_level_is_left_out_of_many_passages(spark):
    texts = [EASY, MID, HARD, "zinc quartz gneiss basalt ", "sonata fugue octave minor "]
    rows = [(i, 1 + i % 5, texts[i % 5] * 2 + f"n{i}") for i in range(7500)]
    scale = fit_scale(spark.createDataFrame(rows, "passage_id long, reading_level int, text string"))
    assert scale.models.levels == [1, 2, 3, 4, 5]
    docs = spark.createDataFrame([(i, t * 20) for i, t in enumerate(texts)], "doc_id long, text string")
    assert {r.doc_id: r.reading_level for r in reading_levels(docs, scale).collect()} == {i: i + 1 for i in range(5)}
