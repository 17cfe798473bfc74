"""What counts as a letter and a word; scores do not depend on how texts are batched."""

from gridtide.llm.langid import LanguageModel, words_of


def test_words_are_letters_and_their_marks():
    assert words_of("½ ² ① 12 _ !") == [] and words_of(None) == [] and words_of("") == []
    assert words_of("don't 3rd ÉTÉ") == ["don", "t", "rd", "été"] and words_of("हिन्दी भाषा") == ["हिन्दी", "भाषा"]


def test_predictions():
    rows = [("aa", "abab", 5), ("aa", "baab", 3), ("bb", "xyxy", 4), ("bb", "yxxy", 6)]
    model = LanguageModel.learn(*map(list, zip(*rows, strict=True)))
    texts = ["abab", "yxyx yx", "½ ²", None, "", "abba " * 50_000, "abab xyxy xyxy"]
    langs, scores = model.predict(texts)
    assert langs == ["aa", "bb", "und", "und", "und", "aa", "bb"] and scores[2:5] == [0, 0, 0] and all(0 <= s <= 1 for s in scores)
    alone = [model.predict([t]) for t in texts]
    assert [x[0][0] for x in alone] == langs
    assert LanguageModel.learn([], [], []).predict(["abab"]) == (["und"], [0.0])
