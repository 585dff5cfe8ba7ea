import pandas as pd

from lexloom.llm import align


def test_language_is_told_from_the_whole_text():
    """A front matter of more than 4000 characters in the other script."""
    ru, en = "Он вышел из дома и долго шёл по дороге. ", "He left the house and walked along the road. "
    texts = [en * 120 + ru * 600, ru * 120 + en * 600, en * 120, ru * 120, ru + en, None, en * 120 + ru * 600]
    assert align._language(pd.Series([None, "", None, None, None, None, "de"]), pd.Series(texts)).tolist() == ["ru", "en", "en", "ru", "", "", "de"]
