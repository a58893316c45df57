import pytest

#: Texts with the odd cases that every operator has to take.
ODD = [
    None, "", " ", "\n\t", "a", "a b c", "  two  spaces\n\n\tand \x85 lines   \x1c sep", "it's I'LL don't 'S 12 345,6 €",
    "été café é İstanbul ΣαΣ ﬁ 漢字かな \U0001d518\U0001f600‍\U0001f680", "x▁y ▁▁ z▁", "<|endoftext|> a  <|endoftext|>b <|startoftext|>",
    "a\x00b \x07", "　wide space  ", "word " * 3000, "x" * 20000, " lead", "trail ", "Don't, stop! (ok) A.B ,x word, ÄÖÜß, Ÿ. ª² <|ENDOFTEXT|> x|y | z", "same word Same WORD word, " * 30, "trail  ", "<s> </s>",
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Odd texts, a repeated row, null ids and sources, and an extra column with a clashing name."""
    rows = [(i, t, "en", f"src{i % 3}" if i % 4 else None, 7) for i, t in enumerate(ODD)] + [(3, ODD[3], "en", "src0", 7), (None, "no id", None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n long")
