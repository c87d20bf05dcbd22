import pytest

#: Awkward rows that every operator has to take: nulls, empty, repeated, very long, no letters, clashing columns.
LONG = " ".join(f"word{i % 977} and the" for i in range(20_000))


@pytest.fixture(scope="session")
def odd_documents(spark):
    rows = [(1, "The cat sat on the mat and the dog ran after it all day long.", "en"),
            (1, "The cat sat on the mat and the dog ran after it all day long.", "en"),
            (2, None, "en"), (3, "", None), (None, "a text without an id, but with words enough for a shingle", "en"),
            (None, None, None), (4, "12 345 !!", "de"), (5, LONG, "en"), (6, "  \n\t ", "fr"),
            (7, "Ünïcode ÀÉ \U0001f600 текст слова 日本語", "xx"), (8, "the cat sat on the MAT and the dog ran after it all day long.", "en")]
    df = spark.createDataFrame([(i, t, lang, 0.5, "x", 3) for i, t, lang in rows],
                               "doc_id long, text string, lang string, score double, component string, n_words int")
    return df.repartition(3)


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.limit(0)
