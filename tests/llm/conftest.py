import pytest

#: Texts that every operator must stand: null, empty, white space, long, repeated, beyond the basic plane.
ODD = [None, "", " \n\t ", "a", "Same text here twice", "Same text here twice", "x" * 70_000, "word " * 30_000, "😀 é   \x00 \x1f", "A B"]


@pytest.fixture(scope="session")
def odd(spark):
    """(doc_id, text) and columns that clash with names the operators use inside."""
    from examweft.llm.common import prepare

    prepare(spark)
    rows = [(i, t, 1, "k", "b") for i, t in enumerate(ODD)] + [(4, ODD[4], 2, None, None), (None, "no id", 3, "k", "b")]
    return spark.createDataFrame(rows, "doc_id long, text string, n long, key string, digest string")


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def tokenizer_path():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
