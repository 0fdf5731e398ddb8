import pytest

#: Texts every operator must take: null, empty, blank, repeated, long, other scripts, characters of four bytes.
ODD = [None, "", " \n\t ", "a", "a", "one two", "one two\none two\n\none two", "é è 漢字 𝒳 \x85x y",
       "x" * 5000, "ab " * 3000, "\n" * 50, "Ünï\rcode\x0bvt\x0cff", "the cat sat on the mat " * 3 + "| <b> $5 % & # * \r\nend"]


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(ODD)]
    rows += [(None, "no key at all", None, None, None), (3, "a", "en", "s", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
