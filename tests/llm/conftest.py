import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, doc string, node long, size long, at long, score double, label string"


def rows():
    """Clean texts, copies, nulls in any column, empty and long texts, repeated rows; columns named as the operators' own."""
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
    texts = [" ".join(words[(i * 7 + j * (i + 3)) % 20] + str((i * j) % 5) for j in range(40)) for i in range(12)]
    out = [(i, t, ("en", "de")[i % 2], f"s{i % 3}") for i, t in enumerate(texts)]
    out += [(20, texts[0], "en", "s0"), (21, texts[0] + " tail", "en", None), (22, None, None, "s1"), (23, "", "en", "s1"), (24, " \n\t ", None, None)]
    out += [(25, "word " * 30_000, "en", "s2"), (None, texts[3], "de", "s2"), (None, None, None, None), (26, "Mail a.b@c.example.org now", "en", "s0")]
    out += [(26, "Mail a.b@c.example.org now", "en", "s0"), (27, "x", "en", "s1"), (27, texts[5], "en", "s1")]
    return [(*r, None if r[1] is None else len(r[1]), 1, "d", 2, 3, 4, 0.5, "l") for r in out]


@pytest.fixture(scope="session")
def dirty(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
