import pytest

DOCS = "doc_id long, text string, lang string, n_words long, contaminated boolean, row long, score double"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(seed: int, n: int) -> str:
    """Deterministic words without a random module."""
    x, out = seed * 2654435761 % 2**32 or 1, []
    for _ in range(n):
        x = (1103515245 * x + 12345) % 2**31
        out.append(WORDS[(x >> 16) % len(WORDS)] + str((x >> 8) % 7))
    return " ".join(out)


@pytest.fixture(scope="session")
def texts():
    """Nulls, empties, short, very long, equal and near texts, and odd characters."""
    base = prose(1, 120)
    near = base.replace(base.split()[60], "other", 1)
    odd = ["", None, " \n\t ", "one", "One two three four", "ONE two three four", "naïve café 日本語 😀 é", "don't 'll'!! <|endoftext|> x", "a" * 3000, "ab " * 2000, prose(9, 9000)]
    return [base, base, near, base + " tail end", prose(2, 80), prose(3, 300), *odd, *[prose(k, 40) for k in range(20, 50)]]


@pytest.fixture(scope="session")
def docs(spark, texts):
    """Documents with columns whose names clash with the operators' own, and one row twice."""
    rows = [(k, t, "en", 1, True, 5, 0.5) for k, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[4]], DOCS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
