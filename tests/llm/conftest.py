import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_schema():
    return DOCS


@pytest.fixture(scope="session")
def odd_rows():
    """Null, empty, blank, long, repeated and tied rows."""
    r = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa", "Über", "naïve", "λόγος"]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    base = text(120).split()
    near = base.copy()
    near[60] = "changed"
    far = base[:60] + text(60).split()
    rows = [
        (0, None), (1, ""), (2, " \t\n "), (3, "one two"), (4, "ONE two"), (5, "one  two"), (6, " ".join(base)), (7, " ".join(base)), (8, " ".join(near)), (9, " ".join(far)),
        (10, text(40000)), (11, "a\nb\na\nb\n"), (12, "x " * 5000), (None, " ".join(base)), (6, " ".join(base)), (13, "| | $$ ** " * 30),
    ]
    return [(i, t, None if k % 4 == 0 else "en", None if k % 5 == 0 else f"src{k % 3}", None) for k, (i, t) in enumerate(rows)]
