import random

import pytest

WORDS = "the and attion haed then oning sh th re for edtion of was in thble on erly Ünd école niño 文 😀".split()


def prose(rng: random.Random, n: int) -> str:
    out = []
    for _ in range(n):
        out.append("".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 4))))
        if rng.random() < 0.1:
            out[-1] += rng.choice([".\n", ",", "\t", "  ", "\r\n", " .", " "])
    return " ".join(out)


@pytest.fixture(scope="session")
def texts():
    """Texts with every special case: null, empty, blank, short, very long, copies, near copies, shared passages."""
    rng = random.Random(7)
    passage = prose(rng, 160)
    base = [prose(rng, rng.randrange(20, 300)) for _ in range(40)]
    out = [None, "", "   \n\t", "one", "one two three", "a" * 3000, "\n".join(["same line here"] * 40), prose(rng, 9000)]
    out += base + base[:6]
    for t in base[6:16]:
        w = t.split(" ")
        w[len(w) // 2] = "changed"
        out.append(" ".join(w))
    for _ in range(12):
        out.append(prose(rng, rng.randrange(0, 40)) + " " + passage + " " + prose(rng, rng.randrange(0, 40)))
    out += ["periodic words go on " * 200, "x " + "periodic words go on " * 90]
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    """documents with clashing extra columns, a null id and repeated rows."""
    rows = [(i, t, ("en", "fr", None)[i % 3], "src0", 0, "x", 1) for i, t in enumerate(texts)]
    rows += [(9, texts[9], "en", "src0", 0, "x", 1), (None, texts[10], "en", None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string, n long")


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
