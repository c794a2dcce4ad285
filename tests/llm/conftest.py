import random
import re

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text, lower=False):
    return WORD.findall((text or "").translate(LOW) if lower else text or "")


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{int(rng.paretovariate(1.1)) % vocabulary:03d}x" for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Null and empty texts, one word, long texts, exact and near copies, repeated lines and passages, odd bytes."""
    rng = random.Random(5)
    texts = [None, "", " \t\n ", "One", "one", "a b c", "A B  C"]
    base = prose(rng, 300, 4000)
    texts += [base, base, base.upper()]
    for k in range(25):  # near copies
        w = base.split()
        for _ in range(k % 6):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    passage = prose(rng, 40, 4000)
    for _ in range(12):
        texts.append(f"{prose(rng, 30, 4000)}\n{passage}\n{prose(rng, 20, 4000)}")
    texts += [prose(rng, 6000, 9000), "naïve café x — 漢字 \u0085 end", "x " * 500]
    for _ in range(40):
        texts.append("\n".join(prose(rng, rng.randrange(1, 25), 300) for _ in range(rng.randrange(1, 6))))
    rng.shuffle(texts)
    return [(i * 7 + 3, t, None if i % 9 == 0 else "ab"[i % 2], None if i % 11 == 0 else f"s{i % 4}", len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def odd(spark):
    """Repeated rows, a null doc_id and columns whose names clash with results."""
    text = "the same old line of words again and again for all of us here today and more"
    return spark.createDataFrame([(1, text, "a", "s", 0, 5, "z"), (1, text, "a", "s", 0, 5, "z"), (None, text, None, None, None, 6, None), (2, None, None, None, None, 7, "q")], SCHEMA + ", n int, score string")
