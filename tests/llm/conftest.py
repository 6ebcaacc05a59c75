import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, batch string, k string"


def sample_texts(seed=3, n=60):
    """Texts with exact and near copies, shared passages, empty, null, short and long ones."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    passage = [rng.choice(vocab) for _ in range(60)]
    out = [None, "", "   \n\t ", "one", "two words", "It's ' 's  don't\n\nstop <|endoftext|> now 中文 ok", " x\u0085y\x1cz"]
    for i in range(n):
        words = [rng.choice(vocab) for _ in range(rng.choice([3, 15, 40, 120]))]
        if i % 4 == 0:
            at = rng.randint(0, len(words))
            words[at:at] = passage[rng.randint(0, 20) :]
        sep = rng.choice([" ", "\n", "  ", "\t\x0b"])
        out.append(sep.join(words))
        if i % 5 == 0:
            out.append(out[-1])
        if i % 6 == 0:
            near = list(words)
            near[len(near) // 2] = "changed"
            out.append(" ".join(near))
    out.append(" ".join(rng.choice(vocab) for _ in range(30000)))
    return out


@pytest.fixture(scope="session")
def texts():
    return sample_texts()


@pytest.fixture(scope="session")
def docs(spark, texts):
    """A table with clashing extra columns, ids out of order, and rows that stand twice."""
    rows = [(7 * i % 1009, t, "en" if i % 2 else None, [None, "b", "a", "B"][i % 4] if i % 3 else "a", len(t or ""), "x", "y") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + rows[8:11], SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
