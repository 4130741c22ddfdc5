import random

import pytest

WORDS = ["alpha", "beta", "gamma", "delta", "the", "of", "and", "to", "in", "is", "river", "stone", "Märchen", "été",
         "x1", "42", "over,", "under.", "night", "day"]


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text) rows with copies, near copies, nulls, blanks, ties, a long text and repeated lines."""
    rng = random.Random(7)
    run = [sentence(rng, 30), sentence(rng, 30), sentence(rng, 12)]
    shared = sentence(rng, 60)
    texts = [sentence(rng, rng.randint(1, 120)) for _ in range(25)]
    texts += [texts[3], texts[3], texts[4] + " tail", None, "", " \t\n ", "one", "two words"]
    texts += ["\n".join([sentence(rng, 9), *run, sentence(rng, 9)]), "\n".join([*run, sentence(rng, 20)])]
    texts += [shared, sentence(rng, 8) + "\n" + shared, "\n\n" + shared + "\n\nend", run[0] + "\n" + run[1]]
    texts += ["\n".join(sentence(rng, 25) for _ in range(120))]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(3, texts[3]), (3, texts[3]), (None, texts[5]), (None, None)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """The corpus with extra columns whose names clash with what operators use inside."""
    rows = [(i, t, "k", 1, 2, "m", 3) for i, t in corpus]
    return spark.createDataFrame(rows, "doc_id long, text string, _key string, _h1 int, n_words int, kept string, pos int")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string")


@pytest.fixture(scope="session")
def tokenizer_path():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
