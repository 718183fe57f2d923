import random
import string

import pytest

WORDS = ["alpha", "Beta", "gamma,", "délta", "Éta.", "theta", "iota", "kappa!", "lambda", "mu", "the", "of", "and", "a"]


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) * (rng.random() < 0.5) for _ in range(n))


@pytest.fixture(scope="session")
def fixture_docs(spark):
    """Small documents with copies, near copies, shared passages, nulls, empty and odd texts, ties and repeated rows."""
    rng = random.Random(7)
    texts = [prose(rng, rng.choice([3, 12, 60, 130])) for _ in range(120)]
    for i in range(30):
        texts.append(texts[i])
        texts.append(texts[i].upper())
        words = texts[i].split(" ")
        words[rng.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
    passage = prose(rng, 60)
    texts += [f"{prose(rng, 30)} {passage} {prose(rng, 30)}" for _ in range(20)]
    base = prose(rng, 100).split(" ")
    for _ in range(25):
        words = list(base)
        for _ in range(3):
            words[rng.randrange(100)] = rng.choice(string.ascii_lowercase) * 3
        texts.append(" ".join(words))
    texts += ["", " \t\n", None, "one", "one two", "One  TWO", "x" * 5000, "line\n" * 40, prose(rng, 3000)]
    rows = [(i, t, ["en", "de", None][i % 3], ["s1", "s2", "s3", None][i % 4 if i % 3 else 0], i) for i, t in enumerate(texts)]
    rows += [(None, texts[0], "en", "s1", 0), (None, None, None, None, None), rows[5], rows[5]]
    rng.shuffle(rows)
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark, fixture_docs, tmp_path_factory):
    """The fixture as a Parquet table, with a column whose name operators use themselves."""
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    frame = spark.createDataFrame(fixture_docs, SCHEMA).selectExpr("*", "n_chars AS size", "text AS t", "doc_id AS token", "n_chars AS label", "lang AS kept")
    frame.repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "empty.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    return spark.read.parquet(path)
