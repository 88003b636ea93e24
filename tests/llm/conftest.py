import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed=5, n=160):
    """Small documents with exact and near copies, shared passages, blank, null and repeated rows."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)] + ["The", "of", "Über", "naïve", "x*", "a|b", "50%"]
    word = lambda: rng.choice(vocab)
    passage = " ".join(word() for _ in range(40))
    texts = []
    for i in range(n):
        kind = i % 8
        text = "".join(word() + rng.choice([" ", " ", " ", "\n", "\t", "  ", "\r\n"]) for _ in range(rng.randint(1, 150)))
        if kind == 1 and texts:
            text = rng.choice(texts) or ""
        elif kind == 2 and texts:
            words = (rng.choice(texts) or "a").split(" ")
            words[rng.randrange(len(words))] = "changed"
            text = " ".join(words)
        elif kind == 3:
            at = rng.randrange(len(text))
            text = text[:at] + "\n" + passage + "\n" + text[at:]
        elif kind == 4:
            text = "\n".join([text, "same line here", text.strip(), "same line here"])
        texts.append(text)
    texts += [None, "", " \n ", "one", "one two", "the " * 300, None]
    rows = [(i * 3 % 1000, t, "en", [f"s{i % 4}", None][i % 11 == 0], len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, "no id here at all", None, None, None), (None, texts[3], "en", "s1", 5)]
    return rows, passage


@pytest.fixture(scope="session")
def docs(spark):
    rows, _ = corpus()
    return spark.createDataFrame(rows, DOCS).repartition(5).cache()


@pytest.fixture(scope="session")
def odd(spark):
    """The same with columns whose names the operators may use inside."""
    from pyspark.sql import functions as F

    rows, _ = corpus()
    df = spark.createDataFrame(rows, DOCS)
    for name in ("key", "data", "size", "n", "fp", "row", "quality", "copies", "words", "id", "first", "cell", "stay_row", "own_key", "mix_key", "line_own", "line_gone", "line_report", "pii_found", "quality_verdict", "taken", "KEY_"):
        df = df.withColumn(name, F.lit(1))
    return df


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)
