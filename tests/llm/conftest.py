import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa"]) + str(rng.randint(0, 60)) for _ in range(n))


def rows(texts):
    return [(k, t, "en", f"src{k % 5}", len(t or "")) for k, t in enumerate(texts)]


@pytest.fixture(scope="session")
def awkward():
    """Null, empty and blank texts, copies, near copies, shared passages, short periods, a long text, odd characters."""
    rng = random.Random(7)
    passage, other = words(rng, 70), words(rng, 120)
    texts = [None, "", " \t\n", "one", words(rng, 300), passage, words(rng, 20) + " " + passage + " " + words(rng, 30)]
    texts += [words(rng, 10) + "\n" + passage + "\n" + words(rng, 10) for _ in range(4)]
    texts += [other, other, other.replace("alpha", "ALPHA"), other + " tail", "x" * 700, "ab" * 300, "Und " * 400, "der der " * 100 + passage]
    texts += ["é" * 150 + "ü" * 150, "é" * 150 + "ü" * 150 + "z", " a b\x1cc\x85d " * 40, words(rng, 4000) + " " + other]
    texts += [passage[:-3], "   " + passage + "   ", None, ""]
    return rows(texts)


@pytest.fixture
def table(spark):
    def make(data, extra=True):
        frame = spark.createDataFrame(data, DOCS)
        if extra:  # columns whose names operators use inside
            from pyspark.sql import functions as F

            for name in ("anchor", "n", "fp", "leaf", "slot", "rank", "keep", "quality", "length", "piece", "line", "u1"):
                frame = frame.withColumn(name, F.lit("clash"))
        return frame

    return make
