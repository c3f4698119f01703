import random

import pytest

SYLLABLES = "ba ce di fo gu ha je ki lo mu na pe ri so tu va we xi yo zu".split()


def word(rng):
    return "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4)))


def prose(rng, n):
    out = []
    for i in range(n):
        w = word(rng)
        out.append(w.capitalize() + "." if i % 9 == 8 else w)
    return " ".join(out)


@pytest.fixture(scope="session")
def rows():
    """(doc_id, text, lang, source): prose with copies, near copies, leaks, junk and odd cases."""
    rng = random.Random(11)
    shared = prose(rng, 60)
    texts = [prose(rng, rng.randint(25, 120)) for _ in range(60)]
    base = prose(rng, 150)
    for k in range(12):  # near copies of one text, some of them chained
        words = base.split(" ")
        for j in range(k):
            words[(j * 13 + 5) % len(words)] = word(rng)
        texts.append(" ".join(words))
    texts += [texts[3], texts[3].upper(), texts[4]]  # copies
    texts += [f"{t}\n{shared}\n{t[:40]}" for t in texts[:6]]
    texts += ["lo " * 60, "Ba!! CE!! " * 30, "#$% di*** " * 40, "x | y | " * 20]
    texts += ["", None, " \t\n ", "\n\n", "one", "two words", "a\x0bb\x0cc", "Ünïcode ÄÖ žluť 😀 ba", prose(rng, 20_000)]
    out = [(i, t, "en", "big" if i % 3 == 0 else f"s{i % 5}") for i, t in enumerate(texts)]
    out += [out[7], out[7], (None, texts[5], "en", "big"), (None, None, None, None), (1000, texts[9], None, None)]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The rows with further columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    return df.withColumns({"n_chars": F.length("text").cast("long"), "id": F.lit("x"), "n": F.lit(1), "score": F.lit("y"), "key": F.lit(2.0), "kept": F.lit(None).cast("string")})


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("1 = 0")
