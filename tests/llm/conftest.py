import random

import pytest

WORDS = "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima mike november oscar papa quebec romeo sierra tango uniform victor whiskey xray yankee zulu été straße niño".split()
DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def prose(r: random.Random, n: int) -> str:
    out = []
    for k in range(n):
        out.append(r.choice(WORDS) + str(r.randint(0, 99)) * (r.random() < 0.5))
        out.append("\n" if k % 12 == 11 else " ")
    return "".join(out).strip()


def corpus() -> list[tuple]:
    """Ordinary texts, copies, near copies, shared passages and lines, and odd texts."""
    r = random.Random(3)
    texts = [prose(r, r.randint(25, 400)) for _ in range(60)]
    passage = prose(random.Random(9), 60)
    texts += [t + "\n" + passage for t in texts[:5]]
    texts += [texts[7]] * 8 + [texts[8]] * 2
    texts += [texts[9].replace(w, "changed", 1) for w in texts[9].split()[5:12]]
    texts = [t + ("\nAll rights  RESERVED here" if i % 3 == 0 else "") for i, t in enumerate(texts)]
    texts += ["", None, " \t\n ", "one", "a b c", "word " * 40, "x" * 5000, "\x1c\x85\xa0 é鱼😁 <|endoftext|> 's 're", prose(r, 5000), "alpha\x0bbravo\x0ccharlie\r\ndelta", "0" * 30, passage]
    return [(i, t, "en", f"src{i % 3}" if i % 11 else None, len(t) if t is not None else None) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def docs(spark):
    """The corpus over several partitions, with a repeated row, rows without ids, and columns whose names
    are used inside the operators."""
    rows = corpus()
    rows += [rows[3], rows[3], (None, rows[10][1], "en", "src0", None), (None, None, None, None, None), (5, rows[20][1], "en", "src1", 1)]
    df = spark.createDataFrame(rows, DOC).repartition(5)
    return df.selectExpr("*", *(f"'x' AS `{c}`" for c in "key fp root host _host _KEY _kept _lines _fp _id _place n count chunk rows bits".split()))


@pytest.fixture(scope="session")
def texts(docs):
    """(doc_id, text) of every row, null as empty."""
    return [(r.doc_id, r.text or "") for r in docs.collect()]


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
