"""A small table with every awkward row, and the folder of tables that holds it."""

import random

import pytest

WORDS = "the of and to in a is that for it was on with as be by stone river cloud lantern copper ledger maple signal harbor violet anchor bridge castle desert engine forest garden hammer island jungle kettle ladder".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def make_rows():
    rng = random.Random(7)
    passage = sentence(rng, 60)
    base = sentence(rng, 300)
    near = base.split()
    near[150] = "changed"
    texts = [
        None,
        "",
        " \t\n ",
        "Word",
        "three short words",
        base,
        base,  # an exact copy
        " ".join(near),
        base.upper(),
        sentence(rng, 40) + " " + passage + " " + sentence(rng, 40),
        passage + "\n" + sentence(rng, 90) + "\n" + passage,
        "aé" * 300,
        "ab" * 400,
        "日本語 テキスト " * 60,
        "line one here\nline one here\nother line\n\n" * 20,
        "Licensed under the MIT License. Apache License, Version 2.0! CC BY-NC 4.0 and the GNU General Public License v3",
        "mit dem license 🙂🙂 a b  double  spaces \r\n<|endoftext|>",
        "x" * 5000,
        sentence(rng, 30_000),  # a very long text
        "### $$$ %%% &&& *** |||" * 40,
    ]
    texts += [sentence(rng, rng.randint(5, 200)) for _ in range(25)]
    rows = [(i * 3, t, "en" if i % 3 else None, f"src{i % 4}" if i % 5 else None, "kept", i) for i, t in enumerate(texts)]
    rows += [rows[5], rows[9]]  # repeated rows
    rows += [(None, base, "en", "src0", "kept", -1), (None, None, None, None, None, None)]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, row string, n_words int"
ITEMS = "item_id long, text string"


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, rows, tmp_path_factory):
    """Extra columns have names that the operators use themselves."""
    path = str(tmp_path_factory.mktemp("tables") / "documents.parquet")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def items(rows):
    words = rows[9][1].split()
    long_text = rows[18][1].split()
    return [
        (1, " ".join(words[45:75]).upper()),
        (2, "; ".join(long_text[1000:1012])),
        (3, "short words"),  # fewer words than a window
        (3, "short words"),
        (4, None),
        (5, " ... "),
        (None, " ".join(long_text[50:70])),
        (10, "never seen anywhere in these texts at all or so one hopes"),
    ]


@pytest.fixture(scope="session")
def benchmark(spark, items):
    return spark.createDataFrame(items, ITEMS)
