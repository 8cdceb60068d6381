"""A small table with what is hard: nulls, empty and long texts, ties, repeated rows, extra columns."""

from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, key string, label int"


def prose(seed: int, words: int) -> str:
    rnd = random.Random(seed)
    parts = ["an", "er", "the", "on", "ti", "ou", "st", "ré", "heit", "ción"]
    out = []
    for i in range(words):
        w = "".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 5)))
        out.append(w + (".\n" if i % 40 == 39 else "." if i % 9 == 8 else ""))
    return " ".join(out)


def make_rows() -> list[tuple]:
    base = prose(1, 120)
    near = base.replace(base.split()[60], "changed", 1)
    texts: list[str | None] = [
        None, "", " ", "\n\n", "word", base, base, near, base + " tail words here", prose(2, 300), prose(3, 5000), "same same " * 200,
        "This work is licensed under the GNU General Public License, version 3. All rights reserved. CC BY", "licensed under CC\nBY-NC 4.0", "Released under a the MIT License.",
        "日本語のテキスト と emoji 🎉 <|endoftext|>", "a  b \t c\n\n\nd'll I'VE 12345 x_y", "#$ %& <> ***", "idiot moron " + prose(4, 50), "é \x1c  z",
    ]
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 2}" if i % 4 else None, None, 0.5, "k", 1) for i, t in enumerate(texts)]
    rows += [rows[5], rows[9], (None, prose(5, 60), None, None, None, None, None, None), (None, base, None, None, None, None, None, None)]
    rows += [(100 + i, prose(1000 + i, 30 + i % 50), "en", "s", 1, None, None, None) for i in range(60)]
    rows += [(200 + i, base, "en", "s", 1, None, None, None) for i in range(30)]  # a third are copies
    return rows


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs"))
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(path + "/documents.parquet")
    return spark.read.parquet(path + "/documents.parquet")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark, rows):
    ids = [r[0] for r in rows if r[0] is not None]
    return spark.createDataFrame([(i, int(i % 5 != 0), int(i == 18)) for i in dict.fromkeys(ids)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
