"""Small tables for the tests of this folder."""

from __future__ import annotations

import pandas as pd

DOCS = "doc_id long, text string, lang string, source string, n_chars long"

ODD = [
    (1, None, None, None, None),
    (2, "", "en", "s", 0),
    (3, " \n\t \n", "en", "s", 5),
    (None, "a row without an id has a text all the same", "en", "s", 43),
    (4, "word", "en", "s", 4),
    (5, "é ß 漢字 \u0001\u0003 \U0001f600 <|endoftext|>", "xx", "s", 20),
]


def docs(spark, rows):
    return spark.createDataFrame([tuple(r) for r in rows], DOCS)


def plain(spark, texts, source="s"):
    return docs(spark, [(k, t, "en", source, len(t or "")) for k, t in enumerate(texts)])


def directory(tmp_path, **tables):
    """A folder of Parquet files named like the driver's tables."""
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def clash(df, *names):
    """df with more columns whose names the operators would like to use themselves."""
    for n in names:
        df = df.withColumn(n, df[df.columns[0]])
    return df


def smallest(links, nodes):
    """{node: smallest node reachable} by brute force."""
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def frame(df) -> pd.DataFrame:
    return df.toPandas()
