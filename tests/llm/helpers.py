"""Fixtures' texts and plain versions that the operators are held against."""

import random

LONG = " ".join(f"w{i % 997}x{i}" for i in range(40_000))
TEXTS = [
    (1, None), (2, ""), (3, " \n\t "), (4, "Word"), (5, "One two three four five six seven."),
    (5, "One two three four five six seven."), (6, "one TWO three four five six seven."),
    (None, "one two three four five six seven."), (None, None), (7, LONG), (8, LONG + " more"),
    (9, "it's <|endoftext|> ünïcödé 日本 we'll ½ ²  x\r\ny\x0b\x1c\x85z 12345"), (-3, "!!! ??? 123"),
    (10, "…"),
]
# Columns whose names operators use inside.
EXTRA = "a b sig tree comp key h n n_words chunk bucket bits block body score part before id component".split()


def documents(spark, texts=TEXTS, extra=True):
    rows = [(i, t, "en" if i and i % 2 else None, "s", None if t is None else len(t)) for i, t in texts]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in EXTRA if extra else ():
        df = df.selectExpr("*", f"'x' AS {name}")
    return df.repartition(3)


def sentences(seed, n, words=("alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa", "tau")):
    rng = random.Random(seed)
    return " ".join(rng.choice(words) + str(rng.randrange(50)) for _ in range(n))


def collected(df, key="doc_id"):
    rows = [r.asDict() for r in df.collect()]
    return sorted(rows, key=lambda r: (r[key] is not None, r[key] or 0, str(r)))


def same_as_sql(spark, sf_dir, name):
    import duckdb

    from paceline.llm import catalog

    con = duckdb.connect()
    for table in ("documents", "benchmark", "pages", "embeddings", "labels", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    result = con.execute(catalog.SQL[name])
    names = [d[0] for d in result.description]
    want = sorted((tuple(r) for r in result.fetchall()), key=repr)
    got = sorted((tuple(r[c] for c in names) for r in catalog.QUERIES[name](spark, sf_dir).collect()), key=repr)
    assert got == want
