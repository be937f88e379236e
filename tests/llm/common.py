import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row_ string, fp string, key string"
DATA = "/root/testdata/sf0.001"


def frame(spark, rows):
    """Documents from (doc_id, text) or (doc_id, text, lang), with extra columns whose names operators use inside."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else None, "s", len(r[1] or ""), "x", "y", "z") for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def stored(spark, tmp_path, rows, name="docs"):
    """The same as a table: written and read again."""
    path = str(tmp_path / name)
    frame(spark, rows).write.parquet(path)
    return spark.read.parquet(path)


def words(n, seed, vocabulary=5000):
    rng = random.Random(seed)
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]
