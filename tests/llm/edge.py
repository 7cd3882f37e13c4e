"""Documents with every odd case, and names that operators use themselves."""

LONG = "alpha beta gamma delta " * 30_000

ROWS = [
    (1, "The quick brown fox jumps over the lazy dog. " * 8 + "Done.", "en", "a", 10),
    (2, None, "en", "a", None),
    (3, "", None, "b", 0),
    (4, " \n\t ", "en", None, 4),
    (5, LONG, "en", "a", len(LONG)),
    (6, "same text twice", "en", "b", 15),
    (6, "same text twice", "en", "b", 15),
    (7, "same text twice", "fr", "c", 15),
    (None, "no id at all, but a text", "en", "c", 5),
    (8, "été à la plage — où ça? 中文 \u0085   x", "fr", None, 20),
    (9, "12345 67890 !!! ***", None, "d", 18),
]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ("measures", "fails", "host_bad", "bad_host", "language", "stay_id", "stay_hash", "mark", "row", "mix_id", "mix_a", "shard", "page", "span", "carved", "host", "path", "rule", "verdict", "score", "Size", "fp", "k")


def docs(spark, rows=ROWS):
    return spark.createDataFrame(rows, COLUMNS)


def clashing(spark, rows=ROWS):
    df = docs(spark, rows)
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHING])


def save(spark, rows, folder, columns=COLUMNS, name="documents"):
    """A folder that queries can run on."""
    spark.createDataFrame(rows, columns).coalesce(2).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)
