"""Small tables with all that can be odd about rows: nulls, blanks, long texts, ties, repeats, clashing names."""

from pyspark.sql import functions as F

PROSE = "the quick brown fox jumps over the lazy dog while seven wizards quietly boxed up many extra jugs of liquid for the old king and his quiet court by the river near a green hill under pale morning light today again"
ODD = [(1, PROSE), (2, None), (3, ""), (4, " \n\t "), (5, "one"), (6, PROSE), (6, PROSE), (7, "x" * 50_000), (8, (PROSE + " ") * 300), (None, PROSE), (9, "Straße çédille 日本語 😀 ▁ \x00 end"), (1, "same id, another text altogether")]
CLASH = ["node", "pack", "part", "key", "count", "n", "c", "rank", "score", "spans", "body", "kept"]


def documents(spark, rows=ODD):
    """(doc_id, text, lang, source, n_chars) and columns whose names operators use inside."""
    df = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string")
    df = df.withColumns({"lang": F.lit("en"), "source": F.lit(None).cast("string"), "n_chars": F.length("text").cast("long")})
    return df.withColumns({c: F.lit(1) for c in CLASH})


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
