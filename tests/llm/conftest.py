import pytest

#: Columns that operators use inside; documents may carry them too.
CLASHING = "score fp batch key kind shard payload measured _kept least root count n label _label words train row_ _p _i ids start length offset spans base"


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Documents with nulls everywhere, empty and long texts, repeated rows and clashing columns; and the same with no rows."""
    long = "the quick brown fox jumps over a lazy dog near some river bank " * 3000
    plain = "It was a fine day in the old town and many people walked along the river until the sun went down behind hills."
    rows = [(1, plain, "en", "a", 5), (2, "", "en", "a", 0), (3, None, "en", None, None), (None, plain, None, "a", 5), (4, long, "en", "b", 9),
            (5, plain, "en", "a", 5), (5, plain, "en", "a", 5), (6, " \t\n ", None, None, 4), (7, "one", "de", "b", 3), (8, plain + " More.", "en", "a", 5)]
    extra = CLASHING.split()
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in extra)
    full = spark.createDataFrame([(*r, *["x"] * len(extra)) for r in rows], schema)
    return full, full.limit(0), rows


def same_ids(rows, column="doc_id"):
    return sorted((r[column] for r in rows), key=lambda v: (v is not None, v or 0))


ALL_IDS = [None, 1, 2, 3, 4, 5, 5, 6, 7, 8]
