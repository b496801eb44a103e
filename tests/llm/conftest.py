import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Columns whose names the operators use for their results or inside.
CLASHES = ["n_tokens", "fp", "score", "component_id", "fingerprint", "spans", "root", "id", "key", "lang_pred", "page", "shard", "n_bytes", "flac", "redacted"]

EN = "the cat and the dog went to the market with some of the other animals in the morning because they were hungry and wanted fish"
DE = "der hund und die katze gingen auf den markt mit einigen der anderen tiere weil sie hungrig waren und fisch wollten"


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in any column, empty, blank and very long texts, ties, repeated rows, clashing names."""
    from pyspark.sql import functions as F

    long = (EN + " number one. ") * 1500
    rows = [
        (0, None, "en", "src0", None),
        (1, "", "en", None, 0),
        (2, " \n\t ", None, "src0", 4),
        (3, EN, "en", "src0", len(EN)),
        (3, EN, "en", "src0", len(EN)),
        (4, EN, "en", "src1", len(EN)),
        (5, DE, "de", "src1", len(DE)),
        (6, DE + " " + EN, None, "src1", None),
        (7, long, "en", "src2", len(long)),
        (8, "a" * 70_000, "en", "src2", 70_000),
        (9, "12345 !!! ... 42", "de", "src2", 16),
        (10, 'mail an.x@mail3.example.com ip 10.0.0.1 card 4111 1111 1111 1111 tel +1 (555) 555-0100 token = "5f367f08b1a810c7777ad785b0be5f367f08b1a8"', "en", "app/.env", 90),
        (11, "日本語 é̂ 👍🏽 <|endoftext|>  x\x00y", "fr", "src3", 20),
        (None, "no id here at all but some text to look at", "en", "src3", 42),
        (None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({c: F.lit("x") for c in CLASHES}).repartition(3)


@pytest.fixture(scope="session")
def none(awkward):
    return awkward.limit(0)
