import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, members string, node long, digest string"


@pytest.fixture(scope="session")
def documents(spark):
    """A function that makes a documents table of (doc_id, text[, lang]) rows, with further columns of clashing names."""

    def make(rows, parts=3):
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, None, None, "x", 7, "y") for r in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(parts) if full else spark.createDataFrame([], SCHEMA)

    return make


#: Nulls in every column, empty and blank texts, one word, ties and repeated rows, a long text, odd characters.
ODD = [
    (1, None),
    (2, ""),
    (3, " \t\n "),
    (4, "Word"),
    (5, "same text here twice over and over again"),
    (5, "same text here twice over and over again"),
    (6, "same text here twice over and over again"),
    (None, "same text here twice over and over again"),
    (None, None),
    (7, "0123 !!! --- ..."),
    (8, "é ß 𝄞 ▁   \x00 end\r\nline two\n\n\nlast"),
    (9, "long words " * 30_000),
    (10, "x" * 5000),
]


@pytest.fixture(scope="session")
def odd():
    return ODD


#: The registered names: one query for each operator, and the pipeline.
NAMES = ["op1_substring_dedup", "op2_quality_classifier", "op3_packing", "op4_language_id", "op5_sentencepiece_sampling", "op6_document_fingerprints", "op7_minhash_near_dedup", "op8_nearest_neighbours", "op9_license_scans", "op10_lm_scoring", "pipeline"]
