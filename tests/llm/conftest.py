import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def llm(tmp_path_factory):
    """The running session; a shared folder is set only where there is none."""
    spark = SparkSession.getActiveSession() or (
        SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


DOCS = "doc_id long, text string, lang string, source string, n_chars long, start long, uid string"


@pytest.fixture(scope="session")
def docs_of(llm):
    """Texts (or (doc_id, text, lang, source)) to a documents table with extra, clashing columns."""
    def make(rows):
        full = [r if isinstance(r, tuple) else (i, r, "en", f"src{i % 3}") for i, r in enumerate(rows)]
        return llm.createDataFrame([(*r, len(r[1] or ""), 5, "x") for r in full], DOCS)
    return make


@pytest.fixture(scope="session")
def corpus(llm):
    return llm.read.parquet("/root/testdata/sf0.001/documents.parquet")
