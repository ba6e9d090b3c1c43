import pytest


@pytest.fixture
def docs_of(spark):
    """A documents table of (doc_id, text) rows, with the other columns filled in."""

    def make(rows):
        return spark.createDataFrame(
            [(i, t, "en", "src0", len(t) if t is not None else None) for i, t in rows],
            "doc_id long, text string, lang string, source string, n_chars long")

    return make


@pytest.fixture
def sf_dir_of(tmp_path):
    """Write tables given by name into a folder and return its path."""

    def make(**tables):
        for name, frame in tables.items():
            frame.write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return make
