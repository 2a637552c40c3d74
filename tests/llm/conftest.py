import pytest

from dialoom.sources.readers import table


@pytest.fixture
def folder(spark, tmp_path):
    """Writes small tables as name.parquet and gives the folder."""

    def write(**tables):
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    assert table
    return write
