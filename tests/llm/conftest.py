import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def tables(spark, tmp_path_factory):
    """Writes the given row lists as Parquet tables and returns their folder."""
    schemas = {"documents": DOC + ", ids string, score string", "benchmark": "item_id long, text string, spans string",
               "labels": "doc_id long, quality int, toxic int", "embeddings": "vec_id long, embedding array<float>, n_links string"}

    def write(**rows):
        d = str(tmp_path_factory.mktemp("t"))
        for name, data in rows.items():
            width = len(spark.createDataFrame([], schemas[name]).columns)
            full = [tuple(r) + (None,) * (width - len(r)) for r in data]
            spark.createDataFrame(full, schemas[name]).repartition(3).write.parquet(f"{d}/{name}.parquet")
        return d
    return write
