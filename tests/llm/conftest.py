import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

DOC = "doc_id long, text string, lang string, source string, n_chars long, extra int, kept boolean"


@pytest.fixture(scope="session")
def documents(spark, tmp_path_factory):
    """Write rows of (doc_id, text[, lang]) as a table with a further column, and read it back."""
    made = 0

    def make(rows, parts=3):
        nonlocal made
        made += 1
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", None, 7, None) for r in rows]
        path = str(tmp_path_factory.mktemp("docs") / f"{made}")
        spark.createDataFrame(full, DOC).repartition(parts).write.parquet(path)
        return spark.read.parquet(path)

    return make
