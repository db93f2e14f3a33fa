import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[2]
if str(ROOT) not in sys.path:
    sys.path.insert(0, str(ROOT))


@pytest.fixture(autouse=True)
def reachable(spark):
    """Python workers find the package wherever the tests are started."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(ROOT))


@pytest.fixture(scope="session")
def vocabulary():
    import public_tokenizers

    return public_tokenizers.path


@pytest.fixture
def documents(spark):
    """Rows (doc_id, text[, source, lang]) as a table like `documents`, with columns whose names clash."""

    def make(rows, **extra):
        full = [(i, text, *(rest + ["en", "s"])[:2]) for i, text, *rest in ([*row] for row in rows)]
        df = spark.createDataFrame(full, "doc_id long, text string, lang string, source string")
        return df.selectExpr("*", "length(text) as n_chars", "1 as n", "2 as block", "'x' as size", "3 as score")

    return make
