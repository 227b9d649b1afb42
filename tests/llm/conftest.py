import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))


@pytest.fixture(scope="session")
def schema():
    return "doc_id bigint, text string, lang string, source string, n_chars bigint"
