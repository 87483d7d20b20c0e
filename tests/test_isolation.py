"""The library never leans on the training-data subpackage."""

import re
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_nothing_else_imports_it():
    for path in (ROOT / "vellum").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert not re.search(r"vellum\.llm|corpus_pipeline", path.read_text()), path
