"""Nothing outside the subpackage llm imports it, but for the entry point, which can do without."""

import re
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_imports():
    own = [p for p in (ROOT / "weftlake").rglob("*.py") if "llm" not in p.relative_to(ROOT).parts]
    assert own
    for p in own:
        assert not re.search(r"^\s*(?:from|import)\s+\S*\bllm\b", p.read_text(), re.M), p
