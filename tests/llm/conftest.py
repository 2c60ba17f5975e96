import pytest

pytest.importorskip("sluice.llm")
