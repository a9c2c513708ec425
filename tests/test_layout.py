"""The core stands without the llm subpackage."""

import re
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_core_does_not_import_llm():
    for p in (ROOT / "barwise").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert not re.search(r"barwise\.llm|from \.+llm", p.read_text()), p


def test_no_local_checkpoint():
    for p in (ROOT / "barwise").rglob("*.py"):
        assert "localCheckpoint" not in p.read_text(), p


def test_no_machine_local_folder():
    for p in (ROOT / "barwise").rglob("*.py"):
        assert not re.search(r"\btempfile\b|mkdtemp", p.read_text()), p


def test_shared_folder_is_the_one_the_session_names(spark, monkeypatch):
    """Below spark.checkpoint.dir where it is set; without it a cluster is refused."""
    import pytest

    from barwise import session

    assert "/barwise-x-" in session.shared_folder(spark, "x")

    class Conf:
        def get(self, key, default=None):
            return "file:///shared/" if key == "spark.checkpoint.dir" and self.named else default

    class Cluster:
        sparkContext = type("C", (), {"master": "spark://host:7077", "_jvm": spark.sparkContext._jvm, "_jsc": spark.sparkContext._jsc})()  # noqa: N815
        conf = Conf()

    Conf.named = False
    with pytest.raises(RuntimeError):
        session.shared_folder(Cluster(), "x")
    Conf.named = True
    assert session.shared_folder(Cluster(), "x").startswith("file:///shared/barwise-x-")
