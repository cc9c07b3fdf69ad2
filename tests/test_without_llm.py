"""The rest of the library works where the training-data subpackage and the pipeline are absent."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

from tests.conftest import ROOT


def test_entry_without_the_subpackage(tmp_path):
    for name in ("__spark_entry__.py", "motionspark"):
        source = os.path.join(ROOT, name)
        (shutil.copytree if os.path.isdir(source) else shutil.copy)(source, tmp_path / name)
    if os.path.isdir(tmp_path / "motionspark" / "llm"):
        os.rename(tmp_path / "motionspark" / "llm", tmp_path / "gone")
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and not any(x.startswith('op') for x in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True, timeout=60)


def test_nothing_else_imports_the_subpackage():
    for folder, _, names in os.walk(os.path.join(ROOT, "motionspark")):
        if "llm" not in folder.split(os.sep):
            for n in names:
                if n.endswith(".py"):
                    with open(os.path.join(folder, n)) as f:
                        assert "motionspark.llm" not in f.read()
