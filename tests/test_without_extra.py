import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_the_rest_stands_without_the_subpackage(tmp_path):
    skip = shutil.ignore_patterns("llm", ".git", "__pycache__", ".pytest_cache")
    shutil.copytree(ROOT, tmp_path / "repo", ignore=skip)
    code = "import __spark_entry__ as e; from gleanline.plans import registry; assert set(e.queries()) == set(registry.QUERIES) and set(e.oracle_sql()) == set(registry.ORACLES); import gleanline; print(gleanline.__file__)"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", env={**os.environ, "PYTHONPATH": str(tmp_path / "repo")}, capture_output=True, text=True, timeout=120, check=False)
    assert done.returncode == 0 and str(tmp_path) in done.stdout, done.stderr


def test_nothing_outside_the_subpackage_names_it():
    for folder, _, names in os.walk(os.path.join(ROOT, "gleanline")):
        if os.path.basename(folder) != "llm":
            for name in names:
                if name.endswith(".py"):
                    text = open(os.path.join(folder, name)).read()
                    assert "gleanline.llm" not in text and "import llm" not in text, name
