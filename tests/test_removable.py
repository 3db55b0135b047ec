"""The rest of the package stands without the llm subpackage."""

import pathlib
import shutil
import subprocess
import sys

ROOT = pathlib.Path(__file__).parent.parent


def test_entry_without_llm(tmp_path):
    for x in ("newsloom", "__spark_entry__.py"):
        src = ROOT / x
        (shutil.copytree if src.is_dir() else shutil.copy)(src, tmp_path / x)
    shutil.rmtree(tmp_path / "newsloom/llm", ignore_errors=True)
    for f in (ROOT / "tests").glob("*.py"):
        (tmp_path / "tests").mkdir(exist_ok=True)
        shutil.copy(f, tmp_path / "tests")
    # Every test of the rest can be collected: no module of theirs needs the removed one.
    subprocess.run([sys.executable, "-m", "pytest", "tests", "--collect-only", "-q", "-p", "no:cacheprovider"], cwd=tmp_path, check=True, timeout=240, stdout=subprocess.DEVNULL)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'p4_found' in q and 'p1_found' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)


def test_nothing_imports_llm():
    name = "newsloom." + "llm"
    for f in (ROOT / "newsloom").rglob("*.py"):
        if "llm" not in f.relative_to(ROOT).parts:
            assert name not in f.read_text(), f
