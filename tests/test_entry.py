import os
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["qid", "id", "score", "rank"] and df.count() > 0


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_rest_needs_neither_subpackage_nor_pipeline(tmp_path):
    """A copy without the training text operators still imports and registers its queries."""
    for p in ["gallerylens", "__spark_entry__.py"]:
        subprocess.run(["cp", "-r", str(ROOT / p), str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "gallerylens/llm")], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 120 and not any(k.startswith('op') or k == 'pipeline' for k in q); print('fine')"
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "HOME": "/tmp"}, capture_output=True, text=True)
    assert done.stdout.strip().endswith("fine"), done.stderr


def test_a_missing_library_takes_only_its_queries_away(tmp_path):
    """Without the vocabularies the other queries stand."""
    (tmp_path / "public_tokenizers.py").write_text("raise ImportError('hidden')")
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 120 and 'op1_simhash' not in q and 'pipeline' not in q; print('fine')"
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=ROOT, env={"PATH": "/usr/bin:/bin", "HOME": "/tmp", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert done.stdout.strip().endswith("fine"), done.stderr


def test_operators_run_from_another_folder(tmp_path):
    """Workers that start elsewhere get the package from the session."""
    code = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
from gallerylens.session import session
from gallerylens.operators import quantised
spark = session(cpus=1)
docs = spark.createDataFrame([(1, [[1.0, 2.0]]), (2, [[-1.0, 0.5]])], "id long, vs array<array<double>>")
print("found", quantised.codes(docs, 2).count())
"""
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, capture_output=True, text=True)
    assert "found 2" in done.stdout, done.stderr[-2000:]


def test_nothing_else_imports_the_subpackage():
    for p in (ROOT / "gallerylens").rglob("*.py"):
        if "llm" not in p.parts:
            assert "llm" not in p.read_text(), p
