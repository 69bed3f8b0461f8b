import subprocess
import sys

import __spark_entry__ as e


def test_entry(spark):
    out = e.entry(spark)
    assert out.columns == ["cluster_id", "size"] and out.count() == 7  # measured once by another engine


def test_names():
    assert set(e.oracle_sql()) <= set(e.queries())


def test_without_the_corpus_operators(tmp_path):
    """The entry works where the corpus folders and the pipeline are gone."""
    import os
    import shutil

    root = os.path.dirname(os.path.abspath(e.__file__))
    shutil.copytree(f"{root}/trackloom", tmp_path / "trackloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not [x for x in q if x.startswith('op') or x == 'pipeline']; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": ""})


def test_with_the_pipeline_file_but_without_the_folders(tmp_path):
    """Both folders are deleted and corpus_pipeline.py stays: the entry imports, a query and the other tests run."""
    import os
    import shutil

    root = os.path.dirname(os.path.abspath(e.__file__))
    for folder in ("trackloom", "tests"):
        shutil.copytree(f"{root}/{folder}", tmp_path / folder, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if os.path.exists(f"{root}/{name}"):
            shutil.copy(f"{root}/{name}", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not [x for x in q if x.startswith('op') or x == 'pipeline']"
    env = {**os.environ, "PYTHONPATH": ""}
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env=env)
    subprocess.run([sys.executable, "-B", "-m", "pytest", "-x", "-q", "-p", "no:cacheprovider", "tests/test_entry.py", "-k", "names or nothing"], cwd=tmp_path, check=True, env=env)


def test_nothing_else_imports_them():
    import pathlib

    root = pathlib.Path(e.__file__).parent
    for p in (root / "trackloom").rglob("*.py"):
        if "llm" not in p.parts:
            assert "llm" not in p.read_text(), p
