import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_works_without_the_corpus_operators():
    code = ("import sys; sys.modules['labelq.llm'] = None; sys.modules['corpus_pipeline'] = None\n"
            "import __spark_entry__ as e; q = e.queries(); assert 'aqi' in q and 'pipeline' not in q and not any(k.startswith('op') for k in q); assert set(e.oracle_sql()) <= set(q)")
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_nothing_else_imports_them():
    for folder, _, names in os.walk(os.path.join(ROOT, "labelq")):
        if os.sep + "llm" not in folder:
            for n in names:
                if n.endswith(".py"):
                    text = open(os.path.join(folder, n)).read()
                    assert "labelq.llm" not in text and "corpus_pipeline" not in text, n


def test_flagship(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.count() == 1 and {"aqi", "c", "m", "g"} <= set(df.columns)
