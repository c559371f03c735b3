import ast
from pathlib import Path

import __spark_entry__ as entry


def test_entry_gives_five_folds(spark):
    assert entry.entry(spark).count() == 5


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_does_not_import_the_training_data_subpackage():
    root = Path(entry.__file__).parent / "quartzfold"
    for path in root.rglob("*.py"):
        if path.relative_to(root).parts[0] != "llm":
            for node in ast.walk(ast.parse(path.read_text())):
                names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
                assert not any("llm" in n for n in names)
