import __spark_entry__ as entry


def test_registry(spark):
    q = entry.queries()
    assert set(entry.oracle_sql()) <= set(q)
    assert entry.entry(spark).count() > 0


def test_core_does_not_need_llm():
    import pathlib

    root = pathlib.Path(entry.__file__).parent / "loomstat"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "loomstat.llm" not in p.read_text()
