import __spark_entry__ as entry


def test_names_and_sql():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {"p2_found", "p5_found"} <= set(entry.queries())


def test_core_does_not_import_llm():
    from pathlib import Path

    root = Path(entry.__file__).parent / "verseframe"
    bad = [p for p in root.rglob("*.py") if "llm" not in p.parts and "verseframe.llm" in p.read_text()]
    assert not bad
