def test_registered():
    import __spark_entry__ as e
    from sedimenta.llm.queries import QUERIES

    names = e.queries()
    assert [n for n in QUERIES if n in names] == list(QUERIES) and "pipeline" in names
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 14)]
