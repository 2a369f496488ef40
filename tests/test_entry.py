import __spark_entry__ as entry


def test_catalogue_is_consistent():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_package_is_shipped_once_where_workers_lack_it(spark, monkeypatch, tmp_path):
    sent = []
    monkeypatch.setattr(type(spark.sparkContext), "addPyFile", lambda self, path: sent.append(path))
    monkeypatch.setattr(entry, "_SHIPPED", set())
    monkeypatch.setenv("PYTHONPATH", str(entry.HERE))
    entry._ship(spark)
    assert not sent
    monkeypatch.setenv("PYTHONPATH", "")
    monkeypatch.chdir(tmp_path)
    entry._ship(spark)
    entry._ship(spark)
    assert len(sent) == 1 and sent[0].endswith(".zip")


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["source1_entity_id", "matched_entity_ids"] and df.count() == 150
