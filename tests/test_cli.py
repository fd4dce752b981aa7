from lectern.__main__ import main


def test_commands(spark, sf, tmp_path, capsys):
    a, b = [r.module for r in spark.read.parquet(f"{sf}/verses.parquet").groupBy("module").count().orderBy("count", ascending=False).limit(2).collect()]
    main([sf, "editions"], spark)
    main([sf, "query", a, "--search", "a", "--page", "1"], spark)
    main([sf, "query", f"{a},{b}", "--reference", "1B 1"], spark)
    main([sf, "statistics", a, "1B 1:1-5"], spark)
    main([sf, "compare", a, b], spark)
    assert "total" in capsys.readouterr().out
    main([sf, "compare-all", a], spark)
    lines = capsys.readouterr().out.splitlines()
    from lectern.operators.stats import missing_from_default

    assert len(lines) - 1 == missing_from_default(spark.read.parquet(f"{sf}/verses.parquet"), a).count()  # every one, however many
    main([sf, "disable", a, str(tmp_path / "catalog")], spark)
    assert {r.enabled for r in spark.read.parquet(str(tmp_path / "catalog")).where(f"module = '{a}'").collect()} == {0}
    spark.createDataFrame([(a, "1", "x")], "module string, version string, meta_hash string").write.parquet(str(tmp_path / "made"))
    main([sf, "refresh", str(tmp_path / "made"), "1"], spark)
    assert f"{a}\tmetadata" in capsys.readouterr().out
    main([sf, "export", "module", a, "en", str(tmp_path / "out")], spark)
    assert spark.read.text(str(tmp_path / "out")).count() > 0
    path = tmp_path / "x.zip"
    import json
    import zipfile

    with zipfile.ZipFile(path, "w") as z:
        z.writestr("info.json", json.dumps({"delimiter": "|", "fields": ["book", "chapter", "verse", "text"]}))
        z.writestr("verses.txt", "# x\n1|1|1|a\n1|1|2|b\n")
    main([sf, "import", "module", str(path), "mine", str(tmp_path / "in")], spark)
    assert spark.read.parquet(str(tmp_path / "in")).where("module = 'mine'").count() == 2
