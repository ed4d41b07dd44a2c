"""The exit model is as good after it was stored, and better than the commonest label."""

from tickloom.ml.search import load_model, save_model, score_exit, train_exit


def test_exit_model_survives_storage(spark, tmp_path):
    rows = [(1.0, float(i % 20 - 10), float(i % 7), int(i % 20 > 12)) for i in range(400)]
    df = spark.createDataFrame(rows, "direction double, unrealized double, duration double, label int")
    model = train_exit(df, ["direction", "unrealized", "duration"], rounds=3, depth=2)
    save_model(model, str(tmp_path / "m"))
    save_model(model, str(tmp_path / "m"))
    before, after = (score_exit(m, df, 0.5).orderBy("unrealized", "duration").collect() for m in (model, load_model(str(tmp_path / "m"))))
    assert [r["p_close"] for r in before] == [r["p_close"] for r in after]
    assert all(r["close"] == bool(r["label"]) for r in after)
