"""Feature and training reports."""

from types import SimpleNamespace

from stratus.plans import preprocess, training


def test_feature_report_lists_every_feature_in_its_group(spark):
    columns = ["Chuva", "temp", "hora", "estacao", "amplitude_termica", "radiacao_norm", "temp_lag_3h", "temp_rolling_mean_6h", "temp_rolling_std_6h", "odd.name", "flag_lag"]
    rows = [(1, 1.0, 3, "verao", None, 0.5, 1.0, 2.0, None, 1, 1), (0, None, 4, None, None, 0.5, 1.0, 2.0, 3.0, 1, 1)]
    df = spark.createDataFrame(rows, ", ".join(f"`{c}` {t}" for c, t in zip(columns, "int double int string double double double double double int int".split())))
    got = [(r.section, r.position, r["item"], r.value) for r in preprocess.feature_report(df).collect()]
    assert [g for g in got if g[0] == "summary"] == [("summary", 1, "n_rows", 2.0), ("summary", 2, "n_columns", 11.0), ("summary", 3, "rain_rate", 50.0)]
    assert {g for g in got if g[0] != "summary"} == {
        ("measure", 1, "flag_lag", 100.0), ("measure", 2, "odd.name", 100.0), ("measure", 3, "temp", 50.0), ("temporal", 1, "estacao", 50.0), ("temporal", 2, "hora", 100.0),
        ("weather", 1, "amplitude_termica", 0.0), ("weather", 2, "radiacao_norm", 100.0), ("lag", 1, "temp_lag_3h", 100.0),
        ("rolling", 1, "temp_rolling_mean_6h", 100.0), ("rolling", 2, "temp_rolling_std_6h", 50.0),
    }


def test_feature_report_without_rows_or_label(spark):
    got = {r["item"]: r.value for r in preprocess.feature_report(spark.createDataFrame([], "temp double")).collect()}
    assert got == {"n_rows": 0.0, "n_columns": 1.0, "temp": None}


def test_training_report_numbers_the_features(spark):
    report = spark.createDataFrame([("classification", "f1", 1.0)], "model string, metric string, value double")
    got = [tuple(r) for r in training.training_report(SimpleNamespace(features=["b", "a"]), report).collect()]
    assert got == [("classification", "f1", 1.0), ("features", "b", 1.0), ("features", "a", 2.0)]
    assert training.training_report(SimpleNamespace(features=[]), report).count() == 1
