import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array

from sparktab.operators import features


@pytest.fixture(scope="module")
def df(spark):
    rows = [
        (1.0, 5.0, None, "b", True, 0),
        (2.0, 5.0, None, "a", False, 1),
        (None, 5.0, None, None, True, 0),
        (4.0, 5.0, None, "b", None, 1),
        (4.0, 5.0, None, "a", False, 1),
    ]
    return spark.createDataFrame(
        rows, "n double, flat double, empty double, s string, f boolean, target int"
    )


NAMES = ["n", "flat", "empty", "s", "f"]


def vectors(model, df):
    return [r[0] for r in model.transform(df).select(vector_to_array("features")).collect()]


def test_fills_and_slots(spark, df):
    model = features.build_encoder(df, NAMES, scale=False).fit(df)
    names = [n for _, n, _ in features.slot_table(model)]
    assert names == ["num__n", "num__flat", "cat__s_a", "cat__s_b", "cat__f_false", "cat__f_true"]
    assert model.stages[0].value("dropped") == ["empty"]
    assert vectors(model, df)[2] == [3.0, 5.0, 1.0, 0.0, 0.0, 1.0]
    new = spark.createDataFrame([(1.0, 5.0, 1.0, "zzz", True, 0)], df.schema)
    assert vectors(model, new)[0] == [1.0, 5.0, 0.0, 0.0, 0.0, 1.0]


def test_three_passes_equal_separate_stages(df):
    model = features.build_encoder(df, ["n", "flat"]).fit(df)
    filled = features.MedianModeImputer(numeric=["n", "flat"]).fit(df)
    scaler = features.PopulationScaler(columns=["num__n", "num__flat"]).fit(filled.transform(df))
    assert model.stages[1].value("means") == pytest.approx(scaler.value("means"))
    assert model.stages[1].value("scales") == pytest.approx(scaler.value("scales"))
    assert scaler.value("scales")["num__flat"] == 1.0


def test_saved_encoder_is_the_same(df, tmp_path):
    model = features.build_encoder(df, NAMES).fit(df)
    model.write().save(str(tmp_path / "encoder"))
    again = PipelineModel.load(str(tmp_path / "encoder"))
    assert vectors(again, df) == vectors(model, df)
    assert features.slot_table(again) == features.slot_table(model)


def test_time_columns_are_refused(spark):
    df = spark.sql("SELECT timestamp'2024-01-01' AS t, 1 AS target")
    with pytest.raises(ValueError, match="cannot be a feature"):
        features.build_encoder(df, ["t"])
