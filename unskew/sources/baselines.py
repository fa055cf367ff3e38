"""Published means of other models over complete KEEL folds, for ranking beside a run's own results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Model, mean F1, GMean, AUC, AUPRC; no runtimes were published.
MEANS = [
    ("imDEF", 0.826620, 0.785904, 0.924965, 0.757964),
    ("GLOS", 0.818394, 0.738539, 0.913981, 0.741400),
    ("SMOM", 0.816839, 0.739864, 0.914412, 0.737223),
    ("ILMNN", 0.819072, 0.761859, 0.910727, 0.733174),
    ("OREM-M", 0.817979, 0.742719, 0.913280, 0.731980),
    ("SHSampler", 0.805404, 0.804485, 0.915334, 0.730297),
    ("QC-SMOTE", 0.813756, 0.716018, 0.913969, 0.742386),
    ("MDO", 0.810412, 0.717436, 0.913575, 0.744960),
    ("SOUP", 0.814191, 0.752670, 0.913441, 0.731857),
    ("DBCF", 0.806212, 0.731196, 0.914624, 0.735421),
    ("NROMM", 0.816622, 0.729635, 0.911864, 0.736195),
    ("FRAME", 0.817877, 0.734125, 0.899494, 0.733334),
    ("MC-CCR", 0.812355, 0.709753, 0.910447, 0.742792),
    ("DEAHS", 0.755338, 0.846988, 0.911965, 0.725536),
    ("MC-RBO", 0.813466, 0.709309, 0.910173, 0.740252),
    ("SPE", 0.741054, 0.834540, 0.902776, 0.711464),
    ("EB-SMOTE", 0.796866, 0.675642, 0.907739, 0.726652),
    ("DualLexiBoost", 0.782815, 0.717674, 0.793031, 0.536187),
    ("Ours", 0.662080, 0.461101, 0.849311, 0.619209),
    ("LexiBoost", 0.681185, 0.617157, 0.806734, 0.474475),
    ("AdaBoostAD", 0.585638, 0.672716, 0.808345, 0.469757),
]


def baselines(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MEANS, "Model string, F1 double, GMean double, AUC double, AUPRC double")
