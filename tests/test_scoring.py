import hashlib

from pyspark.sql import functions as F

from pathwise.operators import scoring as S


def test_bands_at_boundaries(spark):
    vals = [0.0, 49.99, 50.0, 54.99, 55.0, 69.99, 70.0, 75.0, 100.0]
    df = spark.createDataFrame([(v,) for v in vals], "s double")
    out = df.select("s", S.risk_level("s").alias("r1"), S.risk_level("s", True).alias("r2"),
                    S.quiz_segment("s").alias("seg")).collect()
    got = {r.s: (r.r1, r.r2, r.seg) for r in out}
    assert got[49.99] == ("high", "high", "struggling")
    assert got[50.0][0] == "medium" and got[69.99][0] == "medium"
    assert got[70.0] == ("low", "medium", "mid")        # <=70 is medium only in the inclusive variant
    assert got[55.0][2] == "struggling" and got[75.0][2] == "mid" and got[100.0][2] == "fast"


def test_learner_class_and_difficulty_band(spark):
    df = spark.createDataFrame([(80.0, 70.0, 0), (80.0, 50.0, 0), (50.0, 90.0, 0), (45.5, 0.0, 0), (70.5, 0.0, 0)],
                               "p double, e double, o int")
    r = df.select(S.learner_class("p", "e").alias("c"), S.difficulty_label("p", "o").alias("d")).collect()
    assert [x.c for x in r[:3]] == ["Fast Learner", "Low Engagement", "Struggling Learner"]
    assert r[3].d == "Guided" and r[4].d == "Guided"    # gaps default to Guided


def test_ab_bucket_is_deterministic_and_matches_md5(spark):
    df = spark.createDataFrame([("user-123",), ("user-123",), ("u9",)], "u string")
    out = df.select(S.ab_bucket_number("u", "exp").alias("n"), S.ab_bucket("u", "exp", 50).alias("b")).collect()
    expect = int(hashlib.md5(b"exp:user-123").hexdigest()[:8], 16) % 100
    assert out[0].n == out[1].n == expect
    assert out[0].b == ("treatment" if expect < 50 else "control")


def test_hashed_vector_and_rewards(spark):
    df = spark.createDataFrame([("Linear Equations", "rating_submitted", 5), ("x", "recommendation_clicked", None),
                                ("y", "rating_submitted", None), ("z", "other", None)], "t string, e string, r int")
    out = df.select(S.hashed_vector("t").alias("v"), S.event_reward("e", "r").alias("rw"),
                    S.interaction_weight("e").alias("w")).collect()
    raw = hashlib.sha256(b"Linear Equations").digest()[:9]
    assert out[0].v == [b / 255.0 for b in raw]
    assert [x.rw for x in out] == [1.0, 1.0, 0.6, 0.0]
    assert [x.w for x in out] == [1.5, 2.0, 1.5, 1.0]


def test_explanation_and_weak_areas(spark):
    df = spark.createDataFrame([(50.0, 30.0, 7, 40.0, 50.0, 50.0, 50.0, "Algebra"),
                                (90.0, 90.0, 1, 90.0, 90.0, 90.0, 90.0, "Algebra")],
                               "p double, e double, n int, c double, q double, a double, s double, w string")
    out = df.select(S.explanation("p", "e", "n", "c").alias("x"),
                    F.array_join(S.weak_areas("q", "a", "s", "w"), "|").alias("wa")).collect()
    assert out[0].x == ("This student shows low predicted performance, low engagement, high attempts, "
                        "inconsistent performance.")
    assert out[1].x == "This student shows strong overall performance."
    assert out[0].wa == "Algebra|Attendance / Consistency|Assignment Completion" and out[1].wa == "None"
