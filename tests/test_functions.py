from pyspark.sql import functions as F

from heliograph.functions import payloads, text, vectors
from heliograph.functions.aliases import Catalog


def one(spark, column, **values):
    cols = [F.lit(v).alias(k) if not isinstance(v, list) else F.array(*[F.lit(x) for x in v]).cast("array<string>").alias(k) for k, v in values.items()]
    return spark.range(1).select(*cols, F.lit(0).alias("_")).select(column.alias("x")).first()["x"]


def test_counts(spark):
    for said, want in (("至少三辆车的雨夜街景", ("车", 3, "gte")), ("最多十二只狗", ("狗", 12, "lte")), ("5 个人", ("人", 5, "eq")), ("二十张汽车", ("汽车", 20, "eq")), ("风景", (None, None, None))):
        assert tuple(one(spark, text.count_phrase(F.col("t")), t=said)) == want


def test_unique_strings(spark):
    assert one(spark, text.unique_strings(F.col("v")), v=["A b", " ab", "", "c", "C "]) == ["A b", "c"]
    assert one(spark, text.unique_strings(F.col("v")), v=["Ａ", "a", "ﬁ", "fi"]) == ["Ａ", "ﬁ"]
    assert one(spark, text.normalize(F.col("t")), t=" Ａb\tC ß\u3000") == "abcss"


def test_quotes_citations_intent(spark):
    assert one(spark, text.quoted_terms(F.col("t")), t="x “老王” y 'b c' \"d\"") == ["老王", "b c", "d"]
    assert one(spark, text.citations(F.col("t")), t="可见汽车[img_val-1] [img_val-1][img_b]") == ["val-1", "b"]
    assert one(spark, text.intent(F.col("t")), t="写成游记") == "story"
    assert one(spark, text.intent(F.col("t")), t="寻找夜晚街道") == "search"
    # noon lies in afternoon, so noon comes first
    assert one(spark, text.time_bucket(F.col("t")), t="in the Afternoon") == 2


def test_catalog(spark):
    c = Catalog()
    assert one(spark, c.find_excluded(F.col("t")), t="不要人物，寻找冷色调的雨夜城市") == ["人物"]
    assert one(spark, c.find(F.col("t"), "scene"), t="不要人物，寻找冷色调的雨夜城市") == ["城市"]
    assert one(spark, c.find_excluded(F.col("t")), t="无人机拍摄的城市") == []
    assert one(spark, c.remove_negative(F.col("t"), F.array(F.lit("人物"))), t="不要人物，找城市") == "找城市"
    # a one-letter alias must be the whole value
    assert not one(spark, c.matches(F.lit("人物"), F.col("v")), v=["无人机"])
    assert one(spark, c.matches(F.lit("人物"), F.col("v")), v=["行人"])


def test_vectors(spark):
    u = one(spark, vectors.l2_normalize(F.array(F.lit(3.0), F.lit(4.0))))
    assert [round(x, 6) for x in u] == [0.6, 0.8]
    assert one(spark, vectors.l2_normalize(F.array(F.lit(0.0), F.lit(0.0)))) is None


def test_payloads(spark):
    assert payloads.first_object('x {bad} {"a": 1} y') == {"a": 1}
    assert payloads.closed('{"s": 1, "ocr_text": ["A", "B", "cut') == {"s": 1, "ocr_text": ["A", "B"]}
    assert one(spark, payloads.as_list(F.col("j"), "a"), j='{"a": {"lighting": "back"}}') == ["lighting:back"]
    assert one(spark, payloads.as_list(F.col("j"), "a"), j='{"_a": ["x", "x", "y"]}') == ["x", "y"]
    assert not one(spark, payloads.strict(F.col("j")), j='{"a": NaN}')
