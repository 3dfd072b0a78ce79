import corpus_pipeline as P
from pyspark.sql import functions as F

from tallyroom.llm.tables import kept

SF = "/root/testdata/sf0.001"


def test_every_stage_takes_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    planted = spark.createDataFrame(
        [(9001, "мы не знаем этого языка и никогда его не учили " * 5), (9002, "12345 ..."), (9003, None), (9004, "The mail of the and there is one@two.example and with that it was here for the others"), (None, "on the with and that was of the in there for others to be")],
        "doc_id long, text string")
    copy = docs.where("length(text) > 300").orderBy("doc_id").limit(1).withColumn("doc_id", F.lit(9005).cast("long"))
    leak = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").limit(1).select(F.lit(9006).cast("long").alias("doc_id"), "text")
    rest = planted.unionByName(leak).withColumns({"lang": F.lit(None).cast("string"), "source": F.lit("x"), "n_chars": F.length("text").cast("long")})
    docs = docs.unionByName(rest).unionByName(copy)
    seen = {}
    for name, stage in P.STAGES:
        docs = kept(stage(spark, docs, SF), name)
        seen[name] = {r["doc_id"]: r["text"] for r in docs.collect()} if "text" in docs.columns else docs.count()
        if name != P.STAGES[-1][0]:
            assert docs.columns == columns
    first, second, third, fourth = (seen[n] for n, _ in P.STAGES[:4])
    assert not {9001, 9002, 9003} & set(first) and {9004, 9005, 9006, None} <= set(first)
    assert 9005 not in second and len(second) > 150
    assert 9006 not in third and 9004 in third
    assert "[EMAIL]" in fourth[9004] and fourth.keys() == third.keys()
    assert seen["bpe_codec"] == len(fourth)


def test_odd_rows_through_every_stage(spark):
    """Repeated rows and ids, several null ids, null and empty texts, clashing names; then no rows at all."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    a, b, c = (r["text"] for r in docs.where("lang = 'en' AND length(text) BETWEEN 400 AND 2000").orderBy("doc_id").limit(40).collect()[::15])
    rows = [(1, a), (2, a), (2, b), (None, b), (None, c), (3, None), (3, ""), (4, "  "), (4, c + " tail"), (4, c + " tail")]
    extra = "doc_id long, text string, lang string, source string, n_chars long, `row` int, _t int, node int, base int, hits int, mark string, own_id int"
    odd = spark.createDataFrame([(i, t, None, "x", 1, 1, 2, 3, 4, 5, "m", 6) for i, t in rows], extra)
    taught = docs.select(*docs.columns, *(F.lit(None).cast(odd.schema[k].dataType).alias(k) for k in odd.columns[5:])).where("doc_id > 100")
    one = P.known_languages(spark, taught.unionByName(odd), SF).where("source = 'x'")
    assert one.columns == odd.columns and sorted((r["doc_id"] or 0, r["text"]) for r in one.collect()) == sorted((i or 0, t) for i, t in rows if t and t.strip())
    two = kept(P.without_near_duplicates(spark, kept(one, "one"), SF), "two")
    assert two.columns == odd.columns and sorted((r["doc_id"], r["text"]) for r in two.distinct().collect()) == [(1, a), (2, b), (4, c + " tail")]
    three = P.decontaminated(spark, two, SF)
    four = P.without_personal_data(spark, three, SF)
    assert three.columns == four.columns == odd.columns and four.distinct().count() == 3
    assert {r["doc_id"] for r in P.encoded(spark, four, SF).collect()} == {1, 2, 4}
    none = docs.limit(0)
    for name, stage in P.STAGES:
        out = stage(spark, none, SF)
        assert out.count() == 0 and (name == P.STAGES[-1][0] or out.columns == none.columns)


def test_the_pipeline_on_the_small_tables(spark):
    out = P.run(spark, SF)
    assert out.columns == ["doc_id", "ids", "n_tokens", "ids_sha256", "decoded_sha256"] and 100 < out.count() <= 200
