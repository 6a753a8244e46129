from quillbit.operators.container import decompress_texts
from quillbit.streaming import compress_stream


def test_stream(spark, tmp_path):
    texts = [(i, f"line {i}\n" * 20) for i in range(12)]
    for part in range(3):
        spark.createDataFrame(texts[part::3], "id long, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, text string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = compress_stream(stream, "id", "text", str(tmp_path / "out"), str(tmp_path / "check"))
    query.awaitTermination(120)
    found = spark.read.parquet(str(tmp_path / "out"))
    assert found.select("batch").distinct().count() == 3
    assert sorted((r.id, r.text) for r in decompress_texts(found.select("id", "container")).collect()) == texts
