"""Lines masked a text at a time, against each line by itself."""

from pyspark.sql import functions as F

from tallyspark.llm import line_dedup as ld


def test_whole_texts_mask_as_lines_do(spark):
    texts = ["", " ", "\n", "a b\n\nc", " a", "a ", "a\n b", "a \nb", "a  b", "a\tb c d", "a\x0bb\x0cc\rd", "\n \n", "p 1 of 2\nq 3 of\n x 4  y z", "one 2 three", "é ü ö 7\n漢字 b c 9d e", "plain words only\nand more"]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "k int, text string")
    each = F.transform(F.split("text", "\n"), ld._masked)
    for r in df.select("text", ld._masked_text(F.col("text")).alias("got"), each.alias("want")).collect():
        assert r.got == r.want, repr(r.text)
