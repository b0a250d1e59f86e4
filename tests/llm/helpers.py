import re

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
PLAIN = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text, pattern=WORD, lower=False):
    raw = (text or "").encode()
    return pattern.findall(raw.lower() if lower else raw)


def table(spark, rows, schema):
    """A table of several partitions, or an empty one."""
    df = spark.createDataFrame(rows, schema)
    return df.repartition(3) if rows else df
