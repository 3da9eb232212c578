"""Runs that are killed, taken up, refused and damaged; fenced answers and helper flags."""

import pytest
from pyspark.sql import functions as F

from plumbline.sources import blocks, runs
from plumbline.sources.files import Refused


def length(df):
    return df.select("key", F.length("text").cast("string").alias("value"))


def turns(spark, n):
    return spark.createDataFrame([(f"k{i}", "x" * (i % 7) if i % 5 else None) for i in range(n)], "key string, text string")


def rows(df):
    return sorted(map(tuple, df.select("key", "value", "scorer").collect()))


def test_a_killed_run_ends_with_the_same_rows(spark, tmp_path):
    whole = runs.take_up(turns(spark, 60), str(tmp_path / "a"), "v1", length)

    def dies(df):
        return length(df).withColumn("value", F.when(F.col("key") == "k41", F.raise_error(F.lit("killed"))).otherwise(F.col("value")).cast("string"))

    path = str(tmp_path / "b")
    runs.take_up(turns(spark, 20), path, "v1", length)
    with pytest.raises(Exception, match="killed"):
        runs.take_up(turns(spark, 60), path, "v1", dies)
    # rows of a batch that never got its manifest
    spark.createDataFrame([("k30", "s", "999", "zz")], "key string, input_sha256 string, value string, batch string").write.parquet(f"{path}/batch-zz")
    assert len(rows(runs.completed(spark, path))) == 20
    scored = []
    again = runs.take_up(turns(spark, 60), path, "v1", lambda df: scored.append(df.count()) or length(df))
    assert rows(again) == rows(whole) and scored == [40]
    assert rows(runs.take_up(turns(spark, 60), path, "v1", None)) == rows(whole)  # nothing is left to score


def test_a_changed_scorer_is_refused(spark, tmp_path):
    path = str(tmp_path / "a")
    first = rows(runs.take_up(turns(spark, 20), path, "v1", length))
    same = runs.take_up(turns(spark, 20), path, "v2", length)
    assert rows(same) == first  # equal values stay as they were, under their scorer
    other = lambda df: df.select("key", F.when(F.col("key") == "k3", "7").otherwise(F.length("text").cast("string")).alias("value"))
    with pytest.raises(Refused, match="1 values would change"):
        runs.take_up(turns(spark, 20), path, "v3", other)
    assert rows(runs.completed(spark, path)) == first
    forced = rows(runs.take_up(turns(spark, 20), path, "v3", other, force=True))
    assert [r for r in forced if r not in first] == [("k3", "7", "v3")]


def test_changed_inputs_repeats_and_damage(spark, tmp_path):
    path = str(tmp_path / "a")
    runs.take_up(turns(spark, 5), path, "v1", length)
    with pytest.raises(Refused, match="inputs changed"):
        runs.take_up(turns(spark, 5).withColumn("text", F.lit("other")), path, "v1", length)
    with pytest.raises(Refused, match="repeats"):
        runs.take_up(turns(spark, 5).union(turns(spark, 1)), path, "v1", length)
    batch = runs.manifests(spark, path).first()["batch"]
    spark.createDataFrame([("k9", "s", "1", batch)], "key string, input_sha256 string, value string, batch string").write.mode("append").parquet(f"{path}/batch-{batch}")
    with pytest.raises(runs.Damaged):
        runs.completed(spark, path)


def test_no_inputs(spark, tmp_path):
    assert runs.take_up(turns(spark, 0), str(tmp_path / "a"), "v1", length).collect() == []


ANSWER = """Here:
orders/total.py

```python
TIER = "PLATINUM"
```
./orders/report.py
```
x = 1
```
orders/total.py
```python
TIER = "GOLD"
```
notes.txt
```
PLATINUM
```
"""


def test_blocks_and_sites(spark):
    df = spark.createDataFrame([(1, ANSWER), (2, None), (3, "no files")], "id long, text string")
    got = {r["id"]: r for r in blocks.site_coverage(blocks.file_blocks(df), ["orders/total.py", "orders/report.py"], "GOLD").collect()}
    assert got[1]["files"] == {"orders/total.py": 'TIER = "GOLD"\n', "orders/report.py": "x = 1\n"}
    assert (got[1]["sites_covered"], got[1]["missed_sites"], got[1]["oracle"]) == (1, ["orders/report.py"], False)
    assert (got[2]["files_returned"], got[2]["sites_covered"], got[3]["files_returned"]) == (0, 0, 0)


CODE = {
    "from billing.money import to_cents\ny = to_cents(x)": (True, False, False, False),
    "y = int(x * 100)": (False, False, True, False),
    "y = _to_cents(x)\nz = round(x)": (False, False, True, False),
    "import billing.money\ny = x * 100": (False, False, True, False),
    "def go(f):\n    for i in range(3):\n        try:\n            return f()\n        except E: pass": (False, False, False, True),
    "from billing.retry import retry\ndef go(f):\n    for i in a:\n        try: g()\n        except E: pass\n    return retry(f)": (False, True, False, False),
    "def retry(f):\n    while True:\n        try: return f()\n        except E: pass\nretry(g)": (False, False, False, False),
    "def (": (False, False, False, False),
}


def test_helper_use(spark):
    df = spark.createDataFrame([(c,) for c in CODE] + [(None,)], "text string")
    got = {r["text"]: tuple(r)[1:] for r in blocks.helper_use(df).collect()}
    assert got == {**CODE, None: (False, False, False, False)}
